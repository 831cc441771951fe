"""Comparing answers with expected values, a row each.

The answer is the named column of its row; where that is null, the row's first numeric value that is not. If the
expected value or the answer is text or a date, their spellings must be equal; numbers may differ by an absolute
or a relative tolerance, and NaN equals nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C


def _spelled(df: DataFrame, c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss") if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(c).cast("string")


def compared(df: DataFrame, expected: str, column: str, row: list[str]) -> DataFrame:
    """``df`` with ``ok`` and ``reason``; ``row`` names the answer's columns in their order."""
    def numeric(c):
        return isinstance(df.schema[c].dataType, T.NumericType)

    rest = [F.col(c).cast("double") for c in row if c != column and numeric(c)]
    by_text = not numeric(expected) or column in row and not numeric(column)
    fallback = F.coalesce(*rest) if rest else F.lit(None).cast("double")
    if column in row and not numeric(column):
        value = F.coalesce(_spelled(df, column), fallback.cast("string"))
    else:
        value = F.coalesce(F.col(column).cast("double"), fallback) if column in row else fallback
    missing = value.isNull()
    if by_text:
        ok = _spelled(df, expected) == value.cast("string")
    else:
        diff = F.abs(value - F.col(expected).cast("double"))
        ok = ((diff <= C.COMPARE_ABS_TOL) | (diff <= F.abs(F.col(expected).cast("double")) * C.COMPARE_REL_TOL)) & ~F.isnan(diff)
    return df.withColumn("ok", F.coalesce(ok, F.lit(False)) & ~missing).withColumn(
        "reason", F.when(missing, F.lit("no value")).when(F.col(expected).isNull(), F.lit("nothing expected")).otherwise(F.lit("compared as text" if by_text else "compared as numbers")))
