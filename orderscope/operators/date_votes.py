"""Lenient date coercion with the spelling inferred per column.

Every value of a column is tried under every candidate spelling in one aggregate. Spellings that cannot be
mistaken for each other are all accepted; of those that can (day or month first), the one that reads more of
the column's values does — with equal votes the first listed — and the other is not tried at all. Then
each value is parsed once; what no accepted spelling reads becomes NULL and is counted as rejected. Blank and
null values are neither parsed nor rejected. A time part is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> (shape of the text, pattern of the date in it)
PLAIN = {
    "iso": (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    "slashed year first": (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    "digits": (r"^\d{8}$", "yyyyMMdd"),
    "month name": (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    "full month name": (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    "dotted": (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
}
#: Families whose members read the same texts: only the winner of a column's vote counts.
RIVALS = {
    "slashed": {"day first": (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), "month first": (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy")},
    "dashed": {"day first": (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), "month first": (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy")},
}
_TIME = r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"


def _text(c: str) -> Column:
    return F.regexp_replace(F.trim(F.col(c).cast("string")), _TIME, "")


def _read(c: str, shape: str, pattern: str) -> Column:
    t = _text(c)
    return F.when(t.rlike(shape), F.try_to_date(t, pattern))


def votes(df: DataFrame, columns: list[str]) -> dict[str, dict[str, str]]:
    """Per column and family of rivals, the spelling that reads most values (one pass over the table)."""
    aggs = [F.count(_read(c, *how)).alias(f"{i}|{family}|{name}") for i, c in enumerate(columns) for family, members in RIVALS.items() for name, how in members.items()]
    row = df.agg(*aggs).first().asDict() if aggs else {}
    return {c: {family: max(members, key=lambda name: (row[f"{i}|{family}|{name}"], -list(members).index(name))) for family, members in RIVALS.items()}
            for i, c in enumerate(columns)}


def coerce_dates(df: DataFrame, columns: list[str], suffix: str = "_rejected") -> DataFrame:
    """``df`` with each of ``columns`` as a date, and a flag column (name + ``suffix``) for values that nothing read."""
    columns = [c for c in columns if c in df.columns]
    won = votes(df, columns)
    out = {}
    for c in columns:
        accepted = [*PLAIN.values(), *[RIVALS[family][name] for family, name in won[c].items()]]
        out[c] = F.coalesce(*[_read(c, *how) for how in accepted])
    flags = {c + suffix: (F.length(F.trim(F.col(c).cast("string"))) > 0) & out[c].isNull() for c in columns}
    keep = [F.coalesce(flags[c + suffix], F.lit(False)).alias(c + suffix) for c in columns]
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns], *keep)


def rejected(df: DataFrame, columns: list[str], suffix: str = "_rejected") -> DataFrame:
    """(column_name, rejected) counts of a coerced frame."""
    counts = df.agg(*[F.count_if(F.col(c + suffix)).alias(c) for c in columns])
    return counts.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("column_name", "rejected"))
