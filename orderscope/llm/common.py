"""Shared helpers of the subpackage: reading tables, tables written to the shared folder, sizes."""

from __future__ import annotations

import atexit
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.session import shared_dir

BLANK = r"[\x20\x09-\x0D]+"

_runs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage cut that survives a lost
    executor. The session's folder of such tables is deleted when the driver ends."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = shared_dir(spark, "llm", f"run-{uuid.uuid4().hex}")
        atexit.register(_drop, spark, app)
    path = f"{_runs[app]}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, app: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has been stopped already
        return
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_runs.pop(app))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: sizes the number of chunks from the data."""
    return int(docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0)


def trimmed() -> None:
    """Give freed memory back to the system: Python workers live on after a task, and an executor holds several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def numbered(df: DataFrame, group: list[str], bucket: str, order: list, name: str,
             value: str | None = None) -> DataFrame:
    """Gapless number from 0 (or, with ``value``, the sum of that column over earlier rows) of each
    row in its group, without one task per group: rows are numbered inside (group, bucket) and
    shifted by the totals of the group's lower buckets (one row per group and bucket)."""
    from pyspark.sql import Window as W

    inside = W.partitionBy(*group, bucket).orderBy(*order)
    one = F.col(value) if value else F.lit(1)
    totals = df.groupBy(*group, bucket).agg(F.sum(one).cast("long").alias("__total"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select(*[F.col(c).alias(f"__{c}") for c in [*group, bucket]],
                          F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__shift"))
    if value:
        own = F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(value)
    else:
        own = F.row_number().over(inside) - 1
    same = F.lit(True)
    for c in [*group, bucket]:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return (df.withColumn(name, own).join(shift, same)
            .withColumn(name, (F.col(name) + F.col("__shift")).cast("long"))
            .drop("__shift", *[f"__{c}" for c in [*group, bucket]]))
