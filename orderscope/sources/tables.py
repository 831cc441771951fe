"""Reading the input tables.

Each table is one parquet path under ``sf_dir``. Reads name the needed
columns so the scan's ReadSchema is pruned even before Catalyst sees the
projection above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

def path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(path(sf_dir, name))
    return df.select(*columns) if columns else df


#: Rows of a shuffled partition, about: its sort stays in memory.
PARTITION_ROWS = 250_000


def partitions_for(df: DataFrame) -> int:
    """Partitions of a shuffle of ``df``: they grow with its rows (a stored table's count reads footers only)."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PARTITION_ROWS))


def load_balanced(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read a table whose scan has fewer splits than task slots (e.g. one large row group of
    long texts) from a copy written once, spread over the slots, in the shared folder.

    A shuffle inside the query would not help: the optimizer pushes filters
    on per-row results below a repartition, back into the narrow scan.
    """
    from ..session import materialize
    df = load(spark, sf_dir, name)
    slots = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        df = materialize(spark, f"{name}-balanced{slots}", [path(sf_dir, name)], lambda: df.repartition(slots))
    return df.select(*columns) if columns else df
