"""Sharding by rendezvous hashing of record keys over weighted shards.

Every (key, shard) pair has a pseudo-random number u in (0, 1); a record goes to the shard with the
smallest -ln(u) / weight. Adding a shard can only win records for itself, so no record moves between
old shards. Law ``key``: the key and the shards decide, nothing else. A null key is replaced by a
digest of the text, so null-key rows spread too; rows with equal key share a shard, a repeated row is
placed as often as it occurs. A null text has 0 bytes. Everything is Spark SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table

SHARDS = 16
#: Rows that one numbering task sorts, about.
ROWS_PER_BUCKET = 20_000


def record_key(key: str, text: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def _number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def race(key: Column, weights: list[float]) -> list[Column]:
    """The record's time to each shard: exponential with the shard's weight as its rate."""
    def time(s: int, w: float) -> Column:
        u = (_number(F.md5(F.concat_ws(":", key, F.lit(str(s)))), 13).cast("double") + 0.5) / float(1 << 52)
        return F.struct((-F.log(u) / float(w)).alias("t"), F.lit(s).alias("s"))
    return [time(s, w) for s, w in enumerate(weights)]


def place(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None,
          grown_weight: float = 1.0) -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (with one more shard of ``grown_weight``)."""
    weights = weights or [1.0] * SHARDS
    return (docs.withColumn("__race", F.array(*race(record_key(key, text), [*weights, grown_weight])))
            .withColumn("shard", F.array_min(F.slice("__race", 1, len(weights))).getField("s"))
            .withColumn("grown_shard", F.array_min("__race").getField("s")).drop("__race"))


def with_slots(placed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... in every shard. Hash buckets of a shard are numbered apart and
    shifted by the sizes of the buckets before, so no task sorts a whole shard."""
    buckets = placed.count() // (SHARDS * ROWS_PER_BUCKET) + 1
    spread = F.md5(F.concat_ws("/", record_key(key, text), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = placed.withColumn("__spread", spread).withColumn("__bucket", _number(F.col("__spread"), 8) % buckets)
    return numbered(rows, ["shard"], "__bucket", [F.col("__spread")], "slot").drop("__bucket", "__spread")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (place(table(spark, sf_dir, "documents", "doc_id", "text"))
            .withColumn("size", (F.octet_length(text) + 1).cast("long")).withColumn("text_crc32", F.crc32(text))
            .withColumn("law", F.lit("key"))
            .withColumn("__digest", F.md5(text)))
    # the text itself is not shuffled: from here on its digest stands for it
    rows = rows.drop("text").withColumnRenamed("__digest", "text")
    return with_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
