"""The corpus pipeline: five stages over ``documents``, each by one operator of orderscope.llm.

A stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame;
``run`` writes each stage's rows as Parquet and rereads them for the next. Rows with null ids or texts,
repeated rows and an empty table pass as the operators' docstrings say.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderscope.llm import decontaminate, mixing, ngram_jaccard, quality_classifier, sharding
from orderscope.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL cannot express the boosted trees; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (rows are judged where they stand, so no join is needed).
    The fit takes the statistics of its labelled rows only, bounded by its documented sample."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    sample = F.broadcast(quality_classifier.fit_labels(labels).select("doc_id"))  # at most MAX_FIT_ROWS ids
    fitted = docs.select("doc_id", "text").join(sample, "doc_id", "left_semi")
    forest = quality_classifier.fit(written(quality_classifier.statistics(fitted), "pipeline-stats"), labels)
    return quality_classifier.judged(docs.select(*COLUMNS), forest).where("predicted = 1").select(*COLUMNS)


def _row(docs: DataFrame) -> Column:
    """Id and text's digest as a string in the order of ids (whole numbers by value), nulls last."""
    name = F.col("doc_id").cast("string")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        name = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(Decimal(2 ** 63))).cast("string"), 20, "0")
    return F.concat(F.coalesce(F.concat(F.lit("0"), name), F.lit("1")), F.lit("\x01"), F.md5(F.coalesce("text", F.lit(""))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the least by id (nulls last), then by the text's digest. Texts without
    words all stay. Rows are told apart by id and digest, so repeated and null ids are rows of their own."""
    found = ngram_jaccard.near_duplicates(docs.select(_row(docs).alias("row"), "text"), key="row")
    keep = (found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__row"))
            .agg(F.count(F.lit(1)).alias("__n"), F.max("n_shingles").alias("__words")))
    rows = docs.select(*COLUMNS, _row(docs).alias("__row")).join(keep, "__row")
    # only rows of equal id and text are left to compare
    copies = (F.col("__n") > 1) & (F.col("__words") > 0)
    once, again = rows.where(~copies).select(*COLUMNS), rows.where(copies).dropDuplicates(["__row"]).select(*COLUMNS)
    return once.unionByName(again)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.where("__hits IS NULL").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears as often as the mix reads it: taken / size, rounded (0, 1 or 2 times)."""
    parts = mixing.mix(docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text"))
    times = (parts.where("taken * 2 >= size AND size > 0").groupBy("doc_id", "digest")
             .agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("times"))
             .select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "times"))
    rows = docs.select(*COLUMNS).withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    return (rows.join(times, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")))
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there."""
    return sharding.with_slots(sharding.place(docs.select(*COLUMNS))).select(*COLUMNS, "shard", "slot")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", clean),
          ("mixing sources", mixture), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
