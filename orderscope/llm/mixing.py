"""Mixing sources to target weights by a low-discrepancy source schedule.

Slot i of the mix has the golden-ratio point frac((i + 1) / phi); the point, mapped through the
cumulative shares of the sources' slots, names the slot's source. The r-th slot of a source takes the
source's r-th block of ``MIN_BLOCK`` words, and starts over after the last. Blocks cut each source's
documents, in an order shuffled by a hash, into equal runs of words; their length does not depend on
the size of the table, the number of slots grows with it. A source is read at most ``max_epochs`` times.
The slots are the order of the mix: a document's ``first_slot`` is the one that reads its first words, and
``n_slots`` read any of it, so that every stretch of the mix holds every source by its share, up to a
few slots (the points' discrepancy grows with the logarithm of the stretch).

Every source, however small, takes its target rounded to whole words: its last slot ends at the target,
slots after that are not filled, and the few slots that the points leave out come after all others.

Null texts and texts without words have size 0 and are never taken; a null source is a source of its
own, last in order; equal rows are rows of their own. An empty table, or one without words, gives its
rows with taken 0. One row per source goes through the driver (weights and targets are per source).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK, numbered, table, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
MIN_BLOCK = 16
PHI = (5 ** 0.5 - 1) / 2
ROWS_PER_BUCKET = 50_000
MADE = ("size", "source_size", "target", "taken", "first_slot", "n_slots")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, epochs: int = MAX_EPOCHS) -> np.ndarray:
    """Words wanted of each source: weights' shares of ``share`` times all words; a target stops at
    ``epochs`` times its source, and what is over goes to the others by weight until none is above."""
    size, weight = np.array(sizes, float), np.array(weights, float)
    out, open_ = np.zeros(len(size)), np.ones(len(size), bool)
    left = share * size.sum()
    while open_.any():
        want = left * weight / weight[open_].sum()
        full = open_ & (want >= epochs * size)
        if not full.any():
            out[open_] = want[open_]
            break
        out[full] = epochs * size[full]
        left -= out[full].sum()
        open_ &= ~full
    return out


def word_count(text: str = "text"):
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BLANK, -1), "")).cast("long")


def quotas(wanted: np.ndarray, sizes: list[int], block_words: int,
           epochs: int = MAX_EPOCHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per source: its blocks, its slots, and the words that its last slot takes (0: the whole block)."""
    size = np.array(sizes, np.int64)
    words = np.minimum(np.round(wanted).astype(np.int64), epochs * size)
    blocks = np.maximum(-(-size // block_words), 1)
    whole, rest = np.divmod(words, np.maximum(size, 1))
    return blocks, whole * blocks + -(-rest // block_words), rest % block_words


def schedule(spark: SparkSession, slots: np.ndarray, blocks: np.ndarray) -> DataFrame:
    """One row per filled slot: slot, place (index of its source), turn (its rank among the source's
    slots), block, last (whether it is the source's last). Each place has ``slots[place]`` rows."""
    total = int(slots.sum())
    edges = np.cumsum(slots) / max(total, 1)
    last = int(np.flatnonzero(slots)[-1]) if total else 0

    def places(i):
        # frac((i + 1) * phi) from the two halves of i, so that it stays exact for large i
        hi, lo = (i + 1) // (1 << 20), (i + 1) % (1 << 20)
        point = (np.mod(hi * np.mod(PHI * (1 << 20), 1.0), 1.0) + np.mod(lo * PHI, 1.0)) % 1.0
        return np.minimum(np.searchsorted(edges, point, "right"), last).astype(np.int32)

    def name(batches):
        for b in batches:
            i = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places(i)), pa.array(i // ROWS_PER_BUCKET)], ["slot", "place", "bucket"])

    def count(batches):
        for b in batches:
            place, n = np.unique(places(b.column(0).to_numpy()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(n)], ["place", "n"])

    hit = np.zeros(len(slots), np.int64)
    for r in spark.range(total).mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        hit[r["place"]] = r["n"]
    short = np.maximum(slots - hit, 0)
    begin = total + np.cumsum(short) - short
    known = spark.createDataFrame(
        [(i, int(slots[i]), int(blocks[i]), int(hit[i]), int(begin[i]), total / int(slots[i])) for i in range(len(slots)) if slots[i]],
        "place int, __slots long, __blocks long, __hit long, __begin long, __ratio double")
    named = numbered(spark.range(total).mapInArrow(name, "slot long, place int, bucket long"), ["place"], "bucket", [F.col("slot")], "turn")
    # one row per source, made on the driver
    filled = named.drop("bucket").join(F.broadcast(known), "place").where("turn < __slots")
    late = (known.where("__hit < __slots").withColumn("turn", F.explode(F.expr("sequence(__hit, __slots - 1)")))
            .withColumn("slot", F.expr("__begin + turn - __hit")))
    columns = ["slot", "place", "turn", F.expr("turn % __blocks").alias("block"), F.expr("turn = __slots - 1").alias("last"),
               F.expr("slot - cast(floor(turn * __ratio) as bigint)").alias("delta")]
    return filled.select(*columns).unionByName(late.select(*columns))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
        key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` without the text, with size, source_size, target, taken, first_slot (null if nothing is taken) and n_slots.
    ``key`` and the text's digest make the shuffled order; equal rows are interchangeable. Columns of these names in
    ``docs`` are replaced."""
    spark = docs.sparkSession
    h = F.xxhash64(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))), F.lit(seed))
    docs = docs.drop(*[c for c in MADE if c not in (key, source, text)])
    sized = written(docs.withColumn("size", word_count(text)).withColumn("__h", h).drop(text), "mix-sizes")
    per = sized.groupBy(source).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    per.sort(key=lambda r: (r[source] is None, r[source] or ""))
    sizes = [int(r["s"]) for r in per]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(per))], share)
    block = MIN_BLOCK
    blocks, slots, ends = quotas(wanted, sizes, block)
    buckets = sum(r["n"] for r in per) // ROWS_PER_BUCKET + 1

    places = T.StructType([T.StructField("__source", sized.schema[source].dataType), T.StructField("__place", T.IntegerType()),
                           T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
                           T.StructField("__end", T.LongType())])
    known = spark.createDataFrame([(r[source], i, sizes[i], float(wanted[i]), int(ends[i])) for i, r in enumerate(per)], places)
    rows = (sized.join(known, F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
            .withColumn("__bucket", F.floor((F.col("__h").cast("double") / 2.0 ** 64 + 0.5) * buckets).cast("long")))
    rows = numbered(rows, ["__place"], "__bucket", [F.col("__h"), F.col(key)], "__from", value="size")
    rows = written(rows.drop("__bucket", "__h").withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    # blocks that a document touches, each with the words of the document in it
    touched = (rows.where("size > 0").select("__row", F.col("__place").alias("place"), "__from", "size", "__end")
               .select("__row", "place", F.explode(F.sequence(F.expr(f"__from div {block}"), F.expr(f"(__from + size - 1) div {block}"))).alias("block"),
                       "__end", F.greatest(F.lit(0), F.expr(f"__from - block * {block}")).alias("__a"),
                       F.least(F.lit(block), F.expr(f"__from + size - block * {block}")).alias("__b")))
    # the source's last slot stops after __end words of its block: it reads nothing of what lies behind
    # turns are numbered in the order of slots, so of several slots that read a block the first is not the source's last
    times = schedule(spark, slots, blocks).groupBy("place", "block").agg(
        F.count(F.lit(1)).cast("int").alias("times"), F.max("last").alias("last"),
        F.max(F.when(F.col("turn") == F.col("block"), F.col("delta"))).alias("delta"))  # small: slots lie near turn x ratio
    total = int(slots.sum())
    ratios = spark.createDataFrame([(i, total / int(n)) for i, n in enumerate(slots) if n], "place int, __ratio double")  # one row per source
    first = F.expr("delta + cast(floor(block * __ratio) as bigint)")
    cut = F.col("last") & (F.col("__end") > 0)
    unread = cut & (F.col("__a") >= F.col("__end"))
    words = F.expr("(__b - __a) * times") - F.when(cut, F.expr("__b - greatest(__a, least(__b, __end))")).otherwise(0)
    read = (touched.join(times, ["place", "block"]).join(F.broadcast(ratios), "place")
            .select("__row", words.alias("words"), (F.col("times") - unread.cast("int")).alias("reads"),
                    F.when(~(unread & (F.col("times") == 1)), first).alias("slot")))
    taken = read.groupBy("__row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.sum("reads").alias("n_slots"))
    return (rows.join(taken, "__row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
            .withColumn("n_slots", F.coalesce("n_slots", F.lit(0)).cast("long")).drop("__row", "__from", "__end", "__place"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")
