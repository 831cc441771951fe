"""Benchmark decontamination by winnowing.

Of every ``GUARANTEE`` consecutive k-gram hashes the smallest is kept as a fingerprint, in documents
and benchmark items alike. Two equal spans of K + GUARANTEE - 1 = 10 words keep the same k-gram, so the
join of fingerprints misses no shared window of 10 words. A joined fingerprint is extended: the
10-word windows around it are compared with the items' windows, and their words are hit. Items with
fewer words than a window (too short for the guarantee) are matched whole, by their own length.

Null and empty texts have no words. Repeated document rows get equal results each, null ids too;
a null item id counts as an item without a name in the digest. An empty benchmark hits nothing.
Everything is Spark SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WINDOW = 10
K = 5
GUARANTEE = WINDOW - K + 1
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fingerprints and windows of a benchmark up to this many rows (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Tables of matches (one row per document with a match) up to this many bytes are broadcast.
BROADCAST_BYTES = 64 << 20


def word_hashes(text: str) -> Column:
    """Hashes of the words, with A-Z lower-cased and nothing else (lower() would change other letters too)."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.transform(F.array_remove(F.split(low, SPLIT, -1), ""), lambda w: F.xxhash64(w))


def gram_hashes(hashes: str, n: int) -> Column:
    at = ", ".join(f"get({hashes}, i + {j})" for j in range(n))
    return F.expr(f"CASE WHEN size({hashes}) >= {n} THEN transform(sequence(0, size({hashes}) - {n}), i -> xxhash64({at})) ELSE CAST(array() AS array<bigint>) END")


def winnow(grams: str) -> Column:
    """Distinct minima over every window of GUARANTEE k-grams."""
    at = ", ".join(f"get({grams}, i + {j})" for j in range(GUARANTEE))
    return F.expr(f"CASE WHEN size({grams}) >= {GUARANTEE} THEN array_distinct(transform(sequence(0, size({grams}) - {GUARANTEE}), i -> least({at}))) ELSE CAST(array() AS array<bigint>) END")


# Arrays are exploded with explode_outer: explode adds a filter on the array, which is pushed below the
# projections and evaluates every array expression again inside itself. Its extra null rows join nothing.


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sized_bytes(df: DataFrame, size: Column) -> DataFrame:
    """Broadcast a table of matches if its measured bytes are few; else it is joined by shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(size).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES else df


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per contaminated (key, text digest): starts and lengths of hit windows (``spans``) and ``items``."""
    items = benchmark.select("item_id", word_hashes("text").alias("h"))
    sizes = [r["n"] for r in items.select(F.size("h").alias("n")).where((F.col("n") > 0) & (F.col("n") < WINDOW)).distinct().collect()]
    long_items = items.where(F.size("h") >= WINDOW)
    windows = long_items.select("item_id", F.lit(WINDOW).alias("len"), F.explode_outer(gram_hashes("h", WINDOW)).alias("w"))
    for n in sizes:  # at most 9 lengths
        windows = windows.unionByName(items.where(F.size("h") == n).select("item_id", F.lit(n).alias("len"), F.explode_outer(gram_hashes("h", n)).alias("w")))
    windows = written(windows.distinct(), "op5-windows")
    prints = written(long_items.withColumn("g", gram_hashes("h", K)).select(F.explode_outer(winnow("g")).alias("fp")).distinct(), "op5-prints")

    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    name = ["__key", "__digest"]
    d = docs.select(F.col(key).alias("__key"), digest.alias("__digest"), word_hashes(text).alias("h"))
    found = (d.withColumn("g", gram_hashes("h", K)).select(*name, F.explode_outer(winnow("g")).alias("fp"))
             .join(_sized(prints), "fp").groupBy(*name).agg(F.collect_set("fp").alias("fps")))
    found = written(found, "op5-candidates").withColumnsRenamed({"__key": "__k", "__digest": "__d"})
    # extension of the joined fingerprints: windows that hold one, in the documents that have one
    near = (docs.select(F.col(key).alias("__key"), digest.alias("__digest"), F.col(text).alias("__text"))
            .join(_sized_bytes(found, F.size("fps") * 8 + 100), F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__digest") == F.col("__d")))
            .withColumn("h", word_hashes("__text")).withColumn("g", gram_hashes("h", K)).withColumn("w10", gram_hashes("h", WINDOW))
            .withColumn("at", F.expr("filter(transform(g, (x, i) -> CASE WHEN array_contains(fps, x) THEN i END), x -> x IS NOT NULL)"))
            .withColumn("starts", F.expr(f"array_distinct(flatten(transform(at, p -> sequence(greatest(p - {GUARANTEE - 1}, 0), least(p, size(h) - {WINDOW})))))")))
    tried = near.select(*name, F.lit(WINDOW).alias("len"), F.explode_outer("starts").alias("s"), "w10").select(
        *name, "len", "s", F.expr("get(w10, s)").alias("w"))
    for n in sizes:
        tried = tried.unionByName(d.select(*name, F.lit(n).alias("len"), F.posexplode_outer(gram_hashes("h", n)).alias("s", "w")))
    return (tried.join(_sized(windows), ["len", "w"]).groupBy(*name)
            .agg(F.sort_array(F.collect_set(F.struct("s", "len"))).alias("spans"),
                 F.sort_array(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items")))


def covered(spans: str) -> Column:
    """Words in the union of spans sorted by start."""
    return F.expr(f"""aggregate({spans}, struct(0L AS n, 0L AS stop), (a, x) -> struct(
        a.n + greatest(0L, CAST(x.s + x.len AS bigint) - greatest(a.stop, CAST(x.s AS bigint))) AS n,
        greatest(a.stop, CAST(x.s + x.len AS bigint)) AS stop)).n""")


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of ``docs`` with __hits (words hit) and __items; texts stay where they are unless many are hit."""
    found = written(hits(docs, benchmark, key, text).select("__key", "__digest", covered("spans").alias("__hits"), F.col("items").alias("__items")), "op5-hits")
    mine = docs.withColumn("__d", F.md5(F.coalesce(F.col(text), F.lit(""))))
    size = F.aggregate("__items", F.lit(100), lambda a, x: a + F.length(x) + 16)
    return mine.join(_sized_bytes(found, size), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__d") == F.col("__digest")), "left").drop("__key", "__digest", "__d")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = hits(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    found = found.select("__key", "__digest", covered("spans").alias("n_hit"), "items")
    words = F.size(F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), ANY_CASE, -1), ""))
    rows = docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"), words.cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return (rows.join(found, F.col("doc_id").eqNullSafe(F.col("__key")) & (F.col("digest") == F.col("__digest")), "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                    F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


SQL = """
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM iw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
cand AS (SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, lens WHERE len(ws) >= n)),
hit AS MATERIALIZED (SELECT rid, i, cand.n, item FROM cand JOIN win ON cand.n = win.n AND cand.k = win.k),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""
