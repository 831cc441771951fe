"""Many-query exact top-k in pairs of blocks (R9), and an inverted-file index that reads probed lists only.

Block pairs: queries and corpus are dealt into blocks sized from their bytes. A query stands in one block and
is sent to every corpus block, a corpus vector is sent to every query block (one, unless the queries are
larger than QUERY_BLOCK). A pair of blocks is one group: a matrix product in slices with a running top-k per
query, so a group gives at most k rows per query whatever it holds. Nothing passes through the driver but
two sizes.

Index: k-means on a bounded sample gives the lists, all vectors are written by list. A search finds the lists of
its queries and puts their numbers into the scan as partition filters, so lists that no query probes are not
read. Lists are split by their measured size. ``calibrated_probes`` finds the number of lists to probe that reaches a
recall, on a stated set of queries, by comparison with the exact answer.

Order of hits: score rounded to 9 digits, then id. Vectors are scored at unit length (zero vectors score 0); rows
without a vector are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import shared_dir, written_once
from .topk import topk_per_group

#: Bytes of vectors (as doubles) in a block of queries and in a block of the corpus.
QUERY_BLOCK, CORPUS_BLOCK = 16 << 20, 64 << 20
#: Vectors scored against a block of queries at a time.
SLICE = 4096
#: Queries scored at a time.
QUERY_SLICE = 1024
#: Vectors that k-means is fitted on, at most.
FIT_ROWS = 100_000


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _matrix(column) -> np.ndarray:
    return _unit(np.stack([np.asarray(v, np.float64) for v in column]))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of each row's k best, in order."""
    rounded = np.round(scores, 9)
    if scores.shape[1] > 4 * k:
        edge = -np.partition(-rounded, k - 1, axis=1)[:, k - 1: k]
        return [np.flatnonzero(r >= e)[np.lexsort((ids[r >= e], -r[r >= e]))[:k]] for r, e in zip(rounded, edge)]
    return [np.lexsort((ids, -r))[:k] for r in rounded]


def _topk(queries: pd.DataFrame, corpus: pd.DataFrame, k: int, qid: str, qvec: str, id_col: str, vec_col: str) -> pd.DataFrame:
    """Each query's k best; at most QUERY_SLICE x SLICE scores at a time, however many queries there are."""
    if not len(queries) or not len(corpus):
        return pd.DataFrame({qid: np.zeros(0, np.int64), id_col: np.zeros(0, np.int64), "score": np.zeros(0)})
    return pd.concat([_topk_slice(queries.iloc[lo: lo + QUERY_SLICE], corpus, k, qid, qvec, id_col, vec_col) for lo in range(0, len(queries), QUERY_SLICE)], ignore_index=True)


def _topk_slice(queries: pd.DataFrame, corpus: pd.DataFrame, k: int, qid: str, qvec: str, id_col: str, vec_col: str) -> pd.DataFrame:
    q, found = _matrix(queries[qvec]), [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
    for lo in range(0, len(corpus), SLICE):
        part = corpus.iloc[lo: lo + SLICE]
        ids, s = part[id_col].to_numpy(), q @ _matrix(part[vec_col]).T
        for i, cols in enumerate(_best(s, ids, k)):
            both, score = np.r_[found[i][0], ids[cols]], np.r_[found[i][1], s[i][cols]]
            order = np.lexsort((both, -np.round(score, 9)))[:k]
            found[i] = both[order], score[order]
    n = [len(f[0]) for f in found]
    return pd.DataFrame({qid: np.repeat(queries[qid].to_numpy(), n), id_col: np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})


def _bytes(df: DataFrame, vec: str) -> int:
    return int(df.agg(F.sum(F.size(vec).cast("long"))).first()[0] or 0) * 8


def block_pair_topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", vec_col: str = "embedding", qid: str = "query_id",
                    qvec: str = "embedding") -> DataFrame:
    """Exact cosine top-k of every query: (qid, id, score, rank)."""
    queries = queries.select(qid, F.col(qvec).alias("__q")).where(F.col("__q").isNotNull())
    corpus = corpus.select(id_col, F.col(vec_col).alias("__d")).where(F.col("__d").isNotNull())
    n_q, n_d = _bytes(queries, "__q") // QUERY_BLOCK + 1, _bytes(corpus, "__d") // CORPUS_BLOCK + 1
    n_d = max(n_d, queries.sparkSession.sparkContext.defaultParallelism)
    q = queries.select("*", F.pmod(F.xxhash64(qid), F.lit(n_q)).cast("int").alias("__i"), F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))).alias("__j"))
    d = corpus.select("*", F.pmod(F.xxhash64(id_col), F.lit(n_d)).cast("int").alias("__j"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("__i"))

    def score(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        return _topk(qs, ds, k, qid, "__q", id_col, "__d")

    found = q.groupBy("__i", "__j").cogroup(d.groupBy("__i", "__j")).applyInPandas(score, f"{qid} long, {id_col} long, score double")
    return topk_per_group(found, [qid], "score", id_col, k)


# --------------------------------------------------------------------------- inverted file

@dataclass
class InvertedFile:
    vectors: DataFrame      # list_id (partition column), id, vector
    centroids: np.ndarray   # one unit row per list
    sizes: dict             # list -> vectors
    id_col: str
    vec_col: str


def lists_for(kind: str, dim: int) -> int | None:
    """Lists of the table's index, or None where its vectors are too long for one (exact search then)."""
    if dim > C.IVF_MAX_DIM:
        return None
    return {"orders": C.IVF_LISTS_ORDERS, "commesse": C.IVF_LISTS_COMMESSE}[kind]


def build(corpus: DataFrame, lists: int, id_col: str = "doc_id", vec_col: str = "embedding", seed: int = 1, fit_rows: int = FIT_ROWS) -> InvertedFile:
    """Lists by k-means (cosine) on at most ``fit_rows`` vectors, chosen by hash; every vector is assigned."""
    spark = corpus.sparkSession
    rows = corpus.select(id_col, vec_col).where(F.col(vec_col).isNotNull())
    n = rows.count()
    if not n:
        raise ValueError("no vectors to index")
    kept = rows if n <= fit_rows else rows.where(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))
    model = KMeans(k=max(2, min(lists, n)), featuresCol="__f", predictionCol="list_id", distanceMeasure="cosine", seed=seed, maxIter=10).fit(
        kept.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("__f")).where(F.aggregate(F.col(vec_col).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x) > 0))
    centroids = _unit(np.array(model.clusterCenters(), dtype=np.float64))
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for b in batches:
            if len(b):
                yield b.assign(list_id=(_matrix(b[vec_col]) @ sent.value.T).argmax(1).astype(np.int32))

    kind = rows.schema[vec_col].dataType.simpleString()
    path = shared_dir(spark, "ivf", "index-" + uuid.uuid4().hex)
    rows.mapInPandas(assign, f"{id_col} long, {vec_col} {kind}, list_id int").write.partitionBy("list_id").parquet(path)
    vectors = spark.read.parquet(path)
    return InvertedFile(vectors, centroids, {r["list_id"]: r["count"] for r in vectors.groupBy("list_id").count().collect()}, id_col, vec_col)


def search(index: InvertedFile, queries: DataFrame, k: int, nprobe: int, qid: str = "query_id", qvec: str = "embedding", split_rows: int = 50_000,
           where=None) -> DataFrame:
    """Top-k inside the ``nprobe`` lists next to each query: (qid, id, score, rank). ``where`` is a filter on ids
    and what else the index's rows carry."""
    sent, id_col = queries.sparkSession.sparkContext.broadcast(index.centroids), index.id_col

    def probe(batches):
        for b in batches:
            if len(b):
                top = np.argsort(-(_matrix(b["__q"]) @ sent.value.T), axis=1, kind="stable")[:, :nprobe]
                yield pd.DataFrame({qid: np.repeat(b[qid].to_numpy(), top.shape[1]), "__q": np.repeat(b["__q"].to_numpy(), top.shape[1]), "list_id": top.reshape(-1).astype(np.int32)})

    q = queries.select(qid, F.col(qvec).cast("array<double>").alias("__q")).where(F.col("__q").isNotNull())
    probes = written_once(q.mapInPandas(probe, f"{qid} long, __q array<double>, list_id int"), "ivf-probes")
    asked = {r["list_id"]: r["count"] for r in probes.groupBy("list_id").count().collect()}  # at most as many as there are lists
    lists = sorted(asked)
    # queries of a list are dealt into blocks of about QUERY_BLOCK bytes
    blocks = max(asked.values(), default=0) * (_bytes(probes, "__q") // max(1, sum(asked.values()))) // QUERY_BLOCK + 1
    cut = {i: -(-index.sizes.get(i, 0) // split_rows) for i in lists}
    pieces = F.coalesce(F.create_map(*[F.lit(x) for i in lists for x in (i, max(1, cut[i]))])[F.col("list_id")], F.lit(1)) if lists else F.lit(1)
    vectors = index.vectors.where(F.col("list_id").isin(lists))
    if where is not None:
        vectors = vectors.where(where)
    d = vectors.select("list_id", index.id_col, F.col(index.vec_col).alias("__d"), F.pmod(F.xxhash64(index.id_col), pieces).cast("int").alias("__sub"),
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
    p = probes.withColumn("__sub", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn("__block", F.pmod(F.xxhash64(qid), F.lit(blocks)).cast("int"))

    def score(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        return _topk(qs, ds, k, qid, "__q", id_col, "__d")

    found = p.groupBy("list_id", "__sub", "__block").cogroup(d.groupBy("list_id", "__sub", "__block")).applyInPandas(score, f"{qid} long, {index.id_col} long, score double")
    return topk_per_group(found, [qid], "score", index.id_col, k)


def calibrated_probes(index: InvertedFile, queries: DataFrame, exact: DataFrame, k: int, recall: float = 0.9, qid: str = "query_id", qvec: str = "embedding") -> tuple[int, float]:
    """(nprobe, recall): the least power of two of lists, or all, with at least that share of the exact hits."""
    total, nprobe = exact.count(), 1
    while True:
        got = search(index, queries, k, nprobe, qid, qvec).join(exact.select(qid, index.id_col), [qid, index.id_col], "left_semi").count()
        if got >= recall * total or nprobe >= len(index.centroids):
            return nprobe, got / max(1, total)
        nprobe = min(2 * nprobe, len(index.centroids))
