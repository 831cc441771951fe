"""Hybrid BM25 + vector search (R4–R9) over a materialised corpus index.

Persisted once per input fingerprint (shared checkpoint folder):
* ``corpus``   – id, raw text, normalised text, token count, unit vector
* ``postings`` – term-sorted (term, id, tf, dl)
* ``terms``    – (term, df, idf)

A search reads them: the query's terms are broadcast onto the postings
(equi-join), the vector scores are one codegen'd pass over the corpus, each
retriever keeps its ``5·top_k`` best (TakeOrderedAndProject), and the
fusion works on at most ``10·top_k`` candidate rows (a bounded set, so the
min–max window over it is one small task). Text and metadata are attached
to the final ``top_k`` ids only.

Semantics: candidates are the union of both lists; a document present only
in the BM25 list gets vector score 0 (not its real score); each score is
min–max normalised over the candidates (range < 1e-9 → all 0);
``combined = α·vec + (1−α)·bm25``. Ties at every cut: score (9 digits) desc,
then id asc.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as TX
from ..functions import vectors as V
from ..session import materialize, written_once
from ..sources import fixtures as FX
from ..sources import tables as T
from . import bm25 as B


@dataclass
class Corpus:
    docs: DataFrame          # id, text, text_normalized, dl, vec
    index: B.BM25Index
    id_col: str
    meta: list[str] = field(default_factory=list)


def build_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Documents that have a vector (inner join), normalised, tokenised and indexed once."""
    inputs = [T.path(sf_dir, "documents"), T.path(sf_dir, "embeddings")]

    def _docs():
        d = FX.doc_vectors(spark, sf_dir)
        norm = TX.with_normalized_text(d, "text").select("doc_id", "text", "text_normalized",
                                                          V.l2_normalize("embedding").alias("vec"))
        return norm.withColumn("dl", F.size(TX.tokenize("text_normalized")).cast("long"))

    docs = materialize(spark, "corpus_docs", inputs, _docs)
    postings = materialize(
        spark, "corpus_postings", inputs,
        lambda: B.postings_from(docs.select("doc_id", TX.tokenize("text_normalized").alias("tokens")), "doc_id"),
        sort_within=["term"])
    stats = B.stats_from(docs.select("doc_id", "dl"))
    terms = materialize(spark, "corpus_terms", inputs,
                        lambda: B.terms_from(postings, stats.select("n_docs").scalar()))
    index = B.BM25Index(docs.select("doc_id", "dl"), postings, terms, stats, "doc_id")
    return Corpus(docs, index, "doc_id")


def corpus_of(df: DataFrame, id_col: str, text_col: str, vec_col: str, meta: list[str] | None = None, keep=None) -> Corpus:
    """R1/R7 over any table: rows with a vector, their normalised text, postings and terms, and the columns ``meta``
    that hits carry. ``keep(name, build, sort_within)`` stores the parts (default: computed where they are used)."""
    keep = keep or (lambda name, build, **how: build())
    meta = [c for c in (meta or []) if c not in (id_col, "text", "text_normalized", "dl", "vec")]

    def rows():
        have = TX.with_normalized_text(df.where(F.col(vec_col).isNotNull()), text_col, "__normalized")
        return have.select(id_col, F.col(text_col).alias("text"), F.col("__normalized").alias("text_normalized"), V.l2_normalize(vec_col).alias("vec"),
                           F.size(TX.tokenize("__normalized")).cast("long").alias("dl"), *meta)

    docs = keep("docs", rows)
    postings = keep("postings", lambda: B.postings_from(docs.select(id_col, TX.tokenize("text_normalized").alias("tokens")), id_col), sort_within=["term"])
    stats = B.stats_from(docs.select(id_col, "dl"))
    terms = keep("terms", lambda: B.terms_from(postings, stats.select("n_docs").scalar()))
    return Corpus(docs, B.BM25Index(docs.select(id_col, "dl"), postings, terms, stats, id_col), id_col, meta)


def query_text(spark: SparkSession, sf_dir: str, item_id: int = 0) -> DataFrame:
    return T.load(spark, sf_dir, "benchmark").where(F.col("item_id") == item_id).select("text")


def query_vec(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> Column:
    e = T.load(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).where(F.col("vec_id") == vec_id)
    from .vector_search import query_vector
    return V.l2_normalize(query_vector(e, "embedding"))


def _cut(df: DataFrame, score: str, id_col: str, k: int) -> DataFrame:
    return df.orderBy(F.round(F.col(score), 9).desc(), F.col(id_col).asc()).limit(k)


def candidates(corpus: Corpus, qterms: DataFrame, qvec: Column, top_k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The two candidate lists (vector, BM25) of size ``5·top_k`` each."""
    k = max(top_k * C.CANDIDATE_FACTOR, top_k)
    idc = corpus.id_col
    vec = corpus.docs.select(idc, V.dot(F.col("vec"), qvec).alias("vec_score"))
    vtop = _cut(vec, "vec_score", idc, k)
    bm = B.score_all(corpus.index, qterms)
    btop = _cut(bm, "bm25", idc, min(top_k * C.CANDIDATE_FACTOR, k))
    return vtop, btop, bm


def fuse(vtop: DataFrame, btop: DataFrame, bm: DataFrame, id_col: str, alpha: float) -> DataFrame:
    """R5/R6/R7 on the candidate set: union, zero-fill, min–max, α-mix."""
    ids = vtop.select(id_col).union(btop.select(id_col)).distinct()          # G1
    cand = (ids.join(bm, id_col)                                              # true BM25 for every candidate
               .join(vtop.select(id_col, "vec_score"), id_col, "left")
               .withColumn("vec_score", F.coalesce(F.col("vec_score"), F.lit(0.0))))
    return minmax(cand, ["vec_score", "bm25"], id_col) \
        .withColumn("score_combined", F.lit(alpha) * F.col("vec_score_n") + F.lit(1.0 - alpha) * F.col("bm25_n"))


def minmax(cand: DataFrame, cols: list[str], id_col: str) -> DataFrame:
    """(x − min) / (max − min) over the whole (bounded) candidate set; range < 1e-9 → 0."""
    w = Window.partitionBy()   # candidate set is at most 10·top_k rows
    out = cand
    for c in cols:
        mn, mx = F.min(c).over(w), F.max(c).over(w)
        out = out.withColumn(f"{c}_n", F.when(mx - mn < C.MINMAX_EPS, F.lit(0.0)).otherwise((F.col(c) - mn) / (mx - mn)))
    return out


def hybrid_search(corpus: Corpus, qterms: DataFrame, qvec: Column, top_k: int = C.DEFAULT_TOP_K,
                  alpha: float = C.DEFAULT_ALPHA) -> DataFrame:
    vtop, btop, bm = candidates(corpus, qterms, qvec, top_k)
    fused = fuse(vtop, btop, bm, corpus.id_col, alpha)
    best = _cut(fused, "score_combined", corpus.id_col, top_k)
    # Attach text to the final ids only (≤ top_k rows, bounded broadcast)
    meta = corpus.docs.select(corpus.id_col, "text")
    return (meta.join(F.broadcast(best), corpus.id_col)
                .select(corpus.id_col,
                        F.round("score_combined", 6).alias("score_combined"),
                        F.round("vec_score_n", 6).alias("score_vector"),
                        F.round("bm25_n", 6).alias("score_bm25"),
                        "text"))


def hybrid_hits(corpus: Corpus, qterms: DataFrame, qvec: Column, top_k: int = C.DEFAULT_TOP_K, alpha: float = C.DEFAULT_ALPHA) -> DataFrame:
    """The search with the whole hit (C8): scores, both texts and the corpus' metadata columns.

    The scored documents are written once, so the postings are read once, and documents that share no word with the
    query need no row of their own: their score is 0, and of them only as many lowest ids count as the cut has room for."""
    idc, k = corpus.id_col, top_k * C.CANDIDATE_FACTOR
    scored = written_once(B.score_terms(corpus.index, qterms), "bm25-hits")
    vtop = written_once(_cut(corpus.docs.select(idc, V.dot(F.col("vec"), V.l2_normalize(qvec)).alias("vec_score")), "vec_score", idc, k), "vector-hits")
    zero = _cut(corpus.docs.select(idc).join(scored.select(idc), idc, "left_anti").withColumn("bm25", F.lit(0.0)), "bm25", idc, k)
    btop = _cut(scored.unionByName(zero), "bm25", idc, k)
    ids = vtop.select(idc).union(btop.select(idc)).distinct()
    cand = (ids.join(scored, idc, "left").join(vtop, idc, "left").fillna(0.0, ["bm25", "vec_score"]))
    fused = minmax(cand, ["vec_score", "bm25"], idc).withColumn("score_combined", F.lit(alpha) * F.col("vec_score_n") + F.lit(1.0 - alpha) * F.col("bm25_n"))
    best = _cut(fused, "score_combined", idc, top_k)
    meta = corpus.docs.select(idc, "text", "text_normalized", *corpus.meta)
    return meta.join(F.broadcast(best), idc).select(idc, F.round("score_combined", 6).alias("score_combined"), F.round("vec_score_n", 6).alias("score_vector"),
                                                    F.round("bm25_n", 6).alias("score_bm25"), "text", "text_normalized", *corpus.meta)
