"""Registration: retrieval over whole tables — bounded BM25, mentions, block-pair search, the inverted file and
hybrid search over any table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as TX
from ..functions import vectors as V
from ..operators import bm25 as B
from ..operators import bm25_topk as BT
from ..operators import filters as FL
from ..operators import hybrid as H
from ..operators import mentions as M
from ..operators import topk as TK
from ..operators import vector_blocks as VB
from ..session import in_rounds, materialize, written_once
from ..sources import fixtures as FX
from ..sources import tables as T
from . import extra as X
from . import oracle_text as O

#: Words of the documents whose postings one range partition orders, about.
WORDS_PER_PART = 2_000_000
QUERIES_50 = "record_id % 50 = 0"  # the stated query set: every id divisible by 50, against all rows


def orders_all(spark, sf):
    """Every order, with a vector where there is one (order grain)."""
    inputs = [T.path(sf, t) for t in ("embeddings", "orders", "customer", "nation", "region")]
    return materialize(spark, "orders_all", inputs, lambda: FX.build_order_vectors(spark, sf, how="right"), sort_within=["record_id"])


ORDERS_ALL_SQL = FX.ORDER_VECTORS_SQL.replace("FROM embeddings e\nJOIN orders o ON", "FROM embeddings e\nRIGHT JOIN orders o ON")


def documents_index(spark, sf) -> tuple[B.BM25Index, BT.ImpactIndex]:
    """BM25 over every document, vector or not: lengths, postings and terms, and the postings by impact. One stored table,
    ordered by term and level, holds the postings with their impacts; the partitions that order it grow with the words."""
    inputs = [T.path(sf, "documents")]
    # texts are put in order before they are split: their words take several times the room
    docs = materialize(spark, "bm25_documents", inputs,
                       lambda: TX.with_normalized_whole(X._docs(spark, sf).sortWithinPartitions("doc_id"), "text")
                       .select("doc_id", TX.tokenize("text_normalized").alias("tokens")).withColumn("dl", F.size("tokens").cast("long")))
    stats = B.stats_from(docs)

    def by_impact():
        found = B.postings_from(docs, "doc_id")
        words = docs.agg(F.sum("dl")).first()[0] or 0
        parts = max(spark.sparkContext.defaultParallelism, -(-words // WORDS_PER_PART))
        # counted once, then put in order in rounds of terms: the disk holds one round's shuffle
        unordered = written_once(BT.with_impacts(B.BM25Index(docs, found, None, stats, "doc_id"), keep=("tf", "dl")), "impacts")
        rounds = in_rounds(unordered, "term", unordered.count())
        return [x.repartitionByRange(-(-parts // len(rounds)), "term", "level", "doc_id") for x in rounds]
    levels = materialize(spark, "bm25_impacts", inputs, by_impact, sort_within=["term", "level", "doc_id"])
    postings = levels.select("term", "doc_id", "tf", "dl")
    terms = materialize(spark, "bm25_all_terms", inputs, lambda: B.terms_from(postings, stats.select("n_docs").scalar()))
    index = B.BM25Index(docs.select("doc_id", "dl"), postings, terms, stats, "doc_id")
    blocks = materialize(spark, "bm25_blocks", inputs, lambda: BT.blocks_of(levels, terms))
    return index, BT.ImpactIndex(docs, levels, blocks, "doc_id")


def corpus_all_sql(item_id: int = 0) -> dict[str, str]:
    d = X._corpus_sql(item_id)
    d["corpus"] = f"SELECT doc_id, text, {O.normalize_text('text')} AS tn FROM documents"
    return {k: v for k, v in d.items() if k not in ("qv", "qu", "vec")}


def register_all(register, with_cte) -> None:
    _bm25(register, with_cte)
    _mentions(register, with_cte)
    _vectors(register, with_cte)
    _filters(register, with_cte)
    _hybrid(register, with_cte)


# ----------------------------------------------------------------------------- R1 / R2 / R4

def _bm25(register, with_cte):
    def stats(s, sf):
        c, _ = documents_index(s, sf)
        n = c.terms.agg(F.count(F.lit(1)).alias("n_terms"), F.avg("idf").alias("mean_idf"))
        return c.stats.select("n_docs", F.round("avgdl", 9).alias("avgdl"), n.select("n_terms").scalar().alias("n_terms"),
                              F.round(n.select("mean_idf").scalar(), 9).alias("mean_idf"))
    register("bm25_stats_all", stats, with_cte("""
SELECT (SELECT n FROM st) AS n_docs, round((SELECT avgdl FROM st), 9) AS avgdl, (SELECT COUNT(*) FROM idf) AS n_terms,
       round((SELECT AVG(idf) FROM idf), 9) AS mean_idf""", **corpus_all_sql()))

    def scores(s, sf):
        return B.score_all(documents_index(s, sf)[0], B.query_terms(H.query_text(s, sf))).select("doc_id", F.round("bm25", 6).alias("bm25"))
    register("bm25_scores_all", scores, with_cte("SELECT doc_id, round(bm25, 6) AS bm25 FROM bm", **corpus_all_sql()))

    def bounded(s, sf):
        _, impacts = documents_index(s, sf)
        return BT.topk(impacts, BT.terms_of(H.query_text(s, sf)), C.DEFAULT_TOP_K).select("doc_id", F.round("bm25", 6).alias("bm25"))
    register("bm25_topk_bounded", bounded, with_cte(
        f"SELECT doc_id, round(bm25, 6) AS bm25 FROM sc ORDER BY round(bm25, 9) DESC, doc_id LIMIT {C.DEFAULT_TOP_K}", **corpus_all_sql()))

    def many(s, sf, k: int = C.DEFAULT_TOP_K):
        index, _ = documents_index(s, sf)
        q = B.query_terms(T.load(s, sf, "benchmark").withColumnRenamed("item_id", "query_id"), "text", ["query_id"])
        found = B.score_terms(index, q, ["query_id"], broadcast_query=False)
        return TK.topk_per_group(found, ["query_id"], "bm25", "doc_id", k).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"), "rank")
    d = corpus_all_sql()
    d["qt"] = f"""SELECT item_id AS query_id, term, COUNT(*) AS qtf FROM (
        SELECT item_id, unnest({O.tokens(O.normalize_text('text'))}) AS term FROM benchmark) GROUP BY ALL"""
    d["sc"] = d["sc"].replace("SELECT p.doc_id,", "SELECT qt.query_id, p.doc_id,").replace("GROUP BY p.doc_id", "GROUP BY ALL")
    register("batch_search_all", many, with_cte(f"""
SELECT query_id, doc_id, round(bm25, 6) AS bm25, rnk AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS rnk FROM sc)
WHERE rnk <= {C.DEFAULT_TOP_K}""", **{k: v for k, v in d.items() if k != "bm"}))


# ----------------------------------------------------------------------------- C6

def _mentions(register, with_cte):
    def texts_and_names(s, sf):
        orders = orders_all(s, sf).select("record_id", F.concat_ws(" ", "vendor", "order_summary").alias("text"))
        return orders, X._projects(s, sf).select("commessa_code", "nome_commessa")

    for key, mode, test in (
            ("orders_mentioning_any_project", "substring", "contains(lower(text), lower(nome_commessa)) AND trim(nome_commessa) <> ''"),
            ("orders_mentioning_any_project_words", "words", "len(nt) > 0 AND contains(' ' || array_to_string(tt, ' ') || ' ', ' ' || array_to_string(nt, ' ') || ' ')")):
        def run(s, sf, mode=mode):
            return M.mentions(*texts_and_names(s, sf), "record_id", "text", "commessa_code", "nome_commessa", mode)
        register(key, run, f"""
SELECT record_id, commessa_code FROM
  (SELECT record_id, concat_ws(' ', vendor, order_summary) AS text, {O.tokens("concat_ws(' ', vendor, order_summary)")} AS tt FROM ({ORDERS_ALL_SQL})),
  (SELECT num_commessa AS commessa_code, nome_commessa, {O.tokens('nome_commessa')} AS nt FROM ({FX.PROJECTS_RAW_SQL}))
WHERE {test}""")


# ----------------------------------------------------------------------------- R9 / R13

def _vectors(register, with_cte):
    def tables(s, sf):
        e = T.load(s, sf, "embeddings", ["vec_id", "embedding"]).withColumnRenamed("vec_id", "doc_id")
        q = X._orders_vec(s, sf).where(QUERIES_50).select(F.col("record_id").alias("query_id"), F.col("summary_embedding").alias("embedding"))
        return e, q

    exact_sql = with_cte(f"""
SELECT query_id, doc_id, round(score, 6) AS score, rnk AS rank FROM (
  SELECT q.record_id AS query_id, e.vec_id AS doc_id, {O.cosine('e.embedding', 'q.summary_embedding')} AS score,
         ROW_NUMBER() OVER (PARTITION BY q.record_id ORDER BY round({O.cosine('e.embedding', 'q.summary_embedding')}, 9) DESC, e.vec_id) AS rnk
  FROM order_vectors q, embeddings e WHERE q.{QUERIES_50})
WHERE rnk <= {C.DEFAULT_TOP_K}""", order_vectors=FX.ORDER_VECTORS_SQL)

    def shown(df):
        return df.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")

    register("vector_block_pairs", lambda s, sf: shown(VB.block_pair_topk(*tables(s, sf), C.DEFAULT_TOP_K)), exact_sql)

    def full_probe(s, sf):
        e, q = tables(s, sf)
        index = VB.build(e, 16)
        return shown(VB.search(index, q, C.DEFAULT_TOP_K, len(index.centroids)))
    register("ann_full_probe", full_probe, exact_sql)

    def recall(s, sf):
        """The orders' index (200 lists) probed as widely as a recall of 0.9 on the stated queries takes."""
        o = X._orders_vec(s, sf).select("record_id", "summary_embedding")
        dim = o.select(F.size("summary_embedding")).first()[0]
        q = o.where(QUERIES_50).select(F.col("record_id").alias("query_id"), F.col("summary_embedding").alias("embedding"))
        index = VB.build(o, VB.lists_for("orders", dim), "record_id", "summary_embedding")
        exact = written_once(VB.block_pair_topk(o, q, C.DEFAULT_TOP_K, "record_id", "summary_embedding"), "exact-neighbours")
        nprobe, found = VB.calibrated_probes(index, q, exact, C.DEFAULT_TOP_K)
        return exact.agg(F.lit(len(index.centroids)).alias("lists"), F.lit(nprobe).alias("nprobe"), F.lit(found).alias("recall"), F.count(F.lit(1)).alias("exact_hits"))
    register("ann_recall_target", recall, None)


# ----------------------------------------------------------------------------- B9-B12, B15 over every order

def _filters(register, with_cte):
    cols = "record_id, order_code, order_date, vendor, region, amount"

    def filtered(filters):
        return lambda s, sf: orders_all(s, sf).where(FL.order_filter(filters, vector_col=None)).select(*cols.split(", "))
    cases = {
        "filter_ilike_all": ({"region": "eur", "vendor": "customer#0000001"}, "region ILIKE '%eur%' AND vendor ILIKE '%customer#0000001%'"),
        "filter_dates_all": ({"date_from": "1996-01-01", "date_to": "1996-12-31"}, "order_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"),
        "filter_amounts_all": ({"min_amount": 0, "max_amount": 150000}, "amount BETWEEN 0 AND 150000"),
        "filter_combo_all": ({"region": "asia", "category": "BUILDING", "date_from": "1996-01-01", "min_amount": 1000},
                             "region ILIKE '%asia%' AND category ILIKE '%BUILDING%' AND order_date >= DATE '1996-01-01' AND amount >= 1000"),
    }
    for key, (filters, where) in cases.items():
        register(key, filtered(filters), with_cte(f"SELECT {cols} FROM orders_all WHERE {where}", orders_all=ORDERS_ALL_SQL))
    register("lookup_code_all", lambda s, sf: FL.lookup_code(orders_all(s, sf), "777").select(*cols.split(", ")), with_cte(
        f"SELECT {cols} FROM orders_all WHERE order_code = '777' OR CAST(record_id AS VARCHAR) = '777' ORDER BY record_id LIMIT 1", orders_all=ORDERS_ALL_SQL))


# ----------------------------------------------------------------------------- R3-R7, C8 over the orders table

HIT_METADATA = ["order_code", "order_date", "vendor", "region", "category", "amount"]


def orders_corpus(spark, sf) -> H.Corpus:
    inputs = [T.path(sf, t) for t in ("embeddings", "orders", "customer", "nation", "region")]
    return H.corpus_of(X._orders_vec(spark, sf), "record_id", "order_summary", "summary_embedding", HIT_METADATA,
                       keep=lambda name, build, **how: materialize(spark, f"orders_corpus_{name}", inputs, build, **how))


def _hybrid(register, with_cte):
    query = "Machinery URGENT"

    def hybrid(s, sf):
        c = orders_corpus(s, sf)
        q = s.createDataFrame([(query,)], "text string")
        return H.hybrid_hits(c, B.query_terms(q), X._anchor_vec(s, sf), C.DEFAULT_TOP_K, C.DEFAULT_ALPHA)
    d = X._hybrid_sql(C.DEFAULT_TOP_K, C.DEFAULT_ALPHA)
    d["corpus"] = f"""SELECT record_id AS doc_id, order_summary AS text, {O.normalize_text('order_summary')} AS tn, summary_embedding AS emb,
                             {', '.join(HIT_METADATA)} FROM order_vectors"""
    d["qt"] = f"SELECT term, COUNT(*) AS qtf FROM (SELECT unnest({O.tokens(O.normalize_text(O.q(query)))}) AS term) GROUP BY term"
    register("hybrid_orders", hybrid, with_cte(f"""
SELECT comb.doc_id AS record_id, round(sc, 6) AS score_combined, round(vn, 6) AS score_vector, round(bn, 6) AS score_bm25,
       corpus.text, corpus.tn AS text_normalized, {', '.join('corpus.' + c for c in HIT_METADATA)}
FROM comb JOIN corpus USING (doc_id) ORDER BY round(sc, 9) DESC, comb.doc_id LIMIT {C.DEFAULT_TOP_K}""", **({"order_vectors": FX.ORDER_VECTORS_SQL} | d)))
