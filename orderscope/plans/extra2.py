"""Registration: guarded SQL, upsert, enrichment jobs, batch/ANN retrieval,
sampling, value slots, serialization, ingest round trip, result comparator."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..config import ENGINE as C_ENGINE
from ..functions import text as TX
from ..functions import vectors as V
from ..operators import ann as ANN
from ..operators import bm25 as B
from ..operators import enrich as EN
from ..operators import filters as FL
from ..operators import hybrid as H
from ..operators import prepare as P
from ..operators import topk as TK
from ..operators import upsert as UP
from ..operators import vector_search as VS
from ..session import materialize, shared_dir
from ..sources import exports as EX
from ..sources import fixtures as FX
from ..sources import ingest as IN
from ..sources import tables as T
from . import extra as X
from . import oracle_text as O
from .sqlguard import SqlGuard, serialize_columns

KEYS = EX.SOURCE_ORDER
KEYS_SQL = ", ".join(KEYS)
PALETTE_SIZE = 30   # fixed: size of the concatenated qualitative colour palette


def guard_for(spark, sf):
    return SqlGuard(spark, {
        "orders": lambda s: FX.procurement(s, sf),
        "commesse": lambda s: X._commesse(s, sf),
    })


def _guard_ctes(with_cte, sql: str) -> str:
    ctes = {"procurement": FX.PROCUREMENT_SQL, "projects_raw": FX.PROJECTS_RAW_SQL,
            "projects": X.PROJECTS_SQL, "commesse": X.COMMESSE_SQL, "orders": "SELECT * FROM procurement"}
    return with_cte(sql, **ctes)


def register_all(register, with_cte) -> None:
    _sql(register, with_cte)
    _jobs(register, with_cte)
    _retrieval(register, with_cte)
    _misc(register, with_cte)


# ----------------------------------------------------------------------------- H / F3 / G4 / C7 / E

SQL_CASES = {
    # name: (user sql, params, wrapped limit as applied by the policy)
    "sql_passthrough": ("SELECT vendor, CAST(SUM(amount) AS DOUBLE) AS total FROM orders "
                        "WHERE order_date >= DATE '1998-01-01' AND vendor IS NOT NULL "
                        "GROUP BY vendor ORDER BY total DESC, vendor LIMIT 5;", None, 500),
    "sql_params": ("SELECT contract_type, COUNT(*) AS n FROM orders WHERE amount >= :min_amount "
                   "GROUP BY contract_type", {"min_amount": 5000}, 200),
    "sql_limit": ("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(amount AS DOUBLE) AS amount "
                  "FROM orders ORDER BY amount DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey "
                  "limit 9999", None, 500),
    "sql_guard": ("select l_orderkey, l_linenumber, l_partkey, l_suppkey, vendor from orders "
                  "order by l_orderkey, l_linenumber, l_partkey, l_suppkey", None, 200),
    "sql_join": ("WITH o AS (SELECT city, COUNT(*) AS n_lines, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS spend "
                 "FROM orders GROUP BY city), c AS (SELECT committente, COUNT(*) AS n_projects FROM commesse "
                 "GROUP BY committente) SELECT o.city, o.n_lines, o.spend, c.n_projects FROM o "
                 "JOIN c ON o.city = c.committente", None, 200),
    "sql_window": ("SELECT * FROM (SELECT category, vendor, total, CAST(RANK() OVER (PARTITION BY category "
                   "ORDER BY total DESC, vendor) AS BIGINT) AS rnk FROM (SELECT category, vendor, CAST(SUM(amount) AS DOUBLE) "
                   "AS total FROM orders WHERE vendor IS NOT NULL GROUP BY category, vendor) t) r WHERE rnk <= 5",
                   None, 200),
    "sql_setops": ("SELECT vendor FROM orders WHERE category = 'SMALL' INTERSECT "
                   "SELECT vendor FROM orders WHERE category = 'LARGE' EXCEPT "
                   "SELECT vendor FROM orders WHERE amount > 100000 UNION SELECT 'none' AS vendor", None, 200),
}


def _sql(register, with_cte):
    for name, (sql, params, _) in SQL_CASES.items():
        def run(s, sf, sql=sql, params=params):
            return guard_for(s, sf).run(sql, params=params).df
        cleaned = sql.strip().rstrip(";")
        if params:
            for k, v in params.items():
                cleaned = cleaned.replace(f":{k}", str(v))
        if name == "sql_limit":
            cleaned = cleaned.replace("limit 9999", "LIMIT 500")
        limit = SQL_CASES[name][2]
        wrapped = f"SELECT * FROM (\n{cleaned}\n) LIMIT {limit}"
        register(name, run, _guard_ctes(with_cte, wrapped))


# ----------------------------------------------------------------------------- A6 / U1 / U2 / C4 / C5 / C1-C2

def prepared_documents(s, sf):
    """The prepared document table (normalised once per input version) the embedding jobs read."""
    return materialize(s, "documents_prepared", [T.path(sf, "documents")],
                       lambda: TX.with_normalized_whole(X._docs(s, sf), "text"))


def _jobs(register, with_cte):
    def upsert_orders(s, sf):
        o = T.load(s, sf, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
        target = o.select(F.col("o_orderkey").alias("record_id"), "o_orderstatus",
                          F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
        open_ = target.where(F.col("o_orderstatus") == "O")
        v1 = open_.select("record_id", F.lit("R").alias("o_orderstatus"),
                          (F.col("amount") * F.lit(1.10)).cast("decimal(18,2)").alias("amount"), F.lit(1).alias("seq"))
        v2 = open_.select("record_id", F.lit("P").alias("o_orderstatus"),
                          (F.col("amount") * F.lit(1.20)).cast("decimal(18,2)").alias("amount"), F.lit(2).alias("seq"))
        return UP.upsert(target, v2.unionByName(v1), "record_id", "seq")
    register("upsert_orders", upsert_orders, """
WITH t AS (SELECT o_orderkey AS record_id, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)
SELECT * FROM t WHERE o_orderstatus <> 'O'
UNION ALL
SELECT record_id, 'P' AS o_orderstatus, CAST(amount * 1.20 AS DECIMAL(18,2)) AS amount FROM t WHERE o_orderstatus = 'O'""")

    docs_keyed = prepared_documents

    def cache_from_labels(s, sf, clip: bool = False):
        """The previous run embedded the labelled documents: their keys form the cache."""
        lab = T.load(s, sf, "labels", ["doc_id"])
        prev = EN.keyed_texts(docs_keyed(s, sf).join(lab, "doc_id", "left_semi"), "text_normalized", clip=clip)
        return EN.hashed_bow(prev.select("cache_key", "_text").dropDuplicates(["cache_key"]), C.EMBED_OUTPUT_DIM) \
                 .select("cache_key", "embedding")

    def embed_cache_split(s, sf):
        keyed = EN.keyed_texts(docs_keyed(s, sf), "text_normalized", clip=True)
        hits, misses = EN.cache_split(keyed, cache_from_labels(s, sf, clip=True))
        return keyed.agg(F.count(F.lit(1)).alias("n_texts"), F.count_distinct("cache_key").alias("n_keys")) \
                    .select("n_texts", "n_keys", hits.agg(F.count(F.lit(1))).scalar().alias("n_hits"),
                            misses.agg(F.count(F.lit(1))).scalar().alias("n_misses"))
    lim = C.EMBED_MAX_TOKENS * C.AVG_CHARS_PER_TOKEN
    key_sql = f"'{C.EMBEDDING_MODEL}:{C.EMBED_OUTPUT_DIM}:' || sha256(substring({O.normalize_text('text')}, 1, {lim}))"
    register("embed_cache_split", embed_cache_split, f"""
WITH k AS (SELECT doc_id, {key_sql} AS cache_key FROM documents),
     c AS (SELECT DISTINCT cache_key FROM k WHERE doc_id IN (SELECT doc_id FROM labels)),
     d AS (SELECT DISTINCT cache_key FROM k)
SELECT (SELECT COUNT(*) FROM k) AS n_texts, (SELECT COUNT(*) FROM d) AS n_keys,
       (SELECT COUNT(*) FROM d WHERE cache_key IN (SELECT cache_key FROM c)) AS n_hits,
       (SELECT COUNT(*) FROM d WHERE cache_key NOT IN (SELECT cache_key FROM c)) AS n_misses""")

    def embed_job(s, sf):
        out, _, _ = EN.embed_job(docs_keyed(s, sf), "text_normalized", cache_from_labels(s, sf))  # whole texts
        return out.select("doc_id", "cache_key", F.size("embedding").cast("bigint").alias("dim"),
                          (F.round(V.norm("embedding"), 6) == 1.0).alias("is_unit"))
    whole_key_sql = f"'{C.EMBEDDING_MODEL}:{C.EMBED_OUTPUT_DIM}:' || sha256({O.normalize_text('text')})"
    register("embed_job", embed_job, f"""
SELECT doc_id, {whole_key_sql} AS cache_key, CAST({C.EMBED_OUTPUT_DIM} AS BIGINT) AS dim,
       len({O.tokens(O.normalize_text(O.normalize_text('text')))}) > 0 AS is_unit
FROM documents""")

    sig_cols = ["ordine_n", "fornitore", "oggetto", "descrizione", "note", "importo_ordine", "data_ord"]

    def current_rows(s, sf):
        ids = X._export_ids(s, sf)
        rows = ids.withColumn("text_raw", TX.combine_text(C.TEXT_COLUMNS))
        return EN.summary_keys(rows, sig_cols)

    def previous_summaries(s, sf):
        """Previous run: amounts of the newest year were revised since; summaries of rows without a note failed."""
        prev = X._export_ids(s, sf)
        newest = prev.agg(F.max("data_ord")).scalar()
        prev = prev.withColumn("importo_ordine", F.when(F.substring("data_ord", 1, 4) == F.substring(newest, 1, 4),
                                                        F.lit("0.00")).otherwise(F.col("importo_ordine")))
        prev = EN.summary_keys(prev.withColumn("text_raw", TX.combine_text(C.TEXT_COLUMNS)), sig_cols)
        return prev.select("record_id", "summary_key",
                           F.when(F.col("note").isNull(), F.lit("")).otherwise(EN.extractive_summary(F.col("text_raw")))
                           .alias("order_summary"))

    def summary_pending(s, sf):
        current = current_rows(s, sf)
        return EN.summary_pending(current.select("record_id", "summary_key"), previous_summaries(s, sf), current.count()).select("record_id")
    def js(replace_amount: bool) -> str:
        parts = []
        for c in sorted(sig_cols):
            v = c
            if c == "importo_ordine" and replace_amount:
                v = ("CASE WHEN substr(data_ord, 1, 4) = (SELECT substr(MAX(data_ord), 1, 4) FROM export_ids) "
                     "THEN '0.00' ELSE importo_ordine END")
            parts.append(f"'{c}': {v}")
        return "to_json({" + ", ".join(parts) + "})"
    register("summary_pending", summary_pending, X._ctx_export(f"""
, cur AS (SELECT record_id, {js(False)} AS k FROM export_ids),
  prev AS (SELECT record_id, {js(True)} AS k, note FROM export_ids)
SELECT c.record_id FROM cur c
WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.record_id = c.record_id AND p.k = c.k AND p.note IS NOT NULL)""",
        with_cte, ids=True))

    def summary_job(s, sf):
        out = EN.summary_job(current_rows(s, sf), previous_summaries(s, sf))
        return out.select("record_id", "source_row", F.col("ordine_n").alias("order_id"),
                          F.col("fornitore").alias("vendor"), "order_summary", "summary_normalized")
    first = "trim(CASE WHEN position(' | ' IN text_raw) > 0 THEN substr(text_raw, 1, position(' | ' IN text_raw) - 1) ELSE text_raw END)"
    register("summary_job", summary_job, X._ctx_export(f"""
SELECT record_id, record_id AS source_row, ordine_n AS order_id, fornitore AS vendor, order_summary,
       {O.normalize_text('order_summary')} AS summary_normalized
FROM (SELECT *, {first} AS order_summary FROM (
        SELECT *, {O.combine_text(['oggetto', 'descrizione', '"desc"', 'note'])} AS text_raw FROM export_ids))""",
        with_cte, ids=True))

    def assemble_orders(s, sf):
        raw = X._export_ids(s, sf)
        summaries = EN.summary_job(current_rows(s, sf), None)
        vec = T.load(s, sf, "embeddings", ["vec_id", "embedding"]).withColumnRenamed("vec_id", "record_id")
        a = P.assemble_orders(raw, summaries, vec, n_vectors=vec.count())
        return a.select("record_id", "source_row", "order_code", "order_date", "delivery_date", "category",
                        "contract_type", "order_type", "vendor", "region", "city", "amount", "text_raw",
                        "text_normalized", "order_summary", "summary_normalized", "summary_embedding")
    register("assemble_orders", assemble_orders, X._ctx_export(f"""
SELECT x.record_id, x.record_id AS source_row, ordine_n AS order_code, TRY_CAST(data_ord AS DATE) AS order_date,
       TRY_CAST(data_consegna AS DATE) AS delivery_date, tipologia AS category, tipo_contratto_txt AS contract_type,
       tipo_ordine AS order_type, fornitore AS vendor, {O.normalize_region('regione')} AS region,
       {O.clean_text('comune')} AS city, TRY_CAST(importo_ordine AS DECIMAL(18,2)) AS amount,
       text_clean AS text_raw, {O.normalize_text('text_clean')} AS text_normalized,
       {first.replace('text_raw', 'text_orig')} AS order_summary,
       {O.normalize_text(first.replace('text_raw', 'text_orig'))} AS summary_normalized,
       e.embedding AS summary_embedding
FROM (SELECT *, {O.combine_text([O.clean_text(c) for c in ['oggetto', 'descrizione', '"desc"', 'note']])} AS text_clean,
             {O.combine_text(['oggetto', 'descrizione', '"desc"', 'note'])} AS text_orig
      FROM export_ids) x
JOIN embeddings e ON x.record_id = e.vec_id""", with_cte, ids=True))

    def orders_mentioning_project(s, sf):
        cm = X._commesse(s, sf)
        name = FL.lookup_code(cm, "12", "commessa_code").select("nome_commessa").first()[0]   # one anchor row
        ov = X._orders_vec(s, sf)
        text = F.lower(F.concat_ws(" ", F.col("vendor"), F.col("order_summary")))
        return (ov.where(text.contains(name.lower()))
                  .select("record_id", "order_code", "vendor", F.lit(name).alias("nome_commessa")))
    register("orders_mentioning_project", orders_mentioning_project, X._ctx_projects(f"""
SELECT record_id, order_code, vendor, nm AS nome_commessa
FROM ({FX.ORDER_VECTORS_SQL}) ov,
     (SELECT nome_commessa AS nm FROM commesse WHERE commessa_code = '12' OR CAST(record_id AS VARCHAR) = '12'
      ORDER BY record_id LIMIT 1) p
WHERE contains(lower(concat_ws(' ', vendor, order_summary)), lower(nm))""", with_cte, vectors=True))


def semantic_text_search(s, sf, query: str = "Machinery URGENT", top_k: int = C.DEFAULT_TOP_K, dim: int = 1999):
    """R8 + R10 by text: summaries embedded by the embedding job (offline model), stored once per input version; the
    query text normalised and embedded by the same model, cosine top-k over the orders."""
    def vectors():
        ov = X._orders_vec(s, sf).select("record_id", "order_code", "vendor", "order_summary")
        rows, _, _ = EN.embed_job(TX.with_normalized_text(ov, "order_summary", "summary_normalized"), "summary_normalized", EN.empty_cache(s), dim=dim)
        return rows
    rows = materialize(s, f"order_text_vectors_{dim}", [T.path(sf, t) for t in ("embeddings", "orders", "customer", "nation", "region")], vectors)
    qv = VS.query_vector(EN.text_vector(s, query, dim), "embedding")
    hits = VS.topk(VS.score(rows, "embedding", qv), "_sim", "record_id", top_k)
    return hits.select("record_id", "order_code", "vendor", "order_summary",
                       F.round(F.greatest(F.lit(0.0), F.col("_sim")), 6).alias("similarity"))


# ----------------------------------------------------------------------------- R9 / R13 / U3

def _retrieval(register, with_cte):
    def batch_search(s, sf, k: int = C.DEFAULT_TOP_K):
        corpus = H.build_corpus(s, sf)
        q = T.load(s, sf, "benchmark").withColumnRenamed("item_id", "query_id")
        qt = B.query_terms(q, "text", ["query_id"])
        # many queries: broadcast the (query, term) table only below the row bound, else shuffle-join
        small = qt.count() <= C_ENGINE.broadcast_row_limit
        scores = B.score_terms(corpus.index, qt, ["query_id"], broadcast_query=small)
        top = TK.topk_per_group(scores, ["query_id"], "bm25", "doc_id", k)
        return top.select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"), "rank")
    d = X._corpus_sql()
    d["qt"] = f"""SELECT item_id AS query_id, term, COUNT(*) AS qtf FROM (
        SELECT item_id, unnest({O.tokens(O.normalize_text('text'))}) AS term FROM benchmark) GROUP BY ALL"""
    d["sc"] = f"""SELECT qt.query_id, p.doc_id, SUM(qt.qtf * idf.idf * (p.tf * {C.BM25_K1 + 1}) /
                    (p.tf + {C.BM25_K1} * (1 - {C.BM25_B} + {C.BM25_B} * dl.dl / (SELECT avgdl FROM st)))) AS bm25
                  FROM post p JOIN qt USING (term) JOIN idf USING (term) JOIN dl USING (doc_id) GROUP BY ALL"""
    register("batch_search", batch_search, with_cte(f"""
SELECT query_id, doc_id, round(bm25, 6) AS bm25, rnk AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS rnk FROM sc)
WHERE rnk <= {C.DEFAULT_TOP_K}""", **{k: v for k, v in d.items() if k not in ("bm", "qv", "qu", "vec")}))

    def batch_vector_search(s, sf, k: int = C.DEFAULT_TOP_K):
        e = T.load(s, sf, "embeddings", ["vec_id", "embedding"])
        q = X._orders_vec(s, sf).where("record_id % 50 = 0").select(F.col("record_id").alias("query_id"), F.col("summary_embedding").alias("embedding"))  # the stated query set
        top = ANN.batch_vector_topk(e.withColumnRenamed("vec_id", "doc_id"), q, k)
        return top.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
    register("batch_vector_search", batch_vector_search, with_cte(f"""
SELECT query_id, doc_id, round(score, 6) AS score, rnk AS rank FROM (
  SELECT q.record_id AS query_id, e.vec_id AS doc_id, {O.cosine('e.embedding', 'q.summary_embedding')} AS score,
         ROW_NUMBER() OVER (PARTITION BY q.record_id ORDER BY round({O.cosine('e.embedding', 'q.summary_embedding')}, 9) DESC, e.vec_id) AS rnk
  FROM order_vectors q, embeddings e WHERE q.record_id % 50 = 0)
WHERE rnk <= {C.DEFAULT_TOP_K}""", order_vectors=FX.ORDER_VECTORS_SQL))

    def ann_ivf_recall(s, sf, k: int = C.DEFAULT_TOP_K, nlist: int = 16):
        e = T.load(s, sf, "embeddings", ["vec_id", "embedding"]).withColumnRenamed("vec_id", "doc_id")
        q = X._orders_vec(s, sf).where("record_id % 50 = 0").select(F.col("record_id").alias("query_id"), F.col("summary_embedding").alias("embedding"))  # the stated query set
        exact = ANN.materialize_once(ANN.batch_vector_topk(e, q, k))
        index, centroids = ANN.ivf_build(e, nlist)
        out = None
        for nprobe in (1, 2, 4, 8, nlist):
            r = ANN.recall_at_k(exact, ANN.ivf_search(index, centroids, q, k, nprobe), k) \
                   .select(F.lit(nprobe).alias("nprobe"), F.round("recall", 4).alias("recall"))
            out = r if out is None else out.unionByName(r)
        return out
    register("ann_ivf_recall", ann_ivf_recall, None)

    def project_2d(s, sf):
        e = T.load(s, sf, "embeddings", ["vec_id", "embedding"])
        p = ANN.project_2d(e, "vec_id", "embedding")
        return p.select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    register("project_2d", project_2d, None)

    # cosine of token-count vectors (the hashed model without bucket collisions on these tokens)
    tok = O.tokens(O.normalize_text("order_summary"))
    register("semantic_text_search", semantic_text_search, with_cte(f"""
SELECT ov.record_id, ov.order_code, ov.vendor, ov.order_summary,
       round(greatest(0.0, CASE WHEN dn.nd = 0 THEN 0.0 ELSE COALESCE(dot.v, 0) / (sqrt(dn.nd) * sqrt((SELECT SUM(c * c) FROM q))) END), 6) AS similarity
FROM order_vectors ov JOIN dn USING (record_id) LEFT JOIN dot USING (record_id)
ORDER BY round(CASE WHEN dn.nd = 0 THEN 0.0 ELSE COALESCE(dot.v, 0) / (sqrt(dn.nd) * sqrt((SELECT SUM(c * c) FROM q))) END, 9) DESC,
         ov.record_id
LIMIT {C.DEFAULT_TOP_K}""",
        order_vectors=FX.ORDER_VECTORS_SQL,
        q=f"SELECT t, COUNT(*) AS c FROM (SELECT unnest({O.tokens(O.normalize_text(chr(39) + 'Machinery URGENT' + chr(39)))}) AS t) GROUP BY t",
        dt=f"SELECT record_id, t, COUNT(*) AS c FROM (SELECT record_id, unnest({tok}) AS t FROM order_vectors) GROUP BY ALL",
        dn="SELECT record_id, SUM(c * c) AS nd FROM dt GROUP BY record_id",
        dot="SELECT dt.record_id, SUM(dt.c * q.c) AS v FROM dt JOIN q USING (t) GROUP BY dt.record_id"))


# ----------------------------------------------------------------------------- F5 / S20 / S21 / A9 / A1 / D48

def _misc(register, with_cte):
    def na_to_null(s, sf):
        """A numeric transform yields NaN for some rows (sqrt of a negative deviation); NaN → NULL."""
        e = T.load(s, sf, "events", ["event_id", "value"])
        raw = e.select("event_id", F.sqrt(F.col("value") - 10).alias("root"))
        return P.na_to_null(raw)
    register("na_to_null", na_to_null,
             "SELECT event_id, CASE WHEN value - 10 < 0 THEN NULL ELSE sqrt(value - 10) END AS root FROM events")

    def stream_ingest(s, sf):
        """Incremental load: export v1 (all rows) and v2 (newest year revised) stream into the change log."""
        import uuid
        from ..streaming.incremental import current_state, run_available, start_changelog
        ex = X._export(s, sf).withColumn("seq", F.lit(1))
        newest = ex.agg(F.max(F.substring("data_ord", 1, 4))).scalar()
        rev = (ex.where(F.substring("data_ord", 1, 4) == newest)
                 .withColumn("importo_ordine", (F.col("importo_ordine").cast("decimal(18,2)") + 1)
                             .cast("decimal(18,2)").cast("string"))
                 .withColumn("seq", F.lit(2)))
        src = shared_dir(s, "stream-src", uuid.uuid4().hex)
        ex.write.parquet(src + "/v1")
        rev.write.parquet(src + "/v2")
        schema = s.read.parquet(src + "/v1").schema
        q, log = start_changelog(s, src + "/*", schema, ["ordine_n", "importo_ordine", "oggetto", "note"])
        run_available(q)
        cur = current_state(s, log, KEYS, columns=["importo_ordine", "seq", "text_normalized"])
        return cur.select(*KEYS, "importo_ordine", "seq", "text_normalized")
    register("stream_ingest", stream_ingest, X._ctx_export(f"""
SELECT {KEYS_SQL},
       CASE WHEN substr(data_ord, 1, 4) = (SELECT MAX(substr(data_ord, 1, 4)) FROM export)
            THEN CAST(CAST(CAST(importo_ordine AS DECIMAL(18,2)) + 1 AS DECIMAL(18,2)) AS VARCHAR)
            ELSE importo_ordine END AS importo_ordine,
       CASE WHEN substr(data_ord, 1, 4) = (SELECT MAX(substr(data_ord, 1, 4)) FROM export) THEN 2 ELSE 1 END AS seq,
       {O.normalize_text(O.combine_text(['oggetto', 'descrizione', '"desc"', 'note']))} AS text_normalized
FROM export""", with_cte))

    from ..sources import payload as PL
    register("payload_items", lambda s, sf: PL.payload_items(PL.pages(s, sf)), with_cte("""
SELECT doc_id, page, line % 3 AS item_pos, code, CASE WHEN cut THEN tail ELSE description END AS description,
       quantity, unit_price, total_price FROM lines""", lines=PL.lines_sql()))
    register("payload_stitch", lambda s, sf: PL.payload_stitch(PL.pages(s, sf)), with_cte("""
SELECT doc_id, page, line % 3 AS item_pos, code, description FROM lines""", lines=PL.lines_sql()))
    register("sample_n", lambda s, sf: TK.sample_n(FX.procurement(s, sf), 100, 42, KEYS).select(*KEYS, "amount"),
             with_cte(f"""SELECT {KEYS_SQL}, amount FROM procurement
ORDER BY md5('42|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|'
             || CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)), {KEYS_SQL} LIMIT 100""",
                      procurement=FX.PROCUREMENT_SQL))

    def category_slot(s, sf):
        ids = X._export_ids(s, sf)
        t = TK.value_slots(ids.where(F.col("tipologia").isNotNull()), "tipologia", "record_id", PALETTE_SIZE)
        v = TK.value_slots(ids.withColumn("fornitore", F.coalesce("fornitore", F.lit(""))), "fornitore",
                           "record_id", PALETTE_SIZE)
        return (t.select(F.lit("tipologia").alias("column_name"), F.col("tipologia").alias("value"), "slot")
                 .unionByName(v.select(F.lit("fornitore").alias("column_name"), F.col("fornitore").alias("value"), "slot")))
    register("category_slot", category_slot, X._ctx_export(f"""
SELECT 'tipologia' AS column_name, v AS value, CAST((ROW_NUMBER() OVER (ORDER BY f, v) - 1) % {PALETTE_SIZE} AS BIGINT) AS slot
FROM (SELECT tipologia AS v, MIN(record_id) AS f FROM export_ids WHERE tipologia IS NOT NULL GROUP BY 1)
UNION ALL
SELECT 'fornitore', v, CAST((ROW_NUMBER() OVER (ORDER BY f, v) - 1) % {PALETTE_SIZE} AS BIGINT)
FROM (SELECT COALESCE(fornitore, '') AS v, MIN(record_id) AS f FROM export_ids GROUP BY 1)""", with_cte, ids=True))

    def padded(s, sf):
        e = T.load(s, sf, "embeddings", ["embedding"]).select(
            F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
        return TK.padded_range(e, ["x", "y"]).select(*[F.round(c, 9).alias(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")])
    pr = []
    for c, idx in (("x", 1), ("y", 2)):
        mn, mx = f"MIN(CAST(embedding[{idx}] AS DOUBLE))", f"MAX(CAST(embedding[{idx}] AS DOUBLE))"
        p = f"(CASE WHEN ({mx} - {mn}) * 0.05 = 0 THEN 1.0 ELSE ({mx} - {mn}) * 0.05 END)"
        pr += [f"round({mn} - {p}, 9) AS {c}_lo", f"round({mx} + {p}, 9) AS {c}_hi"]
    register("padded_range", padded, f"SELECT {', '.join(pr)} FROM embeddings")

    def serialize_rows(s, sf):
        hits = VS.semantic_orders(X._orders_vec(s, sf), X._anchor_vec(s, sf), 5)
        return serialize_columns(hits).select("record_id", F.to_json(F.struct(*[c for c in hits.columns if c != "similarity"]),
                                                                          {"ignoreNullFields": "false"})
                                              .alias("payload"))
    cols = ["record_id", "order_code", "order_date", "delivery_date", "vendor", "region", "category",
            "contract_type", "order_type", "amount", "summary"]
    sim_sql = O.cosine("summary_embedding", "(SELECT embedding FROM embeddings WHERE vec_id = 0)")
    obj = ", ".join(f"'{c}': " + (f"strftime({c}, '%Y-%m-%d')" if c in ("order_date", "delivery_date")
                                   else ("CAST(amount AS DOUBLE)" if c == "amount"
                                         else ("order_summary" if c == "summary" else c))) for c in cols)
    register("serialize_rows", serialize_rows, X._ctx_ov(f"""
SELECT record_id, CAST(to_json({{{obj}}}) AS VARCHAR) AS payload FROM (
  SELECT * FROM (SELECT *, {sim_sql} AS sim FROM order_vectors WHERE summary_embedding IS NOT NULL)
  ORDER BY round(sim, 9) DESC, record_id LIMIT 5)""", with_cte))

    def ingest_roundtrip(s, sf):
        """A1/A3: export written as CSV with header, read back as strings through the checked reader."""
        path = shared_dir(s, "exports", f"orders_csv-{uuid.uuid4().hex}")
        IN.write_csv(X._export(s, sf).drop(*KEYS[1:]).withColumn("l_orderkey", F.col("l_orderkey").cast("string")), path)
        back, _ = IN.read_checked(s, path)
        return back.select("l_orderkey", "ordine_n", "posiz_num", "data_ord", "tipologia", "fornitore", "regione",
                           "importo_ordine", "oggetto", "note")
    register("ingest_roundtrip", ingest_roundtrip, X._ctx_export("""
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, ordine_n, posiz_num, data_ord, tipologia, fornitore, regione,
       importo_ordine, oggetto, note FROM export""", with_cte))

    def compare_results(s, sf):
        """Expected (DataFrame catalogue) vs actual (guarded SQL) for scalar questions; tolerance rule."""
        from . import analytics as AN
        p = FX.procurement(s, sf)
        g = guard_for(s, sf)
        cases = {
            "total_orders": (AN.total_orders(p), "SELECT COUNT(*) AS v FROM orders"),
            "total_amount": (AN.total_amount(p), "SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS v FROM orders"),
            "avg_amount": (AN.avg_amount(p), "SELECT CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS v FROM orders"),
            "orders_over_10k": (AN.orders_over_10k(p), "SELECT COUNT(*) AS v FROM orders WHERE amount > 10000"),
            "amount_spread": (AN.amount_spread(p), "SELECT CAST(MAX(amount) - MIN(amount) AS DOUBLE) AS v FROM orders"),
        }
        out = None
        for name, (exp_df, sql) in cases.items():
            act = g.run(sql).df
            row = exp_df.select(F.col(exp_df.columns[0]).cast("double").alias("expected")) \
                        .select(F.lit(name).alias("name"), "expected",
                                act.select(F.col("v").cast("double")).scalar().alias("actual"))
            out = row if out is None else out.unionByName(row)
        diff = F.abs(F.col("actual") - F.col("expected"))
        return out.withColumn("ok", (diff <= C.COMPARE_ABS_TOL) | (diff <= F.abs(F.col("expected")) * C.COMPARE_REL_TOL))
    parts = {
        "total_orders": "CAST(COUNT(*) AS DOUBLE)",
        "total_amount": "CAST(COALESCE(SUM(amount), 0) AS DOUBLE)",
        "avg_amount": "CAST(SUM(amount) AS DOUBLE) / COUNT(amount)",
        "orders_over_10k": "CAST(COUNT(*) FILTER (WHERE amount > 10000) AS DOUBLE)",
        "amount_spread": "CAST(MAX(amount) - MIN(amount) AS DOUBLE)",
    }
    union = " UNION ALL ".join(f"SELECT '{n}' AS name, {e} AS expected, {e} AS actual, TRUE AS ok FROM procurement"
                               for n, e in parts.items())
    register("compare_results", compare_results, with_cte(union, procurement=FX.PROCUREMENT_SQL))
