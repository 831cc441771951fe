"""Registration of the non-analytic operators: text functions, ingest and
preparation, filters, vector search, BM25/hybrid retrieval.

Every query reads the input tables (or views Spark derives from them) and
processes whole texts. Each oracle SQL is the same definition in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as TX
from ..functions import vectors as V
from ..operators import bm25 as B
from ..operators import filters as FL
from ..operators import hybrid as H
from ..operators import prepare as P
from ..operators import vector_search as VS
from ..sources import exports as EX
from ..sources import fixtures as FX
from ..sources import tables as T
from . import oracle_text as O

KEYS = EX.SOURCE_ORDER
KEYS_SQL = ", ".join(KEYS)


def _docs(spark, sf):
    return T.load_balanced(spark, sf, "documents", ["doc_id", "text"])


def _conv(spark, sf):
    return T.load(spark, sf, "conversations")


def _export(spark, sf):
    return EX.orders_export(spark, sf)


def _export_ids(spark, sf):
    """A4 at ingest: the rows get their ids once per input version and are persisted, typed, in the shared folder; the
    export's texts are derived when they are read."""
    from ..session import materialize
    inputs = [T.path(sf, t) for t in ("lineitem", "orders", "part", "supplier", "nation", "region")]
    rows = materialize(spark, "orders_export_rows", inputs, lambda: FX.build_procurement(spark, sf, ids=True))
    return EX.export_columns(rows.withColumn("source_row", F.col("record_id")))


def _projects(spark, sf):
    """Prepared projects (S10) with ids assigned at ingest."""
    return P.derive_commesse(EX.projects_export(spark, sf))


def _commesse_assembled(spark, sf):
    vec = T.load(spark, sf, "embeddings", ["vec_id", "embedding"]).withColumnRenamed("vec_id", "record_id")
    return P.assemble_commesse(_projects(spark, sf), vec)


def _commesse(spark, sf):
    """The db-ready projects table, assembled once per input version (what the loader persists)."""
    from ..session import materialize
    inputs = [T.path(sf, t) for t in ("customer", "nation", "orders", "embeddings")]
    return materialize(spark, "commesse_ready", inputs, lambda: _commesse_assembled(spark, sf))


def _orders_vec(spark, sf):
    return FX.order_vectors(spark, sf)


def _anchor_vec(spark, sf, vec_id: int = 0):
    e = T.load(spark, sf, "embeddings", ["vec_id", "embedding"]).where(F.col("vec_id") == vec_id)
    return VS.query_vector(e, "embedding")


# ----------------------------------------------------------------------------- SQL fragments

EXPORT_IDS_SQL = f"SELECT *, ROW_NUMBER() OVER (ORDER BY {KEYS_SQL}) - 1 AS record_id FROM export"

PROJECTS_SQL = f"""
SELECT * FROM (
  SELECT record_id,
         {O.clean_value('num_commessa')} AS commessa_code,
         {O.combine_text(['oggetto_filled'])} AS text_raw,
         {O.normalize_text(O.combine_text(['oggetto_filled']))} AS text_normalized,
         oggetto_filled,
         committente AS cliente,
         ditta, num_commessa, nome_commessa, settore, mgo, committente, ente_appaltante, oggetto, importo,
         consegna, ultimazione, codice_gara, responsabile_commessa, responsabile_cantiere, preposti
  FROM (
    SELECT *, {O.oggetto_filled('oggetto', 'nome_commessa', 'settore', 'committente')} AS oggetto_filled
    FROM (
      SELECT record_id,
             {O.clean_value('NULL')} AS ditta,
             {O.clean_value('num_commessa')} AS num_commessa,
             {O.clean_value('nome_commessa')} AS nome_commessa,
             {O.clean_value('settore')} AS settore,
             {O.clean_value('NULL')} AS mgo,
             {O.clean_value('committente')} AS committente,
             {O.clean_value('NULL')} AS ente_appaltante,
             {O.clean_value('oggetto')} AS oggetto,
             importo, consegna, ultimazione,
             {O.clean_value('NULL')} AS codice_gara,
             {O.clean_value('NULL')} AS responsabile_commessa,
             {O.clean_value('NULL')} AS responsabile_cantiere,
             {O.clean_value('NULL')} AS preposti
      FROM projects_raw)))
WHERE length(text_normalized) > 0
"""

COMMESSE_SQL = """
SELECT p.*, e.embedding AS oggetto_embedding FROM projects p JOIN embeddings e ON p.record_id = e.vec_id
"""


def _ctx_export(sql: str, with_cte, ids: bool = False) -> str:
    ctes = {"procurement": FX.PROCUREMENT_SQL, "export": EX.ORDERS_EXPORT_SQL}
    if ids:
        ctes["export_ids"] = EXPORT_IDS_SQL
    return with_cte(sql, **ctes)


def _ctx_projects(sql: str, with_cte, vectors: bool = False) -> str:
    ctes = {"projects_raw": FX.PROJECTS_RAW_SQL, "projects": PROJECTS_SQL}
    if vectors:
        ctes["commesse"] = COMMESSE_SQL
    return with_cte(sql, **ctes)


def _ctx_ov(sql: str, with_cte) -> str:
    return with_cte(sql, order_vectors=FX.ORDER_VECTORS_SQL)


def register_all(register, with_cte) -> None:
    _text(register, with_cte)
    _ingest(register, with_cte)
    _filters_vectors(register, with_cte)
    _retrieval(register, with_cte)
    from . import extra2, retrieval, storage
    for module in (extra2, retrieval, storage):
        module.register_all(register, with_cte)


# ----------------------------------------------------------------------------- S: text functions

def _text(register, with_cte):
    register("norm_whitespace",
             lambda s, sf: _docs(s, sf).select("doc_id", TX.norm_whitespace("text").alias("text_ws")),
             f"SELECT doc_id, {O.ws('text')} AS text_ws FROM documents")
    register("strip_accents",
             lambda s, sf: _docs(s, sf).select("doc_id", TX.strip_accents("text").alias("text_plain")),
             "SELECT doc_id, strip_accents(text) AS text_plain FROM documents")
    register("normalize_text",
             lambda s, sf: TX.with_normalized_text(_docs(s, sf), "text").select("doc_id", "text_normalized"),
             f"SELECT doc_id, {O.normalize_text('text')} AS text_normalized FROM documents")
    register("clean_text",
             lambda s, sf: _docs(s, sf).select("doc_id", TX.clean_text("text").alias("text_clean")),
             f"SELECT doc_id, {O.clean_text('text')} AS text_clean FROM documents")

    def tokenize(s, sf):
        t = TX.with_normalized_text(_docs(s, sf), "text").select("doc_id", TX.tokenize("text_normalized").alias("tok"))
        return t.select("doc_id", F.size("tok").cast("bigint").alias("n_tokens"),
                        F.size(F.array_distinct("tok")).cast("bigint").alias("n_distinct"),
                        F.element_at("tok", 1).alias("first_token"), F.element_at("tok", -1).alias("last_token"))
    register("tokenize", tokenize, f"""
SELECT doc_id, CAST(len(tok) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tok)) AS BIGINT) AS n_distinct,
       tok[1] AS first_token, tok[-1] AS last_token
FROM (SELECT doc_id, {O.tokens(O.normalize_text('text'))} AS tok FROM documents)""")

    register("text_preview",
             lambda s, sf: _docs(s, sf).select("doc_id", TX.text_preview("text").alias("preview")),
             f"SELECT doc_id, substring(COALESCE(text, ''), 1, {C.TEXT_PREVIEW_CHARS}) AS preview FROM documents")

    def clip(s, sf):
        c = TX.clip_text(F.col("text"))
        return _docs(s, sf).select("doc_id", c["est_tokens"].alias("est_tokens"), c["was_clipped"].alias("was_clipped"),
                                   c["near_limit"].alias("near_limit"),
                                   F.length(c["clipped_text"]).cast("bigint").alias("clipped_chars"))
    lim = C.EMBED_MAX_TOKENS * C.AVG_CHARS_PER_TOKEN
    est = f"CASE WHEN length(text) > {lim} THEN {C.EMBED_MAX_TOKENS} ELSE CAST(ceil(length(text) / {C.AVG_CHARS_PER_TOKEN}) AS BIGINT) END"
    register("clip_text", clip, f"""
SELECT doc_id, CAST({est} AS BIGINT) AS est_tokens, length(text) > {lim} AS was_clipped,
       (length(text) <= {lim}) AND ({est} > {C.EMBED_WARN_MARGIN * C.EMBED_MAX_TOKENS}) AS near_limit,
       CAST(least(length(text), {lim}) AS BIGINT) AS clipped_chars
FROM documents""")

    def cache_key(s, sf):
        c = TX.clip_text(F.col("text_normalized"))
        return TX.with_normalized_text(_docs(s, sf), "text").select(
            "doc_id", TX.embed_cache_key(c["clipped_text"]).alias("cache_key"))
    register("embed_cache_key", cache_key, f"""
SELECT doc_id, '{C.EMBEDDING_MODEL}:{C.EMBED_OUTPUT_DIM}:' || sha256(substring(tn, 1, {lim})) AS cache_key
FROM (SELECT doc_id, {O.normalize_text('text')} AS tn FROM documents)""")

    register("looks_like_sql",
             lambda s, sf: _conv(s, sf).select("conv_id", "turn", TX.looks_like_sql("text").alias("looks_like_sql")),
             """SELECT conv_id, turn, (lower(text) LIKE '%select%' AND lower(text) LIKE '%from%')
                   OR lower(text) LIKE '%with %' OR lower(text) LIKE '%;%' AS looks_like_sql FROM conversations""")

    def trunc(s, sf):
        c = _conv(s, sf)
        js = F.concat(F.lit('{"role": '), F.regexp_extract(F.to_json(F.array("role")), r"^\[(.*)\]$", 1),
                      F.lit(', "text": '), F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1),
                      F.lit("}"))
        return c.select("conv_id", "turn", TX.truncate_json(js).alias("payload"))
    register("truncate_json", trunc, f"""
SELECT conv_id, turn,
       CASE WHEN length(js) <= {C.TRUNCATE_JSON_CHARS} THEN js
            ELSE substring(js, 1, {C.TRUNCATE_JSON_CHARS - 3}) || '...' END AS payload
FROM (SELECT conv_id, turn, '{{"role": ' || to_json(role) || ', "text": ' || to_json(text) || '}}' AS js FROM conversations)""")

    register("last_user_message",
             lambda s, sf: _conv(s, sf).where(F.col("role") == "user").groupBy("conv_id")
             .agg(F.max_by("text", "turn").alias("question")),
             "SELECT conv_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id")

    # export-based text functions
    register("combine_text",
             lambda s, sf: _export(s, sf).select(*KEYS, TX.combine_text(C.TEXT_COLUMNS).alias("text_raw")),
             _ctx_export(f'SELECT {KEYS_SQL}, {O.combine_text(["oggetto", "descrizione", chr(34) + "desc" + chr(34), "note"])} AS text_raw FROM export', with_cte))
    register("normalize_region",
             lambda s, sf: _export(s, sf).select(*KEYS, TX.normalize_region("regione").alias("region")),
             _ctx_export(f"SELECT {KEYS_SQL}, {O.normalize_region('regione')} AS region FROM export", with_cte))
    register("parse_number",
             lambda s, sf: _export(s, sf).select(*KEYS, TX.parse_number("importo_ordine").alias("amount_num"),
                                                 TX.parse_number("importo_tot").alias("total_num")),
             _ctx_export(f"""SELECT {KEYS_SQL},
   COALESCE(TRY_CAST(importo_ordine AS DOUBLE), TRY_CAST(replace(importo_ordine, ',', '') AS DOUBLE)) AS amount_num,
   COALESCE(TRY_CAST(importo_tot AS DOUBLE), TRY_CAST(replace(importo_tot, ',', '') AS DOUBLE)) AS total_num
 FROM export""", with_cte))
    register("hover_text",
             lambda s, sf: _export(s, sf).select(
                 *KEYS, TX.hover_text("ordine_n", "fornitore", "tipologia", TX.text_preview("oggetto")).alias("hovertext")),
             _ctx_export(f"""SELECT {KEYS_SQL},
   'Order: ' || CAST(ordine_n AS VARCHAR) || '<br>' || 'Vendor: ' || COALESCE(fornitore, '') || '<br>'
   || 'Tipo: ' || COALESCE(tipologia, '') || '<br>' || substring(COALESCE(oggetto, ''), 1, {C.TEXT_PREVIEW_CHARS}) AS hovertext
 FROM export""", with_cte))

    sig_cols = ["ordine_n", "fornitore", "oggetto", "descrizione", "note", "importo_ordine", "data_ord"]
    register("row_signature",
             lambda s, sf: _export(s, sf).select(*KEYS, F.sha2(TX.row_signature(sig_cols), 256).alias("summary_key")),
             _ctx_export(f"""SELECT {KEYS_SQL}, sha256(to_json({{{', '.join(f"'{c}': {c}" for c in sorted(sig_cols))}}})) AS summary_key
 FROM export""", with_cte))

    register("oggetto_filled",
             lambda s, sf: FX.build_projects_raw(s, sf).select(
                 "record_id", TX.oggetto_filled("oggetto", "nome_commessa", "settore", "committente").alias("oggetto_filled")),
             with_cte(f"SELECT record_id, {O.oggetto_filled('oggetto', 'nome_commessa', 'settore', 'committente')} AS oggetto_filled FROM projects_raw",
                      projects_raw=FX.PROJECTS_RAW_SQL))


# ----------------------------------------------------------------------------- A/B/C: ingest, prepare, assemble

def _ingest(register, with_cte):
    register("row_ids", lambda s, sf: _export_ids(s, sf).select(*KEYS, "record_id"),
             _ctx_export(f"SELECT {KEYS_SQL}, record_id FROM export_ids", with_cte, ids=True))

    register("prepare_orders", lambda s, sf: P.prepare_orders(_export_ids(s, sf)),
             _ctx_export(f"""
SELECT record_id, record_id AS source_row, ordine_n AS order_id, fornitore AS vendor, text_raw, text_normalized FROM (
  SELECT *, {O.normalize_text('text_raw')} AS text_normalized FROM (
    SELECT *, {O.combine_text(['oggetto', 'descrizione', '"desc"', 'note'])} AS text_raw FROM export_ids))
WHERE length(text_normalized) > 0""", with_cte, ids=True))

    def schema_align(s, sf):
        return P.schema_align(_export(s, sf), C.RAW_SOURCE_COLUMNS).select(*KEYS, *C.RAW_SOURCE_COLUMNS)
    export_cols = ["ordine_n", "posiz_num", "data_ord", "data_consegna", "tipologia", "tipo_contratto_txt",
                   "tipo_ordine", "fornitore", "regione", "comune", "importo_ordine", "importo_tot", "oggetto",
                   "descrizione", "desc", "note"]
    cols_sql = ", ".join((f'"{c}"' if c in export_cols else f'CAST(NULL AS VARCHAR) AS "{c}"')
                         for c in C.RAW_SOURCE_COLUMNS)
    register("schema_align", schema_align, _ctx_export(f"SELECT {KEYS_SQL}, {cols_sql} FROM export", with_cte))

    register("coerce_dates",
             lambda s, sf: P.coerce_dates(_export(s, sf), ["data_ord", "data_consegna"]).select(*KEYS, "data_ord", "data_consegna"),
             _ctx_export(f"SELECT {KEYS_SQL}, TRY_CAST(data_ord AS DATE) AS data_ord, TRY_CAST(data_consegna AS DATE) AS data_consegna FROM export", with_cte))
    register("coerce_numerics",
             lambda s, sf: P.coerce_numerics(_export(s, sf), ["importo_ordine", "importo_tot"]).select(*KEYS, "importo_ordine", "importo_tot"),
             _ctx_export(f"SELECT {KEYS_SQL}, TRY_CAST(importo_ordine AS DECIMAL(18,2)) AS importo_ordine, TRY_CAST(importo_tot AS DECIMAL(18,2)) AS importo_tot FROM export", with_cte))

    derived = ["record_id", "order_code", "order_date", "delivery_date", "category", "contract_type", "order_type",
               "vendor", "region", "city", "amount", "text_raw", "text_normalized"]
    register("derive_orders", lambda s, sf: P.derive_orders(_export_ids(s, sf)).select(*derived),
             _ctx_export(f"""
SELECT record_id, ordine_n AS order_code, TRY_CAST(data_ord AS DATE) AS order_date,
       TRY_CAST(data_consegna AS DATE) AS delivery_date, tipologia AS category, tipo_contratto_txt AS contract_type,
       tipo_ordine AS order_type, fornitore AS vendor, {O.normalize_region('regione')} AS region,
       {O.clean_text('comune')} AS city, TRY_CAST(importo_ordine AS DECIMAL(18,2)) AS amount,
       text_raw, {O.normalize_text('text_raw')} AS text_normalized
FROM (SELECT *, {O.combine_text([O.clean_text(c) for c in ['oggetto', 'descrizione', '"desc"', 'note']])} AS text_raw
      FROM export_ids)""", with_cte, ids=True))

    register("rename_map",
             lambda s, sf: P.rename_map(EX.projects_export(s, sf), C.COMMESSE_RENAME_MAP),
             with_cte("""SELECT record_id, num_commessa, nome_commessa, settore, committente, oggetto,
       CAST(importo AS VARCHAR) AS importo, strftime(consegna, '%Y-%m-%d') AS consegna,
       strftime(ultimazione, '%Y-%m-%d') AS ultimazione FROM projects_raw""", projects_raw=FX.PROJECTS_RAW_SQL))

    register("derive_commesse", _projects, _ctx_projects("SELECT * FROM projects", with_cte))
    register("assemble_commesse", _commesse_assembled, _ctx_projects("""
SELECT record_id, commessa_code, ditta, nome_commessa, settore, mgo, committente, cliente, ente_appaltante, oggetto,
       oggetto_filled, importo, consegna, ultimazione, codice_gara, responsabile_commessa, responsabile_cantiere,
       preposti, text_raw, text_normalized, oggetto_embedding, num_commessa FROM commesse""", with_cte, vectors=True))

    register("drop_empty_text",
             lambda s, sf: P.drop_empty_text(TX.with_normalized_text(_docs(s, sf), "text")).select("doc_id"),
             f"SELECT doc_id FROM documents WHERE length({O.normalize_text('text')}) > 0")
    register("drop_missing_vectors",
             lambda s, sf: P.drop_missing_vectors(FX.doc_vectors(s, sf, "left"), "embedding").select("doc_id"),
             "SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.embedding IS NOT NULL")

    def enrich_category(s, sf):
        e = T.load(s, sf, "embeddings", ["vec_id"]).withColumnRenamed("vec_id", "record_id")
        raw = _export_ids(s, sf).select("record_id", "tipologia")
        return (e.join(raw, "record_id", "left")
                 .select("record_id", F.coalesce(F.col("tipologia"), F.lit("")).alias("tipologia")))
    register("enrich_category", enrich_category, _ctx_export("""
SELECT e.vec_id AS record_id, COALESCE(x.tipologia, '') AS tipologia
FROM embeddings e LEFT JOIN export_ids x ON e.vec_id = x.record_id""", with_cte, ids=True))


# ----------------------------------------------------------------------------- B9–B15, R10–R12, S15–S16

def _ov_filter(filters):
    return lambda s, sf: _orders_vec(s, sf).where(FL.order_filter(filters)).select("record_id")


def _filters_vectors(register, with_cte):
    register("filter_ilike", _ov_filter({"region": "eur", "vendor": "customer#0000001"}),
             _ctx_ov("SELECT record_id FROM order_vectors WHERE summary_embedding IS NOT NULL AND region ILIKE '%eur%' AND vendor ILIKE '%customer#0000001%'", with_cte))
    register("filter_dates", _ov_filter({"date_from": "1996-01-01", "date_to": "1996-12-31"}),
             _ctx_ov("SELECT record_id FROM order_vectors WHERE summary_embedding IS NOT NULL AND order_date >= DATE '1996-01-01' AND order_date <= DATE '1996-12-31'", with_cte))
    register("filter_amounts", _ov_filter({"min_amount": 0, "max_amount": 150000}),
             _ctx_ov("SELECT record_id FROM order_vectors WHERE summary_embedding IS NOT NULL AND amount >= 0 AND amount <= 150000", with_cte))
    combo = {"region": "a", "contract_type": "urgent", "category": "", "order_type": None, "date_from": "1995-06-01",
             "max_amount": 200000, "unknown_field": "x"}
    register("filter_combo", _ov_filter(combo), _ctx_ov("""
SELECT record_id FROM order_vectors WHERE summary_embedding IS NOT NULL AND region ILIKE '%a%'
  AND contract_type ILIKE '%urgent%' AND order_date >= DATE '1995-06-01' AND amount <= 200000""", with_cte))

    register("lookup_code",
             lambda s, sf: FL.lookup_code(_orders_vec(s, sf), "7").select("record_id", "order_code"),
             _ctx_ov("SELECT record_id, order_code FROM order_vectors WHERE order_code = '7' OR CAST(record_id AS VARCHAR) = '7' ORDER BY record_id LIMIT 1", with_cte))

    cfilt = {"settore": "mach", "date_from": "1995-01-01", "min_importo": 0}
    register("commesse_filter",
             lambda s, sf: _commesse(s, sf).where(FL.commesse_filter(cfilt)).select("record_id", "committente", "settore"),
             _ctx_projects("""SELECT record_id, committente, settore FROM commesse WHERE oggetto_embedding IS NOT NULL
  AND settore ILIKE '%mach%' AND consegna >= DATE '1995-01-01' AND importo >= 0""", with_cte, vectors=True))

    register("l2_normalize",
             lambda s, sf: T.load(s, sf, "embeddings", ["vec_id", "embedding"]).select(
                 "vec_id", F.transform(V.l2_normalize("embedding"), lambda x: F.round(x, 9)).alias("unit")),
             f"""SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x / nrm, 9)) AS unit
FROM (SELECT vec_id, embedding, CASE WHEN {O.norm('embedding')} = 0 THEN 1.0 ELSE {O.norm('embedding')} END AS nrm FROM embeddings)""")

    def cosine_pairs(s, sf):
        e = T.load(s, sf, "embeddings", ["vec_id", "embedding"])
        q = _anchor_vec(s, sf)
        c = V.cosine(F.col("embedding"), q)
        return e.select("vec_id", F.round(c, 9).alias("cosine"), F.round(V.clamp0(c), 9).alias("similarity"),
                        F.round(V.dot("embedding", q), 9).alias("dot"))
    register("cosine_pairs", cosine_pairs, f"""
SELECT vec_id, round({O.cosine('embedding', 'q')}, 9) AS cosine, round(greatest(0.0, {O.cosine('embedding', 'q')}), 9) AS similarity,
       round({O.dot('embedding', 'q')}, 9) AS dot
FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)""")

    hit_sql = """SELECT record_id, order_code, order_date, delivery_date, vendor, region, category, contract_type, order_type,
       CAST(amount AS DOUBLE) AS amount, order_summary AS summary, round(greatest(0.0, sim), 6) AS similarity"""
    sim_sql = O.cosine("summary_embedding", "(SELECT embedding FROM embeddings WHERE vec_id = 0)")

    register("semantic_orders", lambda s, sf: VS.semantic_orders(_orders_vec(s, sf), _anchor_vec(s, sf), 5),
             _ctx_ov(f"""{hit_sql} FROM (SELECT *, {sim_sql} AS sim FROM order_vectors WHERE summary_embedding IS NOT NULL)
ORDER BY round(sim, 9) DESC, record_id LIMIT 5""", with_cte))
    register("semantic_orders_filtered",
             lambda s, sf: VS.semantic_orders(_orders_vec(s, sf), _anchor_vec(s, sf), 10,
                                              {"region": "america", "min_amount": 50000, "date_to": "1999-12-31"}),
             _ctx_ov(f"""{hit_sql} FROM (SELECT *, {sim_sql} AS sim FROM order_vectors WHERE summary_embedding IS NOT NULL
  AND region ILIKE '%america%' AND amount >= 50000 AND order_date <= DATE '1999-12-31')
ORDER BY round(sim, 9) DESC, record_id LIMIT 10""", with_cte))

    anchor_sql = O.cosine("summary_embedding", "(SELECT summary_embedding FROM order_vectors WHERE order_code = '7' OR CAST(record_id AS VARCHAR) = '7' ORDER BY record_id LIMIT 1)")
    register("similar_to_order", lambda s, sf: VS.similar_to_order(_orders_vec(s, sf), "7", 5),
             _ctx_ov(f"""{hit_sql} FROM (SELECT *, {anchor_sql} AS sim FROM order_vectors WHERE summary_embedding IS NOT NULL)
ORDER BY round(sim, 9) DESC, record_id LIMIT 5""", with_cte))
    register("similar_vendors", lambda s, sf: VS.similar_vendors(_orders_vec(s, sf), "7", 5),
             _ctx_ov(f"""SELECT vendor, round(greatest(0.0, best), 6) AS similarity FROM (
  SELECT vendor, MAX({anchor_sql}) AS best FROM order_vectors WHERE vendor IS NOT NULL AND summary_embedding IS NOT NULL
  GROUP BY vendor) ORDER BY round(best, 9) DESC, vendor LIMIT 5""", with_cte))

    def similar_recent(s, sf):
        ov = _orders_vec(s, sf)
        start = F.add_months(F.lit(ov.agg(F.max("order_date")).first()[0]), -6)   # literal bound, pushed down
        return VS.semantic_orders(ov, _anchor_vec(s, sf), 5, {"date_from": start})
    register("similar_recent", similar_recent,
             _ctx_ov(f"""{hit_sql} FROM (SELECT *, {sim_sql} AS sim FROM order_vectors WHERE summary_embedding IS NOT NULL
  AND order_date >= (SELECT CAST(MAX(order_date) - INTERVAL 6 MONTH AS DATE) FROM order_vectors))
ORDER BY round(sim, 9) DESC, record_id LIMIT 5""", with_cte))

    csim = O.cosine("oggetto_embedding", "(SELECT oggetto_embedding FROM commesse WHERE commessa_code = '12' OR CAST(record_id AS VARCHAR) = '12' ORDER BY record_id LIMIT 1)")

    def semantic_commesse(s, sf):
        cm = _commesse(s, sf)
        q = VS.query_vector(FL.lookup_code(cm, "12", "commessa_code"), "oggetto_embedding")
        return VS.semantic_commesse(cm, q, 5, {"settore": "a", "max_importo": 9000})
    register("semantic_commesse", semantic_commesse, _ctx_projects(f"""
SELECT record_id, commessa_code, nome_commessa, committente, responsabile_commessa, responsabile_cantiere, settore,
       CAST(importo AS DOUBLE) AS importo, strftime(consegna, '%Y-%m-%d') AS consegna,
       strftime(ultimazione, '%Y-%m-%d') AS ultimazione, oggetto_filled AS oggetto,
       round(greatest(0.0, sim), 6) AS similarity
FROM (SELECT *, {csim} AS sim FROM commesse WHERE oggetto_embedding IS NOT NULL AND settore ILIKE '%a%' AND importo <= 9000)
ORDER BY round(sim, 9) DESC, record_id LIMIT 5""", with_cte, vectors=True))

    register("commesse_lookup",
             lambda s, sf: _commesse(s, sf).where(
                 FL.ilike_contains("oggetto_filled", "lavori") & FL.commesse_filter({"committente": "a", "min_importo": 1000}))
             .select("record_id", "commessa_code", "oggetto_filled", "committente", "responsabile_commessa", "importo"),
             _ctx_projects("""SELECT record_id, commessa_code, oggetto_filled, committente, responsabile_commessa, importo
FROM commesse WHERE oggetto_filled ILIKE '%lavori%' AND oggetto_embedding IS NOT NULL AND committente ILIKE '%a%' AND importo >= 1000""",
                           with_cte, vectors=True))


# ----------------------------------------------------------------------------- R1–R9: retrieval

def _corpus_sql(item_id: int = 0) -> dict[str, str]:
    k1, b = C.BM25_K1, C.BM25_B
    return {
        "corpus": f"""SELECT d.doc_id, d.text, {O.normalize_text('d.text')} AS tn, e.embedding AS emb
                      FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id""",
        "toks": f"SELECT doc_id, {O.tokens('tn')} AS toks FROM corpus",
        "dl": "SELECT doc_id, len(toks) AS dl FROM toks",
        "post": "SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM toks) GROUP BY ALL",
        "st": "SELECT COUNT(*) AS n, AVG(dl) AS avgdl FROM dl",
        "idf0": "SELECT term, COUNT(*) AS df, ln((SELECT n FROM st) - COUNT(*) + 0.5) - ln(COUNT(*) + 0.5) AS idf FROM post GROUP BY term",
        "idf": f"SELECT term, df, CASE WHEN idf < 0 THEN {C.BM25_EPSILON} * (SELECT AVG(idf) FROM idf0) ELSE idf END AS idf FROM idf0",
        "qt": f"""SELECT term, COUNT(*) AS qtf FROM (SELECT unnest({O.tokens(O.normalize_text('text'))}) AS term
                  FROM benchmark WHERE item_id = {item_id}) GROUP BY term""",
        "sc": f"""SELECT p.doc_id, SUM(qt.qtf * idf.idf * (p.tf * {k1 + 1}) / (p.tf + {k1} * (1 - {b} + {b} * dl.dl / (SELECT avgdl FROM st)))) AS bm25
                  FROM post p JOIN qt USING (term) JOIN idf USING (term) JOIN dl USING (doc_id) GROUP BY p.doc_id""",
        "bm": "SELECT dl.doc_id, COALESCE(sc.bm25, 0.0) AS bm25 FROM dl LEFT JOIN sc USING (doc_id)",
        "qv": f"""SELECT CAST(embedding AS DOUBLE[]) AS q,
                         CASE WHEN {O.norm('embedding')} = 0 THEN 1.0 ELSE {O.norm('embedding')} END AS qn
                  FROM embeddings WHERE vec_id = 0""",
        "qu": "SELECT list_transform(q, lambda x: x / qn) AS qu FROM qv",
        "vec": f"""SELECT doc_id, list_dot_product(list_transform(CAST(emb AS DOUBLE[]), lambda x: x / en), qu) AS vec_score
                   FROM (SELECT doc_id, emb, CASE WHEN {O.norm('emb')} = 0 THEN 1.0 ELSE {O.norm('emb')} END AS en FROM corpus), qu""",
    }


def _hybrid_sql(top_k: int, alpha: float) -> dict[str, str]:
    k = top_k * C.CANDIDATE_FACTOR
    d = _corpus_sql()
    d.update({
        "vtop": f"SELECT doc_id, vec_score FROM vec ORDER BY round(vec_score, 9) DESC, doc_id LIMIT {k}",
        "btop": f"SELECT doc_id FROM bm ORDER BY round(bm25, 9) DESC, doc_id LIMIT {k}",
        "cand": """SELECT ids.doc_id, bm.bm25, COALESCE(vtop.vec_score, 0.0) AS vec_score
                   FROM (SELECT doc_id FROM vtop UNION SELECT doc_id FROM btop) ids JOIN bm USING (doc_id)
                   LEFT JOIN vtop USING (doc_id)""",
        "mm": "SELECT MIN(vec_score) AS vmn, MAX(vec_score) AS vmx, MIN(bm25) AS bmn, MAX(bm25) AS bmx FROM cand",
        "fused": f"""SELECT doc_id, vec_score, bm25,
                       CASE WHEN vmx - vmn < {C.MINMAX_EPS} THEN 0.0 ELSE (vec_score - vmn) / (vmx - vmn) END AS vn,
                       CASE WHEN bmx - bmn < {C.MINMAX_EPS} THEN 0.0 ELSE (bm25 - bmn) / (bmx - bmn) END AS bn
                     FROM cand, mm""",
        "comb": f"SELECT *, {alpha} * vn + {1.0 - alpha} * bn AS sc FROM fused",
    })
    return d


def _retrieval(register, with_cte):
    def corpus(s, sf):
        return H.build_corpus(s, sf)

    def bm25_stats(s, sf):
        c = corpus(s, sf)
        n_terms = c.index.terms.agg(F.count(F.lit(1)).alias("n_terms"), F.avg("idf").alias("mean_idf"))
        return c.index.stats.select(
            "n_docs", F.round("avgdl", 9).alias("avgdl"),
            n_terms.select("n_terms").scalar().alias("n_terms"),
            F.round(n_terms.select("mean_idf").scalar(), 9).alias("mean_idf"))
    register("bm25_stats", bm25_stats, with_cte("""
SELECT (SELECT n FROM st) AS n_docs, round((SELECT avgdl FROM st), 9) AS avgdl, (SELECT COUNT(*) FROM idf) AS n_terms,
       round((SELECT AVG(idf) FROM idf), 9) AS mean_idf""", **_corpus_sql()))

    def bm25_scores(s, sf):
        c = corpus(s, sf)
        bm = B.score_all(c.index, B.query_terms(H.query_text(s, sf)))
        return bm.select("doc_id", F.round("bm25", 6).alias("bm25"))
    register("bm25_scores", bm25_scores, with_cte("SELECT doc_id, round(bm25, 6) AS bm25 FROM bm", **_corpus_sql()))

    def vector_topk(s, sf):
        c = corpus(s, sf)
        vtop, _, _ = H.candidates(c, B.query_terms(H.query_text(s, sf)), H.query_vec(s, sf), C.DEFAULT_TOP_K)
        return vtop.select("doc_id", F.round("vec_score", 6).alias("vec_score"))
    register("vector_topk", vector_topk, with_cte(
        f"SELECT doc_id, round(vec_score, 6) AS vec_score FROM vec ORDER BY round(vec_score, 9) DESC, doc_id LIMIT {C.DEFAULT_TOP_K * C.CANDIDATE_FACTOR}",
        **_corpus_sql()))

    def cand_parts(s, sf):
        c = corpus(s, sf)
        return c, H.candidates(c, B.query_terms(H.query_text(s, sf)), H.query_vec(s, sf), C.DEFAULT_TOP_K)

    def candidates_union(s, sf):
        _, (vtop, btop, _) = cand_parts(s, sf)
        return vtop.select("doc_id").union(btop.select("doc_id")).distinct()
    register("candidates_union", candidates_union,
             with_cte("SELECT doc_id FROM vtop UNION SELECT doc_id FROM btop", **_hybrid_sql(C.DEFAULT_TOP_K, C.DEFAULT_ALPHA)))

    def minmax_norm(s, sf):
        c, (vtop, btop, bm) = cand_parts(s, sf)
        f = H.fuse(vtop, btop, bm, "doc_id", C.DEFAULT_ALPHA)
        return f.select("doc_id", F.round("vec_score_n", 6).alias("score_vector"), F.round("bm25_n", 6).alias("score_bm25"))
    register("minmax_norm", minmax_norm,
             with_cte("SELECT doc_id, round(vn, 6) AS score_vector, round(bn, 6) AS score_bm25 FROM fused",
                      **_hybrid_sql(C.DEFAULT_TOP_K, C.DEFAULT_ALPHA)))

    def hybrid(s, sf):
        c = corpus(s, sf)
        return H.hybrid_search(c, B.query_terms(H.query_text(s, sf)), H.query_vec(s, sf), C.DEFAULT_TOP_K, C.DEFAULT_ALPHA)
    register("hybrid_search", hybrid, with_cte(f"""
SELECT comb.doc_id, round(sc, 6) AS score_combined, round(vn, 6) AS score_vector, round(bn, 6) AS score_bm25, corpus.text
FROM comb JOIN corpus USING (doc_id) ORDER BY round(sc, 9) DESC, comb.doc_id LIMIT {C.DEFAULT_TOP_K}""",
                                               **_hybrid_sql(C.DEFAULT_TOP_K, C.DEFAULT_ALPHA)))
