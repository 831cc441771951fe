"""Registration: stored tables, the orders job, checked exports, coercion by vote, payload chains, the catalogue,
the vector store, and proofs of set operations, the comparator and the projection."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import config as C
from ..functions import text as TX
from ..operators import ann as ANN
from ..operators import date_votes as DV
from ..operators import enrich as EN
from ..operators import prepare as P
from ..operators.observed import Counters
from ..session import in_rounds, shared_dir
from ..sources import exports as EX
from ..sources import fixtures as FX
from ..sources import ingest as IN
from ..sources import payload as PL
from ..sources import schema as S
from ..sources import tables as T
from ..sources.versioned import VersionedTable
from . import etl
from . import extra as X
from . import extra2 as X2
from . import oracle_text as O
from .compare import compared

KEYS = EX.SOURCE_ORDER
KEYS_SQL = ", ".join(KEYS)


def register_all(register, with_cte) -> None:
    _stored(register, with_cte)
    _ingest(register, with_cte)
    _vectors(register, with_cte)
    _proofs(register, with_cte)


def _new_table(s, name: str, key: str) -> VersionedTable:
    return VersionedTable(s, shared_dir(s, "stored", f"{name}-{uuid.uuid4().hex}"), key)


# ----------------------------------------------------------------------------- A5 / A6 / A8 / G3 / the job

ORDER_TABLE = ST.StructType([ST.StructField("record_id", ST.LongType()), ST.StructField("status", ST.StringType()),
                             ST.StructField("amount", ST.DecimalType(18, 2)), ST.StructField("order_date", ST.DateType()),
                             ST.StructField("note", ST.StringType())])


def _order_rows(s, sf):
    o = T.load(s, sf, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    return o.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("string").alias("amount"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), F.col("o_orderpriority").alias("priority"))


def _reloaded(s, sf) -> VersionedTable:
    """A5: the orders as text, loaded twice into a typed table (a missing column is NULL, an extra one goes)."""
    t = _new_table(s, "orders", "record_id")
    t.reload(_order_rows(s, sf).where("status = 'F'"), ORDER_TABLE, part_rows=5000)
    t.reload(_order_rows(s, sf), ORDER_TABLE, part_rows=5000)
    return t


_RELOADED_SQL = """SELECT o_orderkey AS record_id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
       CAST(o_orderdate AS DATE) AS order_date, CAST(NULL AS VARCHAR) AS note FROM orders"""


def _stored(register, with_cte):
    register("reload_orders", lambda s, sf: _reloaded(s, sf).read(), _RELOADED_SQL)

    def upserted(s, sf):
        """Two revisions of the orders of the newest year and one new order, into storage."""
        t = _reloaded(s, sf)
        rows = t.read()
        newest = rows.where(F.year("order_date") == rows.agg(F.year(F.max("order_date"))).scalar())
        revise = [newest.withColumns({"status": F.lit(st), "amount": (F.col("amount") * x).cast("decimal(18,2)"), "seq": F.lit(n)}) for st, x, n in (("R", 2, 1), ("P", 3, 2))]
        added = rows.agg((F.max("record_id") + 1).alias("record_id")).select("record_id", F.lit("N").alias("status"), F.lit(1).cast("decimal(18,2)").alias("amount"),
                                                                             F.lit("2002-01-01").cast("date").alias("order_date"), F.lit("new").alias("note"), F.lit(1).alias("seq"))
        t.upsert(revise[1].unionByName(revise[0]).unionByName(added), "seq")
        return t.read()
    register("upsert_stored", upserted, with_cte("""
SELECT record_id, CASE WHEN n THEN 'P' ELSE status END AS status, CASE WHEN n THEN CAST(amount * 3 AS DECIMAL(18,2)) ELSE amount END AS amount, order_date, note
FROM (SELECT *, year(order_date) = (SELECT year(MAX(order_date)) FROM t) AS n FROM t)
UNION ALL SELECT MAX(record_id) + 1, 'N', CAST(1 AS DECIMAL(18,2)), DATE '2002-01-01', 'new' FROM t""", t=_RELOADED_SQL))

    def catalog(s, sf):
        """Both db-ready tables, stored with their descriptions; the listing reads the version files only."""
        tables = {}
        for name, df in (("orders", _ready(s, sf)), ("commesse", X._commesse(s, sf))):
            tables[name] = _new_table(s, name, "record_id")
            tables[name].reload(S.described(df, name))
        return S.stored_catalog(s, tables)

    def listed(table, columns, types, descriptions):
        return [f"({O.q(table)}, {i}, {O.q(c)}, {O.q(types.get(c, 'string'))}, {O.q(descriptions.get(c, S.RAW_DEFAULT))})" for i, c in enumerate(columns)]
    rows = listed("orders", P.ORDER_READY_COLUMNS, _TYPES, S.ORDERS_DESCRIPTIONS) + listed("commesse", P.PROJECT_READY_COLUMNS, _PROJECT_TYPES, S.COMMESSE_DESCRIPTIONS)
    register("schema_catalog", catalog, f"SELECT table_name, CAST(position AS INTEGER) AS position, column_name, type, description FROM (VALUES {', '.join(rows)}) AS t(table_name, position, column_name, type, description)")

    register("project_ready", lambda s, sf: _ready(s, sf).drop("summary_embedding"), X._ctx_export(_READY_SQL, with_cte, ids=True))

    def job(s, sf):
        """The whole orders job on an export in CSV, twice; the second run makes no vector and no summary."""
        path = shared_dir(s, "etl", uuid.uuid4().hex)
        IN.write_csv(X._export(s, sf), f"{path}/export", "gzip")
        names = {k: f"{path}/{k}" for k in ("orders", "vectors", "summaries")}
        result = [etl.run_orders_etl(s, names["orders"], names["vectors"], f"{path}/export", order_by=KEYS, summaries=names["summaries"], dim=64) for _ in range(2)][-1]
        c = result.counts
        stored = VersionedTable(s, names["orders"], "record_id").read()
        return stored.agg(F.count(F.lit(1)).alias("stored"), F.count_distinct("summary_normalized").alias("texts"), F.sum("amount").alias("amount")).select(
            F.lit(result.version).alias("version"), F.lit(c["export"]["rows"]).alias("exported"), F.lit(c["rejected"]).alias("rejected"), "stored", "texts", "amount",
            F.lit(c["summaries"]["dropped"]).alias("without_text"), F.lit(c["summaries_pending"]).alias("summaries_made"), F.lit(c["vectors_made"]).alias("vectors_made"))
    register("orders_etl", job, X._ctx_export(f"""
, r AS (SELECT TRY_CAST(importo_ordine AS DECIMAL(18,2)) AS amount, {O.normalize_text("split_part(" + O.combine_text(['oggetto', 'descrizione', '"desc"', 'note']) + ", ' | ', 1)")} AS n FROM export)
SELECT 2 AS version, COUNT(*) AS exported, 0 AS rejected, COUNT(*) FILTER (WHERE n <> '') AS stored, COUNT(DISTINCT n) FILTER (WHERE n <> '') AS texts,
       SUM(amount) FILTER (WHERE n <> '') AS amount, COUNT(*) FILTER (WHERE n = '') AS without_text,
       COUNT(*) FILTER (WHERE n = '') AS summaries_made, 0 AS vectors_made FROM r""", with_cte))


def _ready(s, sf):
    """The db-ready orders with every declared column, once and in order (one build per input version)."""
    from ..session import materialize
    inputs = [T.path(sf, t) for t in ("lineitem", "orders", "part", "supplier", "nation", "region", "embeddings")]
    vec = T.load(s, sf, "embeddings", ["vec_id", "embedding"]).withColumnRenamed("vec_id", "record_id")

    def assembled():
        ids, n = X._export_ids(s, sf), vec.count()
        # more vectors than ids are sent out for: the rows are put together in rounds
        rounds = in_rounds(ids, "record_id", ids.count() if n > P.BROADCAST_IDS else 0)
        return [P.assemble_orders(x, EN.summary_job(EN.summary_keys(x.withColumn("text_raw", TX.combine_text(C.TEXT_COLUMNS)), etl.SIGNATURE), None), vec, n_vectors=n)
                for x in rounds]
    return materialize(s, "orders_ready", inputs, assembled)


_TYPES = {"record_id": "bigint", "source_row": "bigint", "order_date": "date", "delivery_date": "date", "amount": "decimal(18,2)", "summary_embedding": "array<float>"} \
    | {c: "date" for c in C.RAW_DATE_COLUMNS} | {c: "decimal(18,2)" for c in C.RAW_NUMERIC_COLUMNS} | {c: "decimal(38,10)" for c in C.WIDE_NUMERIC_COLUMNS}


_PROJECT_TYPES = {"record_id": "bigint", "importo": "decimal(18,2)", "consegna": "date", "ultimazione": "date", "oggetto_embedding": "array<float>"}


def _ready_sql() -> str:
    export = ["ordine_n", "posiz_num", "data_ord", "data_consegna", "tipologia", "tipo_contratto_txt", "tipo_ordine", "fornitore", "regione", "comune",
              "importo_ordine", "importo_tot", "oggetto", "descrizione", "desc", "note"]
    q = {c: f'"{c}"' for c in export}
    made = {"record_id": "x.record_id", "source_row": "x.record_id", "order_code": "ordine_n", "order_date": "TRY_CAST(data_ord AS DATE)", "delivery_date": "TRY_CAST(data_consegna AS DATE)",
            "category": "tipologia", "contract_type": "tipo_contratto_txt", "order_type": "tipo_ordine", "vendor": "fornitore", "region": O.normalize_region("regione"),
            "city": O.clean_text("comune"), "province": "''", "country": "''", "amount": "TRY_CAST(importo_ordine AS DECIMAL(18,2))", "text_raw": "text_clean",
            "text_normalized": O.normalize_text("text_clean"), "order_summary": _FIRST, "summary_normalized": O.normalize_text(_FIRST)}
    cols = []
    for c in P.ORDER_READY_COLUMNS:
        if c == "summary_embedding":
            continue
        if c in made:
            e = made[c]
        elif c in C.RAW_DATE_COLUMNS:
            e = f"TRY_CAST({q.get(c, 'NULL')} AS DATE)"
        elif c in C.RAW_NUMERIC_COLUMNS:
            e = f"TRY_CAST({q.get(c, 'NULL')} AS {_TYPES[c].upper()})"
        elif c in C.TEXT_COLUMNS:
            e = O.clean_text(q[c])
        else:
            e = q.get(c, "CAST(NULL AS VARCHAR)")
        cols.append(f'{e} AS "{c}"')
    return f"""
SELECT {', '.join(cols)}
FROM (SELECT *, {O.combine_text([O.clean_text(c) for c in ['oggetto', 'descrizione', '"desc"', 'note']])} AS text_clean,
             {O.combine_text(['oggetto', 'descrizione', '"desc"', 'note'])} AS text_orig FROM export_ids) x
JOIN embeddings e ON x.record_id = e.vec_id"""


_FIRST = "trim(CASE WHEN position(' | ' IN text_orig) > 0 THEN substr(text_orig, 1, position(' | ' IN text_orig) - 1) ELSE text_orig END)"
_READY_SQL = _ready_sql()


# ----------------------------------------------------------------------------- A1 / A11 / B5 / B6 / B7

def _ingest(register, with_cte):
    def rejects(s, sf):
        """A damaged export, line by line: lines that lost their end or have a field too many are set apart."""
        p = FX.procurement(s, sf)
        fields = [F.col(c).cast("string") for c in KEYS] + [F.concat(F.lit('"'), F.col("descr"), F.lit(', with ""quotes"""')), F.coalesce(F.col("amount").cast("string"), F.lit(""))]
        line = F.concat_ws(",", *fields)
        damaged = F.when(F.col("order_type") == "A", F.concat_ws(",", *fields[:3])).when(F.col("amount").isNull(), F.concat(line, F.lit(",one more"))).otherwise(line)
        path = shared_dir(s, "damaged", uuid.uuid4().hex)
        header = ",".join([*KEYS, "descr", "amount"])
        # every file of an export begins with its header
        p.select(damaged.alias("value")).mapInPandas(lambda bs: _with_header(bs, header), "value string").write.text(path)
        good, bad = IN.read_checked(s, path)
        return bad.select(F.lit("rejected").alias("kind"), "record").unionByName(
            good.select(F.lit("accepted").alias("kind"), F.concat_ws("|", *KEYS, "descr", F.coalesce("amount", F.lit(""))).alias("record")))
    register("export_rejects", rejects, with_cte(f'''
SELECT CASE WHEN order_type = 'A' OR amount IS NULL THEN 'rejected' ELSE 'accepted' END AS kind,
       CASE WHEN order_type = 'A' THEN concat_ws(',', l_orderkey, l_linenumber, l_partkey)
            WHEN amount IS NULL THEN concat_ws(',', {KEYS_SQL}, '"' || descr || ', with ""quotes"""', '', 'one more')
            ELSE concat_ws('|', {KEYS_SQL}, descr || ', with "quotes"', CAST(amount AS VARCHAR)) END AS record FROM procurement''', procurement=FX.PROCUREMENT_SQL))

    def mixed(s, sf):
        """Order dates in several spellings, some of them no dates."""
        day, line = F.col("order_date"), F.col("l_linenumber")
        spelled = F.when(line == 6, F.lit("31.02.2024")).when(line == 7, F.lit(" "))
        for n, pattern in ((1, "dd/MM/yyyy"), (2, "yyyyMMdd"), (3, "yyyy/MM/dd"), (4, "d MMM yyyy"), (5, "yyyy-MM-dd'T'HH:mm:ss")):
            spelled = spelled.when(line == n, F.date_format(day, pattern))
        return DV.coerce_dates(FX.procurement(s, sf).select(*KEYS, spelled.otherwise(F.date_format(day, "yyyy-MM-dd")).alias("day")), ["day"])
    register("coerce_dates_mixed", mixed, with_cte(
        f"SELECT {KEYS_SQL}, CASE WHEN l_linenumber IN (6, 7) THEN NULL ELSE order_date END AS day, l_linenumber = 6 AS day_rejected FROM procurement", procurement=FX.PROCUREMENT_SQL))

    def wide(s, sf):
        e = T.load(s, sf, "events", ["event_id", "value"])
        text = F.concat(F.format_string("%d", F.floor("value").cast("long")), F.lit(".1234567"))
        return P.coerce_wide_numerics(e.select("event_id", F.when(F.col("event_id") % 10 == 3, "n/a").otherwise(text).alias("qta")), ["qta"]) \
            .select("event_id", F.col("qta").cast("string").alias("qta"))
    register("coerce_numerics_wide", wide, """
SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.1234567000' END AS qta FROM events""")

    def dropped(s, sf):
        """One pass keeps the rows with text and counts the others."""
        counters = Counters()
        ids = X._export_ids(s, sf).select("record_id", F.when(F.col("note").isNull(), "").otherwise(F.col("note")).alias("text_normalized"))
        kept = counters.drop_empty_text(ids)
        n = kept.agg(F.count(F.lit(1)).alias("kept")).first()["kept"]
        c = counters.read()["empty_text"]
        return s.range(1).select(F.lit(n).alias("kept"), F.lit(c["dropped"]).alias("dropped"), F.lit(c["rows"]).alias("seen"))
    register("drop_empty_text_counted", dropped, X._ctx_export(
        "SELECT COUNT(*) FILTER (WHERE note <> '') AS kept, COUNT(*) - COUNT(*) FILTER (WHERE note <> '') AS dropped, COUNT(*) AS seen FROM export_ids", with_cte, ids=True))

    def chains(s, sf):
        pages = PL.long_pages(s, sf)
        return PL.payload_chains(pages, pages.count())
    register("payload_chains", chains, with_cte("""
SELECT doc_id, 2 * line AS page, 0 AS item_pos, code, description, FALSE AS open FROM lines
UNION ALL SELECT doc_id, 2 * line, -1, code, 'then ' || description, TRUE FROM lines QUALIFY line = MAX(line) OVER (PARTITION BY doc_id)""", lines=PL.lines_sql()))


def _with_header(batches, header: str):
    import pandas as pd
    yield pd.DataFrame({"value": [header]})
    yield from batches


# ----------------------------------------------------------------------------- U1 / C4

def letter_shares(texts: list[str]) -> np.ndarray:
    """A model that SQL can follow: counts of four letters, and one."""
    return np.array([[t.count("a"), t.count("e"), t.count("o"), t.count(" "), 1.0] for t in texts], dtype=np.float32)


def _vectors(register, with_cte):
    limit = C.EMBED_MAX_TOKENS * C.AVG_CHARS_PER_TOKEN

    def stored(s, sf):
        """The labelled documents are embedded into a new store, then all documents: only the rest reaches the model."""
        docs = X2.prepared_documents(s, sf)
        store = _new_table(s, "vectors", "cache_key")
        labelled = docs.join(T.load(s, sf, "labels", ["doc_id"]), "doc_id", "left_semi")
        _, first = etl.embed_into_store(labelled, "text_normalized", store, 5, letter_shares, "letters")
        rows, second = etl.embed_into_store(docs, "text_normalized", store, 5, letter_shares, "letters")
        _, third = etl.embed_into_store(docs, "text_normalized", store, 5, letter_shares, "letters")
        store.compact(1)
        v = store.read().select("cache_key", F.transform("embedding", lambda x: F.round(x.cast("double"), 3)).alias("v"))
        return rows.select("doc_id", "cache_key", "over_limit").join(v, "cache_key").select(
            "doc_id", "cache_key", "over_limit", *[F.col("v")[i].alias(f"v{i}") for i in range(5)],
            F.lit(first).alias("first_run"), F.lit(second).alias("second_run"), F.lit(third).alias("third_run"))
    parts = ", ".join(f"(len(t) - len(replace(t, '{c}', '')))" for c in "aeo ") + ", 1"
    register("embed_store", stored, f"""
WITH d AS (SELECT doc_id, {O.normalize_text('text')} AS tn FROM documents),
k AS (SELECT doc_id, tn, 'letters:5:' || sha256(tn) AS cache_key FROM d),
t AS (SELECT cache_key, tn, unnest(range(0, greatest(len(tn), 1), {limit})) AS a FROM (SELECT DISTINCT cache_key, tn FROM k)),
p AS (SELECT cache_key, len(t) / greatest(len(tn), 1)::DOUBLE AS share, len(tn) AS n, [{parts}]::DOUBLE[] AS v FROM (SELECT *, substring(tn, a + 1, {limit}) AS t FROM t)),
u AS (SELECT cache_key, CASE WHEN n = 0 THEN 1 ELSE share END AS share, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM p),
m AS (SELECT cache_key, [SUM(v[1] * share), SUM(v[2] * share), SUM(v[3] * share), SUM(v[4] * share), SUM(v[5] * share)] AS v FROM u GROUP BY cache_key),
w AS (SELECT cache_key, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 3)) AS v FROM m),
f AS (SELECT COUNT(DISTINCT cache_key) AS n FROM k WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, k.cache_key, len(tn) > {limit} AS over_limit, v[1] AS v0, v[2] AS v1, v[3] AS v2, v[4] AS v3, v[5] AS v4,
       (SELECT n FROM f) AS first_run, (SELECT COUNT(*) FROM w) - (SELECT n FROM f) AS second_run, 0 AS third_run
FROM k JOIN w USING (cache_key)""")


# ----------------------------------------------------------------------------- G4 / D48 / U3

def _proofs(register, with_cte):
    text = ("SELECT city FROM orders WHERE category = 'SMALL' INTERSECT SELECT city FROM orders WHERE category = 'LARGE' "
            "EXCEPT SELECT city FROM orders WHERE region = 'ASIA' UNION SELECT region FROM orders WHERE amount IS NULL")
    register("sql_setops_rows", lambda s, sf: X2.guard_for(s, sf).run(text).df, X2._guard_ctes(with_cte, f"SELECT * FROM ({text}) LIMIT 200"))

    def facts(s, sf):
        """The two coordinates are uncorrelated and ordered by variance, and hold no more of it than there is."""
        e = T.load(s, sf, "embeddings", ["vec_id", "embedding"])
        p = ANN.project_2d(e, "vec_id", "embedding").join(e, "vec_id")
        dim = e.select(F.size("embedding")).first()[0]
        moved = p.select("x", "y", *[F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(dim)])
        total = sum((F.var_pop(f"c{i}") for i in range(dim)), F.lit(0.0))
        return moved.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.corr("x", "y")) < 1e-6).alias("uncorrelated"), (F.var_pop("x") >= F.var_pop("y")).alias("ordered"),
                         (F.var_pop("x") + F.var_pop("y") <= total).alias("within_total"), F.round(total, 6).alias("total_variance"))
    register("project_2d_facts", facts, """
SELECT COUNT(*) AS n, TRUE AS uncorrelated, TRUE AS ordered, TRUE AS within_total,
       round((SELECT SUM(v) FROM (SELECT var_pop(c) AS v FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS c FROM embeddings) GROUP BY i)), 6) AS total_variance
FROM embeddings""")

    def values(s, sf):
        """Per vendor: the day of its first order as text, and its total, of which some answers lack the named column."""
        p = FX.procurement(s, sf).where(F.col("vendor").isNotNull())
        per = p.groupBy("vendor").agg(F.min("order_date").alias("first_day"), F.sum("amount").cast("double").alias("spend"), F.count(F.lit(1)).alias("n"))
        answers = per.withColumn("day", F.date_format("first_day", "yyyy-MM-dd")).withColumn("total", F.when(F.col("n") % 2 == 0, F.col("spend") * 1.0005))
        dates = compared(answers, "first_day", "day", ["day", "n"]).select("vendor", F.lit("first_day").alias("name"), "ok", "reason")
        return dates.unionByName(compared(answers, "spend", "total", ["day", "total", "n"]).select("vendor", F.lit("spend").alias("name"), "ok", "reason")) \
            .unionByName(compared(answers, "n", "missing", ["day", "n"]).select("vendor", F.lit("n").alias("name"), "ok", "reason"))
    register("compare_values", values, with_cte("""
SELECT vendor, 'first_day' AS name, TRUE AS ok, 'compared as text' AS reason FROM per
UNION ALL SELECT vendor, 'spend', n % 2 = 0, 'compared as numbers' FROM per
UNION ALL SELECT vendor, 'n', TRUE, 'compared as numbers' FROM per""", procurement=FX.PROCUREMENT_SQL, per="SELECT vendor, COUNT(*) AS n FROM procurement WHERE vendor IS NOT NULL GROUP BY vendor"))
