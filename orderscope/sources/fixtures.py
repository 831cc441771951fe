"""Derived views that stand for the procurement tables.

* ``procurement`` – db-ready order lines (line grain): lineitem ⋈ orders ⋈
  part ⋈ supplier ⋈ nation ⋈ region, NULLs injected by fixed rules.
* ``order_vectors`` – order grain with a unit vector: embeddings ⋈ orders ⋈
  customer ⋈ nation ⋈ region.
* ``projects`` – commesse stand-in: customer ⋈ nation ⟕ order-date range.
* ``doc_vectors`` – documents ⟕ embeddings (retrieval corpus).

Every view is written once per input fingerprint to the shared checkpoint
folder (see ``session.materialize``), so analytic queries scan a narrow,
date-sorted parquet instead of re-running the five-way join.

Join strategy at scale: lineitem ⋈ orders and ⋈ part are large-large
equi-joins (sort-merge on the key; AQE may switch to broadcast when a side
turns out small at run time). supplier is joined after being pre-joined
with nation and region — nation/region are fixed-size (25/5 rows) and the
only sides always broadcast by hint; supplier itself up to the engine's row bound.
Each ``*_SQL`` string is the same definition for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ENGINE
from ..operators.ranking import with_ids_by_group
from ..session import in_rounds, materialize, written_once
from . import tables as T

# ---------------------------------------------------------------------------
# procurement (line grain)
# ---------------------------------------------------------------------------

PROCUREMENT_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "order_code", "order_date",
    "delivery_date", "category", "contract_type", "order_type", "vendor", "region", "city",
    "amount", "importo_tot", "descr", "codice", "order_summary",
]


def build_procurement(spark: SparkSession, sf_dir: str, ids: bool = False) -> list[DataFrame]:
    """The joined lines, in rounds; ``ids`` adds ``record_id``, their place in the order of the line key.

    One large join at a time: the lines take what the table needs of their order, then of their supplier, then of their
    part, and each result is written before the next join moves it, so that the disk holds one shuffle of the lines at once."""
    li = T.load(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                            "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                            "l_returnflag", "l_linestatus", "l_shipdate"])
    o = T.load(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    p = T.load(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type"])
    s = T.load(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    n = T.load(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = T.load(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    # fixed-size dimensions: broadcast is bounded by construction (25 and 5 rows)
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    sup = s.join(F.broadcast(geo), s.s_nationkey == geo.n_nationkey).select(
        "s_suppkey", F.when(F.col("s_suppkey") % 37 == 0, F.lit(None).cast("string")).otherwise(F.col("s_name")).alias("vendor"),
        F.col("r_name").alias("region"), F.col("n_name").alias("city"))
    amount = F.when(F.col("l_quantity") == 50, F.lit(None)).otherwise(F.col("l_extendedprice")) \
        .cast("decimal(18,2)")
    # partitions that grow with the lines: the joined, wider rows are sorted by date without spilling
    parts = T.partitions_for(li)
    # what the table shows of a line, before the line is moved
    li = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", amount.alias("amount"), (F.col("l_discount") == 0).alias("_whole"),
        (F.col("l_tax") == 0).alias("_untaxed"), F.col("l_returnflag").alias("order_type"),
        F.when(F.col("l_linestatus") == "O", F.lit(None).cast("date")).otherwise(F.col("l_shipdate").cast("date")).alias("delivery_date"))
    o = o.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("_total"), F.col("o_orderdate").cast("date").alias("order_date"),
                 F.col("o_orderpriority").alias("contract_type"))
    n_lines = li.count()

    def ordered(x, n):
        return x.repartition(n, "l_orderkey").join(o.repartition(n, "o_orderkey"), x.l_orderkey == o.o_orderkey).select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "order_date", "delivery_date", "contract_type", "order_type", "amount",
            F.when(F.col("_whole"), F.col("amount")).otherwise(F.col("_total")).alias("importo_tot"), "_untaxed")
    rounds = in_rounds(li, "l_orderkey", n_lines)
    lines = written_once([ordered(x, -(-parts // len(rounds))) for x in rounds], "lines-of-orders")
    small = s.count() <= ENGINE.broadcast_row_limit
    if not small:
        lines = written_once([x.join(sup, x.l_suppkey == sup.s_suppkey).drop("s_suppkey") for x in in_rounds(lines, "l_suppkey", n_lines)],
                             "lines-of-suppliers", instead_of=lines)

    def placed(x):
        joined = x.join(p, x.l_partkey == p.p_partkey)
        if small:
            joined = joined.join(F.broadcast(sup), x.l_suppkey == sup.s_suppkey)
        return joined.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("l_orderkey").cast("string").alias("order_code"), "order_date", "delivery_date",
            F.col("p_type").alias("category"), "contract_type", "order_type", "vendor", "region", "city", "amount", "importo_tot",
            F.col("p_name").alias("descr"),
            F.col("p_brand").alias("codice"),
            F.when(F.col("_untaxed"), F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("order_summary"))
    joined = [placed(x) for x in in_rounds(lines, "l_partkey", n_lines)]
    if not ids:
        return joined
    # numbered behind the joins, which drop lines without a part or supplier and repeat those with two
    return with_ids_by_group(written_once(joined, "joined-lines", instead_of=lines), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "record_id", parts)


def procurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The db-ready line table, materialised once and sorted by order_date inside files."""
    inputs = [T.path(sf_dir, t) for t in ("lineitem", "orders", "part", "supplier", "nation", "region")]
    return materialize(spark, "procurement", inputs, lambda: build_procurement(spark, sf_dir),
                       sort_within=["order_date"])


PROCUREMENT_SQL = """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
       CAST(l.l_orderkey AS VARCHAR) AS order_code,
       CAST(o.o_orderdate AS DATE) AS order_date,
       CASE WHEN l.l_linestatus = 'O' THEN NULL ELSE CAST(l.l_shipdate AS DATE) END AS delivery_date,
       p.p_type AS category,
       o.o_orderpriority AS contract_type,
       l.l_returnflag AS order_type,
       CASE WHEN s.s_suppkey % 37 = 0 THEN NULL ELSE s.s_name END AS vendor,
       r.r_name AS region,
       n.n_name AS city,
       CASE WHEN l.l_quantity = 50 THEN NULL ELSE CAST(l.l_extendedprice AS DECIMAL(18,2)) END AS amount,
       CASE WHEN l.l_discount = 0
            THEN (CASE WHEN l.l_quantity = 50 THEN NULL ELSE CAST(l.l_extendedprice AS DECIMAL(18,2)) END)
            ELSE CAST(o.o_totalprice AS DECIMAL(18,2)) END AS importo_tot,
       p.p_name AS descr,
       p.p_brand AS codice,
       CASE WHEN l.l_tax = 0 THEN NULL ELSE p.p_name END AS order_summary
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

# ---------------------------------------------------------------------------
# order vectors (order grain, one unit vector per order)
# ---------------------------------------------------------------------------


def build_order_vectors(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """``how`` "right" keeps the orders without a vector."""
    e = T.load(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    o = T.load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                         "o_orderdate", "o_orderpriority"])
    c = T.load(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    n = T.load(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = T.load(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    cust = c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey)
    df = e.join(o, e.vec_id == o.o_orderkey, how).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return df.select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_orderkey").cast("string").alias("order_code"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("date"))
         .otherwise(F.col("o_orderdate").cast("date")).alias("delivery_date"),
        F.col("c_name").alias("vendor"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("category"),
        F.col("o_orderpriority").alias("contract_type"),
        F.col("o_orderstatus").alias("order_type"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.concat_ws(" ", F.col("c_mktsegment"), F.col("o_orderpriority")).alias("order_summary"),
        F.col("embedding").alias("summary_embedding"),
    )


def order_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = [T.path(sf_dir, t) for t in ("embeddings", "orders", "customer", "nation", "region")]
    return materialize(spark, "order_vectors", inputs, lambda: build_order_vectors(spark, sf_dir))


ORDER_VECTORS_SQL = """
SELECT o.o_orderkey AS record_id,
       CAST(o.o_orderkey AS VARCHAR) AS order_code,
       CAST(o.o_orderdate AS DATE) AS order_date,
       CASE WHEN o.o_orderstatus = 'O' THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS delivery_date,
       c.c_name AS vendor,
       r.r_name AS region,
       c.c_mktsegment AS category,
       o.o_orderpriority AS contract_type,
       o.o_orderstatus AS order_type,
       CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount,
       c.c_mktsegment || ' ' || o.o_orderpriority AS order_summary,
       e.embedding AS summary_embedding
FROM embeddings e
JOIN orders o ON e.vec_id = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

# ---------------------------------------------------------------------------
# projects (commesse stand-in)
# ---------------------------------------------------------------------------


def build_projects_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw projects export: source column names as in the project workbook."""
    # spread over the slots: the texts derived from one small file's rows are the work
    c = T.load_balanced(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    n = T.load(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    o = T.load(spark, sf_dir, "orders", ["o_custkey", "o_orderdate"])
    # pre-aggregate before the join: one row per customer
    span = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_o"), F.max("o_orderdate").alias("last_o"))
    df = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(span, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_custkey") % 5
    return df.select(
        F.col("c_custkey").alias("record_id"),
        F.col("c_custkey").cast("string").alias("num_commessa"),
        F.col("c_name").alias("nome_commessa"),
        F.col("c_mktsegment").alias("settore"),
        F.col("n_name").alias("committente"),
        F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("  "))
         .otherwise(F.concat(F.lit("Lavori  "), F.col("c_mktsegment"))).alias("oggetto"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("importo"),
        F.col("first_o").cast("date").alias("consegna"),
        F.col("last_o").cast("date").alias("ultimazione"),
    )


PROJECTS_RAW_SQL = """
SELECT c.c_custkey AS record_id,
       CAST(c.c_custkey AS VARCHAR) AS num_commessa,
       c.c_name AS nome_commessa,
       c.c_mktsegment AS settore,
       n.n_name AS committente,
       CASE WHEN c.c_custkey % 5 = 0 THEN NULL WHEN c.c_custkey % 5 = 1 THEN '  '
            ELSE 'Lavori  ' || c.c_mktsegment END AS oggetto,
       CAST(c.c_acctbal AS DECIMAL(18,2)) AS importo,
       CAST(sp.first_o AS DATE) AS consegna,
       CAST(sp.last_o AS DATE) AS ultimazione
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_o, max(o_orderdate) AS last_o
           FROM orders GROUP BY o_custkey) sp ON c.c_custkey = sp.o_custkey
"""

# ---------------------------------------------------------------------------
# documents with vectors (retrieval corpus)
# ---------------------------------------------------------------------------


def doc_vectors(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    d = T.load_balanced(spark, sf_dir, "documents", ["doc_id", "text"])
    e = T.load(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return d.join(e, d.doc_id == e.vec_id, how).drop("vec_id")
