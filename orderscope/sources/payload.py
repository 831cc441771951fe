"""Page payloads: the nested JSON contract of extracted document pages.

Contract: ``{items: [{code, description, quantity, unit_price, total_price}],
continuation: {pending_code, pending_description}}``, all fields nullable;
``items`` and ``continuation`` are required.

The pages are derived from the order lines: each order is a document, three
lines per page; when a page is followed by another, the first item of the
next page is cut at the page break — the first half of its description is
reported on this page as ``continuation``, the rest opens the next page.

* ``payload_items`` (A10): ``from_json`` with the fixed schema, pages with a
  missing ``items`` or ``continuation`` are rejected, items unnested with
  their position (``posexplode`` keeps the top-to-bottom order).
* ``payload_stitch`` (A11): the text cut at a page end is joined to the first
  item of the next page. Pages are matched with an equi-join on
  (document, page − 1) rather than a window over the document, so a huge
  document's pages still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import rank_within_groups
from ..session import in_rounds, written_once
from . import tables as TB

LINES_PER_PAGE = 3
#: Pages of a document that one window orders.
PAGES_PER_RUN = 1000

ITEM = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("quantity", T.StringType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("total_price", T.DoubleType()),
])
PAYLOAD = T.StructType([
    T.StructField("items", T.ArrayType(ITEM)),
    T.StructField("continuation", T.StructType([
        T.StructField("pending_code", T.StringType()),
        T.StructField("pending_description", T.StringType()),
    ])),
])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, payload JSON): the extracted pages, written once per input version."""
    from ..session import materialize
    inputs = [TB.path(sf_dir, "lineitem"), TB.path(sf_dir, "part")]
    return materialize(spark, "page_payloads", inputs, lambda: build_pages(spark, sf_dir))


def build_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, payload JSON) built from lineitem ⋈ part."""
    li = TB.load(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                             "l_extendedprice"])
    p = TB.load(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
    # line numbers repeat inside an order: position = rank by (line, part, supplier)
    pos = rank_within_groups(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "line", TB.partitions_for(li))
    lines = pos.join(p, pos.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("doc_id"),
        "line",
        F.col("l_partkey").alias("partkey"),
        (F.col("line") / LINES_PER_PAGE).cast("int").alias("page"),
        F.col("p_brand").alias("code"),
        F.col("p_name").alias("description"),
        F.col("l_quantity").cast("string").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("total_price"))
    half = F.floor(F.length("description") / 2).cast("int")
    first_of_page = (F.col("line") % LINES_PER_PAGE) == 0
    lines = lines.withColumn("cut", first_of_page & (F.col("page") > 0)) \
                 .withColumn("head", F.substring("description", 1, half)) \
                 .withColumn("tail", F.expr("substring(description, floor(length(description) / 2) + 1)"))
    shown = lines.withColumn("description", F.when(F.col("cut"), F.col("tail")).otherwise(F.col("description")))
    item = F.struct("line", "partkey", "code", "description", "quantity", "unit_price", "total_price")
    cont = F.struct(F.col("code").alias("pending_code"), F.col("head").alias("pending_description"))
    # continuation of page p = the cut head of the first line of page p + 1: the line gives an item to its page and its
    # head to the page before, and pages are put together where their document's lines lie
    given = shown.select("doc_id", F.explode(F.array_compact(F.array(
        F.struct("page", item.alias("item"), F.when(F.lit(False), cont).alias("ahead")),
        F.when(F.col("cut"), F.struct((F.col("page") - 1).alias("page"), F.when(F.lit(False), item).alias("item"), cont.alias("ahead")))))).alias("g"))
    empty = F.struct(F.lit(None).cast("string").alias("pending_code"),
                     F.lit(None).cast("string").alias("pending_description"))
    out = (given.groupBy("doc_id", F.col("g.page").alias("page"))
           .agg(F.sort_array(F.collect_list("g.item")).alias("its"), F.collect_list("g.ahead").alias("aheads"))
           .where(F.size("its") > 0).select("doc_id", "page", "its", F.explode_outer("aheads").alias("cont")))
    payload = F.struct(F.transform("its", lambda s: s.dropFields("line", "partkey")).alias("items"),
                       F.coalesce(F.col("cont"), empty).alias("continuation"))
    return out.select("doc_id", "page", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


def long_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, payload): every line has a page of its own and reaches it over two breaks, the pages between hold no
    item; odd lines name their code at the break only; behind the last line a text begins whose page never came."""
    from ..session import materialize
    inputs = [TB.path(sf_dir, "lineitem"), TB.path(sf_dir, "part")]
    return materialize(spark, "long_page_payloads", inputs, lambda: build_long_pages(spark, sf_dir))


def build_long_pages(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """In rounds of documents: a document's pages are built from its lines alone."""
    li = TB.load(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    return [_long_pages_of(spark, sf_dir, x) for x in in_rounds(li, "l_orderkey", li.count())]


def _long_pages_of(spark: SparkSession, sf_dir: str, li: DataFrame) -> DataFrame:
    p = TB.load(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
    pos = rank_within_groups(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "line", TB.partitions_for(li))
    n = pos.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    third = F.floor(F.length("d") / 3).cast("int")
    lines = pos.join(p, pos.l_partkey == p.p_partkey).join(n, "l_orderkey").select(
        F.col("l_orderkey").alias("doc_id"), "line", "n", F.col("p_brand").alias("code"), F.col("p_name").alias("d")).withColumn("k", third)
    cut, last = F.col("line") > 0, F.col("line") == F.col("n") - 1
    none = F.lit(None).cast("string")
    item = F.struct(F.when(F.col("line") % 2 == 0, F.col("code")).when(~cut, F.col("code")).alias("code"),
                    F.when(cut, F.expr("substring(d, 2 * k + 1)")).otherwise(F.col("d")).alias("description"),
                    none.alias("quantity"), F.lit(None).cast("double").alias("unit_price"), F.lit(None).cast("double").alias("total_price"))

    def pending(text, when):
        return F.struct(F.when(when, F.col("code")).alias("pending_code"), F.when(when, text).alias("pending_description"))

    def given(page, items, tail, ahead):
        body = F.struct(items.alias("items"), pending(*tail).alias("tail")) if tail else F.when(F.lit(False), F.struct(F.array(item).alias("items"), pending(none, F.lit(True)).alias("tail")))
        return F.struct(page.alias("page"), body.alias("body"), F.when(F.lit(ahead), pending(F.expr("substring(d, 1, k)"), F.lit(True))).alias("ahead"))

    # a line gives its own page, the page between and the head that the page before shows; pages are put together where their document's lines lie
    twice = 2 * F.col("line")
    own = given(twice, F.array(item), (F.concat(F.lit("then "), F.col("d")), last), False)
    between = given(twice - 1, F.filter(F.array(item), lambda _: F.lit(False)), (F.expr("substring(d, k + 1, k)"), F.lit(True)), False)
    before = given(twice - 2, None, None, True)
    rows = lines.select("doc_id", F.explode(F.array_compact(F.array(own, F.when(cut, between), F.when(cut, before)))).alias("g"))
    out = rows.groupBy("doc_id", F.col("g.page").alias("page")).agg(F.collect_list("g.body").alias("bodies"), F.collect_list("g.ahead").alias("aheads")) \
        .select("doc_id", "page", "aheads", F.inline("bodies")).select("doc_id", "page", "items", "tail", F.explode_outer("aheads").alias("ahead"))
    return out.select("doc_id", "page", F.to_json(F.struct("items", F.coalesce("ahead", "tail").alias("continuation")), {"ignoreNullFields": "false"}).alias("payload"))


def payload_items(pages_df: DataFrame) -> DataFrame:
    """A10: validate and unnest; (doc_id, page, item_pos, item fields)."""
    parsed = pages_df.select("doc_id", "page", F.from_json("payload", PAYLOAD).alias("p"))
    valid = parsed.where(F.col("p.items").isNotNull() & F.col("p.continuation").isNotNull())
    return valid.select("doc_id", F.col("page").cast("bigint").alias("page"),
                        F.posexplode("p.items").alias("item_pos", "it")) \
                .select("doc_id", "page", F.col("item_pos").cast("bigint").alias("item_pos"), "it.*")


def payload_stitch(pages_df: DataFrame) -> DataFrame:
    """Items with the description cut at the previous page end restored."""
    items = payload_items(pages_df)
    conts = pages_df.select("doc_id", (F.col("page") + 1).cast("bigint").alias("page"),
                            F.from_json("payload", PAYLOAD)["continuation"]["pending_description"].alias("pending"))
    j = items.join(conts, ["doc_id", "page"], "left")
    restored = F.when((F.col("item_pos") == 0) & F.col("pending").isNotNull(),
                      F.concat(F.col("pending"), F.col("description"))).otherwise(F.col("description"))
    return j.select("doc_id", "page", "item_pos", "code", restored.alias("description"))


def lines_sql(per_page: int = LINES_PER_PAGE) -> str:
    """Oracle form of the page lines (DuckDB)."""
    return f"""SELECT doc_id, line, line // {per_page} AS page, code, description, quantity, unit_price, total_price,
       (line % {per_page} = 0 AND line // {per_page} > 0) AS cut,
       substring(description, 1, CAST(floor(length(description) / 2) AS INTEGER)) AS head,
       substring(description, CAST(floor(length(description) / 2) AS INTEGER) + 1) AS tail
FROM (SELECT l.l_orderkey AS doc_id,
             ROW_NUMBER() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) - 1 AS line,
             p.p_brand AS code, p.p_name AS description, CAST(l.l_quantity AS VARCHAR) AS quantity,
             l.l_extendedprice / l.l_quantity AS unit_price, l.l_extendedprice AS total_price
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def rejected_payloads(pages_df: DataFrame) -> DataFrame:
    """Pages that break the contract (no items or no continuation), as they came."""
    p = F.from_json("payload", PAYLOAD)
    return pages_df.where(p.isNull() | p["items"].isNull() | p["continuation"].isNull())


def payload_chains(pages_df: DataFrame, rows: int | None = None) -> DataFrame:
    """A11 over any number of page breaks: (doc_id, page, item_pos, code, description, open).

    The text cut at a page's end goes on with the first item of the next page. Where a page has no
    item before its own break, or one item only that is cut again, the text goes on over several pages: the pieces of
    one text form a chain, named by the page where it begins: the latest beginning at or before a page, found by runs of
    PAGES_PER_RUN pages, so that a long document's pages are not one task. Its pieces are joined in page order. A chain whose page is the last
    of its document, or is followed by a missing or invalid page, stays as an item of its own with ``open`` true (its
    tail never came). The code is the first item's own or, where that is null, the pending code.

    Chains stay in their document: ``rows``, the number of pages where it is known, lets many be followed in
    rounds of documents, whose results are written, so that the disk holds one round's shuffles at once.
    """
    parts = [_chains(x) for x in in_rounds(pages_df, "doc_id", rows or 0)]
    return parts[0] if len(parts) == 1 else written_once(parts, "chains")


def _chains(pages_df: DataFrame) -> DataFrame:
    # parsed once: the branches below read the stored columns that they need
    parsed = written_once(pages_df.select("doc_id", F.col("page").cast("bigint").alias("page"), F.from_json("payload", PAYLOAD).alias("p")), "parsed-pages")
    valid = parsed.select("doc_id", "page", F.col("p.items").alias("items"), F.col("p.continuation").alias("cont")) \
        .where(F.col("items").isNotNull() & F.col("cont").isNotNull())
    cut = F.col("cont.pending_description").isNotNull()
    before = valid.join(valid.where(cut).select("doc_id", (F.col("page") + 1).alias("page"), F.lit(True).alias("into")), ["doc_id", "page"], "left") \
        .withColumn("into", F.coalesce("into", F.lit(False)))
    # a page without items hands on the text that came into it
    started = before.withColumn("start", F.when(cut & ~(F.col("into") & (F.size("items") == 0)), F.col("page"))).withColumn("run", F.floor(F.col("page") / PAGES_PER_RUN))
    w = Window.partitionBy("doc_id", "run").orderBy("page")
    runs = started.groupBy("doc_id", "run").agg(F.max("start").alias("latest")) \
        .select("doc_id", "run", F.max("latest").over(Window.partitionBy("doc_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    # read by three branches: written once, so that pages are parsed and ordered once
    numbered = written_once(started.withColumn("upto", F.max("start").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("ahead", F.max("start").over(w.rowsBetween(Window.unboundedPreceding, -1))).join(runs, ["doc_id", "run"]) \
        .withColumn("chain_in", F.when(F.col("into"), F.coalesce("ahead", "earlier"))).withColumn("chain_out", F.when(cut, F.coalesce("upto", "earlier"))) \
        .select("doc_id", "page", "items", "cont", "chain_in", "chain_out"), "payload-chains")
    items = numbered.select("doc_id", "page", "chain_in", F.posexplode("items").alias("item_pos", "it"))
    plain = items.where((F.col("item_pos") > 0) | F.col("chain_in").isNull()) \
        .select("doc_id", "page", F.col("item_pos").cast("bigint").alias("item_pos"), "it.code", "it.description", F.lit(False).alias("open"))
    heads = numbered.where("chain_out IS NOT NULL").select("doc_id", F.col("chain_out").alias("chain"), "page", F.lit(0).alias("tail"),
                                                           F.col("cont.pending_code").alias("code"), F.col("cont.pending_description").alias("text"), F.lit(None).cast("bigint").alias("at"))
    tails = items.where((F.col("item_pos") == 0) & F.col("chain_in").isNotNull()) \
        .select("doc_id", F.col("chain_in").alias("chain"), "page", F.lit(1).alias("tail"), "it.code", F.col("it.description").alias("text"), F.col("page").alias("at"))
    piece = F.struct("page", "tail", "code", "text")
    chains = heads.unionByName(tails).groupBy("doc_id", "chain").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.max("at").alias("at"), F.max("page").alias("last"))
    joined = chains.select("doc_id", F.coalesce("at", "last").alias("page"), F.when(F.col("at").isNull(), F.lit(-1)).otherwise(0).cast("bigint").alias("item_pos"),
                           F.coalesce(F.get(F.filter("pieces", lambda x: x["tail"] == 1), F.lit(0))["code"],
                                      F.get(F.filter("pieces", lambda x: x["code"].isNotNull()), F.lit(0))["code"]).alias("code"),
                           F.array_join(F.transform("pieces", lambda x: x["text"]), "").alias("description"), F.col("at").isNull().alias("open"))
    return plain.unionByName(joined)
