"""Exact filtered cosine top-k (R3, R10–R12) and vendor roll-up of similarities.

The query vector is fetched once (one row, bounded by the vector
dimension) and inlined as an array literal into the scan's projection — no
join and no cross product over the data. Scoring is a codegen'd ``zip_with``/``aggregate`` per
row; the cut is ``orderBy(..).limit(k)`` = TakeOrderedAndProject (a
bounded heap per partition, then a merge of k·#partitions rows).

Ties: similarity rounded to 9 digits, then id ascending; the 0-clamp is
applied after ordering.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .filters import commesse_filter, lookup_code, order_filter

HIT_COLUMNS = ["record_id", "order_code", "order_date", "delivery_date", "vendor", "region", "category",
               "contract_type", "order_type"]


def query_vector(one_row: DataFrame, col: str) -> Column:
    """The query vector of a one-row frame as an array literal (error when absent)."""
    row = one_row.select(F.col(col).cast("array<double>").alias("v")).limit(1).first()
    if row is None or row["v"] is None:
        raise ValueError("No embedding found for the requested anchor")
    return F.array(*[F.lit(float(x)) for x in row["v"]])


def score(df: DataFrame, vec_col: str, q: Column, out: str = "_sim") -> DataFrame:
    return df.withColumn(out, V.cosine(F.col(vec_col), q))


def topk(df: DataFrame, score_col: str, id_col: str, k: int) -> DataFrame:
    return df.orderBy(F.round(F.col(score_col), 9).desc(), F.col(id_col).asc()).limit(k)


def vector_topk(docs: DataFrame, vec_col: str, q: Column, k: int, id_col: str = "doc_id") -> DataFrame:
    """Best ``k`` by dot product of L2-normalised vectors."""
    s = docs.select(id_col, V.dot(V.l2_normalize(vec_col), V.l2_normalize(q)).alias("vec_score"))
    return topk(s, "vec_score", id_col, k)


def semantic_orders(orders: DataFrame, q: Column, top_k: int = 5, filters: dict[str, Any] | None = None) -> DataFrame:
    """Filtered cosine top-k over the orders table; search-hit columns."""
    hits = topk(score(orders.where(order_filter(filters)), "summary_embedding", q), "_sim", "record_id", top_k)
    return hits.select(*HIT_COLUMNS, F.col("amount").cast("double").alias("amount"),
                       F.col("order_summary").alias("summary"),
                       F.round(V.clamp0(F.col("_sim")), 6).alias("similarity"))


def similar_to_order(orders: DataFrame, code: str, top_k: int = 5, filters: dict[str, Any] | None = None) -> DataFrame:
    """The vector of an existing order (code or record id) as the query; own row stays."""
    anchor = lookup_code(orders, code)
    return semantic_orders(orders, query_vector(anchor, "summary_embedding"), top_k, filters)


def similar_vendors(orders: DataFrame, code: str, n: int = 5) -> DataFrame:
    """Vendors with the most similar orders to an order: max similarity per vendor, top n."""
    anchor = lookup_code(orders, code)
    s = score(orders.where(F.col("vendor").isNotNull() & F.col("summary_embedding").isNotNull()),
              "summary_embedding", query_vector(anchor, "summary_embedding"))
    per_vendor = s.groupBy("vendor").agg(F.max("_sim").alias("_best"))
    return (topk(per_vendor, "_best", "vendor", n)
            .select("vendor", F.round(V.clamp0(F.col("_best")), 6).alias("similarity")))


COMMESSE_HIT = ["record_id", "commessa_code", "nome_commessa", "committente", "responsabile_commessa",
                "responsabile_cantiere", "settore"]


def semantic_commesse(commesse: DataFrame, q: Column, top_k: int = 5,
                      filters: dict[str, Any] | None = None) -> DataFrame:
    """Filtered cosine top-k over projects; ``oggetto_filled`` returned as ``oggetto``."""
    hits = topk(score(commesse.where(commesse_filter(filters)), "oggetto_embedding", q), "_sim", "record_id", top_k)
    return hits.select(*COMMESSE_HIT, F.col("importo").cast("double").alias("importo"),
                       F.date_format("consegna", "yyyy-MM-dd").alias("consegna"),
                       F.date_format("ultimazione", "yyyy-MM-dd").alias("ultimazione"),
                       F.col("oggetto_filled").alias("oggetto"),
                       F.round(V.clamp0(F.col("_sim")), 6).alias("similarity"))
