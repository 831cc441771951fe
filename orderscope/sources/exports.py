"""Raw source exports (string-typed, source column names), derived from the
input tables. They stand for the order and project workbooks and feed the
ingest / prepare / assemble operators.

The export keeps the line key (l_orderkey, l_linenumber, l_partkey,
l_suppkey) as the export's natural row order, from which contiguous row
ids are assigned once at ingest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as FX

SOURCE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def orders_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_columns(FX.procurement(spark, sf_dir))


def export_columns(p: DataFrame) -> DataFrame:
    """The export's columns of procurement rows; row ids that the rows carry come last."""
    ids = [c for c in ("record_id", "source_row") if c in p.columns]
    ln = F.col("l_linenumber")
    regione = (F.when(ln == 2, F.lower("region"))
                .when(ln == 3, F.concat(F.lit("  "), F.col("region"), F.lit(" \u00a0")))
                .when(ln == 4, F.lit(" "))
                .when(ln == 5, F.lit(None).cast("string"))
                .when(ln == 6, F.regexp_replace("region", " ", " - "))
                .otherwise(F.col("region")))
    return p.select(
        *SOURCE_ORDER,
        F.col("order_code").alias("ordine_n"),
        F.col("l_linenumber").cast("string").alias("posiz_num"),
        F.date_format("order_date", "yyyy-MM-dd").alias("data_ord"),
        F.when(ln == 7, F.lit("2024-02-30")).otherwise(F.date_format("delivery_date", "yyyy-MM-dd")).alias("data_consegna"),
        F.col("category").alias("tipologia"),
        F.col("contract_type").alias("tipo_contratto_txt"),
        F.col("order_type").alias("tipo_ordine"),
        F.col("vendor").alias("fornitore"),
        regione.alias("regione"),
        F.col("city").alias("comune"),
        F.col("amount").cast("string").alias("importo_ordine"),
        F.col("importo_tot").cast("string").alias("importo_tot"),
        F.col("descr").alias("oggetto"),
        F.concat(F.lit("Fornitura "), F.col("codice")).alias("descrizione"),
        F.when(ln == 1, F.lit("  ")).otherwise(F.lit(None).cast("string")).alias("desc"),
        F.col("order_summary").alias("note"),
        *ids,
    )


ORDERS_EXPORT_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       order_code AS ordine_n,
       CAST(l_linenumber AS VARCHAR) AS posiz_num,
       strftime(order_date, '%Y-%m-%d') AS data_ord,
       CASE WHEN l_linenumber = 7 THEN '2024-02-30' ELSE strftime(delivery_date, '%Y-%m-%d') END AS data_consegna,
       category AS tipologia,
       contract_type AS tipo_contratto_txt,
       order_type AS tipo_ordine,
       vendor AS fornitore,
       CASE WHEN l_linenumber = 2 THEN lower(region)
            WHEN l_linenumber = 3 THEN '  ' || region || ' ' || chr(160)
            WHEN l_linenumber = 4 THEN ' '
            WHEN l_linenumber = 5 THEN NULL
            WHEN l_linenumber = 6 THEN replace(region, ' ', ' - ')
            ELSE region END AS regione,
       city AS comune,
       CAST(amount AS VARCHAR) AS importo_ordine,
       CAST(importo_tot AS VARCHAR) AS importo_tot,
       descr AS oggetto,
       'Fornitura ' || codice AS descrizione,
       CASE WHEN l_linenumber = 1 THEN '  ' ELSE NULL END AS "desc",
       order_summary AS note
FROM procurement
"""


def projects_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects workbook with the source headers (spaces, capitals) before renaming."""
    raw = FX.build_projects_raw(spark, sf_dir)
    return raw.select(
        "record_id",
        F.col("num_commessa").alias("num commessa"),
        F.col("nome_commessa").alias("nome commessa"),
        F.col("settore").alias("Settore"),
        F.col("committente"),
        F.col("oggetto"),
        F.col("importo").cast("string").alias("importo"),
        F.date_format("consegna", "yyyy-MM-dd").alias("consegna"),
        F.date_format("ultimazione", "yyyy-MM-dd").alias("ultimazione"),
    )
