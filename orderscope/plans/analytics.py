"""The analytic question catalogue over the db-ready line table.

Each question is one DataFrame plan over ``procurement`` and the same
definition as DuckDB SQL for the oracle. Rules carried over from the
question definitions:

* grouping drops NULL keys; mean/median/std skip NULL values; std is sample;
  quantiles interpolate linearly; sums treat NULL as 0.
* money sums stay decimal (exact) and are output as double; averages are
  exact sum / count so both engines produce the same double; medians and
  standard deviations are rounded to 4 decimals.
* "the top one" questions break ties by the key ascending.

Scale notes: every question is a single scan of the date-sorted table with
partial (map-side) aggregation; "scalar then filter" questions use a
scalar subquery (one extra tiny job, no join); top-1 per group uses
``min_by`` over a struct key (partial-aggregable, no window); exact
quantiles use ``operators.ranking.exact_percentile`` (a sketch brackets
the rank, only values inside the bracket are ordered).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..operators.ranking import exact_percentile

QUESTIONS: dict[str, tuple] = {}


def question(name: str, sql: str | None):
    def deco(fn):
        QUESTIONS[name] = (fn, sql)
        return fn
    return deco


def amt():
    return F.col("amount")


def n_rows():
    return F.count(F.lit(1))


def money_sum(col=None):
    col = amt() if col is None else col
    return F.coalesce(F.sum(col), F.lit(0).cast("decimal(28,2)")).cast("double")


def exact_avg(col=None):
    col = amt() if col is None else col
    return (F.sum(col).cast("double") / F.count(col))


def top1(df: DataFrame, order_desc: str, key: str) -> DataFrame:
    """Top row by ``order_desc`` desc, ties by ``key`` asc (TakeOrderedAndProject)."""
    return df.orderBy(F.col(order_desc).desc_nulls_last(), F.col(key).asc()).limit(1)


def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("order_date").cast("bigint"))


def latest_year(p: DataFrame, offset: int = 0):
    """Newest order year (+ offset) as a literal: one tiny aggregate over a single pruned column,
    so the year filter that follows is a literal date range Spark pushes into the scan."""
    row = p.agg(F.max("order_date").alias("m")).first()
    return F.lit(None).cast("int") if row["m"] is None else F.lit(row["m"].year + offset)


def in_year(y, months: int = 12):
    """``order_date`` within year ``y`` (first ``months`` months) as a date range, so the
    predicate reaches the parquet scan (row-group skipping on the date-sorted files)."""
    start = F.make_date(y, F.lit(1), F.lit(1))
    return (F.col("order_date") >= start) & (F.col("order_date") < F.add_months(start, months))


# --------------------------------------------------------------------------- scalars

@question("total_orders", "SELECT COUNT(*) AS total_orders FROM procurement")
def total_orders(p):
    return p.agg(n_rows().alias("total_orders"))


@question("distinct_counts", """
SELECT COUNT(DISTINCT vendor) AS distinct_vendors, COUNT(DISTINCT category) AS distinct_categories,
       COUNT(DISTINCT region) AS distinct_regions FROM procurement""")
def distinct_counts(p):
    return p.agg(F.count_distinct("vendor").alias("distinct_vendors"),
                 F.count_distinct("category").alias("distinct_categories"),
                 F.count_distinct("region").alias("distinct_regions"))


@question("total_amount", "SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount FROM procurement")
def total_amount(p):
    return p.agg(money_sum().alias("total_amount"))


@question("avg_amount", "SELECT CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_amount FROM procurement")
def avg_amount(p):
    return p.agg(exact_avg().alias("avg_amount"))


@question("median_amount", """
SELECT ROUND(QUANTILE_CONT(CAST(amount AS DOUBLE), 0.5), 4) AS median_amount FROM procurement""")
def median_amount(p):
    r = exact_percentile(p, "amount", 0.5, out="m")
    return r.select(F.round("m", 4).alias("median_amount"))


@question("p90_amount", """
SELECT ROUND(QUANTILE_CONT(CAST(amount AS DOUBLE), 0.9), 4) AS p90_amount FROM procurement""")
def p90_amount(p):
    r = exact_percentile(p, "amount", 0.9, out="q")
    return r.select(F.round("q", 4).alias("p90_amount"))


@question("orders_over_10k", "SELECT COUNT(*) FILTER (WHERE amount > 10000) AS total_orders FROM procurement")
def orders_over_10k(p):
    return p.agg(F.count_if(amt() > 10000).alias("total_orders"))


@question("orders_between", """
SELECT COUNT(*) FILTER (WHERE amount >= 500 AND amount <= 2000) AS total_orders FROM procurement""")
def orders_between(p):
    return p.agg(F.count_if(amt().between(500, 2000)).alias("total_orders"))


@question("orders_no_delivery", "SELECT COUNT(*) FILTER (WHERE delivery_date IS NULL) AS total_orders FROM procurement")
def orders_no_delivery(p):
    return p.agg(F.count_if(F.col("delivery_date").isNull()).alias("total_orders"))


@question("date_bounds", """
SELECT strftime(MIN(order_date), '%Y-%m-%d') AS earliest_date, strftime(MAX(order_date), '%Y-%m-%d') AS latest_date
FROM procurement""")
def date_bounds(p):
    return p.agg(F.date_format(F.min("order_date"), "yyyy-MM-dd").alias("earliest_date"),
                 F.date_format(F.max("order_date"), "yyyy-MM-dd").alias("latest_date"))


@question("newest_year", """
SELECT year, COUNT(*) AS total_orders, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount
FROM (SELECT YEAR(order_date) AS year, amount FROM procurement)
WHERE year = (SELECT MAX(YEAR(order_date)) FROM procurement)
GROUP BY year""")
def newest_year(p):
    return (with_year(p.where(in_year(latest_year(p)))).groupBy("year")
             .agg(n_rows().alias("total_orders"), money_sum().alias("total_amount")))


@question("busiest_month", """
SELECT month, total_orders FROM (
  SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, COUNT(*) AS total_orders
  FROM procurement WHERE order_date IS NOT NULL GROUP BY 1)
ORDER BY total_orders DESC, month ASC LIMIT 1""")
def busiest_month(p):
    m = (p.where(F.col("order_date").isNotNull())
          .groupBy(F.trunc("order_date", "month").alias("month")).agg(n_rows().alias("total_orders")))
    return top1(m, "total_orders", "month")


# --------------------------------------------------------------------------- vendors

@question("top_vendor", """
SELECT vendor, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount FROM procurement
WHERE vendor IS NOT NULL GROUP BY vendor ORDER BY total_amount DESC, vendor ASC LIMIT 1""")
def top_vendor(p):
    v = p.where(F.col("vendor").isNotNull()).groupBy("vendor").agg(money_sum().alias("total_amount"))
    return top1(v, "total_amount", "vendor")


@question("vendor_avg", """
SELECT vendor, CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_amount FROM procurement
WHERE vendor IS NOT NULL GROUP BY vendor""")
def vendor_avg(p):
    return p.where(F.col("vendor").isNotNull()).groupBy("vendor").agg(exact_avg().alias("avg_amount"))


@question("vendor_over_5k", """
SELECT vendor, COUNT(*) FILTER (WHERE amount > 5000) AS total_orders FROM procurement
WHERE vendor IS NOT NULL GROUP BY vendor""")
def vendor_over_5k(p):
    return p.where(F.col("vendor").isNotNull()).groupBy("vendor").agg(F.count_if(amt() > 5000).alias("total_orders"))


@question("vendor_most_categories", """
SELECT vendor, COUNT(DISTINCT category) AS distinct_categories FROM procurement WHERE vendor IS NOT NULL
GROUP BY vendor ORDER BY distinct_categories DESC, vendor ASC LIMIT 1""")
def vendor_most_categories(p):
    v = p.where(F.col("vendor").isNotNull()).groupBy("vendor") \
         .agg(F.count_distinct("category").alias("distinct_categories"))
    return top1(v, "distinct_categories", "vendor")


@question("vendor_region_total", """
SELECT vendor, region, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount FROM procurement
WHERE vendor IS NOT NULL AND region IS NOT NULL GROUP BY vendor, region""")
def vendor_region_total(p):
    return (p.where(F.col("vendor").isNotNull() & F.col("region").isNotNull())
             .groupBy("vendor", "region").agg(money_sum().alias("total_amount")))


@question("vendor_top_category", """
SELECT vendor, category, total_amount FROM (
  SELECT vendor, category, total_amount,
         ROW_NUMBER() OVER (PARTITION BY vendor ORDER BY total_amount DESC, category ASC) AS rn
  FROM (SELECT vendor, category, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount FROM procurement
        WHERE vendor IS NOT NULL AND category IS NOT NULL GROUP BY vendor, category))
WHERE rn = 1""")
def vendor_top_category(p):
    vc = (p.where(F.col("vendor").isNotNull() & F.col("category").isNotNull())
           .groupBy("vendor", "category").agg(money_sum().alias("total_amount")))
    # top-1 per vendor as a partial aggregate: max total, then smallest category
    best = vc.groupBy("vendor").agg(
        F.min_by(F.struct("category", "total_amount"),
                 F.struct((-F.col("total_amount")).alias("k"), F.col("category"))).alias("b"))
    return best.select("vendor", "b.category", "b.total_amount")


@question("share_top3_amount", """
SELECT (SELECT CAST(COALESCE(SUM(t), 0) AS DOUBLE) FROM (
          SELECT SUM(amount) AS t FROM procurement WHERE vendor IS NOT NULL GROUP BY vendor
          ORDER BY COALESCE(SUM(amount), 0) DESC, vendor ASC LIMIT 3))
       / GREATEST(CAST(COALESCE((SELECT SUM(amount) FROM procurement), 0) AS DOUBLE), 1e-9) AS share_top3""")
def share_top3_amount(p):
    v = p.where(F.col("vendor").isNotNull()).groupBy("vendor").agg(F.sum("amount").alias("t"),
                                                                  money_sum().alias("k"))
    top = v.orderBy(F.col("k").desc(), F.col("vendor").asc()).limit(3)
    num = top.agg(money_sum(F.col("t"))).scalar()
    den = p.agg(money_sum().alias("d"))
    return den.select((num / F.greatest(F.col("d"), F.lit(1e-9))).alias("share_top3"))


@question("share_top3_count", """
SELECT (SELECT CAST(COALESCE(SUM(t), 0) AS DOUBLE) FROM (
          SELECT SUM(amount) AS t FROM procurement WHERE vendor IS NOT NULL GROUP BY vendor
          ORDER BY COUNT(*) DESC, vendor ASC LIMIT 3))
       / GREATEST(CAST(COALESCE((SELECT SUM(amount) FROM procurement), 0) AS DOUBLE), 1e-9) AS share_top3""")
def share_top3_count(p):
    v = p.where(F.col("vendor").isNotNull()).groupBy("vendor").agg(F.sum("amount").alias("t"),
                                                                  n_rows().alias("n"))
    top = v.orderBy(F.col("n").desc(), F.col("vendor").asc()).limit(3)
    num = top.agg(money_sum(F.col("t"))).scalar()
    den = p.agg(money_sum().alias("d"))
    return den.select((num / F.greatest(F.col("d"), F.lit(1e-9))).alias("share_top3"))


@question("vendor_total", """
SELECT vendor, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount FROM procurement
WHERE vendor ILIKE '%supplier#00000001%' GROUP BY vendor""")
def vendor_total(p, pattern: str = "supplier#00000001"):
    return (p.where(F.col("vendor").ilike(f"%{pattern}%")).groupBy("vendor")
             .agg(money_sum().alias("total_amount")))


@question("vendor_label", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       COALESCE(vendor, '') || ' (' || CAST(COUNT(*) OVER (PARTITION BY COALESCE(vendor, '')) AS VARCHAR) || ')'
         AS vendor_label
FROM procurement""")
def vendor_label(p):
    # counts per vendor are pre-aggregated (partial agg) and joined back; a
    # window partitioned by vendor would put a hot vendor's rows in one task
    vv = p.withColumn("_v", F.coalesce(F.col("vendor"), F.lit("")))
    counts = vv.groupBy("_v").agg(n_rows().alias("_n"))
    return (vv.join(counts, "_v")
              .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.concat(F.col("_v"), F.lit(" ("), F.col("_n").cast("string"), F.lit(")")).alias("vendor_label")))


@question("top_vendors_year", """
SELECT vendor, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount FROM procurement
WHERE vendor IS NOT NULL AND YEAR(order_date) = (SELECT MAX(YEAR(order_date)) - 1 FROM procurement)
GROUP BY vendor ORDER BY total_amount DESC, vendor ASC LIMIT 5""")
def top_vendors_year(p, year=None, n: int = 5):
    """Top n vendors by spend in a year (default: the last full year = newest year - 1)."""
    y = F.lit(year) if year is not None else latest_year(p, -1)
    v = (p.where(F.col("vendor").isNotNull() & in_year(y))
          .groupBy("vendor").agg(money_sum().alias("total_amount")))
    return v.orderBy(F.col("total_amount").desc(), F.col("vendor").asc()).limit(n)


@question("top_vendors_region_year", """
SELECT vendor, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount FROM procurement
WHERE vendor IS NOT NULL AND region ILIKE '%europe%'
  AND YEAR(order_date) = (SELECT MAX(YEAR(order_date)) - 1 FROM procurement)
GROUP BY vendor ORDER BY total_amount DESC, vendor ASC LIMIT 10""")
def top_vendors_region_year(p, region: str = "europe", n: int = 10):
    v = (p.where(F.col("vendor").isNotNull() & F.col("region").ilike(f"%{region}%") & in_year(latest_year(p, -1)))
          .groupBy("vendor").agg(money_sum().alias("total_amount")))
    return v.orderBy(F.col("total_amount").desc(), F.col("vendor").asc()).limit(n)


@question("vendor_big_orders", """
SELECT order_code, l_linenumber, l_partkey, l_suppkey, vendor, CAST(amount AS DOUBLE) AS amount, order_date
FROM procurement
WHERE amount > 10000 AND vendor = (SELECT vendor FROM procurement WHERE vendor IS NOT NULL
                                   GROUP BY vendor ORDER BY COUNT(*) DESC, vendor ASC LIMIT 1)""")
def vendor_big_orders(p, vendor: str | None = None):
    if vendor is None:
        top = (p.where(F.col("vendor").isNotNull()).groupBy("vendor").agg(n_rows().alias("n"))
                .orderBy(F.col("n").desc(), F.col("vendor").asc()).limit(1).select("vendor"))
        v = top.scalar()
    else:
        v = F.lit(vendor)
    return (p.where((amt() > 10000) & (F.col("vendor") == v))
             .select("order_code", "l_linenumber", "l_partkey", "l_suppkey", "vendor",
                     amt().cast("double").alias("amount"), "order_date"))


# --------------------------------------------------------------------------- regions / categories / contracts

@question("region_stats", """
SELECT region, COUNT(*) AS total_orders, CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_amount
FROM procurement WHERE region IS NOT NULL GROUP BY region""")
def region_stats(p):
    return p.where(F.col("region").isNotNull()).groupBy("region") \
            .agg(n_rows().alias("total_orders"), exact_avg().alias("avg_amount"))


@question("category_stats", """
SELECT category, COUNT(*) AS total_orders, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount,
       ROUND(QUANTILE_CONT(CAST(amount AS DOUBLE), 0.5), 4) AS median_amount
FROM procurement WHERE category IS NOT NULL GROUP BY category""")
def category_stats(p):
    c = p.where(F.col("category").isNotNull())
    agg = c.groupBy("category").agg(n_rows().alias("total_orders"), money_sum().alias("total_amount"))
    med = exact_percentile(c, "amount", 0.5, ["category"], out="m")
    return (agg.join(med, "category", "left")
               .select("category", "total_orders", "total_amount", F.round("m", 4).alias("median_amount")))


@question("contract_stats", """
SELECT contract_type, COUNT(*) AS total_orders, CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_amount
FROM procurement WHERE contract_type IS NOT NULL GROUP BY contract_type""")
def contract_stats(p):
    return p.where(F.col("contract_type").isNotNull()).groupBy("contract_type") \
            .agg(n_rows().alias("total_orders"), exact_avg().alias("avg_amount"))


@question("order_type_stats", """
SELECT order_type, COUNT(*) AS total_orders, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount
FROM procurement WHERE order_type IS NOT NULL GROUP BY order_type""")
def order_type_stats(p):
    return p.where(F.col("order_type").isNotNull()).groupBy("order_type") \
            .agg(n_rows().alias("total_orders"), money_sum().alias("total_amount"))


_TOP_VALUE_COLUMNS = [("vendor", 5), ("region", 5), ("category", 5), ("contract_type", 5), ("order_type", 3)]


def _top_values_sql() -> str:
    parts = []
    for col, n in _TOP_VALUE_COLUMNS:
        parts.append(f"""SELECT * FROM (SELECT '{col}' AS column_name, CAST({col} AS VARCHAR) AS value,
       COUNT(*) AS total_orders FROM procurement WHERE {col} IS NOT NULL GROUP BY {col}
       ORDER BY total_orders DESC, value ASC LIMIT {n})""")
    return "\nUNION ALL\n".join(parts)


@question("top_values", _top_values_sql())
def top_values(p):
    """Most frequent values per column (NULL dropped, stringified): one scan, one count, then each column's first."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), F.lit(n).alias("n")) for c, n in _TOP_VALUE_COLUMNS]))
    counted = (p.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull())
               .groupBy("column_name", "n", "value").agg(n_rows().alias("total_orders")))
    w = Window.partitionBy("column_name").orderBy(F.col("total_orders").desc(), F.col("value").asc())
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("n")).select("column_name", "value", "total_orders")


@question("share_over_5k", """
SELECT CAST(COUNT(*) FILTER (WHERE amount > 5000) AS DOUBLE) / COUNT(*) AS fraction_over_5k FROM procurement""")
def share_over_5k(p):
    return p.agg((F.count_if(amt() > 5000).cast("double") / n_rows()).alias("fraction_over_5k"))


@question("orders_with_summary", "SELECT COUNT(order_summary) AS total_orders FROM procurement")
def orders_with_summary(p):
    return p.agg(F.count("order_summary").alias("total_orders"))


@question("avg_with_delivery", """
SELECT CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_amount FROM procurement WHERE delivery_date IS NOT NULL""")
def avg_with_delivery(p):
    return p.where(F.col("delivery_date").isNotNull()).agg(exact_avg().alias("avg_amount"))


@question("yoy_growth", """
WITH y AS (SELECT YEAR(order_date) AS year, COALESCE(SUM(amount), 0) AS total FROM procurement
           WHERE order_date IS NOT NULL GROUP BY 1),
     l AS (SELECT * FROM y ORDER BY year DESC LIMIT 2)
SELECT MAX(year) AS latest_year, MIN(year) AS prev_year,
       CAST(arg_max(total, year) - arg_min(total, year) AS DOUBLE)
         / GREATEST(CAST(arg_min(total, year) AS DOUBLE), 1e-9) AS yoy_growth
FROM l HAVING COUNT(*) = 2""")
def yoy_growth(p):
    y = (with_year(p).where(F.col("year").isNotNull()).groupBy("year")
         .agg(F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(28,2)")).alias("total")))
    last2 = y.orderBy(F.col("year").desc()).limit(2)
    cur, prev = F.max_by("total", "year"), F.min_by("total", "year")
    return (last2.agg(F.max("year").alias("latest_year"), F.min("year").alias("prev_year"),
                      ((cur - prev).cast("double") / F.greatest(prev.cast("double"), F.lit(1e-9))).alias("yoy_growth"),
                      n_rows().alias("_n"))
                 .where(F.col("_n") == 2).drop("_n"))


@question("avg_monthly_spend", """
WITH m AS (SELECT YEAR(order_date) AS year, MONTH(order_date) AS month, COALESCE(SUM(amount), 0) AS total
           FROM procurement WHERE order_date IS NOT NULL GROUP BY 1, 2)
SELECT year, CAST(SUM(total) AS DOUBLE) / COUNT(*) AS avg_monthly_amount FROM m
WHERE year = (SELECT MAX(year) FROM m) GROUP BY year""")
def avg_monthly_spend(p):
    m = (with_year(p).where(F.col("year").isNotNull())
         .groupBy("year", F.month("order_date").alias("month"))
         .agg(F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(28,2)")).alias("total")))
    latest = m.agg(F.max("year")).scalar()
    return (m.where(F.col("year") == latest).groupBy("year")
             .agg((F.sum("total").cast("double") / n_rows()).alias("avg_monthly_amount")))


@question("top_region", """
SELECT region, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount FROM procurement WHERE region IS NOT NULL
GROUP BY region ORDER BY total_amount DESC, region ASC LIMIT 1""")
def top_region(p):
    r = p.where(F.col("region").isNotNull()).groupBy("region").agg(money_sum().alias("total_amount"))
    return top1(r, "total_amount", "region")


@question("top_category", """
SELECT category, COUNT(*) AS total_orders FROM procurement WHERE category IS NOT NULL
GROUP BY category ORDER BY total_orders DESC, category ASC LIMIT 1""")
def top_category(p):
    c = p.where(F.col("category").isNotNull()).groupBy("category").agg(n_rows().alias("total_orders"))
    return top1(c, "total_orders", "category")


@question("top_contract_avg", """
SELECT contract_type, CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_amount FROM procurement
WHERE contract_type IS NOT NULL GROUP BY contract_type ORDER BY avg_amount DESC NULLS LAST, contract_type ASC LIMIT 1""")
def top_contract_avg(p):
    c = p.where(F.col("contract_type").isNotNull()).groupBy("contract_type").agg(exact_avg().alias("avg_amount"))
    return top1(c, "avg_amount", "contract_type")


@question("missing_vendor", """
SELECT CAST(COUNT(*) FILTER (WHERE vendor IS NULL) AS DOUBLE) / COUNT(*) AS missing_vendor_ratio FROM procurement""")
def missing_vendor(p):
    return p.agg((F.count_if(F.col("vendor").isNull()).cast("double") / n_rows()).alias("missing_vendor_ratio"))


@question("amount_spread", "SELECT CAST(MAX(amount) - MIN(amount) AS DOUBLE) AS amount_spread FROM procurement")
def amount_spread(p):
    return p.agg((F.max(amt()) - F.min(amt())).cast("double").alias("amount_spread"))


@question("top_category_std", """
SELECT category, ROUND(STDDEV_SAMP(CAST(amount AS DOUBLE)), 4) AS std_amount FROM procurement
WHERE category IS NOT NULL GROUP BY category
ORDER BY STDDEV_SAMP(CAST(amount AS DOUBLE)) DESC NULLS LAST, category ASC LIMIT 1""")
def top_category_std(p):
    c = p.where(F.col("category").isNotNull()).groupBy("category") \
         .agg(F.stddev_samp(amt().cast("double")).alias("s"))
    return top1(c, "s", "category").select("category", F.round("s", 4).alias("std_amount"))


@question("region_avg_with_summary", """
SELECT region, CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_amount FROM procurement
WHERE order_summary IS NOT NULL AND region IS NOT NULL GROUP BY region ORDER BY avg_amount DESC""")
def region_avg_with_summary(p):
    return (p.where(F.col("order_summary").isNotNull() & F.col("region").isNotNull())
             .groupBy("region").agg(exact_avg().alias("avg_amount"))
             .orderBy(F.col("avg_amount").desc()))


@question("category_first_order", """
SELECT category, strftime(MIN(order_date), '%Y-%m-%d') AS earliest_date FROM procurement
WHERE category IS NOT NULL GROUP BY category""")
def category_first_order(p):
    return p.where(F.col("category").isNotNull()).groupBy("category") \
            .agg(F.date_format(F.min("order_date"), "yyyy-MM-dd").alias("earliest_date"))


@question("max_amount_order", """
SELECT order_code, CAST(amount AS DOUBLE) AS amount FROM procurement WHERE amount IS NOT NULL
ORDER BY procurement.amount DESC, order_code ASC LIMIT 1""")
def max_amount_order(p):
    return (p.where(amt().isNotNull()).orderBy(amt().desc(), F.col("order_code").asc()).limit(1)
             .select("order_code", amt().cast("double").alias("amount")))


@question("amount_equals_total", """
SELECT COUNT(*) FILTER (WHERE amount = importo_tot) AS total_orders FROM procurement""")
def amount_equals_total(p):
    return p.agg(F.count_if(amt() == F.col("importo_tot")).alias("total_orders"))


@question("contract_share_region", """
SELECT region, contract_type, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY region) AS contract_share
FROM procurement WHERE region IS NOT NULL GROUP BY region, contract_type""")
def contract_share_region(p):
    """Share of rows with each contract type inside a region (denominator: all rows of the region)."""
    pairs = p.where(F.col("region").isNotNull()).groupBy("region", "contract_type").agg(n_rows().alias("n"))
    per_region = pairs.groupBy("region").agg(F.sum("n").alias("d"))
    return (pairs.join(per_region, "region")
                 .select("region", "contract_type", (F.col("n").cast("double") / F.col("d")).alias("contract_share")))


@question("median_no_delivery", """
SELECT ROUND(QUANTILE_CONT(CAST(amount AS DOUBLE), 0.5), 4) AS median_amount FROM procurement
WHERE delivery_date IS NULL""")
def median_no_delivery(p):
    r = exact_percentile(p.where(F.col("delivery_date").isNull()), "amount", 0.5, out="m")
    return r.select(F.round("m", 4).alias("median_amount"))


@question("region_avg_min_volume", """
SELECT t.region, COALESCE(t.avg_amount, 0.0) AS avg_amount
FROM (SELECT 1 AS one) d LEFT JOIN (
  SELECT region, CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_amount FROM procurement
  WHERE region IS NOT NULL GROUP BY region HAVING COUNT(*) >= 50
  ORDER BY avg_amount DESC NULLS LAST, region ASC LIMIT 1) t ON TRUE""")
def region_avg_min_volume(p, min_rows: int = 50):
    r = (p.where(F.col("region").isNotNull()).groupBy("region")
          .agg(n_rows().alias("n"), exact_avg().alias("a")).where(F.col("n") >= min_rows))
    key = F.struct(F.coalesce(-F.col("a"), F.lit(float("inf"))).alias("k"), F.col("region"))
    return r.agg(F.min_by("region", key).alias("region"),
                 F.coalesce(F.min_by("a", key), F.lit(0.0)).alias("avg_amount"))


@question("latest_month_orders", """
SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, COUNT(*) AS total_orders FROM procurement
WHERE date_trunc('month', order_date) = (SELECT date_trunc('month', MAX(order_date)) FROM procurement)
GROUP BY 1""")
def latest_month_orders(p):
    m = p.where(F.col("order_date").isNotNull()).groupBy(F.trunc("order_date", "month").alias("month")) \
         .agg(n_rows().alias("total_orders"))
    return m.orderBy(F.col("month").desc()).limit(1)


@question("category_year", """
SELECT category, YEAR(order_date) AS year, COUNT(*) AS total_orders FROM procurement
WHERE category IS NOT NULL AND order_date IS NOT NULL GROUP BY 1, 2""")
def category_year(p):
    return (p.where(F.col("category").isNotNull() & F.col("order_date").isNotNull())
             .groupBy("category", F.year("order_date").cast("bigint").alias("year")).agg(n_rows().alias("total_orders")))


@question("contract_category_avg", """
SELECT contract_type, category, CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_amount FROM procurement
WHERE contract_type IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2""")
def contract_category_avg(p):
    return (p.where(F.col("contract_type").isNotNull() & F.col("category").isNotNull())
             .groupBy("contract_type", "category").agg(exact_avg().alias("avg_amount")))


def _threshold_sql() -> str:
    cols = ", ".join(f"COUNT(*) FILTER (WHERE amount > {t}) AS c{t}" for t in C.AMOUNT_THRESHOLDS)
    rows = " UNION ALL ".join(f"SELECT {t} AS threshold, c{t} AS total_orders FROM c" for t in C.AMOUNT_THRESHOLDS)
    return f"WITH c AS (SELECT {cols} FROM procurement) {rows}"


@question("threshold_counts", _threshold_sql())
def threshold_counts(p):
    """One pass of conditional counts, then unpivot to (threshold, total_orders)."""
    wide = p.agg(*[F.count_if(amt() > t).alias(f"c{t}") for t in C.AMOUNT_THRESHOLDS])
    stack = ", ".join(f"{t}, c{t}" for t in C.AMOUNT_THRESHOLDS)
    return wide.selectExpr(f"stack({len(C.AMOUNT_THRESHOLDS)}, {stack}) AS (threshold, total_orders)")


# --------------------------------------------------------------------------- periods / text intents

@question("monthly_category", """
SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, category,
       CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount
FROM procurement WHERE order_date IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2""")
def monthly_category(p):
    return (p.where(F.col("order_date").isNotNull() & F.col("category").isNotNull())
             .groupBy(F.trunc("order_date", "month").alias("month"), "category")
             .agg(money_sum().alias("total_amount")))


@question("monthly_category_12m", """
SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, category,
       CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount
FROM procurement WHERE category IS NOT NULL
  AND order_date > (SELECT MAX(order_date) - INTERVAL 12 MONTH FROM procurement)
GROUP BY 1, 2""")
def monthly_category_12m(p):
    newest = p.agg(F.max("order_date")).first()[0]          # one bounded value -> literal, pushed to the scan
    start = F.add_months(F.lit(newest), -12)
    return (p.where(F.col("category").isNotNull() & (F.col("order_date") > start))
             .groupBy(F.trunc("order_date", "month").alias("month"), "category")
             .agg(money_sum().alias("total_amount")))


@question("region_q1_vendor", """
SELECT vendor, COUNT(*) AS total_orders, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount FROM procurement
WHERE region ILIKE '%europe%' AND vendor IS NOT NULL AND QUARTER(order_date) = 1
  AND YEAR(order_date) = (SELECT MAX(YEAR(order_date)) FROM procurement)
GROUP BY vendor""")
def region_q1_vendor(p, region: str = "europe"):
    return (p.where(F.col("region").ilike(f"%{region}%") & F.col("vendor").isNotNull()
                    & in_year(latest_year(p), months=3))
             .groupBy("vendor").agg(n_rows().alias("total_orders"), money_sum().alias("total_amount")))


@question("text_contains_sorted", """
SELECT order_code, l_linenumber, l_partkey, l_suppkey, descr, CAST(amount AS DOUBLE) AS amount FROM procurement
WHERE descr ILIKE '%red widget%' ORDER BY procurement.amount DESC NULLS LAST""")
def text_contains_sorted(p, text: str = "red widget"):
    return (p.where(F.col("descr").ilike(f"%{text}%"))
             .orderBy(amt().desc_nulls_last())
             .select("order_code", "l_linenumber", "l_partkey", "l_suppkey", "descr", amt().cast("double").alias("amount")))
