"""Filters (B9–B15), argument aliases (B14), top_k bounds (F4), SQL guard."""

import pytest
from pyspark.sql import functions as F

from orderscope.operators import filters as FL
from orderscope.plans.sqlguard import SqlGuard


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(1, "A1", "Lombardia", "ACME srl", "Quadro", "cat", "t", "2024-01-05", 0.0, [1.0, 0.0]),
            (2, "A2", "Lazio", "Beta", "Aperto", "cat", "t", "2024-03-01", 500.0, [0.0, 1.0]),
            (3, "7", "lombardia", "acme spa", "Quadro", "x_y", "t", "2023-12-31", 10000.0, None),
            (4, "B4", None, "Gamma%", "Q", "c%t", "t", "2024-06-30", None, [1.0, 1.0])]
    return spark.createDataFrame(rows, "record_id long, order_code string, region string, vendor string, "
                                       "contract_type string, category string, order_type string, order_date string, "
                                       "amount double, summary_embedding array<double>") \
                .withColumn("order_date", F.to_date("order_date"))


def ids(df):
    return sorted(r[0] for r in df.select("record_id").collect())


def test_ilike_and_vector_presence(orders):
    assert ids(orders.where(FL.order_filter({"region": "LOMB"}))) == [1]
    assert ids(orders.where(FL.order_filter({"region": "LOMB"}, vector_col=None))) == [1, 3]


def test_wildcards_stay_wildcards(orders):
    # user % and _ are wildcards, as in the original ILIKE
    assert ids(orders.where(FL.order_filter({"category": "c%t"}, None))) == [1, 2, 4]
    assert ids(orders.where(FL.order_filter({"category": "x_y"}, None))) == [3]


def test_dates_inclusive_and_amount_zero_valid(orders):
    f = {"date_from": "2024-01-05", "date_to": "2024-03-01", "min_amount": 0}
    assert ids(orders.where(FL.order_filter(f, None))) == [1, 2]
    assert ids(orders.where(FL.order_filter({"max_amount": 0}, None))) == [1]


def test_unknown_and_empty_fields_ignored(orders):
    f = {"region": "", "vendor": None, "nope": "x", "order_type": "t"}
    assert ids(orders.where(FL.order_filter(f))) == [1, 2, 4]


def test_aliases_and_nested_filters():
    a = FL.normalize_filter_args({"filters": {"importo_min": 5, "region": "x"}, "amount_max": 9}, "orders")
    assert a == {"min_amount": 5, "region": "x", "max_amount": 9}
    b = FL.normalize_filter_args({"min_amount": 1, "min_importo": 2}, "commesse")
    assert b == {"min_amount": 1, "min_importo": 2}      # target present: alias left alone
    c = FL.normalize_filter_args({"max_amount": 3}, "commesse")
    assert c == {"max_importo": 3}


def test_alias_rules():
    assert FL.normalize_filter_args({"importo_min": 1, "filters": {"importo_min": 2}}) == {"min_amount": 2}
    assert FL.normalize_filter_args({"min_amount": 1, "filters": {"amount_min": 2}}) == {"min_amount": 1, "amount_min": 2}
    assert FL.normalize_filter_args(None) == {} == FL.normalize_filter_args({"filters": None})


def test_backslash_is_itself(orders):
    assert ids(orders.where(FL.order_filter({"vendor": "a\\\\b"}, None))) == []


def test_lookup_code_by_code_or_id(orders):
    assert FL.lookup_code(orders, "7").first()["record_id"] == 3
    assert FL.lookup_code(orders, "2").first()["record_id"] == 2
    assert FL.lookup_code(orders, "zzz").first() is None


def test_top_k_bounds():
    assert FL.check_top_k(None) == 5 and FL.check_top_k(200) == 200
    for bad in (0, 201):
        with pytest.raises(ValueError):
            FL.check_top_k(bad)


@pytest.fixture(scope="module")
def guard(spark, orders):
    return SqlGuard(spark, {"orders": lambda s: s.createDataFrame(orders.collect(), orders.schema)})


def test_guard_runs_and_limits(guard):
    r = guard.run("SELECT record_id FROM orders ORDER BY record_id;")
    assert [x[0] for x in r.df.collect()] == [1, 2, 3, 4] and r.warnings == ["Added default LIMIT 200"]
    r = guard.run("WITH o AS (SELECT * FROM orders) SELECT COUNT(*) AS n FROM o WHERE amount >= :m", params={"m": 500})
    assert r.df.first()["n"] == 2
    r = guard.run("SELECT created_at FROM (SELECT 1 AS created_at, record_id FROM orders) t LIMIT 2")
    assert r.df.count() == 2


@pytest.mark.parametrize(("sql", "warnings", "bound"), [
    ("select * from orders limit 9999", ["LIMIT reduced from 9999 to 500"], 500),
    ("select * from (select * from orders LIMIT 10) t", ["Added default LIMIT 200"], 200),
    ("select 'limit 9999' AS x from orders", ["Added default LIMIT 200"], 200),
    ("with o as (select * from orders limit 3000) select * from o limit 7", [], 500),
    ("select 1", ["Added default LIMIT 200"], 200),
])
def test_limit_policy_reads_the_plan(guard, sql, warnings, bound):
    assert guard.enforce(sql) == (sql, warnings, bound)


def test_inner_limits_and_literals_are_kept(guard):
    inner = "SELECT COUNT(*) AS n FROM (SELECT a.id FROM (SELECT explode(sequence(1, 4000)) AS id FROM orders) a LIMIT 3000) t"
    assert guard.run(inner).df.first()["n"] == 3000
    assert guard.run("SELECT 'limit 1000; update' AS x FROM orders WHERE vendor NOT ILIKE '%update%'").df.first()["x"] == "limit 1000; update"


@pytest.mark.parametrize(("sql", "says"), [
    ("DROP TABLE orders", "Only SELECT"),
    ("insert into orders select * from orders", "Only SELECT"),
    ("WITH o AS (SELECT 1) INSERT INTO orders SELECT * FROM o", "Mutating"),
    ("SELECT 1; DROP TABLE orders", "rejected"),
    ("SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`", "allowlist"),
    ("SELECT * FROM lineitem", "allowlist"),
    ("SELECT (SELECT max(x) FROM lineitem) AS m FROM orders", "allowlist"),
    ("SELECT 'with lineitem as (' AS x FROM lineitem", "allowlist"),
    ("WITH customer AS (SELECT * FROM customer) SELECT * FROM customer", "rejected|allowlist"),
    ("SELECT reflect('java.lang.System', 'getenv', 'HOME')", "not allowed"),
    ("SELECT * FROM IDENTIFIER('default' || '.orders')", "not allowed"),
    ("SELECT * FROM spark_catalog.default.orders", "allowlist"),
    ("(SELECT 1)", "Only SELECT"),
])
def test_guard_refuses(guard, sql, says):
    with pytest.raises(ValueError, match=says):
        guard.run(sql)


def test_guard_dataset_scope(guard):
    with pytest.raises(ValueError):
        guard.run("SELECT 1 AS x", dataset="orders")
    with pytest.raises(ValueError):
        guard.run("SELECT 'orders' AS x", dataset="orders")
    assert guard.run("SELECT record_id FROM orders", dataset="orders").df.count() == 4


def test_na_to_null_after_pandas_roundtrip(spark, orders):
    from orderscope.operators.prepare import na_to_null
    nan_df = spark.createDataFrame(orders.select("record_id", "amount").toPandas())   # NULL -> NaN
    assert nan_df.where(F.col("amount") >= 500).count() == 3                          # NaN sorts above numbers
    fixed = na_to_null(nan_df)
    assert fixed.where(F.col("amount") >= 500).count() == 2
    assert fixed.where(F.col("amount").isNull()).count() == 1


@pytest.mark.parametrize("n, rows", [(3, 3), (400, 400), (9999, 500)])
def test_limit_given_as_a_parameter(spark, n, rows):
    g = SqlGuard(spark, {"orders": lambda s: spark.range(2000).withColumnRenamed("id", "x")})
    assert g.run("SELECT x FROM orders LIMIT :n", params={"n": n}).df.count() == rows
    assert g.run("WITH o AS (SELECT x FROM orders LIMIT 5) SELECT * FROM o LIMIT :n", params={"n": n}).df.count() == min(5, rows)


def test_scope_is_not_met_by_a_name_alone(spark):
    g = SqlGuard(spark, {"orders": lambda s: spark.range(3).withColumnRenamed("id", "x"), "commesse": lambda s: spark.range(3).withColumnRenamed("id", "y")})
    for sql in ("WITH orders AS (SELECT 1 AS x) SELECT * FROM orders", "WITH orders AS (SELECT y AS x FROM commesse) SELECT * FROM (SELECT * FROM orders) t",
                "SELECT * FROM commesse WHERE y IN (WITH orders AS (SELECT 1 AS x) SELECT x FROM orders)"):
        with pytest.raises(ValueError, match="must target"):
            g.run(sql, dataset="orders")
    assert g.run("WITH o AS (SELECT x FROM orders), orders AS (SELECT x FROM o) SELECT * FROM orders", dataset="orders").df.count() == 3
    assert g.run("SELECT * FROM commesse WHERE y IN (SELECT x FROM orders)", dataset="orders").df.count() == 3
    with pytest.raises(ValueError, match="outside allowlist"):
        g.run("SELECT * FROM (WITH z AS (SELECT 1 AS x) SELECT * FROM z) a, z")


def test_python_word_and_blank_classes(spark):
    import re
    from orderscope.functions import text as TX
    texts = ["m² and ½ cup", "क्षि हिन्दी", "a\x1cb\x1d\x1e c\x1f", "naïve_word Ⅷ x​y", "á b", "  x\x85y　z "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", "t", TX.tokenize("t").alias("w"), TX.norm_whitespace("t").alias("s")).collect():
        assert r["w"] == re.findall(r"\w+", r["t"].lower()) and r["s"] == re.sub(r"\s+", " ", r["t"]).strip()
