"""Stored tables, the orders job, checked exports, dates by vote, chains over pages, the vector store, the comparator."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderscope.operators import date_votes as DV
from orderscope.operators import enrich as EN
from orderscope.operators.observed import Counters
from orderscope.plans import etl
from orderscope.plans.compare import compared
from orderscope.sources import ingest as IN
from orderscope.sources import payload as PL
from orderscope.sources import schema as S
from orderscope.sources.versioned import Conflict, VersionedTable

ROWS = T.StructType([T.StructField("id", T.LongType(), metadata={"comment": "the key"}), T.StructField("v", T.StringType()), T.StructField("x", T.DecimalType(10, 2))])


def table(spark, tmp_path, n=100, part_rows=10):
    t = VersionedTable(spark, str(tmp_path / "t"), "id")
    t.reload(spark.range(n).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("v"), "id").alias("v"), F.lit("n/a").alias("x"), F.lit(1).alias("extra")), ROWS, part_rows=part_rows)
    return t


def test_reload_is_typed_and_keeps_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().schema["id"].dataType == T.LongType() and t.read().schema["id"].metadata == {"comment": "the key"}
    assert t.read().count() == 100 and t.read().where("x IS NULL").count() == 100 and t.read().columns == ["id", "v", "x"]
    t.reload(spark.createDataFrame([(1, "a", None)], ROWS))
    assert t.versions() == [1, 2] and t.read().count() == 1 and t.read(1).count() == 100
    assert t.vacuum() == 1 and t.versions() == [2] and t.read().count() == 1


def test_upsert_rewrites_only_the_parts_of_its_keys(spark, tmp_path):
    t = table(spark, tmp_path)
    before = t.manifest()["folders"]
    files = {p: sorted(os.listdir(f[0])) for p, f in before.items()}
    up = spark.createDataFrame([(3, "old", None, 1), (3, "new", None, 2), (5, "five", None, 1)], "id long, v string, x decimal(10,2), seq int")
    assert t.upsert(up, "seq") == 2
    after = t.manifest()["folders"]
    touched = {p for p in before if before[p] != after[p]}
    assert len(before) > 5 and len(touched) == 1
    assert all(sorted(os.listdir(after[p][0])) == files[p] for p in before if p not in touched)
    got = {r["id"]: r["v"] for r in t.read().collect()}
    assert len(got) == 100 and got[3] == "new" and got[5] == "five" and got[4] == "v4"
    t.upsert(spark.createDataFrame([(1000, "far", None, 1)], "id long, v string, x decimal(10,2), seq int"), "seq")
    assert t.read().count() == 101 and t.upsert(up.limit(0), "seq") == 3
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(None, "x", None, 1)], "id long, v string, x decimal(10,2), seq int"), "seq")


def test_a_killed_writer_leaves_the_last_version(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    monkeypatch.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        t.reload(spark.createDataFrame([(1, "a", None)], ROWS))
    monkeypatch.undo()
    assert t.versions() == [1] and t.read().count() == 100
    with pytest.raises(ValueError, match="stop"):
        t.reload(spark.createDataFrame([(1, "a", None)], ROWS), before_commit=lambda: (_ for _ in ()).throw(ValueError("stop")))
    assert t.read().count() == 100
    other = VersionedTable(spark, t.path, "id")
    with pytest.raises(Conflict):
        other._commit(t.manifest(), 0)


def test_append_and_compact(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "s"), "k")
    rows = lambda *ks: spark.createDataFrame([(k, f"{k}!") for k in ks], "k string, v string")
    t.append(rows("a", "b", "b"))
    assert t.append(rows("a", "b")) == 1
    for k in "cdefg":
        t.append(rows("a", k))
    assert sorted(r["k"] for r in t.read().collect()) == list("abcdefg")
    assert max(map(len, t.manifest()["folders"].values())) > 1
    t.compact(1)
    assert max(map(len, t.manifest()["folders"].values())) == 1 and t.read().count() == 7


def test_empty_table_and_string_keys(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "e"), "id")
    t.reload(spark.createDataFrame([], ROWS))
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(7, "x", None, 1)], "id long, v string, x decimal(10,2), seq int"), "seq")
    assert [r["id"] for r in t.read().collect()] == [7]


def test_catalogue_reads_no_data(spark, tmp_path):
    t = table(spark, tmp_path)
    for fs in t.manifest()["folders"].values():
        for f in fs:
            for name in os.listdir(f):
                os.remove(f"{f}/{name}")
    got = [tuple(r) for r in S.stored_catalog(spark, {"t": t}).collect()]
    assert got[0] == ("t", 0, "id", "bigint", "the key") and len(got) == 3


def test_checked_export(spark, tmp_path):
    d = tmp_path / "x"
    d.mkdir()
    (d / "a.csv").write_text('a,b,c\n1,"x, ""y""",3\n1,2\n1,2,3,4\n,,\n')
    assert not IN.has_line_breaks(spark, str(d))
    good, bad = IN.read_checked(spark, str(d))
    assert sorted(map(tuple, good.collect()), key=str) == sorted([("1", 'x, "y"', "3"), (None, None, None)], key=str)
    assert sorted(r["record"] for r in bad.collect()) == ["1,2", "1,2,3,4"]
    (d / "b.csv").write_text('a,b,c\n1,"two\nlines",3\n')
    assert IN.has_line_breaks(spark, str(d))
    good, bad = IN.read_checked(spark, str(d))
    assert good.where(F.col("b") == "two\nlines").count() == 1 and bad.count() == 2


def test_dates_by_vote(spark):
    rows = [("13/02/2024", "01-31-2024"), ("05/01/2024", "02-03-2024"), ("20240105", "1.2.2024"), ("2024/01/05", "5 March 2024"), ("5 Jan 2024", " "),
            ("2024-01-05T10:11:12Z", None), ("2024-02-30", "x"), ("02/13/2024", "2024-1-5 07:00")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    assert DV.votes(df, ["a", "b"]) == {"a": {"slashed": "day first", "dashed": "day first"}, "b": {"slashed": "day first", "dashed": "month first"}}
    out = DV.coerce_dates(df, ["a", "b", "absent"])
    got = {r["i"]: r for r in out.collect()}
    d = dt.date
    assert [got[i]["a"] for i in range(8)] == [d(2024, 2, 13), d(2024, 1, 5), d(2024, 1, 5), d(2024, 1, 5), d(2024, 1, 5), d(2024, 1, 5), None, None]
    assert [got[i]["b"] for i in range(8)] == [d(2024, 1, 31), d(2024, 2, 3), d(2024, 2, 1), d(2024, 3, 5), None, None, None, d(2024, 1, 5)]
    assert {tuple(r) for r in DV.rejected(out, ["a", "b"]).collect()} == {("a", 2), ("b", 1)}


def test_counters_and_empty_input(spark):
    c = Counters()
    kept = c.drop_empty_text(spark.createDataFrame([("a",), ("",), (None,)], "text_normalized string"))
    assert kept.count() == 1 and c.read()["empty_text"] == {"rows": 3, "dropped": 2}
    c.require_rows("empty_text")
    c.watch(spark.range(0), "none").count()
    with pytest.raises(ValueError, match="no rows"):
        c.require_rows("none")


def page(doc, n, items, code=None, text=None):
    import json
    return (doc, n, json.dumps({"items": None if items is None else [{"code": c, "description": d} for c, d in items], "continuation": {"pending_code": code, "pending_description": text}}))


def test_payload_chains(spark, monkeypatch):
    monkeypatch.setattr(PL, "PAGES_PER_RUN", 2)
    rows = [page(1, 0, [("a", "one"), ("b", "two")], "c", "thr"), page(1, 1, [], "c", "ee "), page(1, 2, [], None, "and"), page(1, 3, [(None, " on"), ("d", "four")], "e", "fi"),
            page(1, 4, [("E", "ve")]), page(2, 0, [("x", "whole")], "y", "open"), page(3, 0, [("p", "q")], "r", "lost"), page(3, 1, None), page(3, 2, [("s", "t")]),
            page(4, 0, [("u", "v")], "w", "gap"), page(4, 5, [("z", "after")])]
    df = spark.createDataFrame(rows, "doc_id long, page int, payload string")
    got = sorted(map(tuple, PL.payload_chains(df).collect()), key=str)
    want = [(1, 0, 0, "a", "one", False), (1, 0, 1, "b", "two", False), (1, 3, 0, "c", "three and on", False), (1, 3, 1, "d", "four", False), (1, 4, 0, "E", "five", False),
            (2, 0, 0, "x", "whole", False), (2, 0, -1, "y", "open", True), (3, 0, 0, "p", "q", False), (3, 0, -1, "r", "lost", True), (3, 2, 0, "s", "t", False),
            (4, 0, 0, "u", "v", False), (4, 0, -1, "w", "gap", True), (4, 5, 0, "z", "after", False)]
    assert got == sorted(want, key=str)
    assert [(r["doc_id"], r["page"]) for r in PL.rejected_payloads(df).collect()] == [(3, 1)]


def test_summaries_of_pending_rows_only(spark):
    calls, two_sentences = spark.sparkContext.accumulator(0), EN.two_sentences

    def model(texts):
        calls.add(len(texts))
        return two_sentences(texts)

    rows = spark.createDataFrame([(1, "First one. Second one! Third.", "k1"), (2, "a | b | c", "k2"), (3, "", "k3")], "record_id long, text_raw string, summary_key string")
    out = EN.summary_job(rows, None, batch=model)
    first = {r["record_id"]: r["order_summary"] for r in out.collect()}
    assert first == {1: "First one. Second one!", 2: "a. b.", 3: ""} and calls.value == 3
    again = spark.createDataFrame([(k, f"k{k}", v) for k, v in first.items()], "record_id long, summary_key string, order_summary string")
    assert EN.summary_job(rows, again, batch=model).count() == 3 and calls.value == 4  # the empty one is asked for again


def test_orders_job_twice(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def model(texts):
        made.add(len(texts))
        return np.array([[len(t), 1.0] for t in texts], np.float32)

    rows = [(str(i), f"item {i % 3}" if i else " ", "2024-01-0" + str(i + 1), "12.5", "v") for i in range(5)]
    (tmp_path / "export").mkdir()
    (tmp_path / "export" / "a.csv").write_text("\n".join(["ordine_n,oggetto,data_ord,importo_ordine,fornitore", *[",".join(r) for r in rows], "too,few", ""]))
    paths = [str(tmp_path / n) for n in ("orders", "vectors", "export")]
    kind = dict(order_by=["ordine_n"], summaries=str(tmp_path / "summaries"), model=model, model_id="m", dim=2, rejects_path=str(tmp_path / "bad"))
    one = etl.run_orders_etl(spark, *paths, **kind)
    assert one.version == 1 and one.counts["export"]["rows"] == 5 and one.counts["rejected"] == 1 and one.counts["summaries"]["dropped"] == 1
    assert one.counts["vectors_made"] == 3 == made.value and one.counts["stored"]["rows"] == 4 and one.counts["summaries_pending"] == 5
    assert spark.read.text(str(tmp_path / "bad")).first()[0] == "too,few"
    two = etl.run_orders_etl(spark, *paths, **kind)
    assert two.version == 2 and two.counts["vectors_made"] == 0 and made.value == 3 and two.counts["summaries_pending"] == 1
    stored = VersionedTable(spark, paths[0], "record_id")
    assert [r["order_code"] for r in stored.read().orderBy("record_id").collect()] == ["1", "2", "3", "4"] and stored.schema()["vendor"].metadata["comment"]
    empty = spark.createDataFrame([], "ordine_n string, oggetto string")
    with pytest.raises(ValueError, match="no rows"):
        etl.run_orders_etl(spark, paths[0], paths[1], export=empty, dim=2)
    assert stored.versions() == [1, 2]


def test_comparator(spark):
    df = spark.createDataFrame([(1, 10.0, 10.005, 3, "x"), (2, 1000.0, 1000.9, 3, "y"), (3, 1000.0, 1001.1, 3, "z"), (4, 3.0, None, 3, "3"), (5, 3.0, None, None, "3"), (6, float("nan"), float("nan"), 1, None)],
                               "i int, expected double, total double, n int, name string")
    ok = {r["i"]: (r["ok"], r["reason"]) for r in compared(df, "expected", "total", ["name", "total", "n"]).collect()}
    assert [ok[i][0] for i in range(1, 7)] == [True, True, False, True, False, False] and ok[5][1] == "no value"
    text = {r["i"]: r["ok"] for r in compared(df.withColumn("want", F.lit("x")), "want", "name", ["name", "n"]).collect()}
    assert [text[i] for i in range(1, 7)] == [True, False, False, False, False, False]
    days = spark.createDataFrame([(dt.date(2024, 1, 5), "2024-01-05"), (dt.date(2024, 1, 5), "2024-1-5")], "d date, s string")
    assert [r["ok"] for r in compared(days, "d", "s", ["s"]).collect()] == [True, False]
