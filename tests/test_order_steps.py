"""Steps that order or rank whole tables: partitions grow with the rows, nothing is written twice."""

import os

import pytest
from pyspark.sql import functions as F

from orderscope.operators import ranking as R
from orderscope.session import shared_dir
from orderscope.sources import exports as EX
from orderscope.sources import tables as T


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "PARTITION_ROWS", 10)
    assert T.partitions_for(spark.range(1000)) == 100
    assert T.partitions_for(spark.range(1)) == spark.sparkContext.defaultParallelism


def test_stored_places_give_the_ids_when_read(spark, tmp_path):
    """Rows are written once, in order; their ids come from the places, whatever reads them."""
    df = spark.range(0, 997).select(((F.col("id") * 7919) % 997).alias("k"), F.col("id").alias("v"))
    R.tagged_rows(df, ["k"], 13).write.parquet(str(tmp_path / "rows"))
    tagged = spark.read.parquet(str(tmp_path / "rows"))
    got = R.number_tagged(tagged, R.row_segments(tagged)).orderBy("k").collect()
    assert [(r["k"], r["record_id"]) for r in got] == [(i, i) for i in range(997)]


def test_export_columns_carry_ids(spark):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "record_id", "source_row"]
    p = spark.createDataFrame([(1, 7, 2, 3, 0, 0)], ", ".join(f"{c} long" for c in cols)).withColumns(
        {c: F.lit("x") for c in ("order_code", "category", "contract_type", "order_type", "vendor", "region", "city", "descr", "codice", "order_summary")}
        | {c: F.lit("2020-01-02").cast("date") for c in ("order_date", "delivery_date")} | {c: F.lit(1).cast("decimal(18,2)") for c in ("amount", "importo_tot")})
    out = EX.export_columns(p)
    assert out.columns[-2:] == ["record_id", "source_row"] and out.columns[:4] == EX.SOURCE_ORDER
    assert out.first()["data_consegna"] == "2024-02-30"


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_ranks_in_groups_of_any_size(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(R, "HOT_ROWS", hot_rows)
    rows = [(g, (i * 37) % 101) for g, n in ((1, 101), (2, 3), (3, 20), (4, 21)) for i in range(n)] + [(None, 5)]
    df = spark.createDataFrame(rows, "g long, k long")
    folder = shared_dir(spark, "ranked").replace("file:", "")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = {(r["g"], r["k"]): r["rank0"] for r in R.rank_within_groups(df, ["g"], ["k"]).collect()}
    after = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    want = {}
    for g in (1, 2, 3, 4):
        for n, k in enumerate(sorted(k for h, k in rows if h == g)):
            want[g, k] = n
    assert got == want
    assert bool(after - before) == (hot_rows == 20)  # only large groups are ordered through written ranges


def test_words_are_counted_without_a_shuffle(spark):
    """Only documents that share an id are added up by a shuffle."""
    from orderscope.operators import bm25 as B
    from orderscope.session import written_once
    rows = [(1, ["b", "a", "b"]), (2, []), (3, ["a"]), (None, ["c"])]
    once = written_once(spark.createDataFrame(rows, "d long, tokens array<string>"), "t-once")
    assert "Exchange" not in plan(B.postings_from(once, "d"))
    assert {tuple(r) for r in B.postings_from(once, "d").collect()} == {("a", 1, 1, 3), ("b", 1, 2, 3), ("a", 3, 1, 1), ("c", None, 1, 1)}
    twice = written_once(spark.createDataFrame([*rows, *rows], "d long, tokens array<string>"), "t-twice")
    assert {tuple(r) for r in B.postings_from(twice, "d").collect()} == {("a", 1, 2, 3), ("b", 1, 4, 3), ("a", 3, 2, 1), ("c", None, 2, 1)}


def test_chains_parse_pages_once(spark):
    from orderscope.sources import payload as PL
    from orderscope.session import written_once
    pages = written_once(spark.createDataFrame([(1, 0, '{"items": [{"code": "a", "description": "x"}], "continuation": {"pending_description": "y"}}'),
                                                (1, 1, '{"items": [{"code": null, "description": "z"}], "continuation": {}}')], "doc_id long, page int, payload string"), "t-pages")
    out = PL.payload_chains(pages)
    assert "from_json" not in plan(out)
    assert {(r["page"], r["description"], r["open"]) for r in out.collect()} == {(0, "x", False), (1, "yz", False)}


def test_summaries_join_the_cache_once(spark):
    from orderscope.operators import enrich as EN
    cur = spark.createDataFrame([(1, "k1", "a | b"), (2, "k2", "c"), (3, None, " d ")], "record_id long, summary_key string, text_raw string")
    old = spark.createDataFrame([(1, "k1", "cached"), (1, "k1", "also cached"), (2, "k0", "stale"), (3, "k3", "")], "record_id long, summary_key string, order_summary string")
    out = EN.summary_job(cur, old)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert {(r["record_id"], r["order_summary"]) for r in out.collect()} == {(1, "cached"), (2, "c"), (3, "d")}


def test_the_orders_job_leaves_no_steps_behind(spark, tmp_path):
    from orderscope.plans import etl
    ex = spark.createDataFrame([("1", "V", "red widget", "10.00", "2020-01-01"), ("2", None, "blue bolt", "x", None), ("3", "W", "  ", "1", None)],
                               "ordine_n string, fornitore string, oggetto string, importo_ordine string, data_ord string")

    def steps():
        return {f"{d}/{f}" for d in ("steps", "ranked", "embed-new") for p in [shared_dir(spark, d).replace("file:", "")] if os.path.isdir(p) for f in os.listdir(p)}
    before = steps()
    runs = [etl.run_orders_etl(spark, str(tmp_path / "orders"), str(tmp_path / "vectors"), export=ex, order_by=["ordine_n"], summaries=str(tmp_path / "summaries"), dim=8) for _ in range(2)]
    assert steps() == before
    assert [r.counts["vectors_made"] for r in runs] == [2, 0] and runs[1].version == 2
    from orderscope.sources.versioned import VersionedTable
    assert {(r["record_id"], r["order_summary"]) for r in VersionedTable(spark, str(tmp_path / "orders"), "record_id").read().collect()} == {(0, "red widget"), (1, "blue bolt")}


def test_scores_held_at_once_are_bounded(spark, monkeypatch):
    """A list that very many queries probe is scored in slices and blocks of queries."""
    import numpy as np
    from orderscope.operators import vector_blocks as VB
    seen, best = [], VB._best
    monkeypatch.setattr(VB, "_best", lambda s, ids, k: seen.append(s.shape) or best(s, ids, k))
    monkeypatch.setattr(VB, "QUERY_SLICE", 8)
    r = np.random.default_rng(3)
    import pandas as pd
    q = pd.DataFrame({"q": range(50), "v": list(r.normal(size=(50, 4)))})
    d = pd.DataFrame({"i": range(70), "w": list(r.normal(size=(70, 4)))})
    got = VB._topk(q, d, 3, "q", "v", "i", "w")
    assert max(s[0] for s in seen) <= 8 and len(got) == 150
    exact = (VB._matrix(q["v"]) @ VB._matrix(d["w"]).T).argsort(1)[:, ::-1][:, :3]
    assert got["i"].tolist() == exact.reshape(-1).tolist()
    monkeypatch.setattr(VB, "QUERY_BLOCK", 64)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in zip(q["q"], q["v"])], "query_id long, embedding array<double>")
    ds = spark.createDataFrame([(i, v.tolist()) for i, v in zip(d["i"], d["w"])], "doc_id long, embedding array<double>")
    hits = VB.search(VB.build(ds, 4), qs, 3, 4).orderBy("query_id", "rank").collect()
    assert [h["doc_id"] for h in hits] == exact.reshape(-1).tolist()


def test_current_state_reads_wanted_columns_only(spark, tmp_path):
    from orderscope.streaming.incremental import current_state
    spark.createDataFrame([(1, 1, "a", "long"), (1, 2, "b", "longer"), (2, 1, "c", "x")], "k long, seq long, v string, other string").write.parquet(str(tmp_path / "log"))
    out = current_state(spark, str(tmp_path / "log"), ["k"], columns=["v"])
    assert "other" not in plan(out)
    assert {(r["k"], r["v"], r["seq"]) for r in out.collect()} == {(1, "b", 2), (2, "c", 1)}
    assert set(current_state(spark, str(tmp_path / "log"), ["k"]).columns) == {"k", "seq", "v", "other"}
