"""Jobs that keep one shuffle of their rows on disk at once: rounds, steps deleted early, shuffle files dropped at the end."""

import os

import pytest
from pyspark.sql import functions as F

from orderscope import session as S
from orderscope.operators import ranking as R
from orderscope.sources import fixtures as FX


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_written_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = S.written_once(spark.range(10_000).repartition(7, "id"), "dropped-shuffle")
    assert shuffle_files(spark) <= before
    assert kept.count() == 10_000
    assert spark.conf.get(S._SHUFFLES_END, None) != "true"  # the session's own jobs are as before


def test_rounds_hold_every_row_once_and_replace_the_earlier_step(spark, monkeypatch):
    monkeypatch.setattr(S, "ROUND_ROWS", 10)
    df = spark.range(40).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("k"), "id")
    first = S.written_once(df, "first-step")
    rounds = S.in_rounds(first, "k", 40)
    assert len(rounds) == 4
    second = S.written_once([x.withColumn("n", F.lit(1)) for x in rounds], "second-step", instead_of=first)
    assert sorted(r["id"] for r in second.collect()) == list(range(40))
    assert not os.path.exists(first._step_path.removeprefix("file://").removeprefix("file:"))


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_ids_by_group_are_the_row_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "ROUND_ROWS", 100)
    monkeypatch.setattr(R, "HOT_ROWS", hot)
    df = spark.range(300).select((F.col("id") * 37 % 300 % 41).alias("g"), (F.col("id") * 7 % 300).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b"))
    df = df.withColumn("g", F.when(F.col("g") < 12, 3).otherwise(F.col("g")))  # one large group
    want = {tuple(r) for r in R.with_row_ids(df, ["g", "a", "b"], "n").collect()}
    rounds = R.with_ids_by_group(df, "g", ["a", "b"], "n", 5)
    assert len(rounds) == 3
    assert {tuple(r) for x in rounds for r in x.collect()} == want


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def lines_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("lines"))
    table(spark, d, "region", [(0, "ASIA")], "r_regionkey long, r_name string")
    table(spark, d, "nation", [(0, "JAPAN", 0)], "n_nationkey long, n_name string, n_regionkey long")
    table(spark, d, "supplier", [(i, f"S{i}", 0) for i in (1, 2, 37)], "s_suppkey long, s_name string, s_nationkey long")
    table(spark, d, "part", [(i, f"part {i}", "B", "T") for i in (1, 2, 3)], "p_partkey long, p_name string, p_brand string, p_type string")
    table(spark, d, "orders", [(i, 100.0 + i, "1996-01-02", "LOW") for i in range(8)], "o_orderkey long, o_totalprice double, o_orderdate string, o_orderpriority string")
    li = [(o, 1 + (o + n) % 3, (1, 2, 37)[(o + n) % 3], n, 50.0 if n == 2 else 7.0, 10.5 * n, 0.0 if n == 1 else 0.1, 0.0 if n == 3 else 0.2, "N", "O" if o % 2 else "F", "1996-02-03")
          for o in range(9) for n in range(1, 5)]
    li += [(0, 99, 1, 0, 7.0, 1.0, 0.1, 0.2, "N", "F", "1996-02-03"), (2, 1, None, 2, 7.0, 1.0, 0.1, 0.2, "N", "F", "1996-02-03"), (None, 1, 1, 1, 7.0, 1.0, 0.1, 0.2, "N", "F", "1996-02-03")]
    table(spark, d, "lineitem", li, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_discount double, "
                                    "l_tax double, l_returnflag string, l_linestatus string, l_shipdate string")
    return d


@pytest.mark.parametrize("limit", [200_000, 0])
def test_lines_joined_in_rounds_have_the_rows_and_ids_of_one_join(spark, lines_dir, monkeypatch, limit):
    monkeypatch.setattr(S, "ROUND_ROWS", 9)
    monkeypatch.setattr(FX.ENGINE, "broadcast_row_limit", limit)
    with S.steps_dropped(spark):
        rounds = FX.build_procurement(spark, lines_dir, ids=True)
        assert len(rounds) > 1
        rows = sorted((r for x in rounds for r in x.collect()), key=lambda r: r["record_id"])
    keys = [tuple(r[c] for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")) for r in rows]
    assert len(rows) == 32 and [r["record_id"] for r in rows] == list(range(32)) and keys == sorted(keys)
    one = next(r for r in rows if (r["l_orderkey"], r["l_linenumber"]) == (0, 1))
    assert (str(one["amount"]), str(one["importo_tot"]), str(one["delivery_date"]), one["vendor"], one["city"]) == ("10.50", "10.50", "1996-02-03", "S2", "JAPAN")
    two = next(r for r in rows if (r["l_orderkey"], r["l_linenumber"]) == (1, 2))
    assert (two["amount"], str(two["importo_tot"]), two["delivery_date"], two["order_summary"]) == (None, "101.00", None, "part 1")
    assert all(r["vendor"] is None for r in rows if r["l_suppkey"] == 37) and all(r["order_summary"] is None for r in rows if r["l_linenumber"] == 3)


def test_embed_job_keys_and_embeds_whole_texts(spark, tmp_path):
    """F8: two long texts that agree in the first 32,768 characters have keys of their own."""
    import hashlib

    from orderscope.plans import catalog
    same = "word " * 7000
    texts = [same + "one", same + "two", "short", ""]
    table(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    table(spark, tmp_path, "labels", [(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in catalog.queries()["embed_job"](spark, str(tmp_path)).collect()}
    assert [got[i]["cache_key"].rsplit(":", 1)[1] for i in range(4)] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert [got[i]["is_unit"] for i in range(4)] == [True, True, True, False]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_vectors_are_sent_to_the_rows(spark, monkeypatch):
    """rows are not shuffled to find those that have a vector."""
    from orderscope.operators import prepare as P
    monkeypatch.setattr(P, "BROADCAST_IDS", 2)
    raw = spark.range(50).select(F.col("id").alias("record_id"), F.col("id").alias("source_row"), F.lit("o").alias("ordine_n"), F.concat(F.lit("text "), "id").alias("oggetto"))
    summaries = raw.select("record_id", F.lit("s").alias("order_summary"), F.lit("s").alias("summary_normalized"))
    vec = spark.createDataFrame([(3, [1.0]), (7, [0.5])], "record_id long, embedding array<float>")
    raw, summaries = (S.written_once(x, "wide-rows") for x in (raw, summaries))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, unknown = P.assemble_orders(raw, summaries, vec, n_vectors=2), P.assemble_orders(raw, summaries, vec)
        assert plan(few).count("BroadcastHashJoin") >= 2 and "LeftSemi, BuildRight" in plan(few) and "BroadcastHashJoin" not in plan(unknown)
        assert sorted(few.collect()) == sorted(unknown.collect()) and few.count() == 2
        assert "BroadcastHashJoin" not in plan(P.assemble_orders(raw, summaries, vec, n_vectors=3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pending_rows_are_found_by_digest_in_rounds(spark, monkeypatch):
    """signatures are not moved, and a round holds a part of the rows only."""
    from orderscope.operators import enrich as EN
    monkeypatch.setattr(S, "ROUND_ROWS", 8)
    cur = spark.range(30).select(F.when(F.col("id") != 29, F.col("id")).alias("record_id"), F.when(F.col("id") != 28, F.concat(F.lit("k"), F.col("id") % 4)).alias("summary_key"))
    old = cur.select("record_id", F.when(F.col("record_id") % 5 == 0, "other").otherwise(F.col("summary_key")).alias("summary_key"),
                     F.when(F.col("record_id") % 7 != 0, "done").alias("order_summary"))
    want = sorted([i for i in range(28) if i % 5 == 0 or i % 7 == 0] + [28, -1])
    lazy, rounds = EN.summary_pending(cur, old), EN.summary_pending(cur, old, 30)
    assert "_digest" in plan(lazy) and hasattr(rounds, "_step_path")
    for got in (lazy, rounds):
        assert got.columns == ["record_id", "summary_key"]
        assert sorted(-1 if r["record_id"] is None else r["record_id"] for r in got.collect()) == want


def test_the_orders_job_in_rounds_keeps_one_version_of_its_summaries_and_no_step(spark, monkeypatch, tmp_path):
    """ranges, rounds and moved parts give the rows of one pass; steps, old summaries and shuffle files are gone at the end."""
    from orderscope.plans import etl
    from orderscope.sources import ingest as IN
    from orderscope.sources import versioned as VT
    monkeypatch.setattr(S, "ROUND_ROWS", 12)
    monkeypatch.setattr(VT, "PART_ROWS", 10)
    rows = [(None if i == 7 else f"{i:02d}", f"object {i % 5}" if i % 6 else " ", f"{i}.50", "1996-01-02") for i in range(40)]
    df = spark.createDataFrame(rows, "ordine_n string, oggetto string, importo_ordine string, data_ord string")
    IN.write_csv(df, f"{tmp_path}/export")
    names = [f"{tmp_path}/{k}" for k in ("orders", "vectors", "export")]
    before = shuffle_files(spark)
    for version in (1, 2):
        r = etl.run_orders_etl(spark, *names, order_by=["ordine_n"], summaries=f"{tmp_path}/summaries", dim=8)
    assert shuffle_files(spark) <= before + 40  # small jobs of the driver; every written step's files are gone
    assert r.version == 2 and r.counts["export"]["rows"] == 40 and r.counts["summaries"]["dropped"] == 7 and r.counts["stored"]["rows"] == 33 and r.counts["vectors_made"] == 0
    stored = {x["record_id"]: x for x in VT.VersionedTable(spark, names[0], "record_id").read().collect()}
    order = sorted(range(40), key=lambda i: (rows[i][0] is not None, rows[i][0] or ""))
    assert {i: stored[i]["order_code"] for i in stored} == {n: rows[i][0] for n, i in enumerate(order) if i % 6}
    assert VT.VersionedTable(spark, f"{tmp_path}/summaries", "record_id").versions() == [2]
    assert not os.path.exists(r"/" + S.shared_dir(spark, "steps").split(":")[-1].lstrip("/")) or not [x for x in os.listdir("/" + S.shared_dir(spark, "steps").split(":")[-1].lstrip("/")) if x.startswith(("etl-", "checked-export-"))]


def test_chains_in_rounds_of_documents(spark, monkeypatch, lines_dir, tmp_path):
    """pages are built and chains followed in rounds, with the rows of one pass."""
    from orderscope.sources import payload as PL

    def chains(rows):
        with S.steps_dropped(spark):
            pages = [p for p in PL.build_long_pages(spark, lines_dir)]
            whole = S.written_once(pages, "pages")
            out = PL.payload_chains(whole, rows)
            return len(pages), hasattr(out, "_step_path"), sorted(map(tuple, out.collect()))
    one = chains(None)
    monkeypatch.setattr(S, "ROUND_ROWS", 9)
    many = chains(60)
    assert (one[0], one[1]) == (1, False) and many[0] > 1 and many[1]
    assert one[2] == many[2] and len(one[2]) == 36 + 1 + 9
