"""Upsert, incremental enrichment, streaming change log, payloads and the driver contract."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from orderscope.operators import enrich as EN
from orderscope.operators import upsert as UP


def test_upsert_last_wins_and_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "record_id long, v string")
    upd = spark.createDataFrame([(2, "b1", 1), (2, "b2", 2), (4, "d", 1), (4, "d0", 0)], "record_id long, v string, seq int")
    once = UP.upsert(target, upd, "record_id", "seq")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "b2"), (3, "c"), (4, "d")]
    twice = UP.upsert(once, upd, "record_id", "seq")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_embedding_rerun_calls_model_zero_times(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return np.array([[len(t), 1.0, 0.5] for t in texts], dtype=np.float32)

    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "alpha beta"), (4, "")], "doc_id long, text string")
    out, new, misses = EN.embed_job(docs, "text", EN.empty_cache(spark), dim=3, model=model)
    rows = out.orderBy("doc_id").collect()
    new_cache = spark.createDataFrame(new.collect(), new.schema)
    assert calls.value == 3                                 # duplicate text embedded once
    assert rows[0]["embedding"] == rows[2]["embedding"]
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-6 for r in rows)
    before = calls.value
    out2, new2, misses2 = EN.embed_job(docs, "text", new_cache, dim=3, model=model)
    assert out2.count() == 4 and new2.count() == 0 and misses2.count() == 0
    assert calls.value == before


def test_default_model_is_deterministic(spark):
    docs = spark.createDataFrame([(1, "pompa sommersa"), (2, "pompa sommersa")], "doc_id long, text string")
    out, _, _ = EN.embed_job(docs, "text", EN.empty_cache(spark), dim=64)
    e = [r["embedding"] for r in out.orderBy("doc_id").collect()]
    assert e[0] == e[1] and len(e[0]) == 64


def test_long_texts_are_embedded_whole(spark):
    """Texts that agree in the first 32,768 characters keep keys and vectors of their own."""
    def model(texts):
        assert max(map(len, texts)) <= 32_768 and len(texts) <= 128
        return np.array([[t.count("a"), t.count("b"), t.count("c")] for t in texts], dtype=np.float32)

    same = "a " * 16_384
    rows = [(1, same + "b" * 16_384), (2, same + "c" * 40_000), (3, same), (4, "ab"), (5, None)] + [(10 + i, "b" * (i + 1) + "a" * 40_000) for i in range(130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out, new, misses = EN.embed_job(docs, "text", EN.empty_cache(spark), dim=3, model=model)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len({got[i]["cache_key"] for i in (1, 2, 3, 4, 5)}) == 5 and new.count() == len(rows)
    for i, mean in ((1, [2, 1, 0]), (2, [32768, 0, 40000]), (3, [1, 0, 0]), (4, [1, 1, 0])):
        assert np.allclose(got[i]["embedding"], np.array(mean) / np.linalg.norm(mean), atol=1e-5)
    assert [got[i]["over_limit"] for i in (1, 2, 3, 4, 5)] == [True, True, False, False, False] and got[3]["near_limit"]
    bow, _, _ = EN.embed_job(docs.where("doc_id < 3"), "text", EN.empty_cache(spark), dim=64)
    e = [r["embedding"] for r in bow.collect()]
    assert len(e) == 2 and e[0] != e[1]


def test_summary_job_reuses_cache(spark):
    cur = spark.createDataFrame([(1, "k1", "first | second"), (2, "k2", "only"), (3, "k3", "x | y")],
                                "record_id long, summary_key string, text_raw string")
    existing = spark.createDataFrame([(1, "k1", "cached one"), (2, "old", "stale"), (3, "k3", "")],
                                     "record_id long, summary_key string, order_summary string")
    pending = EN.summary_pending(cur, existing)
    assert sorted(r[0] for r in pending.select("record_id").collect()) == [2, 3]
    got = {r["record_id"]: r["order_summary"] for r in EN.summary_job(cur, existing).collect()}
    assert got == {1: "cached one", 2: "only", 3: "x"}


def test_streaming_changelog_last_wins(spark, tmp_path):
    from orderscope.streaming.incremental import current_state, run_available, start_changelog
    src = str(tmp_path / "src")
    schema = "k long, oggetto string, descrizione string, seq int"
    spark.createDataFrame([(1, "Pompa", "x", 1), (2, "Valvola", None, 1)], schema).write.parquet(src + "/v1")
    spark.createDataFrame([(1, "Pompa nuova", "x", 2)], schema).write.parquet(src + "/v2")
    q, log = start_changelog(spark, src + "/*", spark.read.parquet(src + "/v1").schema, ["oggetto"],
                             changelog_dir=str(tmp_path / "log"), checkpoint_dir=str(tmp_path / "ckpt"))
    run_available(q)
    cur = {r["k"]: r["text_normalized"] for r in current_state(spark, log, ["k"]).collect()}
    assert cur == {1: "pompa nuova | x", 2: "valvola"}


def test_payload_roundtrip(spark):
    from orderscope.sources import payload as PL
    pages = PL.pages(spark, SF001)
    items = PL.payload_items(pages)
    stitched = PL.payload_stitch(pages)
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    assert items.count() == li.count() == stitched.count()
    part = spark.read.parquet(f"{SF001}/part.parquet")
    li_names = li.join(part, li.l_partkey == part.p_partkey).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list("p_name")).alias("names"))
    st_names = stitched.groupBy(F.col("doc_id").alias("l_orderkey")).agg(F.sort_array(F.collect_list("description")).alias("names"))
    assert li_names.join(st_names, ["l_orderkey", "names"], "left_anti").count() == 0
    cut = items.join(stitched, ["doc_id", "page", "item_pos"]).where(items.description != stitched.description)
    assert cut.count() > 0                                   # some descriptions really were cut at a page end
    bad = spark.createDataFrame([(1, 0, '{"items": null, "continuation": {}}'), (2, 0, '{"items": []}')],
                                "doc_id long, page int, payload string")
    assert PL.payload_items(bad).count() == 0


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "score_combined" in df.columns
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 100


def test_first_summaries_shuffle_no_rows(spark, capsys):
    cur = spark.createDataFrame([(1, "a | b", "k1"), (2, None, "k2"), (None, "c", None), (1, "a | b", "k1")], "record_id long, text_raw string, summary_key string")
    out = EN.summary_job(cur, None)
    rows = out.select("record_id", "order_summary", "summary_normalized").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(1, "a", "a"), (2, "", ""), (None, "c", "c"), (1, "a", "a")], key=repr)
    out.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan


def test_offline_model_normalises_once(spark, capsys):
    from orderscope.functions import text as TX
    from orderscope.functions import vectors as V
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array
    df = spark.createDataFrame([(1, "Pompa s/n 4 pompa caffè"), (2, ""), (3, None), (4, "日本 x ½ a b c")], "k int, _text string")
    out = EN.hashed_bow(df, 16)
    nested = df.withColumn("_tok", TX.tokenize(TX.normalize_text("_text")))
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=16).transform(nested)
    want = tf.select("k", V.l2_normalize(vector_to_array(F.col("_tf"), "float32")).cast("array<float>").alias("e"))
    assert {r["k"]: r["embedding"] for r in out.collect()} == {r["k"]: r["e"] for r in want.collect()}
    assert out.columns == ["k", "_text", "embedding"]
    capsys.readouterr()
    out.explain()
    chain = "(?iuU)_x000D_, "  # the first replacement of the pattern chain
    once = capsys.readouterr().out.count(chain)
    nested.explain()
    assert once == 1 < capsys.readouterr().out.count(chain)


def test_schema_catalog(spark):
    from orderscope.sources.schema import (ORDERS_DESCRIPTIONS, RAW_DEFAULT, combined_columns, schema_catalog,
                                           with_descriptions)
    a = with_descriptions(spark.createDataFrame([(1, "x", "y")], "record_id long, vendor string, fornitore string"),
                          ORDERS_DESCRIPTIONS, RAW_DEFAULT)
    b = spark.createDataFrame([(1, "z")], "record_id long, committente string")
    cat = {(r[0], r[1]): r[2] for r in schema_catalog(spark, {"orders": a, "commesse": b}).collect()}
    assert cat[("orders", "vendor")] == ORDERS_DESCRIPTIONS["vendor"] and cat[("orders", "fornitore")] == RAW_DEFAULT
    assert combined_columns({"orders": a, "commesse": b}) == ["record_id", "vendor", "fornitore", "committente"]


def test_ingest_helpers(spark, tmp_path):
    from pyspark.sql import types as T
    from orderscope.sources.ingest import read_export, require_rows, typed_reload, write_table
    src = spark.createDataFrame([("1", "2024-02-30", "12,5", " a "), ("2", "2024-01-31", "7.25", None)],
                                "id string, d string, amt string, txt string")
    p = str(tmp_path / "csv")
    src.write.options(header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(p)
    back = read_export(spark, p)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, src.collect()))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("d", T.DateType()),
                           T.StructField("amt", T.DecimalType(18, 2)), T.StructField("extra", T.StringType())])
    typed = typed_reload(back, schema).orderBy("id").collect()
    assert typed[0]["d"] is None and typed[0]["amt"] is None and str(typed[1]["amt"]) == "7.25"
    assert typed[1]["extra"] is None and str(typed[1]["d"]) == "2024-01-31"
    write_table(typed_reload(back, schema), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    with pytest.raises(ValueError):
        require_rows(back.where("1 = 0"))
    with pytest.raises(ValueError):
        require_rows(back, ["nope"])


def test_engine_facade(spark):
    from orderscope.operators import hybrid as H
    from orderscope.plans import extra as X
    from orderscope.plans.api import Engine

    def embed64(texts):
        return np.array([[float(len(t) % 7 + 1)] + [1.0] * 63 for t in texts], dtype=np.float32)

    eng = Engine(spark, X._orders_vec(spark, SF001), X._commesse(spark, SF001),
                 corpus=H.build_corpus(spark, SF001), embedder=embed64, dim=64)
    r = eng.run_sql("SELECT COUNT(*) AS n FROM orders WHERE amount >= :m", params={"m": 0})
    assert r.df.first()["n"] > 0 and r.warnings == ["Added default LIMIT 200"]
    hits = eng.semantic_search(order_code="7", top_k=3, filters={"amount_min": 0})
    assert hits.count() == 3 and hits.orderBy(F.desc("similarity")).first()["record_id"] == 7
    assert eng.semantic_search(query_text="Machinery urgent", top_k=4).count() == 4
    assert eng.semantic_search_commesse(commessa_code="12", top_k=2).count() == 2
    assert eng.search("pompa sommersa", top_k=5).count() == 5
    assert eng.list_schema().count() > 10
    with pytest.raises(ValueError):
        eng.semantic_search()
    with pytest.raises(ValueError):
        eng.semantic_search(order_code="7", top_k=0)
