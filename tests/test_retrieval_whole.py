"""Bounded BM25, the mention join, block-pair search, the pruned inverted file, bracketed percentiles, filters and hits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderscope.operators import bm25 as B
from orderscope.operators import bm25_topk as BT
from orderscope.operators import filters as FL
from orderscope.operators import hybrid as H
from orderscope.operators import mentions as M
from orderscope.operators import ranking as R
from orderscope.operators import vector_blocks as VB
from orderscope.session import written_once


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark):
    """Common words in most documents, rare ones in few."""
    r = random.Random(5)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(400)]
    rows = [(i, " ".join(r.choice(common) for _ in range(r.randint(3, 30))) + " " + " ".join(r.choice(rare) for _ in range(r.randint(0, 3)))) for i in range(1500)]
    rows += [(1500, ""), (1501, None), (1502, "r1 r1 r1 r2"), (1503, "r1 r1 r1 r2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    toks = written_once(B.tokens_of(docs, "doc_id", "text").withColumn("dl", F.size("tokens").cast("long")), "t-docs")
    postings = written_once(B.postings_from(toks, "doc_id"), "t-postings")
    stats = B.stats_from(toks)
    terms = written_once(B.terms_from(postings, stats.select("n_docs").scalar()), "t-terms")
    index = B.BM25Index(toks.select("doc_id", "dl"), postings, terms, stats, "doc_id")
    levels = written_once(BT.with_impacts(index).repartitionByRange("term", "level").sortWithinPartitions("term", "level"), "t-levels")
    return index, BT.ImpactIndex(toks, levels, written_once(BT.blocks_of(levels, terms), "t-blocks"), "doc_id")


@pytest.mark.parametrize("query", ["r1 r2", "r1 r2 r3 c0 c1 c2 c3", "c0", "c0 c1 c1 c5", "r7 r8 r9 r10 r11 r12 c0 c0 c0", "nowhere", ""])
@pytest.mark.parametrize("k", [1, 10])
def test_bounded_topk_equals_full_scoring(spark, corpus, query, k, monkeypatch):
    monkeypatch.setattr(BT, "FIRST", 5)
    index, impacts = corpus
    q = spark.createDataFrame([(query,)], "text string")
    full = B.score_terms(index, B.query_terms(q)).orderBy(F.round("bm25", 9).desc(), "doc_id").limit(k)
    got = BT.topk(impacts, BT.terms_of(q), k)
    assert [(r["doc_id"], round(r["bm25"], 8)) for r in got.collect()] == [(r["doc_id"], round(r["bm25"], 8)) for r in full.collect()]


def test_bounded_topk_reads_less_and_pushes_terms(spark, corpus, monkeypatch):
    monkeypatch.setattr(BT, "FIRST", 5)
    index, impacts = corpus
    terms = {t: 1 for t in ("r1", "r2", "c0", "c1", "c2")}
    reads = []
    BT.topk(impacts, terms, 2, reads).collect()
    all_of_them = index.postings.where(F.col("term").isin(list(terms))).count()
    assert sum(reads) < all_of_them / 4
    assert "In(term, [c0,c1,c2,r1,r2])" in plan(impacts.postings.where(F.col("term").isin(list(terms)) & (F.col("level") <= 3))).split("PushedFilters: ")[1]


NAMES = [(1, "Nord"), (2, "nord ring"), (3, "Süd-Ring"), (4, "x"), (5, " "), (6, None), (7, "Customer#1"), (8, "a b a"), (8, "a b a"), (9, "..")]
TEXTS = [(1, "NORD RING road"), (2, "nordring"), (3, "the süd-ring and x"), (4, None), (5, ""), (6, "customer#12 nord"), (7, "a b a b a"), (7, "a b a b a"), (8, "well.. yes")] \
    + [(100 + i, f"filler nord {i}") for i in range(40)]


@pytest.mark.parametrize("mode", ["substring", "words"])
@pytest.mark.parametrize("hot", [100_000, 3], ids=["plain", "hot keys split"])
def test_mentions(spark, mode, hot, monkeypatch):
    import re
    monkeypatch.setattr(M, "SALT_ROWS", hot)
    texts, names = spark.createDataFrame(TEXTS, "t long, body string"), spark.createDataFrame(NAMES, "n long, name string")
    got = M.mentions(texts, names, "t", "body", "n", "name", mode)

    def holds(text, name):
        if text is None or name is None or not name.strip():
            return False
        if mode == "substring":
            return name.lower() in text.lower()
        words = lambda s: re.findall(r"\w+", s.lower())
        a, b = words(text), words(name)
        return bool(b) and any(a[i:i + len(b)] == b for i in range(len(a) - len(b) + 1))
    want = sorted((t, n) for t, text in TEXTS for n, name in NAMES if holds(text, name))
    assert sorted(set(map(tuple, got.collect()))) == sorted(set(want))
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_mentions_derives_the_names_once(spark):
    derived = spark.sparkContext.accumulator(0)

    def counted(s):
        derived.add(1)
        return s
    names = spark.createDataFrame(NAMES, "n long, name string").select("n", F.udf(counted)("name").alias("name"))
    got = M.mentions(spark.createDataFrame(TEXTS, "t long, body string"), names, "t", "body", "n", "name").collect()
    assert {(1, 1), (1, 2), (6, 1), (6, 7)} <= set(map(tuple, got))
    assert derived.value <= 2 * len(NAMES)  # once for the filter and once for the rows, however often they are read


def test_mentions_of_nothing(spark):
    none = spark.createDataFrame([], "n long, name string")
    assert M.mentions(spark.createDataFrame(TEXTS, "t long, body string"), none, "t", "body", "n", "name").collect() == []


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(600, 8))
    m[10] = m[11]
    m[12] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(600, None)]
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>"), m.astype(np.float32).astype(float)


def brute(m, qids, k):
    u = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    s = np.round(u[qids] @ u.T, 9)
    return {(q, int(i), r + 1) for q, row in zip(qids, s) for r, i in enumerate(np.lexsort((np.arange(len(m)), -row))[:k])}


@pytest.mark.parametrize("blocks", [(16 << 20, 64 << 20), (200, 3000)], ids=["one block", "many blocks"])
def test_block_pairs(spark, vectors, blocks, monkeypatch):
    monkeypatch.setattr(VB, "QUERY_BLOCK", blocks[0]), monkeypatch.setattr(VB, "CORPUS_BLOCK", blocks[1]), monkeypatch.setattr(VB, "SLICE", 16)
    df, m = vectors
    q = df.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    got = VB.block_pair_topk(df, q, 7)
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got.collect()} == brute(m, list(range(0, 600, 50)), 7)


def test_inverted_file_reads_probed_lists_only(spark, vectors, capsys):
    df, m = vectors
    index = VB.build(df, 12)
    assert sum(index.sizes.values()) == 600
    q = df.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    full = VB.search(index, q, 5, 12, split_rows=20)
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in full.collect()} == brute(m, list(range(0, 600, 50)), 5)
    one = VB.search(index, q.where("query_id = 0"), 5, 1)
    one.explain("formatted")
    shown = capsys.readouterr().out
    assert "list_id" in shown.split("PartitionFilters: [")[1].split("]")[0]
    exact = written_once(VB.block_pair_topk(df, q, 5), "t-exact")
    nprobe, recall = VB.calibrated_probes(index, q, exact, 5, 0.9)
    assert recall >= 0.9 and 1 <= nprobe <= 12
    assert VB.lists_for("orders", 1999) == 200 and VB.lists_for("commesse", 64) == 100 and VB.lists_for("orders", 2001) is None


@pytest.mark.parametrize("p", [0.0, 0.37, 0.5, 0.9, 1.0])
def test_bracketed_percentile(spark, p):
    rng = np.random.default_rng(3)
    hot = np.r_[np.full(30_000, 5.0), rng.normal(5, 2, 40_000), np.arange(3.0)]
    rows = [("hot", float(v)) for v in hot] + [("small", float(v)) for v in (3, 1, 2)] + [("one", 7.0), ("none", None), (None, 2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["q"] for r in R.exact_percentile(df, "v", p, ["g"], out="q").collect()}
    want = {"hot": np.quantile(hot, p), "small": np.quantile([1, 2, 3], p), "one": 7.0, None: 2.5}
    assert set(got) == set(want) and all(abs(got[g] - want[g]) < 1e-9 for g in want)
    assert abs(R.exact_percentile(df.where("g = 'hot'"), "v", p, out="q").first()["q"] - want["hot"]) < 1e-9
    assert R.exact_percentile(df.where("v IS NULL"), "v", p, out="q").first()["q"] is None


def test_lookup_is_pushed_and_exact(spark, tmp_path):
    rows = [(7, "x7"), (8, "7"), (12, "007"), (-3, "a"), (13, "1e1")]
    spark.createDataFrame(rows, "record_id long, order_code string").write.parquet(str(tmp_path / "o"))
    df = spark.read.parquet(str(tmp_path / "o"))

    def found(code):
        r = FL.lookup_code(df, code).collect()
        return r[0]["record_id"] if r else None
    assert [found(c) for c in ("7", "8", "007", "-3", "10", "1e1", "+8", "08", "99999999999999999999")] == [7, 8, 12, -3, None, 13, None, None, None]
    assert "EqualTo(record_id,8)" in plan(FL.lookup_code(df, "8"))


def test_hybrid_over_any_table(spark):
    rows = [(i, f"pump number {i}" if i % 3 else f"valve {i}", [1.0, i / 10], f"m{i}") for i in range(30)] + [(90, "pump", None, "no vector")]
    c = H.corpus_of(spark.createDataFrame(rows, "id long, words string, v array<double>, text string").withColumnRenamed("text", "extra"), "id", "words", "v", ["extra", "words"])
    q = spark.createDataFrame([("valve 9",)], "text string")
    hits = H.hybrid_hits(c, B.query_terms(q), F.array(F.lit(1.0), F.lit(0.0)), 5)
    got = hits.collect()
    assert hits.columns == ["id", "score_combined", "score_vector", "score_bm25", "text", "text_normalized", "extra", "words"]
    assert len(got) == 5 and max(got, key=lambda r: r["score_bm25"])["id"] == 9 and all(r["extra"] == f"m{r['id']}" for r in got)
    old = H.hybrid_search(c, B.query_terms(q), F.array(F.lit(1.0), F.lit(0.0)), 5)
    assert {(r["id"], r["score_combined"]) for r in old.collect()} == {(r["id"], r["score_combined"]) for r in got}
