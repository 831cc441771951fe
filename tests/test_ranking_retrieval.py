"""Row ids, exact percentiles with a hot group, salted top-k, BM25/hybrid vs brute force, IVF."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderscope import config as C
from orderscope.operators import ann as ANN
from orderscope.operators import bm25 as B
from orderscope.operators import hybrid as H
from orderscope.operators.ranking import exact_percentile, rank_within_groups, with_row_ids
from orderscope.operators.topk import sample_n, topk_per_group


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    g = np.where(np.arange(n) < n // 3, "hot", rng.choice(["a", "b", "c", "d"], n))   # one group = a third
    v = rng.integers(0, 50, n).astype(float)                                          # many ties
    v[::17] = np.nan
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v})
    return spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v"))), pdf


def test_row_ids_are_contiguous(skewed):
    df, pdf = skewed
    out = with_row_ids(df.select("id", "g"), ["g", "id"], num_partitions=7).toPandas()
    exp = pdf.sort_values(["g", "id"]).reset_index(drop=True)
    got = out.sort_values("record_id").reset_index(drop=True)
    assert list(got["record_id"]) == list(range(len(pdf)))
    assert list(got["id"]) == list(exp["id"])


def test_rank_within_groups(skewed):
    df, pdf = skewed
    out = rank_within_groups(df.select("id", "g"), ["g"], ["id"], "r", num_partitions=5).toPandas()
    exp = pdf.assign(r=pdf.sort_values("id").groupby("g").cumcount())
    m = out.merge(exp[["id", "r"]], on="id", suffixes=("", "_e"))
    assert (m["r"] == m["r_e"]).all() and len(m) == len(pdf)


@pytest.mark.parametrize("p", [0.0, 0.5, 0.9, 1.0])
def test_exact_percentile_matches_numpy(skewed, p):
    df, pdf = skewed
    got = {r["g"]: r["q"] for r in exact_percentile(df, "v", p, ["g"], out="q", num_partitions=6).collect()}
    for g, sub in pdf.groupby("g"):
        assert got[g] == pytest.approx(np.nanquantile(sub["v"], p), abs=1e-9)
    overall = exact_percentile(df, "v", p, out="q").first()["q"]
    assert overall == pytest.approx(np.nanquantile(pdf["v"], p), abs=1e-9)


def test_topk_per_group_salted(skewed):
    df, pdf = skewed
    d = df.where(F.col("v").isNotNull())
    got = topk_per_group(d, ["g"], "v", "id", 3, salt_buckets=4).toPandas()
    sub = pdf.dropna().sort_values(["g", "v", "id"], ascending=[True, False, True]).groupby("g").head(3)
    assert sorted(zip(got["g"], got["id"])) == sorted(zip(sub["g"], sub["id"]))


def test_sample_n_exact_and_deterministic(skewed):
    df, _ = skewed
    a = [r[0] for r in sample_n(df, 25, 42, ["id"]).collect()]
    b = [r[0] for r in sample_n(df, 25, 42, ["id"]).collect()]
    assert len(a) == 25 and a == b


# ------------------------------------------------------------------ BM25 / hybrid brute force

DOCS = ["red pump red valve", "blue pump", "green valve seal", "", "pump pump pump", "seal kit red"]


def bm25_numpy(docs, query, k1=C.BM25_K1, b=C.BM25_B, eps=C.BM25_EPSILON):
    toks = [re.findall(r"\w+", d.lower()) for d in docs]
    n = len(toks)
    avgdl = sum(len(t) for t in toks) / n
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    avg = sum(idf.values()) / len(idf)
    idf = {w: (eps * avg if v < 0 else v) for w, v in idf.items()}
    out = np.zeros(n)
    for q in re.findall(r"\w+", query.lower()):
        tf = np.array([t.count(q) for t in toks], dtype=float)
        dl = np.array([len(t) for t in toks], dtype=float)
        out += idf.get(q, 0.0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    return out


def test_bm25_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(DOCS)], "doc_id long, text string")
    idx = B.build_index(docs)
    for query in ["red pump", "pump pump seal", "unknown words", "valve"]:
        q = spark.createDataFrame([(query,)], "text string")
        got = {r["doc_id"]: r["bm25"] for r in B.score_all(idx, B.query_terms(q)).collect()}
        exp = bm25_numpy(DOCS, query)
        assert [got[i] for i in range(len(DOCS))] == pytest.approx(list(exp), abs=1e-9)


def test_hybrid_scores_bounded_and_ranked(spark):
    corpus = H.build_corpus(spark, "/root/testdata/sf0.001")
    qt = B.query_terms(H.query_text(spark, "/root/testdata/sf0.001"))
    res = H.hybrid_search(corpus, qt, H.query_vec(spark, "/root/testdata/sf0.001"), 10).toPandas()
    assert len(res) == 10
    for c in ("score_combined", "score_vector", "score_bm25"):
        assert res[c].between(0, 1).all()
    assert res["score_combined"].round(6).equals((0.4 * res["score_vector"] + 0.6 * res["score_bm25"]).round(6)) or \
        np.allclose(res["score_combined"], 0.4 * res["score_vector"] + 0.6 * res["score_bm25"], atol=2e-6)


def test_minmax_zero_range(spark):
    cand = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.5, 3.0)], "doc_id long, vec_score double, bm25 double")
    out = {r["doc_id"]: (r["vec_score_n"], r["bm25_n"]) for r in H.minmax(cand, ["vec_score", "bm25"], "doc_id").collect()}
    assert out == {1: (0.0, 0.0), 2: (0.0, 1.0)}


# ------------------------------------------------------------------ vectors

def test_batch_topk_and_ivf_full_probe_is_exact(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(300, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs[:20])], "query_id long, embedding array<double>")
    exact = ANN.batch_vector_topk(corpus, queries, 5).toPandas()
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    s = unit[:20] @ unit.T
    for q in range(20):
        assert sorted(exact[exact.query_id == q].doc_id) == sorted(np.argsort(-s[q])[:5].tolist())
    index, cent = ANN.ivf_build(corpus, 4)
    full = ANN.ivf_search(index, cent, queries, 5, nprobe=4)
    rec = ANN.recall_at_k(ANN.batch_vector_topk(corpus, queries, 5), full, 5).first()["recall"]
    assert rec == pytest.approx(1.0)
    exact = ANN.materialize_once(ANN.batch_vector_topk(corpus, queries, 5))
    recalls = [ANN.recall_at_k(exact, ANN.ivf_search(index, cent, queries, 5, p), 5).first()["recall"]
               for p in (1, 2, 3, 4)]
    assert all(a <= b + 1e-12 for a, b in zip(recalls, recalls[1:])) and recalls[-1] == pytest.approx(1.0)
