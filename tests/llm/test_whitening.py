import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus as C  # noqa: E402

whitening = pytest.importorskip("orderscope.llm.whitening")
SCHEMA = "vec_id long, embedding array<double>"


def quantised(rows, d):
    out = []
    for i, v in rows:
        if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, tuple(math.floor(256 * c) for c in v)))
    return out


def check(got, rows, d, weights="one", components=4):
    """Every row against a plain computation over the fit list."""
    kept = quantised(rows, d)
    weight = {x: sum(y == x for _, y in kept) if weights == "count" else 1 for _, x in kept}
    n = sum(weight.values())
    sums = [sum(w * x[j] for x, w in weight.items()) for j in range(d)]
    m = np.array([s / n for s in sums])
    fit, w = np.array([x for x in weight], float) - m, np.array(list(weight.values()), float)
    v = (fit * w[:, None]).T @ fit / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    assert sorted((i is None, i or 0) for i, _ in kept for _ in range(k)) == sorted((r.vec_id is None, r.vec_id or 0) for r in got)
    of = {}
    for i, x in kept:
        of.setdefault(i, []).append(x)
    signs = {}
    for r in sorted(got, key=lambda r: (r.vec_id is None, r.vec_id or 0)):
        assert r.n == n and r.identity_error <= 1e-4
        assert abs(r.explained - e[r.component - 1] / np.trace(v)) <= 1e-4 * r.explained
        options = [(sum((n * a - s) ** 2 for a, s in zip(x, sums)), (np.array(x, float) - m) @ u[:, r.component - 1] / math.sqrt(e[r.component - 1])) for x in of[r.vec_id]]
        fits = [z for dev, z in options if dev == r.deviation and abs(abs(z) - abs(r.whitened)) <= 1e-6 * max(1, abs(z))]
        assert fits
        if abs(fits[0]) > 1e-3:
            assert signs.setdefault(r.component, np.sign(fits[0]) * np.sign(r.whitened)) == np.sign(fits[0]) * np.sign(r.whitened)
    return k


def vectors(seed=1, n=60, d=6):
    r = random.Random(seed)
    v = lambda: [r.gauss(0, 1 + j) / 8 for j in range(d)]
    hot = v()
    rows = [(i, v() if i % 3 else hot) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [None] + [0.0] * (d - 1)), (n + 3, [math.nan] * d), (n + 4, [math.inf] + [1.0] * (d - 1)), (n + 5, [0.5] * (d + 2)),
             (None, v()), (None, hot), (3, v()), (3, hot), (n + 6, [-0.0] * d), (n + 7, [0.0] * d)]
    return rows


@pytest.mark.parametrize("weights", ["one", "count"])
@pytest.mark.parametrize("hot", [1000, 3], ids=["mostly broadcast", "mostly shuffled"])
def test_whitened(spark, monkeypatch, weights, hot):
    monkeypatch.setattr(whitening, "HOT", hot)
    rows = vectors()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "x", "count", "component", "n")})
    assert check(whitening.whitened(docs, weights=weights).collect(), rows, 6, weights) == 4


def test_large_entries_stay_exact(spark):
    """Sums of squares beyond longs, entries of 4 and 8 bytes."""
    rows = [(i, [float(10 ** (i % 9)) * (i + 1), 3.0 - i, 0.25 * i]) for i in range(30)]
    assert check(whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect(), rows, 3) >= 1
    wild = whitening.whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])], SCHEMA))
    assert {r.vec_id for r in wild.collect()} == {1, 2, 3}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])] * 3], ids=["empty", "null only", "one distinct vector"])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_components_without_variance_are_left_out(spark):
    rows = [(i, [i / 16, i / 8, 1.0]) for i in range(12)]  # a line
    assert check(whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect(), rows, 3) == 1


def test_query(spark, tmp_path):
    rows = [(i, [float(np.float32(c)) for c in v] if v else v) for i, v in vectors(seed=4)[:60]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op12_whitening(spark, str(tmp_path))
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    check(got.collect(), rows, 6)
