import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus as C  # noqa: E402

pytest.importorskip("orderscope.llm.registry")
from orderscope.llm import quality_classifier as Q  # noqa: E402
from orderscope.llm import sharding  # noqa: E402
from orderscope.llm.words import chunks  # noqa: E402


def winner(key, shards):
    def time(s):
        return -math.log((int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52))
    return min(range(shards), key=lambda s: (time(s), s))


def test_sharding_query_against_the_race(spark, tmp_path):
    rows = C.documents(seed=3, n=50)
    C.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op9_sharding(spark, str(tmp_path)).collect()
    want = Counter()
    for d, t, *_ in rows:
        raw = (t or "").encode()
        key = str(d) if d is not None else "text:" + hashlib.md5(raw).hexdigest()
        want[d, len(raw) + 1, zlib.crc32(raw), "key", winner(key, 16), winner(key, 17)] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for s in range(16):
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine)))


def plain_statistics(text):
    b = (text or "").encode()
    words, lines = re.findall(rb"[^\x20\x09-\x0d]+", b), re.findall(rb"[^\n]+", b)
    n, n_lines = len(words), len(lines)

    def kind(c):
        return ("upper" if 65 <= c <= 90 else "lower" if 97 <= c <= 122 else "digit" if 48 <= c <= 57 else "wide" if c >= 128 else "sentence_mark" if c in b".!?"
                else "symbol" if c in b"#*$%&|<>@^~_=+\\/{}[]" else "blank" if c in b" \t\n\x0b\x0c\r" else "other_mark")
    share = Counter(map(kind, b))
    size = np.array([len(w) for w in words], float)
    runs = [tuple(words[i:i + 4]) for i in range(n - 3)]

    def mean(x):
        return sum(x) / max(n, 1)
    out = {"log_bytes": math.log1p(len(b)), "log_words": math.log1p(n), "word_bytes": mean(size), "word_bytes_sd": float(size.std()) if n else 0.0,
           "short_words": mean([len(w) <= 3 for w in words]), "distinct_words": len(set(words)) / max(n, 1), "top_word": max(Counter(words).values(), default=0) / max(n, 1),
           "repeated_runs": 1 - len(set(runs)) / len(runs) if runs else 0, "repeated_lines": 1 - len(set(lines)) / n_lines if lines else 0, "line_words": n / max(n_lines, 1),
           "symbol_words": mean([kind(w[-1]) == "symbol" for w in words]), "marked_words": mean([kind(w[-1]) == "sentence_mark" for w in words]),
           "upper_words": mean([kind(w[0]) == "upper" and (len(w) == 1 or kind(w[1]) == "upper") for w in words])}
    return [out.get(k, share[k] / max(len(b), 1)) for k in Q.FEATURES]


def test_document_statistics():
    texts = [t for _, t, *_ in C.documents(n=40)] + ["A BC dE. #x\n\nA BC dE. #x\n", "\n \n", "x", "É! É! É!", "one two three four one two three four", "*" * 5000]
    got = np.concatenate([Q.document_statistics(w) for _, _, w in chunks(pa.array(texts, pa.string()))])
    assert np.allclose(got, np.array([plain_statistics(t) for t in texts]), atol=2e-6, rtol=1e-5)


def plain_trees(x, y, trees, depth, rate, bins, min_rows, l2):
    """The same trees by trying every cut of every feature in every node."""
    p = (y.sum() + 1) / (len(y) + 2)
    margin = np.full(len(y), math.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) for j in range(x.shape[1])]
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        groups = [np.arange(len(y))]
        for _ in range(depth):
            after = []
            for rows in groups:
                best = (1e-6, None, None)
                for j in range(x.shape[1]):
                    for c in cuts[j]:
                        lo = rows[x[rows, j] <= c]
                        if min_rows <= len(lo) <= len(rows) - min_rows:
                            gl, hl, gt, ht = g[lo].sum(), h[lo].sum(), g[rows].sum(), h[rows].sum()
                            gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
                            if gain > best[0] + 1e-12:
                                best = (gain, j, c)
                _, j, c = best
                right = np.zeros(len(rows), bool) if j is None else x[rows, j] > c
                after += [rows[~right], rows[right]]
            groups = after
        for rows in groups:
            margin[rows] += -rate * g[rows].sum() / (h[rows].sum() + l2)
    return 1 / (1 + np.exp(-margin))


def test_boosted_trees_against_every_cut():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] + 0.3 * rng.normal(size=160) > 0)).astype(float)
    kind = dict(trees=6, depth=3, rate=0.3, bins=16, min_rows=5, l2=1.0)
    assert np.allclose(Q.grow(x, y, **kind).score(x), plain_trees(x, y, **kind), atol=1e-9)


def test_judged_in_one_pass_equals_two(spark):
    rows = [(i, t, lang, s) for i, (_, t, lang, s) in enumerate(C.documents(n=30))]
    docs = C.frame(spark, rows)
    stats = Q.statistics(docs.select("doc_id", "text"))
    y = spark.createDataFrame([(i, int(len(C.words(t)) > 60)) for i, t, *_ in rows], "doc_id long, quality int")
    forest = Q.fit(stats, y)
    two = {r.doc_id: (r.score, r.predicted) for r in Q.scored(stats, forest).collect()}
    assert {r.doc_id: (r.score, r.predicted) for r in Q.judged(docs, forest).collect()} == two
    assert Q.judged(docs, forest).columns == [*docs.columns, "score", "predicted"]
