import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus as C  # noqa: E402

collocations = pytest.importorskip("orderscope.llm.collocations")


def brute(rows, max_words=3, least=10, share=50, top=2000):
    f, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", C.lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(ws)
            for n in range(1, max_words + 1):
                for i in range(len(ws) - n + 1):
                    f[lang or "und", tuple(ws[i:i + n])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i:i + m]] = max(longer[lang, p[i:i + m]], a)
    found = {}
    for (lang, p), a in cand.items():
        if (lang, p) in longer and 100 * longer[lang, p] >= share * a:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, x in found.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])]


def prose(seed, n=160):
    """Texts over few words, with ties, odd blanks, every piece end, and frequent phrases inside longer ones."""
    r = random.Random(seed)
    vocab = ["the", "of", "The", "é", "x", "new", "york", "city", "a b", "w\x00z"]
    rows = []
    for i in range(n):
        t = "".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"]) for _ in range(r.randint(0, 40)))
        rows.append((r.choice([i, None, 3]), t + " New York City Hall" * r.randint(0, 2), r.choice(["en", "en", "en", "fr", None])))
    return rows + [(1, None, "en"), (2, "", None), (None, " . ", "only ends")] + [(7, "same row again and again", "en")] * 12


@pytest.fixture(autouse=True)
def small(monkeypatch):
    """Several chunks and parts, short blocks and cut texts even for small tables."""
    for name, value in (("CHUNK_TEXT", 3000), ("PART_TEXT", 5000), ("BLOCK", 100), ("LONG", 500), ("BUCKET_ROWS", 20)):
        monkeypatch.setattr(collocations, name, value)


@pytest.mark.parametrize("rows", [prose(1), prose(2, 40), C.documents(n=30), []], ids=["few words", "smaller", "awkward", "empty"])
@pytest.mark.parametrize("kind", [{}, {"max_words": 4, "min_count": 3, "share": 80, "top": 15}], ids=["as dealt", "four words"])
def test_collocations(spark, rows, kind):
    names = {"max_words": "max_words", "min_count": "least", "share": "share", "top": "top"}
    docs = (C.frame(spark, [r[:3] for r in rows], "doc_id long, text string, lang string").withColumnRenamed("text", "body").withColumnRenamed("lang", "l")
            .withColumns({c: F.lit(1) for c in ("chunk", "n", "phrase", "text", "lang")}))
    got = collocations.collocations(docs, "body", "l", **kind).collect()
    C.same(got, brute(rows, **{names[k]: v for k, v in kind.items()}))


def test_one_fingerprint_for_all_phrases(spark, monkeypatch):
    """Collisions everywhere: phrases are told apart by their words."""
    real = collocations.Grams.fingerprints
    monkeypatch.setattr(collocations.Grams, "fingerprints", lambda self, n: (lambda at, key: (at, key % np.uint64(3)))(*real(self, n)))
    rows = prose(3)
    C.same(collocations.collocations(C.frame(spark, rows, "doc_id long, text string, lang string")).collect(), brute(rows))


def test_fingerprints_do_not_depend_on_place():
    """Equal words have equal fingerprints in chunks of other lengths, blocks and neighbours."""
    phrase = "one two three four"
    texts = [phrase, "x " * 250 + phrase, "y. " + "z " * 333 + phrase + " q" * 700]
    for n in range(1, 5):
        seen = set()
        for t in texts:
            g = collocations.Grams(pa.chunked_array([pa.array([t])]), pa.chunked_array([pa.array(["en"])]))
            at, key = g.fingerprints(n)
            where = {tuple(g.words[int(w)].as_py().decode() for w in g.word[i:i + n]): k for i, k in zip(at, key)}
            seen.add(int(where[tuple(phrase.split()[:n])]))
        assert len(seen) == 1


def test_score_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000
    counts = spark.createDataFrame([("en", 0, "", 10 * big), ("en", 1, "a", big + 7), ("en", 1, "b", big + 1), ("en", 2, "a b", big)], "lang string, words int, phrase string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: counts)
    assert [tuple(r) for r in collocations.collocations(None).collect()] == [("en", 1, "a b", big, big + 7, big + 1, 10 * big, 10 ** 6 * big * big // ((big + 7) * (big + 1)))]


def test_query(spark, tmp_path):
    rows = prose(4)
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = collocations.op11_collocations(spark, str(tmp_path))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    C.same(got.collect(), brute(rows))
