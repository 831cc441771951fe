"""Small tables with awkward rows, and brute-force versions of the operators."""

import hashlib
import random
import re
from collections import Counter

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return BLANK.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def documents(seed=1, n=60):
    """(doc_id, text, lang, source): prose, copies, near copies, shared passages, runs, nulls, empties, a long text."""
    r = random.Random(seed)
    vocab = ["the", "of", "and", "to", "in"] + ["".join(r.choice("aeioulrstné") for _ in range(r.randint(2, 9))) for _ in range(300)]
    prose = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, rows = prose(60), []
    for i in range(n):
        text = prose(r.randint(5, 200)).capitalize() + ".\n" + prose(10)
        if i % 7 == 3 and rows:
            text = rows[r.randrange(len(rows))][1] or "x"
        if i % 7 == 5 and rows:
            w = words(rows[r.randrange(len(rows))][1]) or ["y"]
            w[r.randrange(len(w))] = "edited"
            text = " ".join(w)
        if i % 9 == 4:
            text = prose(7) + "\t" + passage + "\x0b" + prose(7)
        rows.append((i, text, r.choice(["en", "fr", None]), r.choice(["a", "b", "c", None])))
    rows += [(n, None, "en", "a"), (n + 1, "", "de", None), (n + 2, " \n\t", None, "b"), (n + 3, "one", "en", "a"), (n + 4, "ONE", "en", "c"),
             (n + 5, "la " * 90, "es", "a"), (n + 6, "la " * 45 + "le " * 30, "xx", "b"), (n + 7, prose(20_000), "en", "a"),
             (n + 8, "été ÉTÉ x " * 12, "fr", "b"), (n + 8, "same id, other text " * 8, "fr", "b"), (None, "no id at all " * 9, "en", "a"),
             (None, None, None, None), rows[0], rows[0]]
    return rows


def frame(spark, rows, columns="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, columns)


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, *_) in enumerate(rows)]


def kept_words(rows, window=20):
    seen, out = set(), []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            if k in seen:
                gone |= set(range(i, i + window))
            seen.add(k)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contamination(rows, items, window=10):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    known = {}
    for item, t in items:
        w = split.findall(lower(t))
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    out = []
    for d, t, *_ in rows:
        w, hit, found = split.findall(lower(t)), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in known:
                    hit |= set(range(i, i + n))
                    found |= known[k]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def counts(rows, window=8):
    out = []
    for d, t, *_ in rows:
        w, t = words(t), t or ""
        grams = [tuple(w[i:i + window]) for i in range(len(w) - window + 1)]
        many = Counter(grams)
        rep = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + window)}
        lines = [x for x in t.split("\n") if words(x)]
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, str(type(x)) if x is None else x) for x in r)
    assert sorted(map(tuple, got), key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))
