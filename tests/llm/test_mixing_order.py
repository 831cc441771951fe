import math
import os
import sys
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus as C  # noqa: E402

mixing = pytest.importorskip("orderscope.llm.mixing")


def plain_mix(spark, rows, block):
    """taken, first_slot and n_slots of every row, by walking the golden-ratio points slot by slot."""
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    docs = defaultdict(list)
    hashes = {r["i"]: r["h"] for r in spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, doc_id long, text string").select(
        "i", F.xxhash64(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))), F.lit(17)).alias("h")).collect()}
    for i, r in enumerate(rows):
        docs[r[3]].append((hashes[i], i, len(C.words(r[1]))))
    sizes = [sum(n for _, _, n in docs[s]) for s in order]
    total, weight = 1.5 * sum(sizes), [(5, 2, 1)[i % 3] for i in range(len(order))]
    want, open_ = [0.0] * len(order), set(range(len(order)))
    while open_:  # the excess of what is full goes to the others by weight
        left = total - sum(want[i] for i in range(len(order)) if i not in open_)
        share = {i: left * weight[i] / sum(weight[j] for j in open_) for i in open_}
        full = {i for i in open_ if share[i] >= 2 * sizes[i]}
        for i in full or open_:
            want[i] = 2.0 * sizes[i] if full else share[i]
        open_ = open_ - full if full else set()
    words = [min(round(w), 2 * n) for w, n in zip(want, sizes)]
    stream = [[i for _, i, n in sorted(docs[s]) for _ in range(n)] for s in order]
    n_blocks = [max(1, -(-n // block)) for n in sizes]
    slots = [w // max(n, 1) * b + -(-(w % max(n, 1)) // block) for w, n, b in zip(words, sizes, n_blocks)]
    edges = np.cumsum(slots) / max(1, sum(slots))
    out = {i: [0, None, 0] for i in range(len(rows))}
    turn = [0] * len(order)

    def read(place, slot):
        b = turn[place] % n_blocks[place]
        part = stream[place][b * block: (b + 1) * block]
        if turn[place] == slots[place] - 1 and words[place] % max(1, sizes[place]) % block:
            part = part[: words[place] % sizes[place] % block]
        turn[place] += 1
        for i in set(part):
            out[i][0] += part.count(i)
            out[i][1] = slot if out[i][1] is None else min(out[i][1], slot)
            out[i][2] += 1
    for slot in range(sum(slots)):
        place = min(int(np.searchsorted(edges, (slot + 1) * (5 ** 0.5 - 1) / 2 % 1, "right")), max(p for p in range(len(order)) if slots[p]))
        if turn[place] < slots[place]:
            read(place, slot)
    late = sum(slots)
    for place in range(len(order)):
        while turn[place] < slots[place]:
            read(place, late)
            late += 1
    return [(r[0], len(C.words(r[1])), sizes[order.index(r[3])], want[order.index(r[3])], *out[i]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [4, 16])
def test_mix_is_what_the_schedule_reads(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "MIN_BLOCK", block)
    rows = [r for r in C.documents(n=40)[:40]] + [(100 + i, "one two three " * i, None, s) for i, s in enumerate(["z", "z", None, "tiny", "b"])] + [(200, None, None, "b"), (201, "", None, "only empty")]
    got = mixing.mix(C.frame(spark, rows)).collect()
    by_id = {r[0]: r for r in plain_mix(spark, rows, block)}
    assert len(got) == len(rows)
    for r in got:
        want = by_id[r.doc_id]
        assert (r["size"], r.source_size, r.taken, r.first_slot, r.n_slots) == (want[1], want[2], *want[4:]) and math.isclose(r.target, want[3])


def test_order_depends_on_the_points(spark, monkeypatch):
    rows = [(i, f"w{i} " * 40, None, "abc"[i % 3]) for i in range(30)]
    golden = {r.doc_id: r.first_slot for r in mixing.mix(C.frame(spark, rows)).collect()}
    monkeypatch.setattr(mixing, "PHI", 0.5)
    assert golden != {r.doc_id: r.first_slot for r in mixing.mix(C.frame(spark, rows)).collect()}


def test_every_stretch_holds_every_source_by_its_share(spark):
    slots = np.array([6000, 2500, 1200, 299, 1])
    got = sorted(((r.slot, r.place) for r in mixing.schedule(spark, slots, slots).collect()))
    share, seen = slots / slots.sum(), np.zeros(5)
    for n, (_, place) in enumerate(got, 1):
        seen[place] += 1
        assert (np.abs(seen - n * share) <= 3 * math.log2(n + 2) + 2).all()


def test_columns_of_the_same_names(spark):
    rows = [(i, f"w{i} " * 40, None, "ab"[i % 2]) for i in range(10)]
    plain = {r.doc_id: tuple(r[c] for c in mixing.MADE) for r in mixing.mix(C.frame(spark, rows)).collect()}
    clash = C.frame(spark, rows).withColumns({c: F.lit("x") for c in (*mixing.MADE, "place", "block", "slot", "times", "last")})
    got = mixing.mix(clash)
    assert {r.doc_id: tuple(r[c] for c in mixing.MADE) for r in got.collect()} == plain and got.first()["place"] == "x"


def test_query(spark, tmp_path):
    rows = [r for r in C.documents(n=20)[:20]]
    C.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op8_mixing(spark, str(tmp_path))
    assert got.columns == ["doc_id", *mixing.MADE]
    want = {r[0]: r for r in plain_mix(spark, rows, mixing.MIN_BLOCK)}
    assert all((r["size"], r.source_size, r.taken, r.first_slot, r.n_slots) == (want[r.doc_id][1], want[r.doc_id][2], *want[r.doc_id][4:]) for r in got.collect())
