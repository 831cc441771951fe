import math
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus as C  # noqa: E402

llm = pytest.importorskip("orderscope.llm.registry")
from orderscope.llm import (chat_rotation, decontaminate, exchange, lm_scoring, mixing, ngram_jaccard, quality_classifier,  # noqa: E402
                            quality_rules, sharding, substring_dedup, token_files)

from orderscope.llm import words as exchange_words  # noqa: E402

ROWS = C.documents()
EMPTY = []


@pytest.fixture(scope="module")
def docs(spark):
    return C.frame(spark, ROWS)


@pytest.fixture
def sf(spark, tmp_path):
    """A folder of tables made from rows."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    """Many chunks and parts even for small tables."""
    small = exchange.dealt
    for m in (ngram_jaccard, substring_dedup, lm_scoring):
        monkeypatch.setattr(m, "dealt", lambda d, chunk_text=0: small(d, chunk_text=40_000, part_text=60_000))


@pytest.mark.parametrize("rows", [ROWS, EMPTY, C.documents(seed=5, n=30)], ids=["awkward", "empty", "other"])
def test_jaccard_components(spark, rows):
    got = ngram_jaccard.near_duplicates(C.frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    C.same(got, C.components(rows))


def test_jaccard_leaders_and_tiles(spark, monkeypatch):
    """A family of near copies is joined through leaders and through tiles alike."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"e{i}" if j in (i * 7 % 200, i * 13 % 200) else w for j, w in enumerate(base)), None, None) for i in range(40)]
    rows += [(100 + i, " ".join(base[:120] + [f"x{i}_{j}" for j in range(60)]), None, None) for i in range(10)]
    for least, most, block in ((8, 8, 1024), (0, 0, 1024), (0, 0, 4), (1, 1, 4)):  # leaders first, or tiles of one or many blocks only
        for name, value in (("MIN_ROUNDS", least), ("MAX_ROUNDS", most), ("BLOCK", block)):
            monkeypatch.setattr(ngram_jaccard, name, value)
        C.same(ngram_jaccard.near_duplicates(C.frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect(), C.components(rows))


@pytest.mark.parametrize("rows", [[r for r in ROWS if r[0] is not None and r[0] != 68][:-2], EMPTY, C.documents(seed=8, n=40)[:40]], ids=["awkward", "empty", "other"])
def test_substring_dedup(spark, rows):
    got = substring_dedup.deduplicated(C.frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    C.same(got, C.kept_words(rows))


def test_substring_dedup_counts_every_row(spark, docs):
    """Rows of equal or null ids: none is lost, and all but the first copy of a row go."""
    got = substring_dedup.deduplicated(docs).collect()
    assert len(got) == len(ROWS)
    assert sorted(r.n_removed == r.n_words for r in got if r.doc_id == 0) == [False, True, True]


def test_symbols_depend_on_their_span_only():
    """Every symbol whose span lies inside a copied stretch is found again in the copy."""
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 40, 60).astype(np.uint64)
    texts = [np.r_[rng.integers(0, 40, a), shared, rng.integers(0, 40, b)].astype(np.uint64) for a, b in ((17, 5), (3, 29))]
    per = []
    for w, a in zip(texts, (17, 3)):
        per.append([{(int(n), int(lo) - a, int(hi) - a) for n, lo, hi in zip(*level) if lo >= a and hi <= a + 60}
                    for level in substring_dedup.runs_and_pairs(w, np.array([0, len(w)]))])
    assert per[0] == per[1] and len(per[0][3]) > 3


@pytest.mark.parametrize("items", [[(1, None), (2, ""), (None, "of the"), (3, "One"), (7, "été ÉTÉ x été ÉTÉ x été ÉTÉ x été ÉTÉ x")], []], ids=["short", "empty"])
def test_decontamination(spark, docs, sf, items):
    passage = C.words(ROWS[4][1])
    items = items and items + [(11, " ".join(passage[8:40])), (10, " ".join(passage[20:30]).upper()), (12, " ".join(passage[20:29] + ["zzz"] * 9))]
    folder = sf("documents", ROWS, "doc_id long, text string, lang string, source string")
    sf("benchmark", items, "item_id long, text string")
    got = decontaminate.op5_decontamination(spark, folder).collect()
    C.same(got, C.contamination(ROWS, items))


def test_decontamination_of_nothing(spark, sf):
    folder = sf("documents", [], "doc_id long, text string")
    sf("benchmark", [(1, "a b c")], "item_id long, text string")
    assert decontaminate.op5_decontamination(spark, folder).collect() == []


def test_rules(spark, sf):
    folder = sf("documents", ROWS, "doc_id long, text string, lang string, source string")
    got = quality_rules.op1_quality_rules(spark, folder)
    C.same(got.drop("kept").collect(), C.counts(ROWS))
    assert all(not (r.kept and r.base_failed) for r in got.collect())
    assert quality_rules.judge(quality_rules.measure(C.frame(spark, []))).collect() == []


def test_rules_reject_another_distribution(spark):
    rows = [r for r in C.documents(n=60)[:60] if len(C.words(r[1])) > 100]
    rows = [(i, t, "en", "a") for i, t, *_ in rows] + [(900, " ".join("###%d$$$" % i for i in range(300)), "en", "a")]
    got = {r.doc_id: r.kept for r in quality_rules.judge(quality_rules.measure(C.frame(spark, rows))).collect()}
    assert not got.pop(900) and sum(got.values()) > 0.9 * len(got)


@pytest.mark.parametrize("rows", [ROWS, EMPTY], ids=["awkward", "empty"])
def test_lm_scores(spark, rows):
    got = lm_scoring.scored(C.frame(spark, rows)).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    streams = [(d, [*C.words(C.lower(t)), None]) for d, t, *_ in rows]
    uni, bi, hist = Counter(), Counter(), Counter()
    for d, s in streams:
        if not held(d):
            uni.update(s)
            pairs = list(zip(["<s>", *[x or "</s>" for x in s[:-1]]], s))
            bi.update(pairs)
            hist.update(h for h, _ in pairs)
    n, v, want = sum(uni.values()), len(uni), []
    for d, s in streams:
        base = score = 0.0
        h = "<s>"
        for w in s:
            p = (uni[w] + 1) / (n + v + 1)
            base += math.log10(p)
            keep = hist[h] / (hist[h] + lm_scoring.DISCOUNT * hist[h] ** lm_scoring.HEAPS) if hist[h] else 0
            score += math.log10(keep * bi[h, w] / max(hist[h], 1) + (1 - keep) * p)
            h = w
        want.append((d, held(d), len(s), sum(uni[w] > 0 for w in s), n, round(base, 6), round(score, 6)))
    C.same([(*r[:5], round(r[5], 6), round(r[6], 6)) for r in got], want)


def test_token_files(spark, tmp_path, sf):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = [*ROWS, (500, "a<|endoftext|>b x<|endoftext|>", None, None)]
    got = token_files.op3_token_files(spark, sf("documents", rows, "doc_id long, text string, lang string, source string")).collect()
    t = tokenizers.Tokenizer.from_file(path)
    ids = [(d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x, *_ in rows]
    C.same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids])
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])


def test_token_files_of_nothing(spark, sf):
    pytest.importorskip("public_tokenizers")
    assert token_files.op3_token_files(spark, sf("documents", [], "doc_id long, text string")).collect() == []


def test_token_files_encode_a_unit_once():
    """What the pre-tokenizer makes of words is encoded once, however it is written; other words stay whole."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    tokenizers = pytest.importorskip("tokenizers")
    encoder = token_files.Encoder(path)
    texts = ["The the, THE. \u00c9T\u00c9 \u00e9t\u00e9!the", None, "12 2x", "don't a\u00d7b Stra\u00dfe \u00dfA\u00df \u00ffX e\u0301 a\u00a0b A<|endoftext|>B \u0391\u03a3 \u6f22x \u0085 x\x01y"]
    texts += [f"a{chr(c)}Z{chr(c)}1 {chr(c)}" for c in range(1, 0x600)]
    flat, counts = encoder.ids(pa.array(texts[:3]))
    assert set(encoder.known) == {"the".encode(), b",", b".", "\u00e9t\u00e9".encode(), b"!", b"1", b"2", b"x"}
    flat, counts = encoder.ids(pa.array(texts))
    want = [x.ids for x in tokenizers.Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
    encoder.known = {}
    encoder.closes[:] = False  # without marks units are encoded one by one
    assert encoder.ids(pa.array(texts))[0].tolist() == flat.tolist()


def test_coder_takes_an_id_in_two_steps(monkeypatch):
    """An id costs a step over all blocks and one over those without a right guess."""
    steps, step = [], token_files.Coder.step
    monkeypatch.setattr(token_files.Coder, "step", lambda self, *a: (steps.append(1), step(self, *a)))
    blocks = [np.random.default_rng(i).integers(0, 65536, 200).astype(np.uint16) for i in range(5)] + [np.full(200, 65535, np.uint16)]
    coded = token_files.encode_blocks(blocks)
    assert len(steps) <= 400
    back = token_files.decode_blocks(coded, [200] * 6, [zlib.crc32(b.astype("<u4").tobytes()) for b in blocks])
    assert all((a == b).all() for a, b in zip(back, blocks)) and len(steps) <= 800


def test_coder_round_trip():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 65536, 300), np.zeros(300, np.int64), rng.zipf(1.3, 300) % 65536, np.array([65535]), np.tile([7, 8, 9], 100)]
    blocks = [b.astype(np.uint16) for b in blocks]
    coded = token_files.encode_blocks(blocks)
    checks = [zlib.crc32(b.astype("<u4").tobytes()) for b in blocks]
    back = token_files.decode_blocks(coded, [len(b) for b in blocks], checks)
    assert all((a == b).all() for a, b in zip(back, blocks)) and len(coded[4]) < 200
    one = token_files.decode_blocks(coded[2:3], [300], checks[2:3])  # a block decodes alone
    assert (one[0] == blocks[2]).all()
    with pytest.raises(ValueError, match="checksum"):
        token_files.decode_blocks([coded[2][:40] + b"\x55" + coded[2][41:]], [300], checks[2:3])


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    per, weights = Counter(), {}
    for _, t, _, s in ROWS:
        per[s] += len(C.words(t))
    order = sorted(per, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([per[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    assert math.isclose(sum(want.values()), 1.5 * sum(per.values())) and all(want[s] <= 2 * per[s] + 1e-6 for s in order)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == per[r.source] and math.isclose(r.target, want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 4 * mixing.MIN_BLOCK for s in order)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rows: sorted((str(r.doc_id), r["size"], r.taken) for r in rows if r.doc_id not in (0, 68))
    assert key(got) == key(again)


@pytest.mark.parametrize("block", [16, 4096], ids=["fixed", "large"])
def test_mixing_gives_small_sources_their_targets(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "MIN_BLOCK", block)
    sizes = {"a": [500] * 60, "b": [1, 2], "c": [700], "d": [40] * 3, "e": [900, 0, 800]}
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(n)), "en", s) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    got = mixing.mix(C.frame(spark, rows)).collect()
    want = mixing.targets([sum(ns) for ns in sizes.values()], [5, 2, 1, 5, 2])
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert len(got) == len(rows) and {s: taken[s] for s in sizes} == {s: round(w) for s, w in zip(sizes, want)}


def test_mixing_schedule_fills_every_slot_once(spark):
    slots, blocks = np.array([9000, 3, 0, 1, 400]), np.array([5000, 2, 1, 1, 400])
    rows = mixing.schedule(spark, slots, blocks).collect()
    for p in range(5):
        mine = [r for r in rows if r.place == p]
        assert sorted(r.turn for r in mine) == list(range(slots[p])) and all(r.block == r.turn % blocks[p] for r in mine)
        assert [r.turn for r in mine if r.last] == [n - 1 for n in slots[p:p + 1] if n]
    assert len({r.slot for r in rows}) == len(rows) == slots.sum()


def test_mixing_of_nothing(spark):
    assert mixing.mix(C.frame(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix(C.frame(spark, [(1, None, None, None)])).collect()] == [0]


def test_sharding(spark, docs):
    got = sharding.with_slots(sharding.place(docs.withColumn("shard_", F.lit(1)))).collect()
    assert len(got) == len(ROWS)
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    heavy = sharding.place(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)), weights=[8.0, 1.0]).groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in heavy}[0] > 3 * {r["shard"]: r["count"] for r in heavy}.get(1, 1)
    assert sharding.with_slots(sharding.place(C.frame(spark, []))).collect() == []


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann b", "hi"), (1, 2, "bob", "yes"), (1, 3, "ann b", None), (1, 70, "bob", "late"),
            (2, 0, "system", "alone"), (None, 0, None, "x"), (3, None, "bob", "a"), (3, 0, "bob", "a"), (3, 0, "bob", "a")]
    got = {(r.conv_id, r.example, r.perspective): r for r in chat_rotation.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, 0, "ann b"), (1, 0, "bob"), (1, 1, "ann b"), (1, 1, "bob"), (None, 0, "unknown"), (3, -1, "bob"), (3, 0, "bob")}
    r = got[1, 0, "ann b"]
    assert r.rendered == ("<|start|>system\nbe kind<|end|>\n<|start|>assistant\nhi<|end|>\n<|start|>user name=bob\nyes<|end|>\n<|start|>assistant\n<|end|>\n")
    assert [r.rendered[m.start:m.end] for m in r.mask] == ["hi<|end|>\n", "<|end|>\n"]
    assert "user name=ann_b" in got[1, 0, "bob"].rendered and got[1, 1, "ann b"].n_own_turns == 0 and got[3, 0, "bob"].n_turns == 2
    assert chat_rotation.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_chat_rotation_of_long_dialogues_keeps_context(spark):
    role = lambda i: "system" if i in (0, 50, 61, 130) else "ann" if i % 2 else "bob"
    rows = [(1, i, role(i), f"t{i}.") for i in range(300)] + [(None, i, "ann" if i % 2 else "bob", f"n{i}.") for i in (3, 5, 200)]
    rows += [(2, None, "ann" if i % 2 else "bob", f"u{i:03d}.") for i in range(200)]
    got = {(r.conv_id, r.example, r.perspective): r for r in chat_rotation.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    show = lambda i, p: ("<|start|>" + {"system": "system", p: "assistant"}.get(role(i), f"user name={role(i)}") + f"\nt{i}.<|end|>\n")
    for p in ("ann", "bob"):
        for e in range(5):
            own = list(range(64 * e, min(64 * e + 64, 300)))
            before = [i for i in (0, 50, 61, 130) if i < 64 * e - 8] + list(range(64 * e - 8, 64 * e)) if e else []
            r = got[1, e, p]
            assert r.rendered == "".join(show(i, p) for i in before + own)
            assert [r.rendered[m.start:m.end] for m in r.mask] == [f"t{i}.<|end|>\n" for i in own if role(i) == p]
            assert (r.n_turns, r.n_own_turns) == (len(own), sum(role(i) == p for i in own))
    r = got[None, 3, "ann"]
    assert r.rendered == "<|start|>assistant\nn3.<|end|>\n<|start|>assistant\nn5.<|end|>\n<|start|>user name=bob\nn200.<|end|>\n" and not r.mask
    assert got[2, -1, "bob"].n_turns == 200 and got[2, -1, "bob"].n_own_turns == 100 and len(got) == 10 + 4 + 2


def test_classifier_learns_and_is_held_out(spark, sf):
    good = C.documents(seed=2, n=300)[:300]
    rows = [(i, t if i % 3 else " ".join(w + "###" for w in C.words(t)), g, s) for i, t, g, s in good] + [(None, None, None, None), (999, "", None, None)]
    folder = sf("documents", rows, "doc_id long, text string, lang string, source string")
    sf("labels", [(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.op10_quality_classifier(spark, folder).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held if r.doc_id < 300]) > 0.95


def test_flattened_trees_equal_nested_walks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    forest = quality_classifier.grow(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), trees=10, depth=3)

    def walk(row):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node - 7]
        return 1 / (1 + np.exp(-total))
    assert np.allclose(forest.score(x), [walk(r) for r in x])


def test_classifier_without_labels(spark, sf):
    folder = sf("documents", ROWS, "doc_id long, text string, lang string, source string")
    sf("labels", [], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.op10_quality_classifier(spark, folder).collect()} == {0.5}


def test_pipeline_keeps_one_row_of_a_group(spark):
    """Near copies with null and repeated ids: the least (id, digest) of each component stays, nulls last."""
    import hashlib
    import corpus_pipeline as P
    base = [" ".join(f"{g}{i}" for i in range(200)) for g in "abcd"]
    near = lambda g, *at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(base[g].split()))
    rows = [(None, near(0, 5)), (None, near(0, 90)), (None, base[0]), (None, base[0]),          # null ids only
            (7, base[1]), (7, near(2, 3)), (3, near(2, 70)), (7, near(1, 8)), (None, near(1)),   # 7 is in two groups
            (9, base[3]), (9, base[3]), (11, near(3, 50)), (None, None), (None, None), (8, " ")]
    got = P.near_duplicates(spark, spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3), "").collect()
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())
    want = [min(g, key=order) for g in (rows[:4], [rows[4], rows[7], rows[8]], rows[5:7], rows[9:12])] + rows[12:]
    C.same([(r.doc_id, r.text) for r in got], want)


def test_pipeline(spark, sf):
    import corpus_pipeline as P
    good = C.documents(seed=4, n=120)[:120]
    bench = " ".join(C.words(good[1][1])[:15])
    rows = [(i, t, g, s, len(t)) for i, t, g, s in good] + [(500 + i, "### $$$ %%% " * 30, "en", "a", 10) for i in range(40)]
    folder = sf("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf("labels", [(r[0], int(r[0] < 500), 0) for r in rows], "doc_id long, quality int, toxic int")
    sf("benchmark", [(1, bench)], "item_id long, text string")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, folder), "test-" + name.replace(" ", "-"))
        kept.append(docs.collect())
        assert docs.columns[:5] == P.COLUMNS
    assert {r.doc_id for r in kept[0]} == set(range(120))
    parts = {d: c for d, _, c in C.components(good)}
    assert {r.doc_id for r in kept[1]} == {c for c in parts.values()}
    bad = {d for d, *_, hit in C.contamination([(r.doc_id, r.text) for r in kept[1]], [(1, bench)]) if hit}
    assert {r.doc_id for r in kept[2]} == {r.doc_id for r in kept[1]} - bad and 1 in bad
    assert max(Counter(r.doc_id for r in kept[3]).values()) <= 2
    assert len(kept[4]) == len(kept[3]) and all(sorted(r.slot for r in kept[4] if r.shard == s) == list(range(sum(r.shard == s for r in kept[4]))) for s in range(16))
    assert len(P.run(spark, folder).collect()) == len(kept[4])


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n)), "".join("ba"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_modulo_two_to_the_64(spark):
    """Two words of 1,024 characters with one polynomial hash, whatever its base, are two words everywhere."""
    import pyarrow as pa
    one, other = thue_morse(1024)
    data = pa.array([one, other])
    for salt in (0, 1):
        (_, _, w), = exchange_words.chunks(data)
        assert len(set(w.hashes(salt).tolist())) == 2
    fill = "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12 x13 x14 x15 x16 x17 x18 x19 x20 x21 x22 x23 x24 x25"
    rows = [(1, f"{one} " + " ".join([one] * 25), None, None), (2, f"{other} " + " ".join([other] * 25), None, None), (3, one, None, None), (4, other, None, None),
            (5, fill.replace("x13", one), None, None), (6, fill.replace("x13", other), None, None)]
    C.same(substring_dedup.deduplicated(C.frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect(), C.kept_words(rows))
    C.same(ngram_jaccard.near_duplicates(C.frame(spark, rows)).collect(), C.components(rows))
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    flat, counts = token_files.Encoder(path).ids(data)
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in (one, other)]
    assert counts.tolist() == [len(w) for w in want] and flat.tolist() == want[0] + want[1]


def test_equal_ids_have_one_order_for_any_number_of_chunks(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(7, passage + " tail of one", None, None), (7, "head of the other " + passage, None, None), (None, passage + " nowhere", None, None)] + [(100 + i, f"filler {i} " * 9, None, None) for i in range(30)]
    outcomes = set()
    for size in (1 << 20, 4000, 600):
        monkeypatch.setattr(substring_dedup, "dealt", lambda d, size=size: exchange.dealt(d, chunk_text=size, part_text=size))
        outcomes.add(tuple(sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.deduplicated(C.frame(spark, rows)).collect())))
    assert len(outcomes) == 1


def test_one_token_shared_by_many_near_copies(spark, monkeypatch):
    """A family around one passage: pairs are made once, however many tokens two sets share."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base + [f"u{i}_{j}" for j in range(8 + i % 30)]), None, None) for i in range(700)]
    made = []
    real = ngram_jaccard.tiled
    monkeypatch.setattr(ngram_jaccard, "tiled", lambda *a: made.append(ngram_jaccard.written(real(*a), "test")) or made[-1])
    monkeypatch.setattr(ngram_jaccard, "MAX_ROUNDS", 0), monkeypatch.setattr(ngram_jaccard, "MIN_ROUNDS", 0), monkeypatch.setattr(ngram_jaccard, "BLOCK", 256)
    C.same(ngram_jaccard.near_duplicates(C.frame(spark, rows)).collect(), C.components(rows))
    pairs = [tuple(r) for r in made[0].collect()]
    assert pairs and len(pairs) == len(set(pairs))


@pytest.mark.parametrize("set_bytes", [16 << 20, 10_000], ids=["one block", "many blocks"])
def test_tiles_return_fewer_links_than_rows(spark, monkeypatch, set_bytes):
    """Inside a family nothing that leaves a tile grows with the pairs, near misses or links."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 60 - i % 20] + [f"u{i}_{j}" for j in range(4 + i % 12)]), None, None) for i in range(300)]
    made, here = [], []
    real, met = ngram_jaccard.tiled, ngram_jaccard.met
    monkeypatch.setattr(ngram_jaccard, "tiled", lambda *a: made.append(ngram_jaccard.written(real(*a), "test")) or made[-1])
    monkeypatch.setattr(ngram_jaccard, "SET_BYTES", set_bytes)
    monkeypatch.setattr(ngram_jaccard, "met", lambda *a: here.append(ngram_jaccard.written(met(*a), "test")) or here[-1])
    monkeypatch.setattr(ngram_jaccard, "MAX_ROUNDS", 0), monkeypatch.setattr(ngram_jaccard, "MIN_ROUNDS", 0)
    C.same(ngram_jaccard.near_duplicates(C.frame(spark, rows)).collect(), C.components(rows))
    assert made[0].count() < here[0].count()
    if set_bytes > 10_000:  # blocks of one set or two have a link each
        assert made[0].count() < 300
        assert here[0].groupBy("tile", "cls").count().where("count > 1").isEmpty()


def test_new_words_are_encoded_few_at_once(monkeypatch):
    """The library's results for words are held for a bounded number of them, and so are the words' ids."""
    import public_tokenizers
    import pyarrow as pa
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"word{i * 7 + j} shared{j}" for j in range(9)) for i in range(12)]
    encoder, asked = token_files.Encoder(path), []
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    class Library:
        real = encoder.tokenizer

        def encode_batch_fast(self, some, **options):
            asked.append(len(some))
            return self.real.encode_batch_fast(some, **options)
    encoder.tokenizer = Library()
    monkeypatch.setattr(token_files, "WORDS_AT_ONCE", 4), monkeypatch.setattr(token_files, "CACHE_WORDS", 30)
    for lo in range(0, 12, 3):
        flat, counts = encoder.ids(pa.array(texts[lo: lo + 3]))
        assert flat.tolist() == sum(want[lo: lo + 3], []) and counts.tolist() == [len(w) for w in want[lo: lo + 3]]
        assert len(encoder.known) <= 30 + 3 * 18
    assert max(asked) <= 4


def test_messages_are_never_more_than_keys(spark, monkeypatch):
    """Chunks send nothing to parts that they have no keys for."""
    sent = []
    real = exchange.asked
    monkeypatch.setattr(ngram_jaccard, "asked", lambda docs, ask: sent.append(real(docs, ask)) or sent[-1])
    monkeypatch.setattr(ngram_jaccard, "dealt", lambda d: exchange.dealt(d, chunk_text=300, part_text=30))
    ngram_jaccard.described(C.frame(spark, [(i, " ".join(f"w{i}_{j}" for j in range(12)), None, None) for i in range(60)]).select("doc_id", "text")).collect()
    assert sent[0].count() <= 60 * 8  # eight shingles each
    assert sent[0].where("length(body) = 0").count() == 0
