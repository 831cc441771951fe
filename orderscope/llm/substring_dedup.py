"""Substring dedup by recompression.

Rounds rewrite every document's words: first maximal runs of one word, then, in each pair round,
neighbours whose hashed bits are 0 and 1 become one symbol named by a hash of the two. The same words
get the same symbols wherever they stand, but for symbols whose making looked at words outside; each
symbol carries the span of words it depends on, so a 20-word window knows which symbols inside it are
the same in every copy of it. The first such symbol of the highest level is the window's anchor.

Chunks ask which anchors occur twice anywhere (reveal), then, for the windows of those anchors only,
which window hashes start earlier (verify), and drop the words such windows cover. Windows are judged
on the input. A window is known by 96 bits: two hashes of different words' hashes. Rows of equal ids stand
in the order of their texts' digests; null ids, equal to each other, come last. Null and empty texts have no
words and the hash of the empty string; texts of fewer than 20 words lose nothing, long texts are cut as they
are. Ids are whole numbers (others raise an error). Other columns are not read and may have any names; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exchange import answered, asked, bits_of, dealt, packed, parted, rows, served, unpacked
from .words import U, chunks, inside_docs, join_hash, mix, ngram_hashes

WINDOW = 20
ROUNDS = 6
LAST_ID = np.iinfo(np.int64).max
#: A chunk's question to a part: per document its id, digest and number of windows, per window its place and hashes.
QUESTION = (np.int64, np.uint64, np.uint32, np.uint32, np.uint64, np.uint32)


def runs_and_pairs(hashes: np.ndarray, offsets: np.ndarray, rounds: int = ROUNDS):
    """Yields per level: names, and lo/hi of the words that each symbol depends on."""
    n = len(hashes)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not n:
        return
    # level 0: maximal runs of one word; that a run ends is seen at the words beside it
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]
    start = np.flatnonzero(new)
    end = np.r_[start[1:], n]
    name = join_hash(hashes[start], (end - start).astype(np.uint64), 1)
    lo, hi, owner = start - 1, end + 1, doc[start]
    yield name, lo, hi
    for t in range(rounds):
        bit = mix(name + U(t + 1)) >> U(63) == 1
        same = np.r_[owner[1:] == owner[:-1], False]
        first = ~bit & np.r_[bit[1:], False] & same
        second = np.r_[False, first[:-1]]
        # what is not paired depends on the neighbour that could have paired with it (or on the text's edge)
        left_lo = np.where(np.r_[False, same[:-1]], np.r_[lo[0], lo[:-1]], offsets[owner] - 1)
        right_hi = np.where(same, np.r_[hi[1:], hi[-1]], offsets[owner + 1] + 1)
        paired = np.flatnonzero(first)
        new_name, new_lo, new_hi = name.copy(), np.where(bit, np.minimum(lo, left_lo), lo), np.where(bit, hi, np.maximum(hi, right_hi))
        # the neighbour's own span on its far side never exceeds this symbol's (spans are monotone)
        new_name[paired] = join_hash(name[paired], name[paired + 1], t + 2)
        new_lo[paired] = np.minimum(lo[paired], lo[paired + 1])
        new_hi[paired] = np.maximum(hi[paired], hi[paired + 1])
        keep = ~second
        name, lo, hi, owner = new_name[keep], new_lo[keep], new_hi[keep], owner[keep]
        yield name, lo, hi


def anchors(hashes: np.ndarray, offsets: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window start: the index of its anchor in the returned list of symbol names (with level).
    A window inside one long run has no anchor symbol; the run's word stands for it."""
    levels = list(runs_and_pairs(hashes, offsets))
    which = np.full(len(starts), -1, np.int64)
    names, base = [], 0
    for t in range(len(levels) - 1, -1, -1):
        name, lo, hi = levels[t]
        open_ = np.flatnonzero(which < 0)
        i = np.searchsorted(lo, starts[open_], "left")
        i_ok = np.minimum(i, len(name) - 1)
        ok = (i < len(name)) & (hi[i_ok] <= starts[open_] + window)
        used, at = np.unique(i_ok[ok], return_inverse=True)
        which[open_[ok]] = base + at
        names.append(join_hash(name[used], np.full(len(used), t, np.uint64), 99))
        base += len(used)
    open_ = np.flatnonzero(which < 0)
    which[open_] = base + np.arange(len(open_))
    names.append(join_hash(hashes[starts[open_]], np.zeros(len(open_), np.uint64), 98))
    return which, np.concatenate(names)


class Chunk:
    """Words, windows and anchors of the documents of a chunk, in ascending order of id."""

    def __init__(self, table: pa.Table):
        texts = table["text"].to_pylist()
        digest = np.array([int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") for t in texts], np.uint64)
        ids = table["doc_id"].cast(pa.int64())
        order = np.lexsort((digest, ids.fill_null(LAST_ID).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        self.table, self.digest = table.take(pa.array(order)).combine_chunks(), digest[order]
        self.texts = [w for _, _, w in chunks(self.table["text"])]
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *[w.hashes() for w in self.texts]])
        self.offsets = np.r_[0, np.cumsum(np.concatenate([w.counts for w in self.texts]))].astype(np.int64) if self.texts else np.zeros(1, np.int64)
        grams = ngram_hashes(self.hashes, WINDOW)
        self.starts = np.flatnonzero(inside_docs(self.offsets, WINDOW, len(self.hashes))[: len(grams)])
        self.grams = grams[self.starts]

    def checks(self, windows: np.ndarray) -> np.ndarray:
        """32 more bits of these windows, from other hashes of their words."""
        out = np.zeros(len(windows), np.uint64)
        if len(windows):
            second = np.concatenate([w.hashes(1) for w in self.texts])
            for j in range(WINDOW):
                out *= U(0xD6E8FEB86659FD93)
                out += second[self.starts[windows] + j]
        return (mix(out) >> U(32)).astype(np.uint32)

    def asked_windows(self, shared: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of the windows to ask about (the first of each pair of hashes here), their checks, and the indices of
        those known as repeated."""
        maybe = np.flatnonzero(shared[which])
        checks = self.checks(maybe)
        order = np.lexsort((checks, self.grams[maybe]))  # stable: the first of equal ones is the earliest
        gram, check = self.grams[maybe[order]], checks[order]
        is_first = np.zeros(len(maybe), bool)
        if len(order):
            is_first[order[np.r_[True, (gram[1:] != gram[:-1]) | (check[1:] != check[:-1])]]] = True
        return maybe[is_first], checks[is_first], maybe[~is_first]


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space) of every row."""
    docs, parts = dealt(docs)

    def ask_anchors(table: pa.Table) -> pa.Table:
        c = Chunk(table)
        _, names = anchors(c.hashes, c.offsets, c.starts)
        _, to, which = parted(names, parts)
        return rows(to, table["chunk"][0].as_py(), [names[i].tobytes() for i in which])

    def serve_anchors(bodies: list) -> list:
        sent = [np.frombuffer(b, np.uint64) for b in bodies]
        _, at, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        twice, ends = (count > 1)[at], np.cumsum([len(s) for s in sent])
        return [np.packbits(twice[e - len(s): e]).tobytes() for s, e in zip(sent, ends)]

    def revealed(c: Chunk, answers: dict):
        which, names = anchors(c.hashes, c.offsets, c.starts)
        return c.asked_windows(bits_of(answers, names, parts), which)

    def ask_windows(table: pa.Table, answers: dict) -> pa.Table:
        if not table.num_rows or not answers:  # texts without windows ask nothing
            return rows(np.zeros(0, np.int32), 0, [])
        c = Chunk(table)
        ask, checks, _ = revealed(c, answers)
        doc = np.searchsorted(c.offsets, c.starts[ask], "right") - 1
        ids = c.table["doc_id"].cast(pa.int64()).fill_null(LAST_ID).to_numpy()
        _, to, which = parted(c.grams[ask], parts)
        bodies = {part: packed(*[np.zeros(0, t) for t in QUESTION]) for part in answers}
        for part, w in zip(to.tolist(), which):
            d, n = np.unique(doc[w], return_counts=True)
            bodies[part] = packed(ids[d], c.digest[d], n.astype(np.uint32), (c.starts[ask[w]] - c.offsets[doc[w]]).astype(np.uint32), c.grams[ask[w]], checks[w])
        # which anchors are shared travels along, so that the last step need not ask again
        return rows(list(bodies), table["chunk"][0].as_py(),
                    [packed(np.frombuffer(answers.get(part, b""), np.uint8), np.frombuffer(b, np.uint8)) for part, b in bodies.items()])

    def serve_windows(bodies: list) -> list:
        kept, found = [], []
        for b in bodies:
            k, body = unpacked(b, np.uint8, np.uint8)
            d, g, n, *rest = unpacked(body.tobytes(), *QUESTION)
            kept.append(k), found.append((np.repeat(d, n), np.repeat(g, n), *rest))
        ids, digest, pos, gram, check = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((pos, digest, ids, check, gram))
        later = np.zeros(len(gram), bool)
        later[order[1:]] = (gram[order[1:]] == gram[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
        ends = np.cumsum([len(f[0]) for f in found])
        return [packed(k, np.packbits(later[e - len(f[0]): e])) for k, e, f in zip(kept, ends, found)]

    def cut(table: pa.Table, answers: dict) -> pa.Table:
        c = Chunk(table)
        both = {i: unpacked(b, np.uint8, np.uint8) for i, b in answers.items()}
        ask, _, known = revealed(c, {i: b[0].tobytes() for i, b in both.items()})
        later = bits_of({i: b[1].tobytes() for i, b in both.items()}, c.grams[ask], parts)
        step = np.zeros(len(c.hashes) + 1, np.int64)
        for s in (c.starts[ask[later]], c.starts[known]):
            np.add.at(step, s, 1)
            np.add.at(step, s + WINDOW, -1)
        stays = np.cumsum(step[:-1]) == 0
        kept, at = [], 0
        for w in c.texts:
            mine = stays[at: at + len(w.start)]
            at += len(w.start)
            edge = np.zeros(len(w.data) + 2, np.int32)
            np.add.at(edge, w.start[mine], 1)
            np.add.at(edge, w.end[mine] + 1, -1)  # with the blank behind the word
            take = np.cumsum(edge[: len(w.data)]) > 0
            flat = np.where(w.inside, w.data, 32).astype(np.uint8)
            # a word at a text's end takes no blank: the next byte is the next text's
            tail = w.bounds[1:-1][w.bounds[1:-1] < len(w.data)]
            first = np.zeros(len(w.data) + 1, bool)
            first[w.start[mine]] = True
            take[tail] = first[tail]
            total = np.r_[0, np.cumsum(take)]
            body = flat[take].tobytes()
            ends = total[w.bounds]
            kept += [body[ends[i]: ends[i + 1]].rstrip(b" ") for i in range(len(ends) - 1)]
        total = np.r_[0, np.cumsum(~stays)]
        return pa.table({"doc_id": c.table["doc_id"], "n_words": pa.array(np.diff(c.offsets), pa.int64()),
                         "n_removed": pa.array(total[c.offsets[1:]] - total[c.offsets[:-1]], pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = served(asked(docs, ask_anchors), serve_anchors)
    windows = answered(docs, shared, ask_windows, "part int, chunk int, body binary")
    return answered(docs, served(windows, serve_windows), cut, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
