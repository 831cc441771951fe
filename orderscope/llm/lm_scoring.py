"""LM scoring with a weighted backoff automaton over smoothed bigrams.

States are the histories (a word, or a text's start) and the empty state. A seen bigram (h, w) is an arc
from state h with weight log10(l c(h,w)/c(h) + (1-l) p(w)); every state has a failure arc to the empty
state with weight log10(1-l), where each word has an arc of weight log10 p(w), p(w) the add-one
unigram estimate. l = c(h) / (c(h) + DISCOUNT c(h)^HEAPS): the number of different words after h grows
like a power of c(h), as in Heaps' law, so this is Witten-Bell smoothing with that estimate. Arc and
failure weights of a state sum to one.

The counts of all training texts are held by no task: every chunk of texts asks for the counts of its
own words and bigrams (exchange.py), builds the part of the automaton that its texts can reach, and
traverses them. Null and empty texts consist of the end token. Rows are scored one by one, repeated
rows count as often as they occur; a null id belongs to the training side.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .exchange import answered, asked, by_doc, dealt, packed, rows, served, split_parts, unpacked
from .words import U, chunks, join_hash

FOLDS, HELD = 7, 2
DISCOUNT, HEAPS = 1.5, 0.8
#: Larger chunks ask less often about the same word or bigram.
CHUNK_TEXT = 9 << 20
START, END = U(0x243F6A8885A308D3), U(0x13198A2E03707344)


def token_stream(texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by END, and text bounds."""
    hashes, counts = [], []
    for _, _, w in chunks(texts, lower=True):
        hashes.append(w.hashes())
        counts.append(w.counts)
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    bounds = np.r_[0, np.cumsum(counts + 1)]
    stream = np.full(bounds[-1], END, np.uint64)
    is_end = np.zeros(len(stream), bool)
    is_end[bounds[1:] - 1] = True
    stream[~is_end] = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return stream, bounds


class Automaton:
    """The part of the automaton that the texts of one chunk reach."""

    def __init__(self, stream: np.ndarray, bounds: np.ndarray):
        self.stream, self.bounds = stream, bounds
        history = np.r_[START, stream[:-1]] if len(stream) else stream
        history[bounds[:-1]] = START
        self.words, self.word_at = np.unique(np.r_[START, stream], return_inverse=True)
        self.history_at = np.searchsorted(self.words, history)
        self.word_at = self.word_at[1:]
        self.pairs, self.pair_at = np.unique(join_hash(history, stream), return_inverse=True)

    def training_counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words (START: texts) and of bigrams in the texts where ``train``."""
        use = np.repeat(train, np.diff(self.bounds))
        c = np.bincount(self.word_at[use], minlength=len(self.words))
        c[np.searchsorted(self.words, START)] = train.sum()
        return c.astype(np.uint32), np.bincount(self.pair_at[use], minlength=len(self.pairs)).astype(np.uint32)

    def traverse(self, word_count, pair_count, total: int, distinct: int):
        """Per text: known tokens, unigram score, automaton score. The state after a token is the token's
        history state; a missing arc is the failure arc and the empty state's arc."""
        c, ch, chw = (x.astype(float) for x in (word_count[self.word_at], word_count[self.history_at], pair_count[self.pair_at]))
        p = (c + 1) / (total + distinct + 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            keep = np.where(ch > 0, ch / (ch + DISCOUNT * ch ** HEAPS), 0.0)
            arc = np.where(chw > 0, np.log10(keep * chw / np.maximum(ch, 1) + (1 - keep) * p), np.log10(1 - keep) + np.log10(p))
        at = self.bounds[:-1]
        return np.add.reduceat((c > 0).astype(np.int64), at), np.add.reduceat(np.log10(p), at), np.add.reduceat(arc, at)


def held_out(ids: pa.Array) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % FOLDS == HELD for x in ids.to_pylist()], bool)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    docs, parts = dealt(docs, chunk_text=CHUNK_TEXT)

    def ask(table: pa.Table) -> pa.Table:
        table = by_doc(table)
        a = Automaton(*token_stream(table["text"]))
        words, pairs = a.training_counts(~held_out(table["doc_id"]))
        wo, wa = split_parts(a.words, parts)
        po, pa_ = split_parts(a.pairs, parts)
        return rows(np.arange(parts), table["chunk"][0].as_py(), [packed(
            a.words[wo[wa[i]: wa[i + 1]]], words[wo[wa[i]: wa[i + 1]]],
            a.pairs[po[pa_[i]: pa_[i + 1]]], pairs[po[pa_[i]: pa_[i + 1]]]) for i in range(parts)])

    def serve(bodies: list) -> list:
        sent = [unpacked(b, np.uint64, np.uint32, np.uint64, np.uint32) for b in bodies]
        out = []
        for k in (0, 2):
            keys, at = np.unique(np.concatenate([s[k] for s in sent]), return_inverse=True)
            total = np.bincount(at, np.concatenate([s[k + 1] for s in sent]), len(keys)).astype(np.uint64)
            if k == 0:
                real = keys != START
                size = np.array([total[real].sum(), (total[real] > 0).sum()], np.uint64)
            ends = np.cumsum([len(s[k]) for s in sent])
            out.append([total[at[e - len(s[k]): e]] for s, e in zip(sent, ends)])
        # counts travel in 4 bytes where they fit
        small = [[c.astype(np.uint32) if c.max(initial=0) < 1 << 32 else c for c in counts] for counts in out]
        return [packed(size, w.view(np.uint8), p.view(np.uint8)) for w, p in zip(*small)]

    def use(table: pa.Table, answers: dict) -> pa.Table:
        table = by_doc(table)
        a = Automaton(*token_stream(table["text"]))
        words, pairs = np.zeros(len(a.words), np.uint64), np.zeros(len(a.pairs), np.uint64)
        wo, wa = split_parts(a.words, parts)
        po, pa_ = split_parts(a.pairs, parts)
        size = np.zeros(2, np.uint64)
        for i in range(parts):
            n, w, p = unpacked(answers[i], np.uint64, np.uint8, np.uint8)
            size += n
            for counts, mine, body in ((words, wo[wa[i]: wa[i + 1]], w), (pairs, po[pa_[i]: pa_[i + 1]], p)):
                if len(mine):
                    counts[mine] = body.view(np.uint64 if len(body) == 8 * len(mine) else np.uint32)
        known, base, score = a.traverse(words, pairs, int(size[0]), int(size[1]))
        n = len(known)
        return pa.table({"doc_id": table["doc_id"], "held_out": pa.array(held_out(table["doc_id"])), "n_tokens": pa.array(np.diff(a.bounds), pa.int64()),
                         "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(n, int(size[0])), pa.int64()),
                         "base_score": pa.array(base), "score": pa.array(score)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return answered(docs, served(asked(docs, ask), serve), use,
                    f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents", "doc_id", "text"))
