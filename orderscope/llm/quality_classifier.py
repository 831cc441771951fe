"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns whole texts into a row of numbers each (numpy over Arrow buffers, one pass, no
shuffle), written to the shared folder; ``fit`` grows the trees on a bounded sample of labelled rows;
``Forest.score`` walks all rows through the flattened trees, one vectorised numpy step per level.
Null and empty texts have all-zero statistics and get the forest's score for those. Rows are scored
one by one, so repeated rows, null ids and extra columns need no rule; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, trimmed, written
from .words import U, Words, chunks, inside_docs, ngram_hashes

#: Rows of labels used to fit, by smallest hash of their id (a documented bound; scoring covers all rows).
MAX_FIT_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = ["log_bytes", "log_words", "upper", "lower", "digit", "sentence_mark", "other_mark", "symbol", "wide",
            "word_bytes", "word_bytes_sd", "short_words", "distinct_words", "top_word", "repeated_runs",
            "repeated_lines", "line_words", "symbol_words", "marked_words", "upper_words"]

_SYMBOLS = b"#*$%&|<>@^~_=+\\/{}[]"
_CLASSES = ["upper", "lower", "digit", "sentence_mark", "symbol", "wide", "blank", "other_mark"]


def _class_table() -> np.ndarray:
    t = np.full(256, 7, np.int64)
    t[65:91], t[97:123], t[48:58], t[128:] = 0, 1, 2, 5
    t[list(b".!?")] = 3
    t[list(_SYMBOLS)] = 4
    t[[32, 9, 10, 11, 12, 13]] = 6
    return t


def _repeated(keys: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: distinct keys and the size of the largest group of equal keys."""
    if not len(keys):
        return np.zeros(n_docs), np.zeros(n_docs)
    packed = np.sort((doc.astype(np.uint64) << U(40)) | (keys >> U(24)))
    edge = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1], True])
    owner = (packed[edge[:-1]] >> U(40)).astype(np.int64)
    largest = np.zeros(n_docs)
    np.maximum.at(largest, owner, np.diff(edge))
    return np.bincount(owner, minlength=n_docs).astype(float), largest


def document_statistics(words) -> np.ndarray:
    """(documents x FEATURES) for one chunk of texts."""
    data, bounds, n = words.data, words.bounds, len(words.bounds) - 1
    size, count = np.diff(bounds).astype(float), words.counts.astype(float)
    cls = _class_table()[data]
    per = np.bincount(np.repeat(np.arange(n) * 8, np.diff(bounds)) + cls, minlength=8 * n).reshape(n, 8)
    share = per / np.maximum(size, 1)[:, None]
    doc = words.doc_of_word()
    length = (words.end - words.start).astype(float)
    every = np.maximum(count, 1)

    def mean(x):
        return np.bincount(doc, weights=x, minlength=n) / every

    word_bytes = mean(length)
    hashes = words.hashes()
    distinct, top = _repeated(hashes, doc, n)
    inside = inside_docs(words.offsets, 4, len(hashes))
    runs = ngram_hashes(hashes, 4)
    ok = inside[: len(runs)]
    runs_of = np.bincount(doc[: len(runs)][ok], minlength=n)
    runs_distinct, _ = _repeated(runs[ok], doc[: len(runs)][ok], n)
    lines = Words(data, bounds, blanks=(10,))
    lines_distinct, _ = _repeated(lines.hashes(), lines.doc_of_word(), n)
    n_lines = lines.counts
    last, first = cls[words.end - 1], cls[words.start]
    out = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(count), "word_bytes": word_bytes,
        "word_bytes_sd": np.sqrt(np.maximum(mean(length ** 2) - word_bytes ** 2, 0)),
        "short_words": mean(length <= 3), "distinct_words": distinct / every, "top_word": top / every,
        "repeated_runs": 1 - runs_distinct / np.maximum(runs_of, 1) - (runs_of == 0),
        "repeated_lines": 1 - lines_distinct / np.maximum(n_lines, 1) - (n_lines == 0),
        "line_words": count / np.maximum(n_lines, 1), "symbol_words": mean(last == 4), "marked_words": mean(last == 3),
        "upper_words": mean((first == 0) & ((cls[np.minimum(words.start + 1, max(len(data) - 1, 0))] == 0) | (length == 1))),
    }
    out |= {k: share[:, i] for i, k in enumerate(_CLASSES) if k in FEATURES}
    return np.stack([out[k] for k in FEATURES], 1).astype(np.float32)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``stats`` (array of FEATURES)."""
    keep = [c for c in docs.columns if c != text]

    def run(batches):
        for batch in batches:
            parts = [document_statistics(w) for _, _, w in chunks(batch.column(len(keep)))]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], flat], [*keep, "stats"])

    schema = docs.select(*keep).schema.add("stats", T.ArrayType(T.FloatType()))
    return docs.select(*keep, F.col(text).cast("string")).mapInArrow(run, schema)


@dataclass
class Forest:
    """Trees of one depth, flattened: node i of tree t has feature, threshold; leaves have values."""

    feature: np.ndarray    # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    value: np.ndarray      # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and len(node) and node[0] < inner:  # all rows stand on the same level
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
         min_rows: int = 20, l2: float = 1.0) -> Forest:
    """Fit boosted trees for log loss on binned columns; every split is found in a histogram of
    gradients and hessians per (node, feature, bin)."""
    n, k = x.shape
    p = (y.sum() + 1) / (n + 2)
    base = float(np.log(p / (1 - p)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if n < 2 * min_rows or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) for j in range(k)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)], 1)
    margin = np.full(n, base)
    all_f, all_t, all_v = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(n, np.int64)
        feat, thr = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            lo, width = 2 ** level - 1, 2 ** level
            cell = (((node - lo)[:, None] * k + np.arange(k)) * bins + code).ravel()
            hist = [np.bincount(cell, np.repeat(w, k), width * k * bins).reshape(width, k, bins).cumsum(2) for w in (g, h, np.ones(n))]
            gl, hl, nl = hist
            gt, ht, nt = gl[..., -1:], hl[..., -1:], nl[..., -1:]
            gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
            gain[(nl < min_rows) | (nt - nl < min_rows)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i, b in enumerate(best):
                f, c = divmod(int(b), bins)
                if gain[i, f, c] > 1e-6 and c < len(cuts[f]):
                    feat[lo + i], thr[lo + i] = f, cuts[f][c]
            node = 2 * node + 1 + (x[np.arange(n), feat[node]] > thr[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += value[leaf]
        all_f.append(feat), all_t.append(thr), all_v.append(value)
    return Forest(np.array(all_f), np.array(all_t), np.array(all_v), base)


def fold(doc_id, folds: int = 5):
    return F.crc32(F.col(doc_id).cast("string")) % folds


def fit_labels(labels: DataFrame, label: str = "quality", folds: int = 5, held_fold: int = 0,
               max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id and y of at most ``max_rows`` labels outside the held-out fold, by smallest hash of the id
    (null ids and null labels are not used; several labels of one id count as their largest)."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", folds) != held_fold))
            .groupBy("doc_id").agg(F.max(label).alias("y"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_fold: int = 0,
        max_rows: int = MAX_FIT_ROWS) -> Forest:
    """Grow the forest on the rows of ``stats`` that ``fit_labels`` names."""
    known = fit_labels(labels, label, folds, held_fold, max_rows)
    rows = stats.join(known, "doc_id").select("doc_id", "stats", "y").orderBy("doc_id", F.xxhash64("stats")).limit(max_rows).collect()
    x = np.array([r["stats"] for r in rows], np.float32).reshape(len(rows), len(FEATURES))
    return grow(x, np.array([float(r["y"]) for r in rows]))


def scored(stats: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """``stats`` with ``score`` and ``predicted`` in place of the statistics."""
    keep = [c for c in stats.columns if c != "stats"]

    def run(batches):
        for batch in batches:
            flat = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False)
            s = forest.score(flat.reshape(-1, len(FEATURES)).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                [*keep, "score", "predicted"])

    schema = stats.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return stats.select(*keep, "stats").mapInArrow(run, schema)


def judged(docs: DataFrame, forest: Forest, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, ``score`` and ``predicted``: statistics and trees in one pass over the texts."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            x = [document_statistics(w) for _, _, w in chunks(batch.column(names.index(text)))]
            s = forest.score(np.concatenate(x) if x else np.zeros((0, len(FEATURES)), np.float32))
            trimmed()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, name: str = "op10") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    stats = written(statistics(docs.select("doc_id", "text")), f"{name}-stats")
    held = F.coalesce(fold("doc_id") == 0, F.lit(False))
    return scored(stats, fit(stats, labels)).withColumn("held_out", held).select("doc_id", "held_out", "score", "predicted")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, table(spark, sf_dir, "documents", "doc_id", "text"),
                    table(spark, sf_dir, "labels", "doc_id", "quality"))
