"""Vectorised word splitting and hashing over Arrow string columns (helper inside tasks).

A batch of texts is one byte buffer with document offsets. Words are the runs of
bytes outside a separator set (UTF-8 bytes >= 0x80 are always word bytes, so the
byte classes equal the code point classes). A word's 64-bit hash adds up its lanes of 8
bytes, each mixed with its place; it depends on the word's bytes only, so every task on
every executor gives the same word the same number. (A polynomial modulo 2^64 would not do: for any
base there are short pairs of words, the Thue-Morse ones, with one hash.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK_BYTES = 4 << 20  # texts handled at a time; bounds the working memory of a task

_LANE = U(0x9E3779B97F4A7C15)
_MANY = 256
_LAST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of a lane's first k bytes


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def join_hash(a, b, salt: int = 0) -> np.ndarray:
    """Order-sensitive combination of two hash arrays."""
    return mix(np.asarray(a, np.uint64) * U(0x9FB21C651E98DF25) + np.asarray(b, np.uint64) + U((salt * 2 + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))


class Words:
    """Words of a run of documents: ``start``/``end`` byte spans, ``offsets`` of each document's words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False, blanks=BLANKS):
        sep = np.zeros(256, bool)
        sep[list(blanks)] = True
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            data = table[data]
        self.data, self.bounds = data, bounds
        inside = self.inside = ~sep[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cut = bounds[:-1][bounds[:-1] < len(data)]
            first[cut] = inside[cut]
            cut = bounds[1:][bounds[1:] > 0] - 1
            last[cut] = inside[cut]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.start, bounds)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self, salt: int = 0) -> np.ndarray:
        """64 bits for each word; other salts give independent ones."""
        length = self.end - self.start
        if not len(length):
            return np.zeros(0, np.uint64)
        padded = np.r_[self.data, np.zeros(8, np.uint8)]
        lanes = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from every place on
        other = U(salt * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)

        def lane(body, place):
            return mix(body + (U(2) * np.atleast_1d(np.asarray(place, np.uint64)) + U(1)) * _LANE ^ other)

        total = np.zeros(len(length), np.uint64)
        long = np.flatnonzero(length > 8 * _MANY)
        for w in long:  # a word of very many lanes at once
            place = np.arange(-(-int(length[w]) // 8))
            body = lanes[self.start[w] + 8 * place]
            body[-1] &= _LAST[int(length[w]) - 8 * int(place[-1])]
            total[w] = lane(body, place).sum(dtype=np.uint64)
        word, place = np.flatnonzero(length <= 8 * _MANY) if len(long) else np.arange(len(length)), 0
        while len(word):  # lane by lane of the words that are so long
            body = lanes[self.start[word] + 8 * place] & _LAST[np.minimum(length[word] - 8 * place, 8)]
            total[word] += lane(body, place)
            place += 1
            word = word[length[word] > 8 * place]
        return mix(total + length.astype(np.uint64) * _LANE)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document bounds of an Arrow string array; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]: bounds[-1]], bounds - bounds[0]


def chunks(column, lower: bool = False, limit: int = CHUNK_BYTES, blanks=BLANKS):
    """Runs of whole documents of about ``limit`` bytes: (first row, end row, Words)."""
    data, bounds = text_buffer(column)
    row, n = 0, len(bounds) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, end, Words(data[bounds[row]: bounds[end]], bounds[row: end + 1] - bounds[row], lower, blanks)
        row = end


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries (document bounds are the caller's)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out *= U(0xC2B2AE3D27D4EB4F)
        out += hashes[j: j + len(out)]
    return mix(out)


def inside_docs(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask over run starts: True where a run of ``n`` words stays inside its document."""
    counts = np.diff(offsets)
    left = np.repeat(offsets[1:], counts) - np.arange(total)
    return left >= n
