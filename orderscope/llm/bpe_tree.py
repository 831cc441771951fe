"""BPE encoding by tree concatenation, and decoding.

A text of at most LONG characters is encoded where it stands. A longer one is halved until its pieces
have at most LEAF characters; the pieces are rows of their own, encoded in parallel wherever Spark puts
them, and joined pairwise, level by level. At a join a window around the cut is encoded again and grows
on the side where it disagrees, until its first token is the left half's token at that place and one of
its later tokens is the right half's token at the same place. Tokens of a BPE text are right where every
two neighbours are, and every two neighbours then stand in one of the three encodings, so the joined ids
are those of the whole text. Near a cut or a window's end nothing is trusted: words and special tokens
may be cut there (``margin`` bytes).

Rows: null and empty texts have no ids; repeated rows and null keys are rows like others; other columns
of the input are not read and may have any names. A text of any length is encoded whole: its pieces are
shared out, only its ids come together in one row. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed, written

#: Characters: texts above LONG are cut into pieces of at most LEAF.
LONG, LEAF = 1 << 15, 1 << 14
#: Bytes re-encoded on either side of a join at first, and bytes of texts that a library call gets at most.
REACH, CALL = 256, 1 << 21
#: Different words whose ids a task keeps, twice.
KNOWN = 150_000
#: First bytes of characters that are not white space (some characters behind C2, E1, E2 and E3 are).
_VISIBLE = np.array([b > 0x20 and b not in (0x7F, 0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes, in order, for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of every id of a byte-level tokenizer file."""

    def __init__(self, model: str):
        kind = json.loads(model)
        symbol, added = byte_symbols(), {t["id"]: t["content"] for t in kind.get("added_tokens", [])}
        body = {i: bytes(symbol[c] for c in token) if all(c in symbol for c in token) else token.encode() for token, i in kind["model"]["vocab"].items()}
        body |= {i: token.encode() for i, token in added.items()}
        self.length = np.zeros(max(body) + 1, np.int64)
        self.length[list(body)] = [len(b) for b in body.values()]
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(body[i] for i in sorted(body)), np.uint8)
        cutter = kind.get("pre_tokenizer") or {}
        self.words_apart = (kind.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", False)
                            and not cutter.get("add_prefix_space", True) and not any(" " in t for t in added.values()))
        #: A special token cut by an edge, and the word and blanks before it, end within so many bytes of it.
        self.margin = 64 + max([len(t.encode()) for t in added.values()], default=0)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids in a row, special tokens included."""
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class Codec(Vocabulary):
    """The library's tokenizer besides, and the ids of words seen before."""

    def __init__(self, model: str):
        super().__init__(model)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; Spark shares the rows out
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Where a blank stands before something visible a new word begins whatever is around
        it, so texts fall into such words, and each different word is encoded once."""
        out, lo = [], 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CALL):
                size += len(texts[hi])
                hi += 1
            out += self._encoded([t.encode() for t in texts[lo:hi]])
            lo = hi
        return out

    def _bodies(self, own: list[bytes]) -> list[bytes]:
        """Ids (4 bytes each) of different words. Those not seen lately are encoded in one text: where each begins with
        a blank and something visible, a text of words is encoded word by word."""
        bodies = list(map(self.known.get, own))
        missing = [i for i, x in enumerate(bodies) if x is None]
        for i in missing:
            bodies[i] = self.older.get(own[i])
        fresh = [i for i in missing if bodies[i] is None]
        inner = [i for i in fresh if self.words_apart and own[i][:1] == b" " and len(own[i]) > 1 and _VISIBLE[own[i][1]]]
        if inner:
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join([own[i] for i in inner]).decode()], add_special_tokens=False)[0].ids, np.int32)
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(own[i]) for i in inner]), "left") + 1
            raw, lo = ids.tobytes(), 0
            for i, hi in zip(inner, (4 * ends).tolist()):
                bodies[i] = raw[lo:hi]
                lo = hi
        rest = [i for i in fresh if bodies[i] is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([own[i].decode() for i in rest], add_special_tokens=False)):
            bodies[i] = array("i", e.ids).tobytes()
        self.known.update((own[i], bodies[i]) for i in missing)
        if len(self.known) > KNOWN:  # words that are not asked for again are forgotten with the next generation
            self.known, self.older = {}, self.known
        return bodies

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        bounds = np.cumsum([0, *map(len, texts)])
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        begins = np.zeros(len(data) + 1, bool)
        begins[bounds[:-1]] = True
        if self.words_apart and len(data):
            begins[:-2] |= (data[:-1] == 0x20) & _VISIBLE[data[1:]]
        starts = np.flatnonzero(begins[:-1])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        own = words.dictionary.to_pylist()
        bodies = self._bodies(own)
        pool = np.frombuffer(b"".join(bodies), np.int32)
        size = np.array([len(x) // 4 for x in bodies], np.int64)
        at = words.indices.to_numpy()
        n = size[at]
        total = np.r_[0, np.cumsum(n)]
        first = (np.cumsum(size) - size)[at]
        flat = pool[np.repeat(first - total[:-1], n) + np.arange(total[-1])]
        return np.split(flat, total[np.searchsorted(starts, bounds[1:-1])])

    def join(self, data: bytes, cut: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of ``data`` from those of ``data[:cut]`` and ``data[cut:]``."""
        left_at = np.cumsum(self.length[left]) - self.length[left]
        right_at = cut + np.cumsum(self.length[right]) - self.length[right]
        back = ahead = REACH
        while True:
            i = int(np.searchsorted(left_at, max(0, cut - back - self.margin), "right")) - 1
            while i > 0 and data[left_at[i]] & 0xC0 == 0x80:  # a window starts with a character
                i -= 1
            i = max(i, 0)
            lo = int(left_at[i]) if len(left_at) else 0
            hi = min(len(data), cut + ahead + 2 * self.margin)
            while hi < len(data) and data[hi] & 0xC0 == 0x80:
                hi += 1
            window = self.encode([data[lo:hi].decode()])[0]
            if lo and (window[0] != left[i] or lo + self.length[left[i]] > cut - self.margin):
                back *= 2
                continue
            if hi == len(data):
                return np.concatenate([left[:i], window])
            at = lo + np.cumsum(self.length[window]) - self.length[window]
            inner = np.flatnonzero((at >= cut + self.margin) & (at + self.length[window] <= hi - self.margin))
            place = np.minimum(np.searchsorted(right_at, at[inner]), len(right_at) - 1)
            same = np.flatnonzero((right_at[place] == at[inner]) & (right[place] == window[inner]))
            if len(same):
                return np.concatenate([left[:i], window[: inner[same[0]]], right[place[same[0]]:]])
            ahead *= 2


_made: dict[tuple, Vocabulary] = {}


def codec(model: str, kind: type = Codec):
    """One codec or vocabulary per Python worker and tokenizer."""
    if (model, kind) not in _made:
        _made.clear()
        _made[model, kind] = kind(model)
    return _made[model, kind]


def slices(batch: pa.RecordBatch, sizes: np.ndarray, limit: int):
    """Runs of rows whose sizes add up to about ``limit``: what a task holds at a time."""
    at, total = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def halves(text: str, leaf: int) -> list[str]:
    """The text's pieces of at most ``leaf`` characters, by halving."""
    pieces = [text]
    while len(pieces[0]) > leaf:
        pieces = [p for t in pieces for p in (t[: (len(t) + 1) // 2], t[(len(t) + 1) // 2:])]
    return pieces


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    if ends[-1] >= 1 << 31:
        raise ValueError("a batch holds 2^31 ids or more; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def model_text(spark: SparkSession, path: str):
    """The tokenizer's file, read by the driver and sent to every executor (a few MB at most)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", long: int = LONG, leaf: int = LEAF, decode: bool = False) -> DataFrame:
    """(key, ids array<int>) of every row, as the tokenizers library encodes the whole text with the file at
    ``path``, without the tokens that its post-processor would add. With ``decode``, a third column ``text`` is made
    from the ids in the same pass (as by ``decoded``)."""
    model = model_text(docs.sparkSession, path)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    names = ["key", "ids", *(["text"] if decode else [])]
    schema = f"key {kind}, ids array<int>" + (", text string" if decode else "")

    def shown(keys, ids: list[np.ndarray]) -> list:
        c = codec(model.value)
        return [keys, _lists(ids), *([pa.array([c.decode(x).decode("utf-8", "replace") for x in ids], pa.string())] if decode else [])]

    def whole(batches):
        for batch in batches:
            for b in slices(batch, pc.binary_length(batch.column(1)).to_numpy(), CALL):
                yield pa.RecordBatch.from_arrays(shown(b.column(0), codec(model.value).encode(b.column(1).to_pylist())), names=names)
            trimmed()

    def cut(batches):
        for b in batches:
            for i in range(b.num_rows):
                pieces = halves(b.column(1)[i].as_py(), leaf)
                n = len(pieces)
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], n), pa.repeat(b.column(2)[i], n), pa.array(range(n), pa.int32()), pa.array(pieces)],
                                                 names=["key", "row", "piece", "text"])

    def leaves(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(codec(model.value).encode(b.column(3).to_pylist()))], names=["key", "row", "piece", "text", "ids"])

    def tree(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        data = [t.encode() for t in group["text"].to_pylist()]
        ids = [x.values.to_numpy() for x in group["ids"]]
        while len(ids) > 1:  # a power of two
            whole_ = [a + b for a, b in zip(data[::2], data[1::2])]
            ids = [codec(model.value).join(d, len(a), x, y) for d, a, x, y in zip(whole_, data[::2], ids[::2], ids[1::2])]
            data = whole_
        return pa.table(shown(group["key"].slice(0, 1).combine_chunks(), ids), names=names)

    is_long = F.length("text") > long
    # written once: the row numbers that hold a text's pieces together stay the same if a task runs again
    longs = written(rows.where(is_long), "op13-long").withColumn("row", F.monotonically_increasing_id())
    pieces = longs.mapInArrow(cut, f"key {kind}, row long, piece int, text string").repartition("row", "piece")
    joined = (pieces.mapInArrow(leaves, f"key {kind}, row long, piece int, text string, ids array<int>")
              .groupBy("row").applyInArrow(tree, schema))
    out = rows.where(~is_long).mapInArrow(whole, schema).unionByName(joined)
    return out.withColumnRenamed("key", key)


def decoded(ids: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, text) of every row of (key, ids array<int>): each text is the library's decoding, special
    tokens included. Bytes that are not UTF-8 (ids of parts of texts) become replacement characters."""
    model = model_text(ids.sparkSession, path)
    rows = ids.select(F.col(key).alias("key"), "ids")

    def run(batches):
        for b in (b for batch in batches for b in slices(batch, pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(), CALL // 4)):
            c = codec(model.value, Vocabulary)
            texts = [c.decode(x.values.to_numpy()).decode("utf-8", "replace") if x.is_valid else "" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=["key", "ids", "text"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>, text string").withColumnRenamed("key", key)


def op13_bpe_tree(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids and decoded texts of the whole table, as digests."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    back = encoded(table(spark, sf_dir, "documents", "doc_id", "text"), path, decode=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))
