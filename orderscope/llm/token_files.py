"""Token-ID files: an adaptive context-mixing arithmetic coder in independent, checksummed blocks.

Format. A file is the run of blocks of one range of ascending ids, one Parquet row per block:
``file``, ``block`` (from 0), ``n_ids``, ``crc32`` (of the ids as little-endian uint32), ``payload``
(coder bytes), and the directory of the documents that end in the block: ``doc_ids`` and ``doc_ends``
(position in the file behind their last id). A block decodes alone: its models start empty.

Model. Per id, the last id seen after the same two ids (order 2) and after the same id (order 1) are
predictions. Their hit rates by confidence are mixed in the logistic domain, with weights learnt on the
way, into the probability that the order-2 (then the order-1) prediction is right; else the id is coded
by adaptive order-0 tables of three nibbles, each after the nibbles above it, and four flat bits. Ids are below 2^16,
as for the vocabularies meant here; larger ids are refused.

A task codes many blocks side by side: every numpy step moves all blocks on by one decision.
Null texts are empty and have the end id only; null ids come first; rows with equal ids stand in
order of their text's hash; an empty table makes no file.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, total_bytes, trimmed, written
from .words import BLANKS, U, chunks

BLOCK = 2048
LANES = 4096  # blocks that are coded side by side, half as many again where that leaves none over
FILE_TEXT = 24 << 20
END_ID = 2
SLOTS = 1024
#: A task keeps the ids of about this many different words, and has this many new ones encoded at once: the
#: library's result for a word is some hundred times as large as its ids.
CACHE_WORDS = 300_000
WORDS_AT_ONCE = 4096

_TOP, _WORD = 48, 16  # a coder's window, and the bits that leave it at once
_GUESS_BITS, _CDF, _NIBBLE = 14, 15, 12  # what the frequencies of a guess and of a nibble add up to, learnt with 15 bits and coded with 12
# logits of 12-bit probabilities, times 256, and back, rounded, so that every machine has the same tables
_STRETCH = np.round(np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096))) * 256).astype(np.float32)
_SQUASH = np.clip(np.round(16384 / (1 + np.exp((2048 - np.arange(4096)) / 256))), 128, 16256).astype(np.int64)
# where a nibble's lower bounds move to when it is seen; every nibble keeps a frequency above 0
_GOAL = (np.arange(16)[None, :] * 8 + np.where(np.arange(16)[None, :] > np.arange(16)[:, None], (1 << _CDF) - 128, 0)).astype(np.int16)
_BYTES = U(0x0101010101010101)

BLANK, LETTER, DIGIT, SIGN, HARD = range(5)  # kinds of bytes
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The rules of normalisation and cutting that the encoder knows for Latin-1.
CUTS = [{"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}]


def _rules(tokenizer) -> list:
    return [part and json.loads(part.__getstate__()) for part in (tokenizer.normalizer, tokenizer.pre_tokenizer)]


class Coder:
    """Range coder over many lanes: each step codes, in some lanes, an interval [cum, cum + freq) of 2^bits.
    The range stays above 2^32: words of 16 bits leave the window as it narrows; a carry runs into the words before."""

    def __init__(self, lanes: int, length: int, streams: list[bytes] | None = None):
        self.range = np.full(lanes, 1 << _TOP, np.int64)
        self.low = np.zeros(lanes, np.int64)  # decoding: how far the code lies above the interval's lower end
        self.decoding = streams is not None
        # an id takes 54 bits at most; behind its end a stream has zeros (pages that nothing is written to cost nothing)
        self.width = max(max(map(len, streams), default=0) // 2, 4 * length) + 4 if self.decoding else 4 * length + 4
        self.words = np.zeros(lanes * self.width, np.uint16)
        self.at = np.arange(lanes) * self.width
        if self.decoding:
            for i, s in zip(self.at, streams):
                self.words[i: i + len(s) // 2] = np.frombuffer(s[: len(s) // 2 * 2], "<u2")
            for _ in range(_TOP // _WORD):
                self.low = (self.low << _WORD) | self.words[self.at]
                self.at += 1

    def value(self, low: np.ndarray, part: np.ndarray, bits: int) -> np.ndarray:
        """Decoding: where in 2^bits the next interval lies (exact: the quotient has few bits)."""
        return np.minimum(low / part, (1 << bits) - 1).astype(np.int64)

    def step(self, lane, low: np.ndarray, range_: np.ndarray, part: np.ndarray, cum, freq) -> None:
        """Moves ``low`` and ``range_``, those of the lanes ``lane`` (None: of all), into the interval."""
        np.multiply(part, freq, out=range_)
        part *= cum
        if self.decoding:
            low -= part
        else:
            low += part
        some = (range_ < 1 << (_TOP - _WORD)).nonzero()[0]
        while len(some):
            who, x, r = some if lane is None else lane.take(some), low.take(some), range_.take(some)
            at = self.at.take(who)
            if self.decoding:  # a damaged stream may leave its range: its checksum tells
                low[some] = (np.minimum(x, r - 1) << _WORD) | self.words.take(at)
            else:
                self.put(at, x >> (_TOP - _WORD))
                low[some] = (x & ((1 << (_TOP - _WORD)) - 1)) << _WORD
            at += 1
            r <<= _WORD
            self.at[who] = at
            range_[some] = r
            some = some[r < 1 << (_TOP - _WORD)]

    def put(self, at: np.ndarray, word: np.ndarray) -> None:
        self.words[at] = word.astype(np.uint16)
        over = at[word > 0xFFFF] - 1
        while len(over):
            self.words[over] += np.uint16(1)
            over = over[self.words[over] == 0] - 1

    def finished(self) -> list[bytes]:
        """The words so far and one that, with zeros behind it, lies inside the last interval."""
        self.put(self.at, (self.low + (1 << (_TOP - _WORD)) - 1) >> (_TOP - _WORD))
        return [self.words[i * self.width: n + 1].astype("<u2").tobytes() for i, n in enumerate(self.at)]


class Model:
    """Predictions and adaptive probabilities of every lane. Arrays have an axis for the order of a prediction
    (after two ids, after one) and, before it, one for the step that asks whether the first (then the second) is right."""

    def __init__(self, lanes: int):
        self.slots = np.arange(2 * lanes).reshape(2, lanes) * SLOTS
        self.seen = np.full(2 * lanes * SLOTS, -16, np.int32)  # 16 x guess + trust
        self.rates = np.arange(4 * lanes).reshape(2, 2, lanes) * 16
        self.hit = np.full(4 * lanes * 16, 2048, np.int32)  # by trust
        self.weight = np.full((2, 2, lanes), 0.6, np.float32)
        start = (np.arange(16) << (_CDF - 4)).astype(np.int16).view("V32")
        self.nibbles = [np.repeat(start, lanes * n) for n in (1, 16, 256)]  # lower bounds

    def mixed(self, trust, same):
        """The probabilities (of 2^14) that the guesses are right: two hit rates each, mixed in the logistic domain."""
        at = self.rates + trust
        at[0, 1] -= ((trust[1] + 1) >> 1) * ~same
        rate = self.hit.take(at)
        x = _STRETCH.take(rate)
        z = x * self.weight
        return _SQUASH.take((z[:, 0] + z[:, 1]).astype(np.int64) + 2048, mode="clip"), (at, rate, x)

    def learn(self, state, p, ask, bit):
        at, rate, x = state
        goal = bit * np.int32(4095)
        step = (goal[:, None] - rate) >> 4
        step *= ask[:, None]
        step += rate
        self.hit[at] = step
        miss = bit - p.astype(np.float32) * np.float32(1 / 16384)
        miss *= ask
        miss *= np.float32(0.02 / 256)
        x *= miss[:, None]
        self.weight += x


def _nibble(table_: np.ndarray, at: np.ndarray, v: np.ndarray | None, value: np.ndarray | None):
    """A nibble (``v``, or the one whose interval has ``value``) by the tables ``at``, which learn it: itself, cum and freq of 2^12."""
    bounds = table_.take(at).view(np.int16)
    if v is None:  # the bounds are compared as they are coded, without their last three bits
        below = (bounds.reshape(-1, 16) <= (value * 8 + 7).astype(np.int16)[:, None]).view(np.uint64)
        v = (((below[:, 0] + below[:, 1]) * _BYTES) >> U(56)).view(np.int64) - 1
    cell = np.arange(0, 16 * len(at), 16)
    cell += v
    cum = (bounds.take(cell) >> (_CDF - _NIBBLE)).astype(np.int64)
    cell += 1
    upper = (bounds.take(cell, mode="wrap") >> (_CDF - _NIBBLE)).astype(np.int64)
    upper += (upper == 0) * (1 << _NIBBLE)  # behind the last
    upper -= cum
    goal = _GOAL.take(v, axis=0).reshape(-1)
    goal -= bounds
    goal >>= 5
    goal += bounds
    table_[at] = goal.view("V32")
    return v, cum, upper


def _lower(coder: Coder, model: Model, lane: np.ndarray, path: np.ndarray, want: np.ndarray | None) -> np.ndarray:
    """Ids after their first nibble: two nibbles after the nibbles above them, and four flat bits, in one step."""
    low, range_ = coder.low.take(lane), coder.range.take(lane)
    part = range_ >> (2 * _NIBBLE + 4)
    value = coder.value(low, part, 2 * _NIBBLE + 4) if want is None else None
    v, cum, freq = _nibble(model.nibbles[1], (lane << 4) + path, None if want is None else (want >> 8) & 15, value >> (_NIBBLE + 4) if want is None else None)
    path = path * 16 + v
    cum <<= _NIBBLE + 4
    cell = freq << 4
    if want is None:
        value -= cum
    v, below, more = _nibble(model.nibbles[2], (lane << 8) + path, None if want is None else (want >> 4) & 15,
                             np.minimum(value // cell, (1 << _NIBBLE) - 1) if want is None else None)
    below *= cell
    cum += below
    freq *= more
    last = np.minimum((value - below) // freq, 15) if want is None else want & 15
    cum += last * freq
    coder.step(lane, low, range_, part, cum, freq)
    coder.low[lane], coder.range[lane] = low, range_
    return (path * 16 + v) * 16 + last


def _run(coder: Coder, lanes: int, length: int, ids: np.ndarray | None) -> np.ndarray:
    """``ids`` and the result have a row for each place in the blocks and a column for each block."""
    model, out = Model(lanes), np.zeros((length, lanes), np.uint16)
    one, two, slot = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros((2, lanes), np.int64)
    for t in range(length):
        want = ids[t].astype(np.int64) if ids is not None else None
        slot[0] = (two * 40503 + one * 30011) >> 3
        slot[1] = one * 26699
        slot &= SLOTS - 1
        slot += model.slots
        seen = model.seen.take(slot)
        guess, trust = seen >> 4, seen & 15
        ask, same = guess >= 0, guess[0] == guess[1]
        ask[1] &= ~same
        p, state = model.mixed(trust, same)
        first = p[0] * ask[0]
        both = first + (((16384 - first) * p[1]) >> _GUESS_BITS) * ask[1]
        part = coder.range >> (_GUESS_BITS + _NIBBLE)
        if want is None:
            value = coder.value(coder.low, part, _GUESS_BITS + _NIBBLE)
            hit = np.stack([value < first << _NIBBLE, value < both << _NIBBLE])
            hit[1] &= ~hit[0]
        else:
            hit = (guess == want) & ask
        cum = np.where(hit[0], 0, np.where(hit[1], first, both))
        freq = np.where(hit[0], first, np.where(hit[1], both, 16384)) - cum
        cum <<= _NIBBLE
        left = (~(hit[0] | hit[1])).nonzero()[0]  # without a right guess: by order 0, the first nibble in this step
        above, rest = cum.take(left), freq.take(left)
        freq <<= _NIBBLE
        other = want.take(left) if want is not None else None
        path, below, more = _nibble(model.nibbles[0], left, None if want is None else other >> 12,
                                    np.minimum((value.take(left) - above) // rest, (1 << _NIBBLE) - 1) if want is None else None)
        cum[left] = above + below * rest
        freq[left] = more * rest
        coder.step(None, coder.low, coder.range, part, cum, freq)
        got = np.where(hit[0], guess[0], guess[1]).astype(np.int64) if want is None else want
        path = _lower(coder, model, left, path, other)
        if want is None:
            got[left] = path
        ask[1] &= ~hit[0]
        model.learn(state, p, ask, hit)
        out[t] = got
        right = guess == got
        kept = np.where(right | (trust > 3), seen - trust, (got << 4).astype(np.int32))
        kept += np.where(right, np.minimum(trust + 1, 15), trust >> 1)
        model.seen[slot] = kept
        two, one = one, got
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    if any(len(b) and (b.min() < 0 or b.max() > 0xFFFF) for b in blocks):
        raise ValueError("ids must be in 0..65535")
    ids = np.zeros((max(map(len, blocks), default=0), len(blocks)), np.uint16)
    for i, b in enumerate(blocks):  # shorter blocks end in zeros, which the reader cuts off
        ids[: len(b), i] = b
    coder = Coder(len(blocks), len(ids))
    _run(coder, len(blocks), len(ids), ids)
    return coder.finished()


def decode_blocks(payloads: list[bytes], sizes: list[int], checks: list[int]) -> list[np.ndarray]:
    length = max(sizes, default=0)
    out = _run(Coder(len(payloads), length, payloads), len(payloads), length, None)
    blocks = [out[:n, i].astype(np.uint32) for i, n in enumerate(sizes)]
    for b, c in zip(blocks, checks):
        if zlib.crc32(b.astype("<u4").tobytes()) != c:
            raise ValueError("a block fails its checksum")
    return blocks


class Encoder:
    """Ids of whole texts. The vocabulary's pre-tokenizer drops white space, so a text's ids are its words' ids in a row, and
    each word is encoded once. Most words are letters of Latin-1, digits and signs of ASCII: they are cut here into what the
    pre-tokenizer makes of them (runs of letters, single digits, runs of signs, in lower case), and the tokenizer encodes many such
    units in one text: the last token of each, and no other, ends in ``</w>``. A word with any other character, or with the signs of contractions
    and special tokens, is encoded whole and alone; so are all words of a tokenizer that cuts texts in another way."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would each keep memory of their own
        from tokenizers import Tokenizer
        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.cuts, self.kind = False, np.full(256, HARD, np.uint8)
        self.kind[list(BLANKS)] = BLANK
        if _rules(self.tokenizer) == CUTS and all("<" in t.content for t in self.tokenizer.get_added_tokens_decoder().values()):
            self.kind[0x21:0x7F] = SIGN
            self.kind[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = LETTER
            self.kind[list(b"0123456789")] = DIGIT
            self.kind[list(b"'<")] = HARD
            self.cuts = True
            ids = self.tokenizer.get_vocab(with_added_tokens=False)
            self.closes = np.zeros(max(ids.values()) + 1, bool)
            self.closes[[i for t, i in ids.items() if t.endswith("</w>")]] = True

    def cut(self, w) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The units' bytes in a row, where each begins there and, last, the end; which are whole words, to be
        encoded alone; and each document's first unit."""
        kind, data = self.kind[w.data], w.data
        if self.cuts:
            data = _LOWER[w.data]
            lead = (data == 0xC3).nonzero()[0]  # U+00C0 to U+00FF: letters but for two signs
            after = data[lead + 1]
            letter = (after != 0x97) & (after != 0xB7)
            kind[lead[letter]] = kind[lead[letter] + 1] = LETTER
            data[lead[after < 0x9F] + 1] |= 0x20  # of the signs among these, U+00D7, the bytes are put back below
        first = np.ones(len(kind), bool)
        first[1:] = kind[1:] != kind[:-1]
        first |= kind == DIGIT
        first &= w.inside
        first[w.start] = True  # texts follow each other without a blank
        hard = (kind == HARD).nonzero()[0]
        whole = np.zeros(len(kind), bool)
        if len(hard):
            word = np.unique(np.searchsorted(w.start, hard, "right") - 1)
            edge = np.zeros(len(kind) + 1, np.int8)
            edge[w.start[word]] += 1
            edge[w.end[word]] -= 1
            whole = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
            first[whole] = False
            first[w.start[word]] = True
            data = np.where(whole, w.data, data)
        start = first.nonzero()[0]
        rank = np.cumsum(w.inside)
        return data[w.inside], np.r_[rank[start] - 1, rank[-1:]], whole[start], np.searchsorted(start, w.bounds)

    def learn(self, words: list[bytes], units: list[bytes]) -> None:
        for lo in range(0, len(words), WORDS_AT_ONCE):
            some = words[lo: lo + WORDS_AT_ONCE]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([k.decode() for k in some], add_special_tokens=False)):
                self.known[k] = array("H", e.ids).tobytes()
        for lo in range(0, len(units), WORDS_AT_ONCE):
            some = units[lo: lo + WORDS_AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint16)
            ends = 2 * (self.closes[ids].nonzero()[0] + 1)
            if len(ends) != len(some):  # a vocabulary that lacks a character or the mark
                self.learn(some, [])
                continue
            body, ends = ids.tobytes(), ends.tolist()
            for k, i, j in zip(some, [0, *ends], ends):
                self.known[k] = body[i:j]

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = [], []
        for _, _, w in chunks(texts):
            data, ends, whole, offsets = self.cut(w)
            coded = pa.Array.from_buffers(pa.large_binary(), len(whole), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
            keys, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
            hard = np.zeros(len(keys), bool)
            hard[at] = whole
            if len(self.known) > CACHE_WORDS:
                self.known = {}
            new = [(k, h) for k, h in zip(keys, hard.tolist()) if k not in self.known]
            self.learn([k for k, h in new if h], [k for k, h in new if not h])
            bodies = [self.known[k] for k in keys]
            pool, size = np.frombuffer(b"".join(bodies), np.uint16), np.fromiter(map(len, bodies), np.int64, len(bodies)) // 2
            start = np.cumsum(size) - size
            n = size[at]
            total = np.r_[0, np.cumsum(n)]
            flat.append(pool[np.repeat(start[at] - total[:-1], n) + np.arange(total[-1])] if len(at) else np.zeros(0, np.uint16))
            counts.append(total[offsets[1:]] - total[offsets[:-1]])
        return (np.concatenate(flat) if flat else np.zeros(0, np.uint16)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))


BLOCKS = "file int, block int, n_ids int, crc32 long, payload binary, doc_ids array<long>, doc_ends array<long>"


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Block rows of files in ascending order of doc_id."""
    files = total_bytes(docs) // FILE_TEXT + 1
    ranged = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
              .repartitionByRange(files, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
              .select("doc_id", "text", F.spark_partition_id().alias("file")))

    def run(batches):
        encoder = Encoder(path)
        waiting, docs_in, block, done = np.zeros(0, np.uint16), [], 0, 0  # ids not yet coded; (id, end) of their documents
        name = 0

        def emit(count: int):
            nonlocal waiting, docs_in, block, done
            parts = [waiting[i: i + BLOCK] for i in range(0, count, BLOCK)]
            waiting = waiting[count:]
            payloads = encode_blocks(parts)
            trimmed()
            out = {k: [] for k in ("file", "block", "n_ids", "crc32", "payload", "doc_ids", "doc_ends")}
            for ids, payload in zip(parts, payloads):
                done += len(ids)
                mine = 0
                while mine < len(docs_in) and docs_in[mine][1] <= done:
                    mine += 1
                here, docs_in = docs_in[:mine], docs_in[mine:]
                for k, v in zip(out, (name, block, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), payload, [d for d, _ in here], [e for _, e in here])):
                    out[k].append(v)
                block += 1
            return pa.RecordBatch.from_arrays([
                pa.array(out["file"], pa.int32()), pa.array(out["block"], pa.int32()), pa.array(out["n_ids"], pa.int32()), pa.array(out["crc32"], pa.int64()),
                pa.array(out["payload"], pa.binary()), pa.array(out["doc_ids"], pa.list_(pa.int64())), pa.array(out["doc_ends"], pa.list_(pa.int64()))], names=list(out))

        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column(2)[0].as_py()
            for lo in range(0, batch.num_rows, 2000):
                rows = batch.slice(lo, 2000)
                flat, counts = encoder.ids(rows.column(1))
                ends = np.cumsum(counts + 1)
                stream = np.full(ends[-1], end_id, np.uint16)
                word = np.ones(len(stream), bool)
                word[ends - 1] = False
                stream[word] = flat
                base = done + len(waiting)
                docs_in += list(zip(rows.column(0).to_pylist(), (ends + base).tolist()))
                waiting = np.concatenate([waiting, stream])
                while len(waiting) >= BLOCK * LANES * 3 // 2:
                    yield emit(BLOCK * LANES)
        if len(waiting):
            yield emit(len(waiting))

    return ranged.mapInArrow(run, BLOCKS)


def read_back(files: DataFrame) -> DataFrame:
    """file, position (of the document in its file), doc_id, start, n_tokens, ids_crc32, decoded from the
    blocks; start counts from the beginning of the file."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        ids = []
        lanes = -(-table.num_rows // max(1, round(table.num_rows / LANES)))
        for lo in range(0, table.num_rows, lanes):
            part = table.slice(lo, lanes)
            ids += decode_blocks(part["payload"].to_pylist(), part["n_ids"].to_pylist(), part["crc32"].to_pylist())
        ids = np.concatenate(ids).astype("<u4")
        trimmed()
        ends = np.array([e for x in table["doc_ends"].to_pylist() for e in x], np.int64)
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        return pa.table({"file": pa.array(np.full(len(ends), table["file"][0].as_py(), np.int32)), "position": pa.array(np.arange(len(ends))),
                         "doc_id": pa.array([d for x in table["doc_ids"].to_pylist() for d in x], pa.int64()), "start": pa.array(starts), "n_tokens": pa.array(ends - starts),
                         "ids_crc32": pa.array([zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends)], pa.int64())})
    return files.groupBy("file").applyInArrow(run, "file int, position long, doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """The whole table written to files and read back; starts count from the first file."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    back = written(read_back(written(encoded(docs, path), "op3-files")), "op3-back")
    sizes = back.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = sizes.select(F.col("file"), F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return back.join(before, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
