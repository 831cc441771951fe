"""Questions that chunks of documents ask about the whole corpus, and their answers.

Documents are dealt into chunks by a hash; a chunk hashes its words and asks about many keys at once.
Keys are dealt into parts; the questions of a chunk to a part travel as one packed row (numpy arrays
in a binary column) instead of one row per key, and so do the answers. Where it asks only
parts that it has keys for (``parted``), messages are never more than keys, however many chunks and parts there are. A key that is
frequent in a chunk is asked once or is 4 bytes, so no hot key makes a large group. Chunks and parts are sized
from the bytes of the texts, so the work of one group stays the same as the corpus grows.

``docs.groupBy(chunk)`` is the same exchange for asking and for using the answers, and Spark reuses it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import total_bytes, trimmed
from .words import U

CHUNK_TEXT = 6 << 20
PART_TEXT = 10 << 20
ROWS = "part int, chunk int, body binary"


def dealt(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_text: int = CHUNK_TEXT,
          part_text: int = PART_TEXT) -> tuple[DataFrame, int]:
    """(key, text, chunk) rows and the number of parts. Equal rows share a chunk, but for empty texts, which ask
    nothing and may be many: they are spread by where they are read."""
    size = total_bytes(docs, text)
    k = size // chunk_text + 1
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spread = F.when(F.col("text") == "", F.spark_partition_id()).otherwise(0)
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", spread), F.lit(k)).cast("int")), size // part_text + 1


def by_doc(table: pa.Table) -> pa.Table:
    """A chunk in ascending order of id (nulls last), then text."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def split_parts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that groups keys by part (stable), and the bounds of each part in it, parts without keys included."""
    order, to, which = parted(keys, parts)
    size = np.zeros(parts, np.int64)
    size[to] = [len(i) for i in which]
    return order, np.r_[0, np.cumsum(size)]


def parted(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Order that groups keys by part (stable), the parts that have keys, and for each its indices in order."""
    part = (keys % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    return order, part[first], np.split(order, first[1:]) if len(part) else []


def bits_of(answers: dict, keys: np.ndarray, parts: int) -> np.ndarray:
    """The answers of one bit to each key, in the order of ``keys``."""
    out = np.zeros(len(keys), bool)
    _, to, which = parted(keys, parts)
    for part, i in zip(to.tolist(), which):
        out[i] = np.unpackbits(np.frombuffer(answers[part], np.uint8), count=len(i)).astype(bool)
    return out


def packed(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def unpacked(body: bytes, *types) -> list[np.ndarray]:
    sizes = np.frombuffer(body, np.int64, len(types))
    out, at = [], 8 * len(types)
    for n, t in zip(sizes, types):
        out.append(np.frombuffer(body, t, int(n), at))
        at += int(n) * np.dtype(t).itemsize
    return out


def rows(part, chunk, bodies) -> pa.Table:
    n = len(bodies)
    part = np.full(n, part, np.int32) if np.isscalar(part) else np.asarray(part, np.int32)
    chunk = np.full(n, chunk, np.int32) if np.isscalar(chunk) else np.asarray(chunk, np.int32)
    return pa.table([pa.array(part), pa.array(chunk), pa.array(bodies, pa.binary())], names=["part", "chunk", "body"])


def asked(docs: DataFrame, ask) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        out = ask(table)
        trimmed()
        return out
    return docs.groupBy("chunk").applyInArrow(run, ROWS)


def served(questions: DataFrame, serve) -> DataFrame:
    """``serve`` maps the list of bodies sent to a part to the list of answers."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        out = rows(table["part"][0].as_py(), table["chunk"].to_numpy(), serve(table["body"].to_pylist()))
        trimmed()
        return out
    return questions.groupBy("part").applyInArrow(run, ROWS)


def answered(docs: DataFrame, answers: DataFrame, use, schema) -> DataFrame:
    """``use(chunk table, {part: body})`` for every chunk."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = use(left, dict(zip(right["part"].to_pylist(), right["body"].to_pylist())))
        trimmed()
        return out
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
