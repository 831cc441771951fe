"""Embedding whitening with a covariance weighted by multiplicity.

Vectors become whole numbers x = floor(256 c), packed into the smallest of 2, 4 or 8 bytes an entry that holds
all of a vector, so equal vectors are equal keys. Rows are grouped by key; each distinct vector has a fit
weight, its count or one. Weighted sums, then a weighted matrix product of the centred vectors (both
partial per task) give the covariance; its d x d eigenproblem is the only thing the driver solves. Each
distinct vector is whitened once and joined back to its rows: the few vectors that make up a large share
of the rows go by broadcast, the others by a shuffle.

Left out: null vectors, vectors with null or non-finite entries, and vectors whose length is not the most frequent
one among the rest (of equally frequent lengths the longest; empty vectors have no entries to whiten). Entries
beyond the range of a long saturate. Components whose eigenvalue is 0 up to rounding cannot be scaled to
variance one and are left out, so one distinct vector, or none, gives no rows. Repeated rows and null ids are
rows like others; other columns are not read and may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, COMPONENTS = 256, 4
#: Vectors that at least one row in so many shares are hot: there are at most so many of them.
HOT = 1000
#: Entries below this keep sums of squares of up to 2^11 entries exact in longs.
SAFE = 1 << 26
#: Eigenvalues below this part of the largest are rounding errors.
RANK = 1e-12
EXACT = "decimal(38,0)"


def _pack(x: np.ndarray) -> list[bytes]:
    """Keys of vectors of longs: equal vectors, and no others, have equal keys."""
    if not x.shape[1]:
        return [b""] * len(x)
    lo, hi = x.min(1), x.max(1)
    out = []
    narrow, wide = x.astype("<i2"), x.astype("<i4")
    for i in range(len(x)):
        kind = narrow if -(1 << 15) <= lo[i] and hi[i] < 1 << 15 else wide if -(1 << 31) <= lo[i] and hi[i] < 1 << 31 else x
        out.append(kind[i].tobytes())
    return out


def _unpack(keys: pa.Array, d: int) -> np.ndarray:
    """The vectors of keys of ``d`` entries each."""
    out = np.zeros((len(keys), d), np.int64)
    size = pc.binary_length(keys).to_numpy()
    for width in (2, 4, 8):
        at = np.flatnonzero(size == width * d)
        if len(at):
            out[at] = np.frombuffer(b"".join(keys.take(pa.array(at)).to_pylist()), f"<i{width}").reshape(-1, d)
    return out


def keyed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(key, d, x) of every vector without null or non-finite entries; x packs floor(scale c)."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for b in batches:
            v = b.column(1)
            size = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            flat = v.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
            bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
            good = bad[ends] == bad[ends - size]
            for d in np.unique(size[good]).tolist():
                at = np.flatnonzero(good & (size == d))
                c = flat[(ends[at] - d)[:, None] + np.arange(d)]
                with np.errstate(over="ignore"):
                    c = np.floor(scale * c)
                x = np.clip(c, -2.0 ** 63, np.nextafter(2.0 ** 63, 0)).astype("<i8")
                x[c >= 2.0 ** 63] = np.iinfo(np.int64).max
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), pa.array(_pack(x), pa.binary())], names=["key", "d", "x"])

    return rows.mapInArrow(run, f"key {kind}, d int, x binary")


def _summed(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Sum of weights and exact weighted sums per dimension; tasks emit one row a dimension."""
    def run(batches):
        total, n = [0] * d, 0
        for b in batches:
            x, w = _unpack(b.column(0), d), b.column(1).to_numpy()
            if not len(w):
                continue
            if int(np.abs(x.astype(float)).max()) * int(w.sum()) >= 1 << 62:
                x, w = x.astype(object), w.astype(object)
            total = [a + int(s) for a, s in zip(total, (x * w[:, None]).sum(0))]
            n += int(w.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (n, *total)])], names=["i", "s"])

    parts = fit.select("x", "weight").mapInArrow(run, "i int, s string")
    found = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum(F.col("s").cast(EXACT)).alias("s")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def _covariance(fit: DataFrame, columns: list[str], centred, d: int, n: int) -> np.ndarray:
    """Weighted covariance, divisor n, of ``centred(batch)``; tasks emit the upper triangle of their product."""
    upper = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d))
        seen = False
        for b in batches:
            y, w = centred(b), b.column(1).to_numpy()
            total += (y * w[:, None]).T @ y
            seen = seen or len(w) > 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])], names=["i", "j", "v"])

    out = np.zeros((d, d))
    for r in fit.select(*columns).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # d (d + 1) / 2 rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n
    return out


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
             scale: int = SCALE, weights: str = "one") -> DataFrame:
    """key, component, n, deviation (decimal), whitened, explained, identity_error of every remaining row and component.

    ``weights``: what a distinct vector weighs in n, sums and covariances, "one" or its "count" of rows.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights must be 'one' or 'count'")
    rows = keyed(vectors, key, vector, scale)
    kind = rows.schema["key"].dataType.simpleString()
    groups = written(rows.groupBy("d", "x").agg(F.count(F.lit(1)).alias("count")), "op12-groups")
    sizes = groups.groupBy("d").agg(F.sum("count").alias("rows")).orderBy(F.col("rows").desc(), F.col("d").desc()).first()
    schema = f"key {kind}, component int, n long, deviation {EXACT}, whitened double, explained double, identity_error double"
    empty = vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    if sizes is None:
        return empty
    d, total_rows = sizes["d"], sizes["rows"]
    fit = groups.where(F.col("d") == d).select("x", (F.col("count") if weights == "count" else F.lit(1).cast("long")).alias("weight"), "count")
    n, sums = _summed(fit, d)
    mean = np.array([_ratio(s, n) for s in sums])

    def centred(b: pa.RecordBatch) -> np.ndarray:
        return _unpack(b.column(0), d) - mean

    v = _covariance(fit, ["x", "weight"], centred, d, n)
    e, u = np.linalg.eigh(v)
    order = [i for i in np.argsort(-e, kind="stable")[:components] if e[i] > RANK * max(e.max(), 0.0)]
    if not order:
        return empty
    project = u[:, order] / np.sqrt(e[order])
    explained = e[order] / np.trace(v)
    k = len(order)
    bound = max(abs(s) for s in sums)

    def run(batches):
        for b in batches:
            x = _unpack(b.column(0), d)
            z = (x - mean) @ project
            big = len(x) and (np.abs(x.astype(float)).max() >= SAFE or bound * float(np.abs(x.astype(float)).max()) * d >= 2.0 ** 62)
            exact = x.astype(object) if big else x
            squares, products = (exact * exact).sum(1), (exact * np.array(sums, object if big else np.int64)).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([str(s) for s in squares.tolist()], pa.string()),
                                              pa.array([str(s) for s in products.tolist()], pa.string()), pa.array(list(z), pa.list_(pa.float64()))],
                                             names=["x", "weight", "count", "squares", "products", "z"])

    # sum of (n x - S)^2 = n^2 x.x - 2 n x.S + S.S, exact; null where it has more than 38 digits
    done = fit.mapInArrow(run, "x binary, weight long, count long, squares string, products string, z array<double>")
    square_of_sums = sum(s * s for s in sums)
    term = F.expr(f"try_add(try_subtract(try_multiply(CAST({n * n} AS {EXACT}), try_cast(squares AS {EXACT})), "
                  f"try_multiply(CAST({2 * n} AS {EXACT}), try_cast(products AS {EXACT}))), try_cast('{square_of_sums}' AS {EXACT}))")
    done = written(done.select("x", "weight", "count", term.cast(EXACT).alias("deviation"), "z"), "op12-whitened")

    def unit(b: pa.RecordBatch) -> np.ndarray:
        z = b.column(0).flatten().to_numpy().reshape(-1, k)
        return z - z_mean

    z_mean = np.array([r or 0.0 for r in done.agg(*[(F.sum(F.col("z")[i] * F.col("weight")) / n).alias(f"m{i}") for i in range(k)]).first()])
    error = float(np.abs(_covariance(done, ["z", "weight"], unit, k, n) - np.eye(k)).max())

    result = done.select("x", "deviation", "z")
    hot = F.col("count") * HOT > total_rows  # fewer than HOT vectors
    frequent = F.broadcast(done.where(hot).select("x", "deviation", "z"))
    mine = rows.where(F.col("d") == d).select("key", "x")
    joined = mine.join(frequent, "x").unionByName(mine.join(F.broadcast(done.where(hot).select("x")), "x", "left_anti").join(result, "x"))
    out = joined.select("key", F.posexplode(F.arrays_zip("z", F.array(*[F.lit(float(x)) for x in explained]).alias("part"))).alias("c", "at"), "deviation")
    return out.select(F.col("key").alias(key), (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                      F.col("at.z").alias("whitened"), F.col("at.part").alias("explained"), F.lit(error).alias("identity_error"))


def _ratio(s: int, n: int) -> float:
    """s / n, rounded once however large the two are."""
    return s / n


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding")).withColumn("deviation", F.col("deviation").cast("long"))
