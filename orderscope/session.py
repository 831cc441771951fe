"""Session helpers: building a session for tests/bench, the shared checkpoint
folder, and materialising derived tables there (lineage cuts that survive
executor loss)."""

from __future__ import annotations

import hashlib
import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "orderscope") -> SparkSession:
    """Session for tests and the bench. On a cluster the caller's session is used."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("ORDERSCOPE_SHUFFLE_PARTITIONS", cpus))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ORDERSCOPE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: read from the session; set one only if unset (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = os.path.join("/tmp", f"orderscope-ckpt-{uuid.uuid4().hex[:8]}")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A path for written tables under the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return "/".join([base.rstrip("/"), "orderscope", *parts])


_CODE_VERSION: str | None = None


def _code_version() -> str:
    """Hash of this package's source: a changed view definition never reuses an old copy."""
    global _CODE_VERSION
    if _CODE_VERSION is None:
        h = hashlib.sha256()
        root = os.path.dirname(os.path.abspath(__file__))
        for d, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    with open(os.path.join(d, f), "rb") as fh:
                        h.update(fh.read())
        _CODE_VERSION = h.hexdigest()[:12]
    return _CODE_VERSION


def _fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Cheap identity of input files (path, size, mtime) via the Hadoop FS of each path, plus code version."""
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    h = hashlib.sha256(_code_version().encode())
    for p in sorted(paths):
        jpath = jvm.org.apache.hadoop.fs.Path(p)
        fs = jpath.getFileSystem(hconf)
        h.update(p.encode())
        if fs.exists(jpath):
            files, found = fs.listFiles(jpath, True), []  # folders of any depth
            while files.hasNext():
                st = files.next()
                found.append(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}")
            for line in sorted(found):
                h.update(line.encode())
    return h.hexdigest()[:16]


#: Written tables and steps: about a third less disk than Spark's own choice.
CODEC = "zstd"
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Jobs whose result is written: their shuffle files go when they end, not when the driver happens to collect garbage."""
    before = spark.conf.get(_SHUFFLES_END, None)
    spark.conf.set(_SHUFFLES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_END)
        else:
            spark.conf.set(_SHUFFLES_END, before)


def materialize(spark: SparkSession, name: str, inputs: list[str], build, *,
                partition_by: list[str] | None = None, sort_within: list[str] | None = None) -> DataFrame:
    """Write ``build()`` once per input fingerprint to the shared folder and read it back.

    The written parquet is the lineage cut: later queries scan it with column
    pruning and filter pushdown instead of recomputing joins, and a lost
    executor only re-reads files. A ``_SUCCESS`` marker decides reuse. ``build`` may return the table in rounds.
    """
    path = shared_dir(spark, "tables", f"{name}-{_fingerprint(spark, inputs)}")
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(hconf)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        # build into a unique sibling, then rename into place: a half-written
        # output is never visible, and concurrent builders cannot interleave
        tmp = f"{path}.tmp-{uuid.uuid4().hex}"
        sibling, done = jvm.org.apache.hadoop.fs.Path(tmp), jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        try:
            with steps_dropped(spark), shuffles_dropped(spark):  # nothing but the written table is read later
                built = build()
                for df in built if isinstance(built, list) else [built]:  # rounds, one after the other
                    if sort_within:
                        df = df.sortWithinPartitions(*sort_within)
                    writer = df.write.mode("append").option("compression", CODEC)
                    if partition_by:
                        writer = writer.partitionBy(*partition_by)
                    writer.parquet(tmp)
            if fs.exists(target) and not fs.exists(done):  # left over from a build that did not end
                fs.delete(target, True)
            if not fs.exists(target):
                fs.rename(sibling, target)
        finally:
            if fs.exists(sibling):
                fs.delete(sibling, True)
    return spark.read.parquet(path)


_SCOPES: list[list[str]] = []


def step_dir(spark: SparkSession, *parts: str) -> str:
    """A path for a step's rows; the innermost ``steps_dropped`` deletes it at its end."""
    path = shared_dir(spark, *parts)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def steps_dropped(spark: SparkSession):
    """A job whose steps' written rows are not read behind it: they are deleted when it ends, well or not."""
    _SCOPES.append([])
    try:
        yield
    finally:
        jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _SCOPES.pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(hconf).delete(p, True)


def in_rounds(df: DataFrame, key: str, rows: int) -> list[DataFrame]:
    """``df``, of about so many rows, cut by the hash of a key into at most MAX_ROUNDS parts of ROUND_ROWS rows: written one
    after the other, only one part's shuffle is on disk at once."""
    n = max(1, min(MAX_ROUNDS, -(-rows // ROUND_ROWS)))
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)] if n > 1 else [df]


#: Rows of a round, and rounds at most (each reads its whole input).
ROUND_ROWS, MAX_ROUNDS = 1_500_000, 5


def written_once(df: DataFrame | list[DataFrame], name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write a result that several plans read to the shared folder and read it back: a lineage cut. A list is one result
    in rounds, written one after the other. ``instead_of`` is an earlier written step that nothing else reads: it is deleted."""
    rounds = df if isinstance(df, list) else [df]
    spark = rounds[0].sparkSession
    path = step_dir(spark, "steps", f"{name}-{uuid.uuid4().hex}")
    with shuffles_dropped(spark):
        for part in rounds:
            part.write.mode("append").option("compression", CODEC).parquet(path)
    step_deleted(instead_of)
    out = spark.read.schema(rounds[0].schema).parquet(path)
    out._step_path = path
    return out


def step_deleted(step: DataFrame | None) -> None:
    """Delete the files of a step of ``written_once`` that nothing reads any more."""
    if step is not None:
        p = step.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(step._step_path)
        p.getFileSystem(step.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
