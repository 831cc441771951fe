"""Positions in a global order without a single-partition window.

Both operators range-partition on (group…, order…, tiebreak), sort inside
each partition, and derive a row's position from per-partition segment
counts plus prefix sums. Only the segment table — one row per
(group, partition) pair — goes through a window, so its size is bounded by
#groups + #partitions, never by the data. A hot group (say a third of all
rows) is spread over many range partitions; a hot *value* is split too,
because the tiebreak column makes the range key unique.

* ``with_row_ids`` — contiguous 0..n-1 ids (A4), equal to
  ``row_number() over (order by keys) - 1`` when the keys are unique.
* ``with_ids_by_group`` — the same ids where the order begins with a group column: only the groups are put in order.
* ``ranged_percentile`` — linear-interpolated exact quantile per group
  (= Spark ``percentile`` / DuckDB ``quantile_cont``) without buffering a
  group's values in one task.
* ``exact_percentile`` — the same quantile by bracketed selection: a sketch
  brackets the wanted ranks, one pass counts what lies below the bracket,
  and only values inside it are ordered. Nothing is written and only values
  inside brackets are shuffled.

The tagged rows (range partition id and position inside it) are written
once to the shared checkpoint folder and read back: the positions become
plain data, so later filters, UDFs or optimizer rewrites cannot shift
them, a lost executor only re-reads files, and the data is shuffled once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ENGINE
from ..session import CODEC, in_rounds, shuffles_dropped, step_dir, written_once

#: Rows of a group that one window ranks.
HOT_ROWS = 1_000_000


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    if ENGINE.range_partitions:
        return ENGINE.range_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _tagged(df: DataFrame, keys: list, n: int) -> DataFrame:
    return (df.repartitionByRange(n, *keys)
              .sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))


def _tag(df: DataFrame, keys: list, n: int) -> DataFrame:
    tagged = _tagged(df, keys, n)
    path = step_dir(df.sparkSession, "ranked", uuid.uuid4().hex)
    with shuffles_dropped(df.sparkSession):
        tagged.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.parquet(path)


def _segments(tagged: DataFrame, group_cols: list[str]) -> DataFrame:
    seg = tagged.groupBy(*group_cols, "_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    # at most (#groups + #partitions) rows; each group spans at most #partitions rows
    w = Window.partitionBy(*group_cols).orderBy("_pid")
    return (seg.withColumn("_off", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0)))
               .withColumn("_n", F.sum("_cnt").over(Window.partitionBy(*group_cols))))


def tagged_rows(df: DataFrame, order_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """``df`` dealt and sorted by ``order_cols``, with each row's range partition and place in it; a caller that keeps
    the rows writes them once and numbers them with ``number_tagged`` whenever they are read."""
    return _tagged(df, list(order_cols), _partitions(df, num_partitions))


def number_tagged(tagged: DataFrame, segments: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Stored ``tagged_rows`` with their ids; ``segments`` are their ``row_segments``."""
    # one row per range partition: bounded by their number, safe to broadcast
    out = tagged.join(F.broadcast(segments), "_pid")
    out = out.withColumn(id_col, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint"))
    return out.drop("_pid", "_mid", "_first", "_off")


def row_segments(tagged: DataFrame) -> DataFrame:
    """(_pid, _first, _off): where each range partition's ids begin."""
    return _segments(tagged, []).select("_pid", "_first", "_off")


def with_row_ids(df: DataFrame, order_cols: list[str], id_col: str = "record_id",
                 num_partitions: int | None = None, rows: int | None = None) -> DataFrame:
    """A4: contiguous ids in ``order_cols`` order. Keys should be unique for a stable result. ``rows``, the number of
    rows where it is known, lets many rows be put in order in rounds: ranges of the first order column."""
    n = _partitions(df, num_partitions)
    ranges = _ranges(df, order_cols[0], rows or 0)
    if len(ranges) == 1:
        tagged = _tag(df, list(order_cols), n)
    else:
        each = -(-n // len(ranges))
        tagged = written_once([_tagged(x, list(order_cols), each).withColumn("_pid", F.col("_pid") + i * each) for i, x in enumerate(ranges)], "ranked")
    return number_tagged(tagged, row_segments(tagged), id_col)


def _ranges(df: DataFrame, col: str, rows: int) -> list[DataFrame]:
    """``df`` cut at values of ``col`` into as many ranges, in ascending order, as ``in_rounds`` would make parts; how even they are rests on
    a sample, which rows they hold does not."""
    n = len(in_rounds(df, col, rows))
    if n == 1:
        return [df]
    seen = df.select(col).where(F.col(col).isNotNull()).sample(min(1.0, 10_000 / rows), 7)
    w = Window.orderBy(col)  # at most some 10,000 values
    tiles = seen.withColumn("_t", F.ntile(n).over(w)).groupBy("_t").agg(F.min(col).alias("_from"))
    cuts = [r["_from"] for r in tiles.where("_t > 1").orderBy("_t").collect()]
    place = sum((F.when(F.col(col) >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))  # a null comes first
    return [df.where(place == i) for i in range(len(cuts) + 1)]


def with_ids_by_group(df: DataFrame, group_col: str, order_cols: list[str], id_col: str = "record_id", num_partitions: int | None = None) -> list[DataFrame]:
    """A4 for an order that begins with ``group_col``, without moving whole rows by range: contiguous ids in the order of
    (group_col, order_cols), in rounds of ``in_rounds``. Only the groups and their sizes are put in order; a row's id is the number
    of rows in the groups before its own and its rank within it. Rows without a group are left out."""
    n = _partitions(df, num_partitions)
    sizes = df.where(F.col(group_col).isNotNull()).groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"))
    tagged = _tag(sizes, [group_col], n)
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition
    before = tagged.groupBy("_pid").agg(F.sum("_n").alias("_rows")).select("_pid", F.coalesce(F.sum("_rows").over(w), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    first = tagged.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(before), "_pid") \
        .select(F.col(group_col).alias("_group"), (F.col("_off") + F.col("_in")).alias("_first"))
    hot = tagged.where(F.col("_n") > HOT_ROWS).select(group_col)

    def numbered(rows, m):
        ranked = _ranked(rows, hot, [group_col], order_cols, "_rank", m)
        return ranked.join(first.repartition(m, "_group"), F.col(group_col) == F.col("_group")) \
            .select(*df.columns, (F.col("_first") + F.col("_rank")).cast("bigint").alias(id_col))
    rounds = in_rounds(df.where(F.col(group_col).isNotNull()), group_col, df.count())
    return [numbered(x, -(-n // len(rounds))) for x in rounds]


def rank_within_groups(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str = "rank0",
                       num_partitions: int | None = None) -> DataFrame:
    """0-based position inside each group in ``order_cols`` order (keys should be unique per group; rows without a group are left out).

    Groups of at most HOT_ROWS rows are ranked by a window: one shuffle, nothing written, and the result lies by group.
    Larger ones are ranked by range partitions as in ``with_row_ids``; their
    segment table has one row per (group, range partition)."""
    n = _partitions(df, num_partitions)
    df = df.dropna(subset=list(group_cols))
    hot = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).drop("_n")
    return _ranked(df, hot, group_cols, order_cols, out, n)


def _ranked(df: DataFrame, hot: DataFrame, group_cols: list[str], order_cols: list[str], out: str, n: int) -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)

    def by_window(rows):
        return rows.repartition(n, *group_cols).withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))

    if hot.isEmpty():
        return by_window(df)
    hot = written_once(hot, "hot-groups")  # at most one row per HOT_ROWS rows
    cold = by_window(df.join(F.broadcast(hot), list(group_cols), "left_anti"))
    return cold.unionByName(_rank_by_ranges(df.join(F.broadcast(hot), list(group_cols), "left_semi"), group_cols, order_cols, out, n))


def _rank_by_ranges(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str, n: int) -> DataFrame:
    tagged = _tag(df, [*group_cols, *order_cols], n)
    seg = _segments(tagged, list(group_cols)).select(*group_cols, "_pid", "_first", "_off")
    res = tagged.join(seg, [*group_cols, "_pid"])
    res = res.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint"))
    return res.drop("_pid", "_mid", "_first", "_off")


#: Rank error of the bracketing sketch, as a share of a group's rows, is at most 1 / ACCURACY.
ACCURACY = 10_000
#: Different values inside brackets that windows may order, on average per group; more go to ``ranged_percentile``.
INSIDE_LIMIT = 2_000_000


def exact_percentile(df: DataFrame, value: str, p: float, group_cols: list[str] | None = None,
                     out: str = "percentile", num_partitions: int | None = None) -> DataFrame:
    """Exact quantile with linear interpolation, NULL values skipped; one row per group with values.

    The sketch's bracket is wider than its error on both sides; should the wanted rank still lie
    outside it, the result is an error, never a wrong number."""
    group_cols = list(group_cols or [])
    base = df.select(*group_cols, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    slack = 3.0 / ACCURACY
    cuts = [max(0.0, p - slack), min(1.0, p + slack)]
    sketch = base.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", cuts, ACCURACY).alias("_cut"),
                                           F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    pos = F.lit(float(p)) * (F.col("_n") - 1)
    # small groups keep their whole range; the sketch is exact in their order of magnitude
    all_of_it = F.col("_n") <= 2 * ACCURACY
    sketch = sketch.select(*group_cols, "_n", pos.alias("_pos"),
                           F.when(all_of_it, F.col("_min")).otherwise(F.col("_cut")[0]).alias("_lo"),
                           F.when(all_of_it, F.col("_max")).otherwise(F.col("_cut")[1]).alias("_hi"))
    if group_cols:
        groups = _approx_groups(df, group_cols)
        if groups * 2 * ACCURACY > INSIDE_LIMIT * 100:  # very many groups: no sketch of each
            return ranged_percentile(df, value, p, group_cols, out, num_partitions)
        same = [F.col(f"_b.{c}").eqNullSafe(F.col(f"_a.{c}")) for c in group_cols]
        side = F.broadcast(sketch) if groups <= ENGINE.broadcast_row_limit else sketch
        rows = base.alias("_a").join(side.alias("_b"), same).select("_a.*", "_n", "_pos", "_lo", "_hi")
    else:
        one = sketch.first()
        if not one["_n"]:
            return base.agg(F.lit(None).cast("double").alias(out))
        rows = base.select("_v", *[F.lit(one[c]).alias(c) for c in ("_n", "_pos", "_lo", "_hi")])
    # below: one count a group; inside: one row a different value
    bucket = F.when(F.col("_v") < F.col("_lo"), F.lit(None)).otherwise(F.col("_v"))
    counted = (rows.where(F.col("_v") <= F.col("_hi")).groupBy(*group_cols, "_n", "_pos", bucket.alias("_v"))
               .agg(F.count(F.lit(1)).alias("_c")))
    w = Window.partitionBy(*group_cols).orderBy(F.col("_v").asc_nulls_first())
    placed = counted.withColumn("_end", F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))

    def at(rank):
        return F.max(F.when((F.col("_start") <= rank) & (F.col("_end") > rank), F.col("_v")))

    picked = placed.groupBy(*group_cols, "_pos").agg(at(F.floor("_pos")).alias("_vlo"), at(F.ceil("_pos")).alias("_vhi"))
    missed = F.col("_vlo").isNull() | F.col("_vhi").isNull()
    res = F.col("_vlo") + (F.col("_pos") - F.floor("_pos")) * (F.col("_vhi") - F.col("_vlo"))
    return picked.select(*group_cols, F.when(missed, F.raise_error(F.lit("a percentile's rank lies outside its bracket")).cast("double"))
                         .otherwise(res).alias(out))


def ranged_percentile(df: DataFrame, value: str, p: float, group_cols: list[str] | None = None,
                      out: str = "percentile", num_partitions: int | None = None) -> DataFrame:
    """The same quantile by positions in a global order (written once): any number of groups of any size."""
    group_cols = list(group_cols or [])
    n = _partitions(df, num_partitions)
    base = (df.select(*group_cols, F.col(value).cast("double").alias("_v"))
              .where(F.col("_v").isNotNull())
              .withColumn("_tie", F.monotonically_increasing_id()))
    tagged = _tag(base, [*group_cols, "_v", "_tie"], n)
    seg = _segments(tagged, group_cols)
    pos = F.lit(float(p)) * (F.col("_n") - 1)
    wanted = (seg.withColumn("_pos", pos)
                 .withColumn("_lo", F.floor("_pos"))
                 .withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
                 .where((F.col("_r") >= F.col("_off")) & (F.col("_r") < F.col("_off") + F.col("_cnt")))
                 .select(*group_cols, "_pid", (F.col("_first") + F.col("_r") - F.col("_off")).alias("_mid"),
                         "_r", "_lo", "_pos"))
    # wanted has <= 2 rows per group. Broadcast only when the group count is known small.
    if not group_cols or _approx_groups(df, group_cols) * 2 <= ENGINE.broadcast_row_limit:
        wanted = F.broadcast(wanted)
    picked = tagged.select("_pid", "_mid", "_v").join(wanted, ["_pid", "_mid"])
    agg = picked.groupBy(*group_cols).agg(
        F.max(F.when(F.col("_r") == F.col("_lo"), F.col("_v"))).alias("_vlo"),
        F.max(F.when(F.col("_r") != F.col("_lo"), F.col("_v"))).alias("_vhi"),
        F.first("_pos").alias("_pos"), F.first("_lo").alias("_lo"))
    vhi = F.coalesce(F.col("_vhi"), F.col("_vlo"))
    res = F.col("_vlo") + (F.col("_pos") - F.col("_lo")) * (vhi - F.col("_vlo"))
    return agg.select(*group_cols, res.alias(out))


def _approx_groups(df: DataFrame, group_cols: list[str]) -> int:
    """Run-time size check of the group count (one partial-aggregate job over the key columns)."""
    row = df.agg(F.approx_count_distinct(F.struct(*group_cols)).alias("g")).first()
    return int(row["g"] or 0)
