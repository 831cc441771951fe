"""Chat formatting: perspective rotation of dialogues with several parties.

For every participant of a conversation the dialogue is rendered with that speaker's turns as the
assistant and everyone else as a named user; system turns stay system turns and are nobody's
perspective. ``mask`` holds the character spans [start, end) of ``rendered`` that are trained on: the
contents (with the end mark) of the speaker's own turns.

Long dialogues are cut by turn number into examples of ``turns_per_example`` consecutive numbers. A
later example starts with its context, rendered from the same perspective but never trained on: the
conversation's earlier system turns, and the last ``overlap`` turns of the example before. The counts
are of the example's own turns. A null turn number comes before all numbers; rows with null or equal
numbers stay together, so an example is bounded only if numbers differ. Context is looked up by example
(one narrow row each), and only in conversations that are cut; system turns come once per later example.

Ties and repeated rows are ordered by role and text and all kept; a null role is the
participant "unknown", a null text is empty. A conversation with system turns only has no
participant and gives no row. Everything is Spark SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

TURNS_PER_EXAMPLE = 64
OVERLAP = 8
SYSTEM = ("system",)
END = "<|end|>\n"


def _cut(rows: DataFrame) -> DataFrame:
    """The turns of each example in order."""
    return rows.groupBy("conv_id", "example").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def context(rows: DataFrame, overlap: int, system: tuple[str, ...]) -> DataFrame:
    """__conv, __example, before: the turns put in front of each example but a conversation's first."""
    cut = (rows.groupBy("conv_id").agg(F.min("example").alias("lo"), F.max("example").alias("hi")).where("lo < hi")
           .select(F.col("conv_id").alias("__conv")))
    pieces = _cut(rows.join(cut, F.col("conv_id").eqNullSafe(F.col("__conv")), "left_semi"))
    first = F.greatest(F.size("turns") - F.lit(overlap), F.lit(0))  # turns before the tail
    tails = pieces.select(F.col("conv_id").alias("__c"), F.col("example").alias("__prev"),
                          F.slice("turns", first + 1, F.lit(overlap)).alias("tail"))
    told = pieces.select(
        F.col("conv_id").alias("__c"), F.col("example").alias("__e"),
        F.filter("turns", lambda t: t["role"].isin(*system)).alias("all"),
        F.filter(F.slice("turns", F.lit(1), first), lambda t: t["role"].isin(*system)).alias("head")).where(F.size("all") > 0)
    later = (pieces.select(F.col("conv_id").alias("__conv"), F.col("example").alias("__example"))
             .withColumn("__before", F.lag("__example").over(W.partitionBy("__conv").orderBy("__example")))
             .where("__before IS NOT NULL"))
    orders = (later.join(told, F.col("__conv").eqNullSafe(F.col("__c")) & (F.col("__e") < F.col("__example")))
              .groupBy(F.col("__conv").alias("__oc"), F.col("__example").alias("__oe"))
              .agg(F.sort_array(F.collect_list(F.struct("__e", F.when(F.col("__e") == F.col("__before"), F.col("head")).otherwise(F.col("all")).alias("told")))).alias("orders")))
    return (later.join(tails, F.col("__conv").eqNullSafe(F.col("__c")) & (F.col("__before") == F.col("__prev")))
            .join(orders, F.col("__conv").eqNullSafe(F.col("__oc")) & (F.col("__example") == F.col("__oe")), "left")
            .select("__conv", "__example",
                    F.when(F.col("orders").isNull(), F.col("tail"))
                    .otherwise(F.concat(F.flatten(F.transform("orders", lambda o: o["told"])), F.col("tail"))).alias("before")))


def rotate(turns: DataFrame, turns_per_example: int = TURNS_PER_EXAMPLE, system: tuple[str, ...] = SYSTEM,
           overlap: int = OVERLAP) -> DataFrame:
    """conv_id, example, perspective, n_turns, n_own_turns, rendered, mask."""
    rows = turns.select("conv_id", F.coalesce(F.floor(F.col("turn") / turns_per_example), F.lit(-1)).cast("long").alias("example"),
                        "turn", F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # null conversation ids form one conversation: grouping treats nulls as equal, the join below too
    speakers = rows.where(~F.col("role").isin(*system)).select("conv_id", "role").distinct().select(
        F.col("conv_id").alias("__conv"), F.col("role").alias("perspective"))
    ahead = context(rows, overlap, system)
    dialogues = (_cut(rows).join(ahead, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("example") == F.col("__example")), "left")
                 .select("conv_id", "example", "turns", F.coalesce("before", F.slice("turns", 1, 0)).alias("before")))
    joined = dialogues.join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")

    def head(t):
        name = F.regexp_replace(t["role"], r"\s+", "_")
        return (F.when(t["role"] == F.col("perspective"), F.lit("<|start|>assistant\n"))
                .when(t["role"].isin(*system), F.lit("<|start|>system\n"))
                .otherwise(F.concat(F.lit("<|start|>user name="), name, F.lit("\n"))))

    parts = F.transform(F.concat("before", "turns"), lambda t, i: F.struct(
        head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"),
        ((t["role"] == F.col("perspective")) & (i >= F.size("before"))).alias("own")))
    spans = F.aggregate(
        "parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(p["own"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(p["head"])).alias("start"),
                (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"))))).otherwise(acc["spans"]).alias("spans")))
    return (joined.withColumn("parts", parts)
            .withColumn("rendered", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), ""))
            .withColumn("mask", spans["spans"])
            .select("conv_id", "example", "perspective", F.size("turns").alias("n_turns"), F.size("mask").alias("n_own_turns"),
                    "rendered", "mask"))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's view, with a digest of the masked-in text."""
    rows = rotate(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    target = F.array_join(F.transform("mask", lambda m: F.substr(F.col("rendered"), m["start"] + 1, m["end"] - m["start"])), "")
    return rows.select("conv_id", "example", "perspective", "n_turns", "n_own_turns", "rendered",
                       F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",").alias("mask"),
                       F.length(target).alias("target_chars"), F.sha2(target, 256).alias("target_sha256"))


SQL = """
WITH t AS (SELECT conv_id, coalesce(CAST(floor(turn / 64.0) AS BIGINT), -1) AS example, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
p AS (SELECT t.conv_id, t.example, s.perspective, row_number() OVER w AS rn, t.role = s.perspective AS own,
        CASE WHEN t.role = s.perspective THEN '<|start|>assistant' WHEN t.role = 'system' THEN '<|start|>system'
             ELSE '<|start|>user name=' || regexp_replace(t.role, '\\s+', '_', 'g') END || chr(10) AS head,
        t.text || '<|end|>' || chr(10) AS body
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
      WINDOW w AS (PARTITION BY t.conv_id, t.example, s.perspective ORDER BY turn NULLS FIRST, role, text)),
q AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, example, perspective ORDER BY rn) AS stop FROM p)
SELECT conv_id, example, perspective, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (own) AS INTEGER) AS n_own_turns,
  string_agg(head || body, '' ORDER BY rn) AS rendered,
  coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY rn) FILTER (own), '') AS mask,
  CAST(coalesce(sum(length(body)) FILTER (own), 0) AS INTEGER) AS target_chars,
  sha256(coalesce(string_agg(body, '' ORDER BY rn) FILTER (own), '')) AS target_sha256
FROM q GROUP BY conv_id, example, perspective"""
