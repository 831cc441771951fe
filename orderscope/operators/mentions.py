"""Text-mention join (C6): which texts contain which names, without comparing every pair.

Every name is represented by one of its blocking keys, the one that the fewest texts hold; texts are
joined to names on that key alone and each pair is then verified with ``contains``. A name that is in a text
brings all of its keys along, so no mention is missed. Keys are

* ``"substring"``: character grams, as long as the shortest name allows (at most GRAM) — any occurrence counts;
* ``"words"``: the ``\\w+`` tokens — the name's words must stand in a row in the text.

Keys that many texts hold are split: their texts are dealt into salts by id, their names are repeated once per salt.
Null, blank and (in word mode) wordless names mention nothing; null texts hold nothing. Ids need not be unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import written_once

GRAM = 8
#: Texts of a key that one task joins; a key with more is split. At most MAX_HOT keys are split finer than that.
SALT_ROWS, MAX_HOT = 100_000, 10_000


def _grams(col, n: int):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(col) - n + 1, F.lit(1))), lambda i: F.substr(col, i, F.lit(n))))


def mentions(texts: DataFrame, names: DataFrame, text_id: str, text: str, name_id: str, name: str, mode: str = "substring") -> DataFrame:
    """(text_id, name_id) of every text that contains a name, letter case aside; each pair of rows once."""
    if mode not in ("substring", "words"):
        raise ValueError("mode must be 'substring' or 'words'")
    if mode == "words":
        def plain(c):  # words between single blanks, blanks around
            return F.concat(F.lit(" "), F.array_join(TX.tokenize(c), " "), F.lit(" "))
    else:
        def plain(c):
            return F.lower(F.col(c))
    left = texts.select(F.col(text_id).alias("_t"), plain(text).alias("_text")).where(F.col("_text").isNotNull())
    # read several times below: written once, whatever the names are derived from
    right = written_once(names.select(F.col(name_id).alias("_n"), plain(name).alias("_name")).where(F.length(F.trim("_name")) > 0), "mention-names")
    if mode == "words":
        def keys(c):
            return F.array_distinct(F.split(F.trim(c), " "))
    else:
        n = min(GRAM, right.agg(F.min(F.length("_name"))).first()[0] or GRAM)

        def keys(c):
            return _grams(F.col(c), n)
    named = right.withColumn("_key", F.explode(keys("_name")))
    known = named.select("_key").distinct()
    # a text's keys that some name has; the pairs' only source, so it is written once
    held = written_once(left.withColumn("_key", F.explode(keys("_text"))).join(known, "_key", "left_semi").select("_key", "_t", "_text"), "mention-keys")
    many = held.groupBy("_key").agg(F.count(F.lit(1)).alias("_held"))
    rarest = named.join(many, "_key").groupBy("_n", "_name").agg(F.min(F.struct("_held", "_key")).alias("_best"))
    chosen = rarest.select("_n", "_name", F.col("_best._key").alias("_key"), F.col("_best._held").alias("_held"))
    rows = max(SALT_ROWS, held.count() // MAX_HOT)
    salts = F.ceil(F.col("_held") / rows).cast("int")
    hot = F.broadcast(many.where(F.col("_held") > rows).select("_key", salts.alias("_salts")))  # at most MAX_HOT keys
    dealt = (held.join(hot, "_key", "left")
             .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_t", "_text"), F.col("_salts")), F.lit(0)).cast("int")))
    spread = chosen.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    pairs = dealt.join(spread, ["_key", "_salt"]).where(F.col("_text").contains(F.col("_name")))
    return pairs.select(F.col("_t").alias(text_id), F.col("_n").alias(name_id))
