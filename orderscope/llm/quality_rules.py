"""Quality rules: distribution divergence against language references, after simple base rules.

Every text gets a histogram over character classes and one over the common words of its language.
References are the pooled histograms per language of all documents that pass the base rules. A
document is kept when both Jensen-Shannon distances to its language's reference are within limits;
a histogram with too few entries (minimum-length guards) is not compared, nor are the words of a
language without a list.

Null and empty texts have no words and fail the base rules; a null language is a language of its own
(characters only); rows are judged one by one, so repeated rows and ids need no rule. Everything is
Spark SQL functions; no text is shuffled. Distances stay inside each row, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

BLANK = r"[\x20\x09-\x0D]+"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PCT = 30
SYMBOLS = "#*$%&|<>"
#: Guards: fewer characters or words than this are too few to compare.
MIN_CHARS = 200
MIN_COMMON_BASE = 60
MAX_CHAR_DISTANCE = 0.28
#: Word histograms of few words are far from any reference by chance; about sqrt(bins / (8 ln 2 n)) is added.
MAX_WORD_DISTANCE = 0.15
WORD_NOISE = 20 / (8 * 0.6931471805599453)

#: Frequent function words of the languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "be", "with", "as", "by", "at", "this", "from", "are"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au", "sur", "pas", "il"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}


def split_words(text: str = "text", blank: str = BLANK) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), blank, -1), "")


#: Words covered by ``windows`` (hash of the run that starts at each word) that occur twice or more.
REPEATED = f"""
    CASE WHEN size(windows) = size(array_distinct(windows)) THEN 0L ELSE
      aggregate(array(sort_array(transform(windows, (h, i) -> struct(h, i)))), 0L, (z, s) ->
        z + aggregate(array(sort_array(transform(filter(transform(s, (x, k) -> struct(x.i AS i,
              coalesce(get(s, k - 1).h = x.h, false) OR coalesce(get(s, k + 1).h = x.h, false) AS twice)), x -> x.twice), x -> x.i))), 0L, (y, p) ->
          y + aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW}))), 0L, (a, b) -> a + b)))
    END"""


def js_distance(p: str, q: str) -> str:
    """SQL for the Jensen-Shannon distance (base 2) of two arrays of shares."""
    return (f"sqrt(greatest(0D, aggregate(zip_with({p}, {q}, (a, b) -> CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0D END"
            f" + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0D END), 0D, (x, y) -> x + y) / 2))")


def measure(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the text, with base counts, base_failed and the two histograms (counts)."""
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    body = F.coalesce(F.col("__text"), F.lit(""))
    d = docs.withColumn("__text", F.col(text)).drop(text).withColumn("words", split_words("__text"))
    at = ", ".join(f"get(hashes, i + {j})" for j in range(WINDOW))
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.withColumn("windows", F.expr(f"CASE WHEN size(hashes) >= {WINDOW} THEN transform(sequence(0, size(hashes) - {WINDOW}), i -> xxhash64({at})) ELSE CAST(array() AS array<bigint>) END"))
    d = (d.withColumn("n_words", F.size("words").cast("long"))
         .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
         .withColumn("n_symbols", (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"))
         .withColumn("lines", F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
         .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
         .withColumn("n_repeat_words", F.expr(REPEATED).cast("long"))
         .withColumn("rest", F.regexp_replace(body, r"[\p{Ll}\x20\x09-\x0D]+", ""))
         .withColumn("common", F.filter("words", lambda w: w.isin(*every))))

    def without(pattern):
        return F.length("rest") - F.length(F.regexp_replace("rest", pattern, ""))

    classes = [F.col("word_chars") - F.length("rest"), without(r"\p{Lu}+"), without(r"\p{Nd}+"), without(r"""[.,;:!?'"()\-]+""")]
    d = d.withColumn("chars", F.transform(F.array(*classes), lambda x: x.cast("long")))
    d = d.withColumn("chars", F.concat("chars", F.array(F.col("word_chars") - F.aggregate("chars", F.lit(0).cast("long"), lambda a, b: a + b))))
    counts = F.lit(None).cast("array<bigint>")
    for code, ws in COMMON_WORDS.items():
        own = F.array(*[(F.size("common") - F.size(F.array_remove("common", w))).cast("long") for w in ws])
        counts = F.when(F.col(lang) == code, own).otherwise(counts)
    d = d.withColumn("common_counts", counts)
    d = d.withColumn("common_counts", F.concat("common_counts", F.array(
        F.col("n_words") - F.aggregate("common_counts", F.lit(0).cast("long"), lambda a, b: a + b))))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PCT)
    return d.withColumn("base_failed", failed).drop("__text", "words", "hashes", "windows", "lines", "rest", "common")


def references(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """One row per language: shares of character classes and common words over its documents."""
    def pooled(name, n):
        return F.array(*[F.sum(F.get(name, F.lit(i))).cast("double") for i in range(n)])

    def shares(a):
        total = F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        return F.when(total > 0, F.transform(a, lambda x: x / total))

    return (measured.where(~F.col("base_failed")).groupBy(F.col(lang).alias("ref_lang"))
            .agg(pooled("chars", 5).alias("rc"), pooled("common_counts", 21).alias("rw"))
            .select("ref_lang", shares(F.col("rc")).alias("ref_chars"), shares(F.col("rw")).alias("ref_words")))


def judge(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """Adds char_distance, word_distance (null where guarded) and kept."""
    d = measured.join(references(measured, lang), F.col(lang).eqNullSafe(F.col("ref_lang")), "left").drop("ref_lang")
    d = d.withColumn("p", F.expr("transform(chars, x -> CAST(x AS double) / word_chars)")).withColumn(
        "w", F.expr("transform(common_counts, x -> CAST(x AS double) / n_words)"))
    d = (d.withColumn("char_distance", F.expr(f"CASE WHEN word_chars >= {MIN_CHARS} THEN {js_distance('p', 'ref_chars')} END"))
         .withColumn("word_distance", F.expr(f"CASE WHEN n_words >= {MIN_COMMON_BASE} THEN {js_distance('w', 'ref_words')} END")))
    far = F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(
        F.col("word_distance") > MAX_WORD_DISTANCE + F.sqrt(F.lit(WORD_NOISE) / F.col("n_words")), F.lit(False))
    return d.withColumn("kept", ~F.col("base_failed") & ~far).drop("p", "w", "ref_chars", "ref_words")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = written(measure(table(spark, sf_dir, "documents", "doc_id", "lang", "text")), "op1-measures")
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _values() -> str:
    return ", ".join(f"('{c}', '{w}')" for c, ws in COMMON_WORDS.items() for w in ws)


_JS = """sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))"""

SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW})),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
cov AS (SELECT rid, sum(c) AS n FROM (SELECT rid, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {WINDOW})) AS c FROM dup) GROUP BY rid),
m AS MATERIALIZED (SELECT d.rid, doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    regexp_replace(t, '[\\p{{Ll}}\\x20\\x09-\\x0D]+', '', 'g') AS rest, ws
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d) d LEFT JOIN cov USING (rid)),
b AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PCT} * n_words AS base_failed FROM m),
c0 AS (SELECT rid, lang, word_chars, base_failed, word_chars - length(rest) AS c1, length(rest) - length(regexp_replace(rest, '\\p{{Lu}}+', '', 'g')) AS c2,
    length(rest) - length(regexp_replace(rest, '\\p{{Nd}}+', '', 'g')) AS c3, length(rest) - length(regexp_replace(rest, '[.,;:!?''"()\\-]+', '', 'g')) AS c4 FROM b),
c AS MATERIALIZED (SELECT rid, lang, base_failed, word_chars AS total, unnest([1, 2, 3, 4, 5]) AS bin, unnest([c1, c2, c3, c4, word_chars - c1 - c2 - c3 - c4]) AS n FROM c0),
cr AS (SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM c WHERE NOT base_failed GROUP BY lang, bin),
cd AS (SELECT rid, {_JS} AS dist FROM (SELECT rid, n / total AS p, q FROM c JOIN cr ON c.lang IS NOT DISTINCT FROM cr.lang AND c.bin = cr.bin WHERE total >= {MIN_CHARS}) GROUP BY rid),
v(lang, word) AS (VALUES {_values()}),
wc AS (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(ws) AS w FROM b) GROUP BY rid, w),
wl AS (SELECT b.rid, b.lang, b.base_failed, b.n_words, v.word, coalesce(wc.n, 0) AS n FROM b JOIN v USING (lang) LEFT JOIN wc ON wc.rid = b.rid AND wc.w = v.word),
wo AS MATERIALIZED (SELECT rid, lang, base_failed, n_words, word, n FROM wl UNION ALL SELECT rid, lang, base_failed, n_words, '', n_words - sum(n) FROM wl GROUP BY rid, lang, base_failed, n_words),
wr AS (SELECT lang, word, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM wo WHERE NOT base_failed GROUP BY lang, word),
wd AS (SELECT rid, {_JS} AS dist FROM (SELECT rid, n / n_words AS p, q FROM wo JOIN wr USING (lang, word) WHERE n_words >= {MIN_COMMON_BASE}) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(cd.dist > {MAX_CHAR_DISTANCE}, false) AND NOT coalesce(wd.dist > {MAX_WORD_DISTANCE} + sqrt({WORD_NOISE} / n_words), false) AS kept
FROM b LEFT JOIN cd USING (rid) LEFT JOIN wd USING (rid)"""
