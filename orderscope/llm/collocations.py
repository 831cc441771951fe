"""Phrase collocation mining by Rabin-Karp fingerprints.

1. Texts are dealt into chunks. A chunk numbers its words exactly, and polynomials over the prefixes of its
   word sequence, modulo two primes, give every n-gram of every length its fingerprint by one subtraction
   and one product. Fingerprints travel to parts with their counts in the chunk; their place in the message
   is the pointer back to their occurrences. A part adds counts up and answers, pointer by pointer, whether
   the fingerprint is frequent. Fingerprints are cut to 4 bytes and two phrases may share one, so that a
   count can only be too large: no frequent phrase is missed.
2. A chunk follows the pointers of frequent fingerprints to its text, tells phrases of one fingerprint
   apart by their words, and materialises only them, with their counts. Adding these up by the phrase's text
   gives exact counts.
3. Cuts, scores, containment and the first rows of each language are joins and aggregates over the
   frequent phrases, in exact decimals.

Null and empty texts have no words; a null language is ``und``. Repeated rows count as often as they occur.
Other columns are not read and may have any names. A text above LONG bytes is cut at piece ends, so a long
text is many rows (one piece without an end stays whole). An empty table gives no rows. The rows must be the
same whenever they are read (files, or a plan without sampling): otherwise answers do not fit and an
error says so.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, total_bytes, written
from .exchange import ROWS, answered, asked, packed, parted, rows, served, unpacked
from .words import U, Words, mix, text_buffer

MAX_WORDS, MIN_COUNT, SHARE, TOP = 3, 10, 50, 2000
#: Bytes that end a piece, and blanks inside it.
ENDS, BLANKS = tuple(b".,;:!?\n\x0b\x0c\r"), (0x20, 0x09)
LONG = 1 << 20
CHUNK_TEXT, PART_TEXT = 6 << 20, 8 << 20
#: Two primes below 2^31 and a base: products stay below 2^62.
PRIMES, BASE = (2147483647, 2147483629), 1_000_003
#: Words whose prefixes one polynomial covers, and words of the longest n-gram, which may end behind them.
BLOCK, LONGEST = 1 << 16, 64
#: Candidates of a language that one task ranks before the final ranking, about.
BUCKET_ROWS = 100_000


def _powers(p: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have: have + step] = out[:step] * U(pow(BASE, have, p)) % U(p)
        have += step
    return out


def _digest(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Grams:
    """Words of a chunk's texts, numbered exactly, and the fingerprints of its n-grams."""

    def __init__(self, texts, langs):
        data, bounds = text_buffer(texts)
        w = Words(data, bounds, lower=True, blanks=(*BLANKS, *ENDS))
        length = w.end - w.start
        ends = np.r_[0, np.cumsum(length)]
        raw = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(w.data[w.inside])])
        coded = raw.dictionary_encode()
        self.words = coded.dictionary
        self.word = coded.indices.to_numpy().astype(np.int64)
        # a piece's number: ends of pieces and of texts before it
        stop = np.zeros(256, bool)
        stop[list(ENDS)] = True
        doc = w.doc_of_word()
        self.piece = np.r_[0, np.cumsum(stop[w.data])][w.start] + doc
        coded = pc.fill_null(langs, "und").combine_chunks().dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy().astype(np.int64)[doc]
        value = np.array([_digest(x) for x in self.words.to_pylist()], np.uint64)
        self.value = [(value % U(p))[self.word] + U(1) for p in PRIMES]
        self.salt = np.array([_digest(x.encode()) for x in self.langs], np.uint64)
        self.power = [_powers(p, min(BLOCK, len(self.word)) + LONGEST) for p in PRIMES]

    def starts(self, n: int) -> np.ndarray:
        """Starts of the n-grams that stay inside a piece."""
        return np.flatnonzero(self.piece[n - 1:] == self.piece[: len(self.piece) - n + 1]) if len(self.piece) >= n else np.zeros(0, np.int64)

    def fingerprints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, 64-bit fingerprints) of the n-grams, told apart by language and length as well."""
        at = self.starts(n)
        lanes = []
        for p, value, power in zip(PRIMES, self.value, self.power):
            p, out = U(p), np.zeros(len(at), np.uint64)
            for lo in range(0, len(value), BLOCK):  # n-grams that start in this block
                i, j = np.searchsorted(at, [lo, lo + BLOCK])
                here = value[lo: lo + BLOCK + n - 1]
                prefix = np.zeros(len(here) + 1, np.uint64)
                np.cumsum(here * power[: len(here)] % p, out=prefix[1:])
                s = at[i:j] - lo
                # brought to one exponent, equal runs of words are equal wherever they stand
                out[i:j] = (prefix[s + n] - prefix[s]) % p * power[len(here) - 1 - s] % p if len(s) else 0
                out[i:j] = out[i:j] * U(pow(BASE, BLOCK + LONGEST - len(here), int(p))) % p
            lanes.append(out)
        return at, mix((lanes[0] << U(32)) + lanes[1] + self.salt[self.lang[at]] * U(2 * n + 1))

    def exact(self, n: int, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of one occurrence, count) of each different phrase among n-grams at ``at`` with these
        fingerprints: occurrences whose words or language are not those of their fingerprint's first go round again."""
        firsts, counts = [], []
        while len(at):
            _, first, of = np.unique(key, return_index=True, return_inverse=True)
            lead = at[first][of]
            same = self.lang[at] == self.lang[lead]
            for j in range(n):
                same &= self.word[at + j] == self.word[lead + j]
            firsts.append(at[first])
            counts.append(np.bincount(of[same], minlength=len(first)))
            at, key = at[~same], key[~same]
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, counts))

    def phrases(self, n: int, at: np.ndarray) -> pa.Array:
        words = [self.words.take(pa.array(self.word[at + j])) for j in range(n)]
        out = words[0] if n == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))
        return out.cast(pa.large_string()).cast(pa.string())


def pieces_of(text: str, limit: int) -> list[str]:
    """The text cut behind piece ends into parts of about ``limit`` characters."""
    out, lo = [], 0
    while len(text) - lo > limit:
        cut = max(text.rfind(chr(e), lo, lo + limit) for e in ENDS)
        if cut < 0:
            after = [i for i in (text.find(chr(e), lo + limit) for e in ENDS) if i >= 0]
            if not after:
                break
            cut = min(after)
        out.append(text[lo: cut + 1])
        lo = cut + 1
    return [*out, text[lo:]]


def _dealt(docs: DataFrame, text: str, lang: str) -> tuple[DataFrame, int]:
    rows_ = docs.select(F.col(text).alias("text"), F.coalesce(lang, F.lit("und")).alias("lang")).where(F.octet_length("text") > 0)

    def cut(batches):
        for b in batches:
            for t, x in zip(b.column(0).to_pylist(), b.column(1)):
                parts = pieces_of(t, LONG)
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.repeat(x, len(parts))], names=["text", "lang"])

    is_long = F.octet_length("text") > LONG
    rows_ = rows_.where(~is_long).unionByName(rows_.where(is_long).mapInArrow(cut, "text string, lang string"))
    size = total_bytes(docs, text)
    # by the row's number: equal rows, however many, are spread over all chunks
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(size // CHUNK_TEXT + 1)).cast("int")
    return rows_.withColumn("chunk", chunk), size // PART_TEXT + 1


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, words, phrase, n) of every phrase of up to ``max_words`` words with n >= min_count occurrences
    inside pieces, and for every language with words one row with words = 0 and their number."""
    dealt, parts = _dealt(docs, text, lang)
    small = np.uint8 if min_count < 256 else np.uint32

    def asked_keys(g: Grams):
        """Distinct fingerprints with counts, n by n; their place here is the pointer to their occurrences."""
        found = [np.unique(g.fingerprints(n)[1], return_counts=True) for n in range(1, max_words + 1)]
        return np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])

    def ask(t: pa.Table) -> pa.Table:
        keys, counts = asked_keys(Grams(t["text"], t["lang"]))
        counts = np.minimum(counts, min_count).astype(small)
        rest = ((keys // U(parts)) & U(0xFFFFFFFF)).astype(np.uint32)
        _, to, which = parted(keys, parts)
        return rows(to, t["chunk"][0].as_py(), [packed(rest[i], counts[i]) for i in which])

    def serve(bodies: list) -> list:
        sent = [unpacked(b, np.uint32, small) for b in bodies]
        _, of = np.unique(np.concatenate([k for k, _ in sent]), return_inverse=True)
        often = np.bincount(of, np.concatenate([c for _, c in sent]).astype(float))[of] >= min_count
        ends = np.cumsum([len(k) for k, _ in sent])
        return [np.packbits(often[e - len(k): e]).tobytes() for e, (k, _) in zip(ends, sent)]

    def use(t: pa.Table, answers: dict) -> pa.Table:
        if not t.num_rows:
            raise ValueError("answers for a chunk without rows: the rows must be the same whenever they are read")
        g = Grams(t["text"], t["lang"])
        keys, _ = asked_keys(g)
        _, to, which = parted(keys, parts)
        often = np.zeros(len(keys), bool)
        for part, i in zip(to.tolist(), which):
            bits = np.frombuffer(answers.get(part, b""), np.uint8)
            if len(bits) != (len(i) + 7) // 8:
                raise ValueError("answers do not fit their questions: the rows must be the same whenever they are read")
            often[i] = np.unpackbits(bits, count=len(i)).astype(bool)
        total = np.bincount(g.lang, minlength=len(g.langs))
        out = [pa.table({"lang": pa.array(g.langs, pa.string()), "words": pa.array(np.zeros(len(total), np.int32)),
                         "phrase": pa.array([""] * len(total), pa.string()), "n": pa.array(total, pa.int64())})]
        done = 0
        for n in range(1, max_words + 1):
            at, key = g.fingerprints(n)
            own, of = np.unique(key, return_inverse=True)
            keep = often[done: done + len(own)][of]
            done += len(own)
            first, count = g.exact(n, at[keep], key[keep])
            out.append(pa.table({"lang": pa.array(g.langs, pa.string()).take(pa.array(g.lang[first])), "words": pa.array(np.full(len(first), n, np.int32)),
                                 "phrase": g.phrases(n, first), "n": pa.array(count.astype(np.int64))}))
        return pa.concat_tables(out)

    found = answered(dealt, served(asked(dealt, ask), serve), use, "lang string, words int, phrase string, n long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | ((F.col("words") == 0) & (F.col("n") > 0)))


def _sub(phrase, start, n):
    """``n`` words from word ``start`` (from 1) of a phrase."""
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                 share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of 2 to ``max_words`` words.

    a, l and r are the occurrences of the phrase and of the two sides of its weakest cut, n those of all words;
    score is floor(1,000,000 a^2 / (l r)) of that cut. Phrases that a longer frequent phrase holds in at
    least ``share`` percent of their occurrences are left out.
    """
    if not 2 <= max_words <= LONGEST:
        raise ValueError(f"max_words must be in 2..{LONGEST}")
    counts = written(phrase_counts(docs, text, lang, max_words, min_count), "op11-counts")
    whole = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    part = counts.where(f"words BETWEEN 1 AND {max_words - 1}")
    # one row per phrase and cut; a word that begins many phrases is a skewed key, which AQE splits
    cuts = (whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .withColumn("left", _sub("phrase", F.lit(1), F.col("k"))).withColumn("right", _sub("phrase", F.col("k") + 1, F.col("words") - F.col("k"))))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    big = [F.col(c).cast("decimal(38,0)") for c in "alr"]
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * big[0] * big[0], big[1] * big[2])
    scored = (cuts.withColumn("score", score).groupBy("lang", "words", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    inside = (whole.where("words > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
              .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
              .groupBy("lang", _sub("phrase", F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer")))
    kept = (scored.join(inside, ["lang", "phrase"], "left")
            .where(F.coalesce(100 * F.col("longer").cast("decimal(38,0)") < share * F.col("a").cast("decimal(38,0)"), F.lit(True))))
    kept = written(kept.select("lang", "phrase", "a", "l", "r", "score"), "op11-scored")
    buckets = kept.count() // BUCKET_ROWS + 1
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    near = kept.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    best = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents", "text", "lang"))


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, piece FROM (
  SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, p, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT lang, p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces)),
t AS (SELECT lang, w, lead(w, 1) OVER piece AS w2, lead(w, 2) OVER piece AS w3 FROM w WINDOW piece AS (PARTITION BY p ORDER BY i)),
g AS (SELECT lang, 1 AS m, w AS phrase FROM t UNION ALL SELECT lang, 2, w || ' ' || w2 FROM t WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM t WHERE w3 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND f >= 10),
cut AS (SELECT c.lang, c.m, c.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) AS c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') AND x.m = k
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ') AND y.m = c.m - k),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM (
  SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE m = 3) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""
