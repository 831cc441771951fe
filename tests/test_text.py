"""Text functions on hand-written rows, checked against plain-Python definitions."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from orderscope import config as C
from orderscope.functions import text as TX

ROWS = [
    "Fornitura _x000D_ guanti (cod. int. 12) nitrile",
    "pompa S/N 4711 sommersa [x] ricambio",
    "autocarro targata AB 123 CD revisione",
    "Con la presente vi confermiamo l’ordine n. 5: cemento",
    "Con la presente vi confermiamo l'ordine: sabbia",
    "Con la presente vi confermiamo l`ordine 7: ghiaia",
    "Con la presente vi confermiamo l ordine: ferro",
    "ai seguenti prezzi e condizioni: tubi",
    "A termine lavori verrà redatto un consuntivo finale. Extra",
    "a termine lavori verra redatto un consuntivo. Extra",
    "nbsp between  and\ttabs\nlines",
    "ﬁnale ½ İstanbul Straße øre café",
    "",
    "   ",
    "é combining",
    "Ωμέγα Ёлка",
]


NORMALIZED = [
    "fornitura guanti nitrile", "pompa sommersa ricambio", "autocarro revisione", "cemento", "sabbia", "ghiaia", "ferro", "tubi",
    "extra", "extra", "nbsp between and tabs lines", "finale 1⁄2 istanbul straße øre cafe", "", "", "e combining", "ωμεγα елка",
]
CLEANED = [
    "Fornitura guanti nitrile", "pompa sommersa ricambio", "autocarro revisione",
    "Con la presente vi confermiamo l’ordine n. 5: cemento", "Con la presente vi confermiamo l'ordine: sabbia",
    "Con la presente vi confermiamo l`ordine 7: ghiaia", "Con la presente vi confermiamo l ordine: ferro",
    "ai seguenti prezzi e condizioni: tubi", "A termine lavori verrà redatto un consuntivo finale. Extra",
    "a termine lavori verra redatto un consuntivo. Extra", "nbsp between and tabs lines", "ﬁnale ½ İstanbul Straße øre café",
    "", "", "e\u0301 combining", "Ωμέγα Ёлка",
]
MARKS = dict.fromkeys(c for c in range(0x110000) if unicodedata.combining(chr(c)))


def without_marks(t):
    return unicodedata.normalize("NFKD", t).translate(MARKS)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ROWS)] + [(len(ROWS), None)], "id int, t string")


def _col(df, expr):
    return [r[0] for r in df.orderBy("id").select(expr).collect()]


def test_normalize_text(df):
    got = _col(df, TX.normalize_text("t"))
    assert got == NORMALIZED + [""]


def test_normalize_text_dataframe_form(df):
    got = [r[0] for r in TX.with_normalized_text(df, "t", "n").orderBy("id").select("n").collect()]
    assert got == NORMALIZED + [""]


def test_clean_text_keeps_case_and_boilerplate(df):
    got = _col(df, TX.clean_text("t"))
    assert got == CLEANED + [""]
    assert "Con la presente" in got[3]


def test_strip_accents_exact(df):
    got = _col(df, TX.strip_accents("t"))
    assert got[8:12] == ["A termine lavori verra redatto un consuntivo finale. Extra", ROWS[9], "nbsp between  and\ttabs\nlines", "finale 1⁄2 Istanbul Straße øre cafe"]
    assert got[14:] == ["e combining", "Ωμεγα Елка", None]


def test_whitespace_is_unicode(df):
    got = _col(df, TX.norm_whitespace("t"))
    assert got[10] == "nbsp between and tabs lines"


def test_tokenize_unicode_words(spark):
    d = spark.createDataFrame([("Città_1 più-bella, 42!",)], "t string")
    assert d.select(TX.tokenize("t")).first()[0] == re.findall(r"\w+", "Città_1 più-bella, 42!".lower())


def test_combine_text_skips_blank_and_missing(spark):
    d = spark.createDataFrame([("a", "  ", None, " b ")], "oggetto string, descrizione string, desc string, note string")
    assert d.select(TX.combine_text(C.TEXT_COLUMNS + ["absent"], d.columns)).first()[0] == "a |  b"
    with pytest.raises(ValueError):
        TX.combine_text(["absent"], d.columns)


def test_normalize_region(spark):
    vals = ["Friuli - Venezia Giulia", "EMILIA-ROMAGNA", "tarragona", " ", None, "  Lombardia  "]
    d = spark.createDataFrame([(v,) for v in vals], "r string")
    got = [r[0] for r in d.select(TX.normalize_region("r")).collect()]
    assert got == ["Friuli Venezia Giulia", "Emilia-Romagna", "Tarragona", None, None, "Lombardia"]


def test_oggetto_filled(spark):
    d = spark.createDataFrame([("  ", "Nome", " ", "Cliente"), (None, None, "S", None), ("Ogg  x", "n", "s", "c")],
                              "o string, n string, s string, c string")
    got = [r[0] for r in d.select(TX.oggetto_filled("o", "n", "s", "c")).collect()]
    assert got == ["Nome - Cliente", "S", "Ogg x"]


def test_parse_number(spark):
    d = spark.createDataFrame([("1,234.5",), ("12,5",), ("abc",), ("7",)], "x string")
    assert [r[0] for r in d.select(TX.parse_number("x")).collect()] == [1234.5, 125.0, None, 7.0]


def test_clip_text(spark):
    lim = C.EMBED_MAX_TOKENS * C.AVG_CHARS_PER_TOKEN
    d = spark.createDataFrame([("a" * (lim + 5),), ("b" * (lim - 1),), ("ccc",)], "t string")
    c = TX.clip_text(F.col("t"))
    rows = d.select(F.length(c["clipped_text"]), c["est_tokens"], c["was_clipped"], c["near_limit"]).collect()
    assert tuple(rows[0]) == (lim, C.EMBED_MAX_TOKENS, True, False)
    assert tuple(rows[1]) == (lim - 1, C.EMBED_MAX_TOKENS, False, True)
    assert tuple(rows[2]) == (3, 1, False, False)


def test_truncate_and_looks_like_sql(spark):
    d = spark.createDataFrame([("x" * 5000,), ("short",)], "t string")
    got = [r[0] for r in d.select(TX.truncate_json("t")).collect()]
    assert len(got[0]) == C.TRUNCATE_JSON_CHARS and got[0].endswith("...") and got[1] == "short"
    q = spark.createDataFrame([("SELECT a FROM b",), ("with x",), ("hi;",), ("select only",)], "t string")
    assert [r[0] for r in q.select(TX.looks_like_sql("t")).collect()] == [True, True, True, False]


def test_strip_accents_random_unicode(spark):
    """Random strings over Latin, Greek, Cyrillic, combining marks, compatibility forms and CJK."""
    import random
    rng = random.Random(11)
    pools = [range(0x20, 0x7F), range(0xA0, 0x250), range(0x300, 0x370), range(0x370, 0x530),
             range(0x1E00, 0x1F00), range(0x2000, 0x2070), range(0x2150, 0x2190), range(0xFB00, 0xFB07),
             range(0x3040, 0x30A0), range(0xFF01, 0xFF5F)]
    rows = []
    for i in range(400):
        chars = [chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(0, 30))]
        rows.append((i, "".join(c for c in chars if not 0xD800 <= ord(c) <= 0xDFFF)))
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r[0]: r[1] for r in df.select("id", TX.strip_accents("t")).collect()}
    assert all(got[i] == without_marks(t) for i, t in rows)
    # marks go before blanks are collapsed, so a mark between two blanks leaves one blank
    norm = {r[0]: r[1] for r in TX.with_normalized_text(df.where("t RLIKE '^[a-zàèéìòù ]*$'"), "t", "n").select("id", "n").collect()}
    assert all(n == " ".join(without_marks(dict(rows)[i]).split()) for i, n in norm.items())


def test_pattern_search_by_fixed_part_loses_no_match(spark):
    from functools import reduce

    from orderscope import config as C
    patterns = TX._CODE_PATTERNS + C.BOILERPLATE_PATTERNS
    assert set(TX._HOLDS) == set(patterns)
    odd = ["a S/N 12", "ſ/n 12 b", "a [x] b", "[ſ]", "x_X000d_y", "(COD. İNT. 3)", "(cod. ınt. 3)", "TARGATO AB 123 CD", "targato ab123cd è", "é s/n é",
           "Aı seguenti prezzi e condizioni:", "con la presente vi confermiamo l’ordine n. 4: k", "A TERMİNE LAVORI VERRÀ redatto un consuntivo x.", "a termine lavori verrà redatto un consuntivo x.",
           "K K", "plain", "", None, "caffè ﬁne ½ ́x Å", " ÀÉ straße", "日本 s/n 4", "\u0085x\u009f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    plain = reduce(lambda a, rx: F.regexp_replace(a, "(?iuU)" + rx, " "), patterns, F.col("t"))
    fast = F.translate("t", TX._ACCENT_SRC, TX._ACCENT_DST)
    exact = TX._strip_accents_exact(F.when(fast.rlike(TX._NEEDS_EXACT), F.col("t")))
    both = TX.with_normalized_whole(TX.with_normalized_text(df, "t", "n"), "t", "w")
    assert both.where("n <> w or n is null or w is null").count() == 0
    rows = df.select("i", "t", TX._strip_searched(F.col("t"), patterns).alias("a"), plain.alias("b"), TX._strip_accents_unless_ascii(F.col("t")).alias("c"), F.coalesce(exact, fast).alias("d")).collect()
    assert len(rows) == len(odd)
    for r in rows:
        assert r["a"] == r["b"] and r["c"] == r["d"], r["t"]
    assert sum(r["a"] != r["t"] for r in rows) >= 12
