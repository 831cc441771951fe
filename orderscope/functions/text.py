"""Column -> Column text functions (all JVM-side regex/string expressions).

Java regex needs ``(?U)`` so that ``\\s``/``\\w``/``\\b`` are Unicode-aware like
Python's ``re``; ``(?i)`` + ``(?u)`` give Unicode case folding.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

_FLAGS = "(?iuU)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_whitespace(x) -> Column:
    """Collapse any Unicode whitespace run (the separators U+001C to U+001F count) to one space, then trim."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)[\s\x1C-\x1F]+", " "))


def _strip_patterns(col: Column, patterns) -> Column:
    """Replace each pattern by a space, in order.

    If no pattern matches the input, no replacement happens and the chain is
    the identity, so one combined test guards the whole chain: most texts pay
    a single scan instead of one per pattern.
    """
    patterns = list(patterns)
    chain = reduce(lambda acc, rx: F.regexp_replace(acc, _FLAGS + rx, " "), patterns, col)
    if len(patterns) == 1:
        return chain
    any_match = _FLAGS + "|".join(f"(?:{rx})" for rx in patterns)
    return F.when(col.rlike(any_match), chain).otherwise(col)


#: What every match of a pattern holds, lower-cased ASCII: a text without it need not be searched by the regex engine.
_HOLDS = {
    r"_x000D_": "_x000d_",
    r"\(cod\. int\.[^)]+\)": "(cod. int.",
    r"s/n\s*\S+": "s/n",
    r"\[[^\]]+\]": "[",
    r"\btargat[oa]\s+[A-Z]{1,2}\s*\d{3}\s*[A-Z]{1,2}\b": "targat",
    r"con la presente vi confermiamo l[’'` ]ordine[^:]*:": "con la presente vi confermiamo l",
    r"ai seguenti prezzi e condizioni:?": "ai seguenti prezzi e condizioni",
    r"a termine lavori verr[aà] redatto un consuntivo[^.]*\.": "a termine lavori verr",
}
#: The characters besides A-Z and a-z that match ASCII letters when case is folded: long s, dotless and dotted i, Kelvin sign.
_FOLDS_TO_ASCII = "\u017f\u0131\u0130\u212a"


def _either(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _strip_searched(col: Column, patterns) -> Column:
    """``_strip_patterns`` by a byte search for the fixed part of each pattern first. A pattern whose fixed part is
    not known, and a text with letters that fold to ASCII ones, is searched for the pattern itself. ``col`` occurs
    many times, so it must be a column, and no filter on the result may be pushed below it."""
    chain = reduce(lambda acc, rx: F.regexp_replace(acc, _FLAGS + rx, " "), patterns, col)
    low, odd = F.lower(col), _either(col.contains(c) for c in _FOLDS_TO_ASCII)
    found = [(odd | low.contains(_HOLDS[rx])) & col.rlike(_FLAGS + rx) if rx in _HOLDS else col.rlike(_FLAGS + rx) for rx in patterns]
    return F.when(_either(found), chain).otherwise(col)


_CODE_PATTERNS = C.ARTIFACT_PATTERNS + C.INTERNAL_CODE_PATTERNS + [C.LICENSE_PLATE_PATTERN]


def _strip_codes(col: Column) -> Column:
    return _strip_patterns(col, _CODE_PATTERNS)


def _strip_all(col: Column) -> Column:
    return _strip_patterns(col, _CODE_PATTERNS + C.BOILERPLATE_PATTERNS)


# Characters whose compatibility decomposition minus combining marks is at
# most one character, generated from the Unicode database for the Latin,
# Greek and Cyrillic blocks. One-to-one folds go through a JVM ``translate``;
# characters that fold to themselves are safe as they are. Anything else
# (ligatures, fractions, combining marks, other scripts) takes the exact path.
def _accent_table() -> tuple[str, str, str]:
    src, dst, same = [], [], []
    for cp in range(0x00A0, 0x0530):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base == ch:
            same.append(ch)
        elif len(base) == 1:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst), "".join(same)


_ACCENT_SRC, _ACCENT_DST, _ACCENT_SAME = _accent_table()


# After the one-to-one fold, a row needs the exact path only if a character
# above U+00FF remains (other scripts, combining marks, unfolded letters) or one
# of the three vulgar fractions; everything else left is ASCII or folds to itself.
_NEEDS_EXACT = "[^\\u0000-\\u00bb\\u00bf-\\u00ff]"


def _strip_accents_batch(s: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return s.map(one)


_strip_accents_exact = F.pandas_udf(_strip_accents_batch, T.StringType())


def strip_accents(x) -> Column:
    """NFKD minus combining marks.

    One-to-one folds run as a JVM ``translate``; a cheap range test on the
    folded text flags the rows that still need the exact Unicode path. Spark
    evaluates an extracted Python UDF for every row of a batch, so the UDF
    receives NULL for unflagged rows: Python work is proportional to the rows
    that really need it.
    """
    col = _c(x)
    fast = F.translate(col, _ACCENT_SRC, _ACCENT_DST)
    exact = _strip_accents_exact(F.when(fast.rlike(_NEEDS_EXACT), col))
    return F.coalesce(exact, fast)


def _strip_accents_unless_ascii(col: Column) -> Column:
    ascii_only = F.length(col) == F.octet_length(col)  # folds to itself
    fast = F.when(ascii_only, col).otherwise(F.translate(col, _ACCENT_SRC, _ACCENT_DST))
    exact = _strip_accents_exact(F.when(~ascii_only & fast.rlike(_NEEDS_EXACT), col))
    return F.coalesce(exact, fast)


def normalize_text(x) -> Column:
    """S3: strips (artefact, codes, plate, boilerplate) -> lower -> accents -> whitespace; non-string -> ''."""
    col = _c(x).cast("string")
    s = norm_whitespace(strip_accents(F.lower(_strip_all(col))))
    return F.coalesce(s, F.lit(""))


def with_normalized_text(df, src, out: str = "text_normalized"):
    """DataFrame form of ``normalize_text``: the pattern strips and lower-casing
    are projected as a column first, so the accent step (JVM fold + Python
    exact path) reads it once instead of re-evaluating the chain per use."""
    pre = "__pre_" + out
    df = df.withColumn(pre, F.lower(_strip_all(_c(src).cast("string"))))
    return df.withColumn(out, F.coalesce(norm_whitespace(strip_accents(F.col(pre))), F.lit(""))).drop(pre)


def with_normalized_whole(df, src, out: str = "text_normalized"):
    """``with_normalized_text`` for long texts whose normal form is stored or counted, never filtered on: the same
    result by cheaper tests, a byte search before any pattern and no folding of ASCII texts."""
    pre = "__pre_" + out
    df = df.withColumn(pre, _c(src).cast("string"))
    df = df.withColumn(pre, F.lower(_strip_searched(F.col(pre), _CODE_PATTERNS + C.BOILERPLATE_PATTERNS)))
    return df.withColumn(out, F.coalesce(norm_whitespace(_strip_accents_unless_ascii(F.col(pre))), F.lit(""))).drop(pre)


def clean_text(x) -> Column:
    """Same strips without boilerplate, case kept; non-string -> ''."""
    col = _c(x).cast("string")
    return F.coalesce(norm_whitespace(_strip_codes(col)), F.lit(""))


def tokenize(x) -> Column:
    """Runs of letters, numbers (² and ½ are some) and underscores of the lower-cased text; marks part words."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def combine_text(cols: list, available: list[str] | None = None) -> Column:
    """Non-blank fields joined with `` | `` then trimmed; missing columns skipped."""
    names = [c for c in cols if available is None or c in available]
    if not names:
        raise ValueError("No configured text columns were found in the dataframe.")
    parts = [F.when(F.trim(F.coalesce(_c(c).cast("string"), F.lit(""))) != "", _c(c).cast("string"))
             for c in names]
    return F.trim(F.concat_ws(" | ", *parts))


def normalize_region(x) -> Column:
    """Whitespace-clean; blank -> NULL; letters-only lower key folds known spellings."""
    base = norm_whitespace(_c(x).cast("string"))
    key = F.lower(norm_whitespace(F.regexp_replace(base, r"[^a-zA-Z ]+", " ")))
    mapping = F.create_map(*[F.lit(v) for kv in C.REGION_NORMALIZATION.items() for v in kv])
    return F.when(base.isNull() | (base == ""), F.lit(None).cast("string")) \
            .otherwise(F.coalesce(mapping[key], base))


def clean_value(x) -> Column:
    """NULL -> '', stringify, collapse whitespace."""
    return F.coalesce(norm_whitespace(_c(x).cast("string")), F.lit(""))


def oggetto_filled(oggetto, nome, settore, committente) -> Column:
    """Oggetto, or ``nome - settore - committente`` with blank parts skipped."""
    o = clean_value(oggetto)
    parts = [F.when(clean_value(p) != "", clean_value(p)) for p in (nome, settore, committente)]
    return F.when(o != "", o).otherwise(norm_whitespace(F.concat_ws(" - ", *parts)))


def first_filled(filled: str, parts: list[str]) -> Column:
    """S9 over columns that ``clean_value`` has been through: the first column, or the non-blank parts joined."""
    joined = F.concat_ws(" - ", *[F.when(F.col(p) != "", F.col(p)) for p in parts])
    return F.when(F.col(filled) != "", F.col(filled)).otherwise(joined)


def row_signature(cols: list[str]) -> Column:
    """Canonical JSON of the row with keys sorted (NULLs kept) and its SHA-256."""
    js = F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})
    return js


def embed_cache_key(text, model: str = C.EMBEDDING_MODEL, dim: int | None = C.EMBED_OUTPUT_DIM) -> Column:
    """``model:dim:sha256(text)``."""
    tag = str(dim) if dim and dim > 0 else "full"
    return F.concat_ws(":", F.lit(model), F.lit(tag), F.sha2(_c(text), 256))


def clip_text(x) -> dict[str, Column]:
    """Char-budget clip; returns clipped text, token estimate, clipped flag, near-limit flag."""
    limit = C.EMBED_MAX_TOKENS * C.AVG_CHARS_PER_TOKEN
    col = _c(x)
    n = F.length(col)
    clipped = n > limit
    tokens = F.when(clipped, F.lit(C.EMBED_MAX_TOKENS)).otherwise(F.ceil(n / F.lit(C.AVG_CHARS_PER_TOKEN)))
    return {
        "clipped_text": F.when(clipped, F.substring(col, 1, limit)).otherwise(col),
        "est_tokens": tokens.cast("bigint"),
        "was_clipped": clipped,
        "near_limit": (~clipped) & (tokens > F.lit(C.EMBED_WARN_MARGIN * C.EMBED_MAX_TOKENS)),
    }


def text_preview(x, n: int = C.TEXT_PREVIEW_CHARS) -> Column:
    """First n characters of the text ('' for NULL)."""
    return F.substring(F.coalesce(_c(x), F.lit("")), 1, n)


def hover_text(order_id, vendor, category, preview) -> Column:
    """``Order: … <br> Vendor: … <br> Tipo: … <br> preview``."""
    return F.concat_ws("<br>",
                       F.concat(F.lit("Order: "), _c(order_id).cast("string")),
                       F.concat(F.lit("Vendor: "), F.coalesce(_c(vendor), F.lit(""))),
                       F.concat(F.lit("Tipo: "), F.coalesce(_c(category), F.lit(""))),
                       _c(preview))


def parse_number(x) -> Column:
    """Lenient number; thousands commas removed on the second try."""
    s = _c(x).cast("string")
    return F.coalesce(s.try_cast("double"), F.regexp_replace(s, ",", "").try_cast("double"))


def looks_like_sql(x) -> Column:
    """('select' and 'from') or 'with ' or ';' in the lower-cased text."""
    low = F.lower(_c(x))
    return (low.contains("select") & low.contains("from")) | low.contains("with ") | low.contains(";")


def truncate_json(x, max_chars: int = C.TRUNCATE_JSON_CHARS) -> Column:
    """Cut a JSON string to max_chars with a trailing '...'."""
    col = _c(x)
    return F.when(F.length(col) <= max_chars, col) \
            .otherwise(F.concat(F.substring(col, 1, max_chars - 3), F.lit("...")))
