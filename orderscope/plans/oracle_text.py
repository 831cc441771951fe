"""DuckDB SQL expression builders mirroring the text/vector column functions.

Used only to write oracle SQL. RE2 (DuckDB) has ASCII ``\\s``/``\\w``; the
Unicode classes are spelled out so both engines see the same characters.
"""

from __future__ import annotations

from .. import config as C

# Unicode White_Space and the separators 1C to 1F
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ws(expr: str) -> str:
    return f"trim(regexp_replace({expr}, {q(WS + '+')}, ' ', 'g'))"


def _strip(expr: str, patterns) -> str:
    for rx in patterns:
        expr = f"regexp_replace({expr}, {q(rx)}, ' ', 'gi')"
    return expr


def _codes(expr: str) -> str:
    expr = _strip(expr, C.ARTIFACT_PATTERNS)
    expr = _strip(expr, C.INTERNAL_CODE_PATTERNS)
    return _strip(expr, [C.LICENSE_PLATE_PATTERN])


def normalize_text(expr: str) -> str:
    s = _strip(_codes(f"CAST({expr} AS VARCHAR)"), C.BOILERPLATE_PATTERNS)
    return f"COALESCE({ws(f'strip_accents(lower({s}))')}, '')"


def clean_text(expr: str) -> str:
    return f"COALESCE({ws(_codes(f'CAST({expr} AS VARCHAR)'))}, '')"


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {q(WORD)})"


def clean_value(expr: str) -> str:
    return f"COALESCE({ws(f'CAST({expr} AS VARCHAR)')}, '')"


def combine_text(cols: list[str]) -> str:
    parts = ", ".join(f"CASE WHEN trim(COALESCE(CAST({c} AS VARCHAR), '')) <> '' THEN CAST({c} AS VARCHAR) END"
                      for c in cols)
    return f"trim(concat_ws(' | ', {parts}))"


def normalize_region(expr: str) -> str:
    base = ws(f"CAST({expr} AS VARCHAR)")
    key = f"lower({ws(f'regexp_replace({base}, {q(r"[^a-zA-Z ]+")}, {q(" ")}, {q("g")})')})"
    cases = " ".join(f"WHEN {key} = {q(k)} THEN {q(v)}" for k, v in C.REGION_NORMALIZATION.items())
    return f"CASE WHEN {base} IS NULL OR {base} = '' THEN NULL {cases} ELSE {base} END"


def oggetto_filled(o: str, nome: str, settore: str, committente: str) -> str:
    parts = ", ".join(f"CASE WHEN {clean_value(p)} <> '' THEN {clean_value(p)} END" for p in (nome, settore, committente))
    return f"CASE WHEN {clean_value(o)} <> '' THEN {clean_value(o)} ELSE {ws(f'concat_ws({q(" - ")}, {parts})')} END"


def dot(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def norm(a: str) -> str:
    return f"sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])))"


def cosine(a: str, b: str) -> str:
    return (f"CASE WHEN {norm(a)} * {norm(b)} = 0 THEN 0.0 "
            f"ELSE {dot(a, b)} / ({norm(a)} * {norm(b)}) END")
