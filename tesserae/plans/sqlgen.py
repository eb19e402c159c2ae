"""DuckDB SQL fragments for the oracle side (RE2 regex, list lambdas).

These mirror the Column expressions in ``tesserae.functions`` so the oracle
recomputes every derived value independently of Spark.
"""

from __future__ import annotations

from tesserae.functions.text import (ANSWER_PATTERNS, ASCII_DIGITS, FULLWIDTH_DIGITS,
                                     KEYWORD_PATTERNS, NUMBER, NUMBER_THOUSANDS, REFERENCE_MARKER)

_PY_SPACE = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
             r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
_EXOTIC = (r"\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
           r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    cls = "[" + _PY_SPACE + "]+"
    return f"regexp_replace({e}, {lit('^' + cls + '|' + cls + '$')}, '', 'g')"


def norm(e: str) -> str:
    return f"lower({strip(e)})"


def spaces(e: str) -> str:
    return f"regexp_replace({e}, {lit('[' + _EXOTIC + ']')}, ' ', 'g')"


def prepared(e: str) -> str:
    tabs = f"regexp_replace({e}, {lit('[' + _EXOTIC + ']')}, chr(9), 'g')"
    return f"translate({tabs}, {lit(FULLWIDTH_DIGITS)}, {lit(ASCII_DIGITS)})"


def _num(p: str, mode: str) -> str:
    return p if mode == "compat" else p.replace("(" + NUMBER + ")", "(" + NUMBER_THOUSANDS + ")")


def extract_answer(e: str, mode: str = "compat") -> str:
    t = prepared(e)
    picks = [f"regexp_extract_all({t}, {lit('(?im)' + _num(p, mode))}, 1)[-1]" for p in ANSWER_PATTERNS]
    picks.append(f"regexp_extract_all({t}, {lit(_num('(' + NUMBER + ')', mode))}, 1)[-1]")
    return f"TRY_CAST(replace(coalesce({', '.join(picks)}), ',', '') AS DOUBLE)"


def extract_reference(e: str, mode: str = "compat") -> str:
    t = prepared(e)
    return (f"TRY_CAST(replace(coalesce(regexp_extract_all({t}, {lit(_num(REFERENCE_MARKER, mode))}, 1)[1], "
            f"regexp_extract_all({t}, {lit(_num('(' + NUMBER + ')', mode))}, 1)[-1]), ',', '') AS DOUBLE)")


def keywords(e: str) -> str:
    parts = ", ".join(f"regexp_extract_all(lower({e}), {lit(p)}, 0)" for p in KEYWORD_PATTERNS)
    return f"list_sort(list_distinct(flatten([{parts}])))"


def split_ws(e: str) -> str:
    return (f"list_filter(string_split_regex({spaces(e)}, '[ \\t\\n\\r\\f\\x0B]+'), "
            f"lambda w: w <> '')")


def any_token_contained(pred: str, ref: str) -> str:
    return (f"coalesce(len(list_filter({split_ws(f'lower({ref})')}, "
            f"lambda w: contains(lower({pred}), w))) > 0, false)")


def md5_key(seed: int, e: str) -> str:
    return f"md5('{seed}:' || CAST({e} AS VARCHAR))"


def hex_prefix_int(e: str, n: int = 8) -> str:
    return f"CAST(('0x' || substr({e}, 1, {n})) AS BIGINT)"


def quote_regex(e: str) -> str:
    return f"('\\Q' || replace({e}, '\\E', '\\E\\\\E\\Q') || '\\E')"


def tokens(e: str, vocab: int = 32000) -> str:
    words = (f"list_filter(string_split_regex({spaces(e)}, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')")
    return (f"list_transform({words}, lambda w: CAST(1 + ({hex_prefix_int('md5(w)')} % {vocab - 1}) AS INTEGER))")


def int_list_md5(e: str) -> str:
    return f"md5(array_to_string({e}, ','))"
