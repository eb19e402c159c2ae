"""Text expressions (Column -> Column), all JVM-side.

Python-compatible string handling: ``strip``/``split`` with Python's notion of
whitespace, answer extraction with Python ``re`` semantics re-expressed for
Java regex, keyword sets, and fixed-point formatting that rounds the exact
binary value half-to-even as Python's ``format`` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference's behaviour)
# The characters Python's str.isspace() accepts, in code point order.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
                 "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
FULLWIDTH_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"
# Number literal used by every numeric extractor.
NUMBER = r"[+-]?\d+(?:\.\d+)?"
# Answer patterns of the math scorer, in priority order.
ANSWER_PATTERNS = [
    r"(?:Final Answer|最终答案|答案)[：:]\s*(" + NUMBER + ")",
    r"#### (" + NUMBER + ")",
    r"答案是\s*(" + NUMBER + ")",
    r"答案为\s*(" + NUMBER + ")",
    r"=\s*(" + NUMBER + ")$",
]
REFERENCE_MARKER = r"#### (" + NUMBER + ")"
# Code blocks, in order: a python fence, a bare fence, and (around the entry
# point's name) a definition up to a blank line, the next class or def, or the end.
# WS stands for any character that Python's \s accepts.
CODE_FENCES = [r"(?s)```pythonWS*\n(.*?)\n```", r"(?s)```WS*\n(.*?)\n```"]
CODE_DEF = (r"(?s)(defWS+", r".*?)(?:\n\n|\nclass|\ndef|\z)")
# Optional reading of grouped thousands ("1,640"); the default keeps the
# reference's behaviour, where the comma ends the number.
NUMBER_THOUSANDS = r"[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[+-]?\d+(?:\.\d+)?"
# Keyword alternations of the incident scorer.
KEYWORD_PATTERNS = [
    r"连接池|connection pool",
    r"内存泄漏|memory leak",
    r"磁盘空间|disk space",
    r"网络延迟|network latency",
    r"数据库|database",
    r"超时|timeout",
    r"熔断|circuit breaker",
    r"负载均衡|load balancer",
    r"重启|restart",
    r"配置|config",
]
# ---------------------------------------------------------------------------

# Whitespace that Python's \s knows but Java's and RE2's \s do not (everything
# except tab, newline, form feed, carriage return and space): mapped to a
# space where text is split, and to a tab before a regex with \s runs, so that
# the literal space of a pattern matches no more than a space.
EXOTIC_WHITESPACE = "".join(ch for ch in PY_WHITESPACE if ch not in "\t\n\x0c\r ")

# The same set as a class of Java's regex.
_PY_SPACE_CLASS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Java flags: i = case-insensitive, m = multiline, d = only \n ends a line
# (Python's rule for $ under MULTILINE).
_PY_MULTILINE_IC = "(?imd)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ident(c) -> str | None:
    """Backticked SQL identifier for a column given by name, else None."""
    return "`" + c.replace("`", "``") + "`" if isinstance(c, str) else None


def _raw(s: str) -> str:
    """A Spark SQL raw string literal (no escape processing)."""
    if "'" in s:
        raise ValueError("quote in literal")
    return "r'" + s + "'"


def _sql_translate_prepared(e: str) -> str:
    src = EXOTIC_WHITESPACE + FULLWIDTH_DIGITS
    dst = "\t" * len(EXOTIC_WHITESPACE) + ASCII_DIGITS
    return f"translate({e}, '{src}', '{dst}')"


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace
    (a native trim with Python's whitespace set; no regex scan)."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def normalize_spaces(c) -> Column:
    """Map whitespace that only Python's ``\\s`` knows to a plain space."""
    return F.translate(_col(c), EXOTIC_WHITESPACE, " " * len(EXOTIC_WHITESPACE))


def ascii_digits(c) -> Column:
    """Full-width digits to ASCII, so ``\\d`` and the double cast accept them."""
    return F.translate(_col(c), FULLWIDTH_DIGITS, ASCII_DIGITS)


def normalize_text(c) -> Column:
    """``strip().lower()``."""
    return F.lower(py_strip(c))


def py_split(c) -> Column:
    """Python ``str.split()`` with no separator: runs of whitespace, no empties."""
    parts = F.split(normalize_spaces(c), r"[ \t\n\r\f\x0B]+")
    return F.array_remove(parts, "")


def _last(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(-1))


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def _prepared(c) -> Column:
    # one pass: exotic whitespace to tabs and full-width digits to ASCII
    return F.translate(_col(c), EXOTIC_WHITESPACE + FULLWIDTH_DIGITS,
                       "\t" * len(EXOTIC_WHITESPACE) + ASCII_DIGITS)


def _number_pattern(p: str, mode: str) -> str:
    if mode == "compat":
        return p
    if mode == "thousands":
        return p.replace("(" + NUMBER + ")", "(" + NUMBER_THOUSANDS + ")")
    raise ValueError(f"unknown number mode: {mode}")


def _to_double(s: Column) -> Column:
    return F.regexp_replace(s, ",", "").try_cast("double")


def extract_answer(c, mode: str = "compat") -> Column:
    """Numeric answer of a model response, or null.

    The first pattern with any match wins and its last match is taken;
    otherwise the last number anywhere.  ``mode="thousands"`` also reads
    grouped numbers such as ``1,640``.
    """
    pats = [_PY_MULTILINE_IC + _number_pattern(p, mode) for p in ANSWER_PATTERNS]
    pats.append(_number_pattern("(" + NUMBER + ")", mode))
    ident = _ident(c)
    if ident is not None:
        # one SQL expression: parsed once on the JVM instead of one call per node
        t = _sql_translate_prepared(ident)
        picks = ", ".join(f"try_element_at(regexp_extract_all({t}, {_raw(p)}, 1), -1)" for p in pats)
        return F.expr(f"try_cast(regexp_replace(coalesce({picks}), ',', '') AS DOUBLE)")
    t = _prepared(c)
    picks = [_last(F.regexp_extract_all(t, F.lit(p), 1)) for p in pats]
    return _to_double(F.coalesce(*picks))


def extract_reference(c, mode: str = "compat") -> Column:
    """First ``#### n`` (case-sensitive), else the last number, else null."""
    marker = _number_pattern(REFERENCE_MARKER, mode)
    number = _number_pattern("(" + NUMBER + ")", mode)
    ident = _ident(c)
    if ident is not None:
        t = _sql_translate_prepared(ident)
        return F.expr(f"try_cast(regexp_replace(coalesce(try_element_at(regexp_extract_all({t}, {_raw(marker)}, 1), 1), "
                      f"try_element_at(regexp_extract_all({t}, {_raw(number)}, 1), -1)), ',', '') AS DOUBLE)")
    t = _prepared(c)
    return _to_double(F.coalesce(
        _first(F.regexp_extract_all(t, F.lit(marker), 1)),
        _last(F.regexp_extract_all(t, F.lit(number), 1)),
    ))


def approx_equal(a, b, tol: float = 1e-6) -> Column:
    """X6."""
    return F.abs(_col(a) - _col(b)) < F.lit(tol)


def _quote(c: Column) -> Column:
    # \Q...\E quoting; an embedded \E closes and reopens the quote.
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def extract_code(text, entry_point) -> Column:
    """Code block holding ``def <entry_point>``, else the whole text.

    Patterns in order: a python fence, a bare fence, then ``def <entry>`` up
    to a blank line, the next class/def or the end.  For each pattern only the
    first match is considered, stripped, and kept if it defines the entry
    point.  The third pattern is written with a consuming terminator instead
    of a look-ahead; the first match is the same.
    """
    t = _col(text)
    ep = _col(entry_point)
    needle = F.concat(F.lit("def "), ep)
    spaced = lambda p: p.replace("WS", _PY_SPACE_CLASS)
    fenced_py, fenced = (py_strip(_first(F.regexp_extract_all(t, F.lit(spaced(p)), 1))) for p in CODE_FENCES)
    pattern3 = F.concat(F.lit(spaced(CODE_DEF[0])), _quote(ep), F.lit(CODE_DEF[1]))
    bare_def = py_strip(_first(F.regexp_extract_all(t, pattern3, 1)))
    return (F.when(fenced_py.contains(needle), fenced_py)
            .when(fenced.contains(needle), fenced)
            .when(bare_def.contains(needle), bare_def)
            .otherwise(t))


_REGEX_META = set("\\.^$*+?{}[]()")


def _literal_alternatives(pattern: str) -> list[str] | None:
    """The words of a pattern made only of literal alternatives, else None."""
    words = pattern.split("|")
    return None if any(ch in _REGEX_META for w in words for ch in w) or "" in words else words


def extract_keywords(c, patterns: list[str] | None = None) -> Column:
    """Distinct keyword strings found in the lowered text, sorted.

    A pattern that is a plain alternation of literal words, none a part of
    another across patterns' scripts, matches exactly the words that occur in
    the text, so it is evaluated as substring tests (no regex scan).  Any
    other pattern runs as ``regexp_extract_all``.
    """
    literal, regex = [], []
    for p in patterns or KEYWORD_PATTERNS:
        words = _literal_alternatives(p)
        if words is not None and _disjoint_scripts(words):
            literal.extend(words)
        else:
            regex.append(p)
    ident = _ident(c)
    if ident is not None and all("'" not in w for w in literal):
        # one SQL expression (see extract_answer); same plan as the Column path
        low = f"lower({ident})"
        parts = [f"CASE WHEN contains({low}, {_raw(w)}) THEN array({_raw(w)}) ELSE CAST(array() AS ARRAY<STRING>) END"
                 for w in literal]
        parts += [f"regexp_extract_all({low}, {_raw(p)}, 0)" for p in regex]
        body = f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]
        return F.expr(f"sort_array(array_distinct({body}))")
    low = F.lower(_col(c))
    # concat of conditional one-element arrays stays in whole-stage codegen
    # (a filter lambda would not), so lower() is computed once per row
    empty = F.array().cast("array<string>")
    parts = [F.when(F.contains(low, F.lit(w)), F.array(F.lit(w))).otherwise(empty) for w in literal]
    parts.extend(F.regexp_extract_all(low, F.lit(p), 0) for p in regex)
    return F.sort_array(F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0]))


def _disjoint_scripts(words: list[str]) -> bool:
    """Alternatives of one pattern cannot overlap when at most one of them is
    ASCII-only and the others share no character with it; then findall's
    non-overlapping scan reports every word that occurs."""
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if set(a) & set(b):
                return False
    return True


def keyword_overlap(a, b) -> Column:
    """Shared keywords of two keyword sets."""
    return F.array_intersect(_col(a), _col(b))


def any_token_contained(pred, ref) -> Column:
    """Some whitespace token of the lowered reference is in the lowered prediction."""
    p = F.lower(_col(pred))
    return F.coalesce(F.exists(py_split(F.lower(_col(ref))), lambda w: F.contains(p, w)),
                      F.lit(False))


def format_fixed1(c) -> Column:
    """Python ``f"{x:.1f}"``: round the exact binary value half to even.

    Java's formatter rounds the shortest decimal form half-up (1.15 -> 1.2);
    Python rounds the binary value (1.15 -> 1.1).  x*10 is split into an
    exactly-computed sum (x*8 + x*2, both exact) with Knuth's TwoSum error term,
    so the tie test is exact.
    """
    x = _col(c).cast("double")
    a = F.abs(x)
    p = a * F.lit(8.0)
    q = a * F.lit(2.0)
    s = p + q
    bb = s - p
    err = (p - (s - bb)) + (q - bb)
    r = F.floor(s)
    frac = s - r
    up = (frac > 0.5) | ((frac == 0.5) & ((err > 0) | ((err == 0) & (F.pmod(r, F.lit(2)) == 1))))
    n = (r + F.when(up, 1).otherwise(0)).cast("long")
    negative = (x < 0) | ((x == 0) & x.cast("string").startswith("-"))   # keeps -0.0's sign
    sign = F.when(negative, F.lit("-")).otherwise(F.lit(""))
    body = F.concat(sign, F.floor(n / 10).cast("string"),
                    F.lit("."), F.pmod(n, F.lit(10)).cast("string"))
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(body)


def format_percent1(c) -> Column:
    """Python ``f"{x:.1%}"``: x*100 in double, then ``.1f``, then ``%``."""
    return F.concat(format_fixed1(_col(c).cast("double") * F.lit(100.0)), F.lit("%"))


def humanize_seconds(c) -> Column:
    """``x.xs`` under a minute, ``x.xm`` under an hour, else ``x.xh``."""
    s = _col(c).cast("double")
    return (F.when(s < 60, F.concat(format_fixed1(s), F.lit("s")))
            .when(s < 3600, F.concat(format_fixed1(s / 60), F.lit("m")))
            .otherwise(F.concat(format_fixed1(s / 3600), F.lit("h"))))


def md5_key(seed, key) -> Column:
    """Seeded sort key: ``md5('<seed>:<key>')``; reproducible in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))


def hex_prefix_int(c, n_hex: int = 8) -> Column:
    """First ``n_hex`` hex digits of a hex string as a non-negative long."""
    return F.conv(F.substring(_col(c), 1, n_hex), 16, 10).cast("long")


def non_empty(c) -> Column:
    """the text is present and not empty."""
    return F.length(F.coalesce(_col(c), F.lit(""))) > 0
