import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import text as X

# (text, X1, X2) from the fixture table
NUMERIC = [
    ("#### 42", 42.0, 42.0),
    ("FINAL ANSWER: 7 then #### 9", 7.0, 9.0),
    ("#### 1\n#### 2", 2.0, 1.0),
    ("答案是 3.5 元", 3.5, 3.5),
    ("x = 5\ny = 7", 7.0, 7.0),
    ("x = 5\r\nfoo 9 bar", 9.0, 9.0),
    ("答案： ３", 3.0, 3.0),
    ("= 5 apples, 6 left", 6.0, 6.0),
    ("5-3", -3.0, -3.0),
    ("#### 1,640", 1.0, 1.0),
    ("none", None, None),
    ("", None, None),
    ("答案为 12", 12.0, 12.0),
    ("最终答案: -4.25", -4.25, -4.25),
    ("= 4  7", 7.0, 7.0),
]


def test_numeric_extraction(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in NUMERIC], "t string")
    got = df.select(X.extract_answer("t").alias("a"), X.extract_reference("t").alias("r")).collect()
    for (t, a, r), row in zip(NUMERIC, got):
        assert row["a"] == a, t
        assert row["r"] == r, t


def _py_answer(text):
    # the documented Python rule, written out for the property test
    for p in X.ANSWER_PATTERNS:
        m = re.findall(p, text, re.MULTILINE | re.IGNORECASE)
        if m:
            return float(m[-1])
    m = re.findall(r"([+-]?\d+(?:\.\d+)?)", text)
    return float(m[-1]) if m else None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["#### ", "= ", "答案是", "Final Answer: ", "x", " ", "\n", "12", "3.5",
                                 "-7", "答案：", "abc", "\r"]), max_size=8))
def test_numeric_extraction_matches_python(spark, parts):
    t = "".join(parts)
    got = spark.createDataFrame([(t,)], "t string").select(X.extract_answer("t")).first()[0]
    assert got == _py_answer(t)


def test_strip_and_normalize(spark):
    df = spark.createDataFrame([(" \n\t Ab C 　 ",)], "t string")
    r = df.select(X.py_strip("t"), X.normalize_text("t")).first()
    assert r[0] == " \n\t Ab C 　 ".strip()
    assert r[1] == "ab c"


KEYWORDS = [
    ("Database timeout; check configuration", "数据库连接池配置过小，在高并发场景下无法满足需求",
     ["config", "database", "timeout"], False, False),
    ("数据库超时", "数据库连接池配置过小，在高并发场景下无法满足需求", ["数据库", "超时"], True, False),
    ("restart the pod", "restart it", ["restart"], True, True),
    ("x", "", [], False, False),
]


def test_keywords_and_substring(spark):
    df = spark.createDataFrame([(p, r) for p, r, *_ in KEYWORDS], "p string, r string")
    got = df.select(X.extract_keywords("p").alias("pk"),
                    (F.size(X.keyword_overlap(X.extract_keywords("p"), X.extract_keywords("r"))) > 0).alias("shared"),
                    X.any_token_contained("p", "r").alias("sub")).collect()
    for (p, r, pk, shared, sub), row in zip(KEYWORDS, got):
        assert sorted(row["pk"]) == sorted(pk)
        assert row["shared"] is shared
        assert row["sub"] is sub


CODE = [
    ("Here:\n```python\ndef foo(x):\n    return x\n```\n", "foo", "def foo(x):\n    return x"),
    ("```\ndef bar():\n  pass\n```", "bar", "def bar():\n  pass"),
    ("text def baz(y):\n  return 2\n\nmore", "baz", "def baz(y):\n  return 2"),
    ("nothing", "qux", "nothing"),
    ("```python\nprint(1)\n```\ndef qux():\n  1", "qux", "def qux():\n  1"),
    ("def a.b():\n  1\ndef c", "a.b", "def a.b():\n  1"),
]


def test_extract_code(spark):
    df = spark.createDataFrame([(t, e) for t, e, _ in CODE], "t string, e string")
    got = [r[0] for r in df.select(X.extract_code("t", "e")).collect()]
    assert got == [c for _, _, c in CODE]


@settings(max_examples=80, deadline=None)
@given(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False))
def test_format_fixed1_matches_python(spark, v):
    got = spark.createDataFrame([(v,)], "v double").select(X.format_fixed1("v")).first()[0]
    assert got == f"{v:.1f}"


@pytest.mark.parametrize("v", [1.15, 6.55, 0.125, 0.05, 2.5, 3.5, 0.25, 59.99, 1234.56, 0.0])
def test_format_ties(spark, v):
    got = spark.createDataFrame([(v,)], "v double").select(
        X.format_fixed1("v"), X.format_percent1(F.col("v") / 100), X.humanize_seconds("v")).first()
    assert got[0] == f"{v:.1f}"
    assert got[1] == f"{v / 100:.1%}"


def test_humanize(spark):
    vals = [5.0, 59.94, 61.0, 3599.0, 3600.0, 7322.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v double")
           .select(X.humanize_seconds("v")).collect()]

    def py(s):
        return f"{s:.1f}s" if s < 60 else (f"{s / 60:.1f}m" if s < 3600 else f"{s / 3600:.1f}h")
    assert got == [py(v) for v in vals]
    assert not math.isnan(vals[0])


def test_thousands_mode(spark):
    df = spark.createDataFrame([("#### 1,640",), ("答案是 12,345.5",), ("x = 7",)], "t string")
    got = [tuple(r) for r in df.select(X.extract_answer("t", "thousands"), X.extract_reference("t", "thousands"),
                                       X.extract_answer("t")).collect()]
    assert got == [(1640.0, 1640.0, 1.0), (12345.5, 12345.5, 12.0), (7.0, 7.0, 7.0)]
    with pytest.raises(ValueError):
        X.extract_answer("t", "roman")


def test_keyword_literal_path_equals_regex_path(spark):
    texts = ["Database connection pool; restart then timeout", "数据库连接池配置过小", "重启 熔断 load balancer",
             "CONFIGURATION memory leak disk space network latency", "", "nothing here", "超时超时 circuit breaker"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    fast = [r[0] for r in df.select(X.extract_keywords("t")).collect()]
    # force the regex path: a trailing empty group is a regex metacharacter
    slow_patterns = [p + "|(?!)" for p in X.KEYWORD_PATTERNS]
    slow = [[w for w in r[0] if w] for r in df.select(X.extract_keywords("t", slow_patterns)).collect()]
    assert fast == slow


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(X.PY_WHITESPACE) + ["a", "é", "数", "\u200b", "x"]), max_size=12))
def test_strip_matches_python(spark, s):
    got = spark.createDataFrame([(s,)], "t string").select(X.py_strip("t"), X.py_split("t")).first()
    assert got[0] == s.strip() and got[1] == s.split()


def test_sql_and_column_paths_agree(spark):
    texts = [t for t, _, _ in NUMERIC] + ["#### 1,640 and 2,000", "Database timeout restart 数据库"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for mode in ("compat", "thousands"):
        a = df.select(X.extract_answer("t", mode), X.extract_reference("t", mode)).collect()
        b = df.select(X.extract_answer(F.col("t"), mode), X.extract_reference(F.col("t"), mode)).collect()
        assert a == b
    assert df.select(X.extract_keywords("t")).collect() == df.select(X.extract_keywords(F.col("t"))).collect()


@pytest.mark.parametrize("t, a, r", [("#### 5 then 9 x", 9.0, 9.0), ("####　5 then 9 x", 9.0, 9.0), ("#### 5 then 9 x", 5.0, 5.0),
                                     ("答案：　7 of 8 x", 7.0, 8.0), ("Final Answer: 3 of 4 x", 4.0, 4.0), ("= 4", 4.0, 4.0)])
def test_exotic_whitespace_is_space_only_where_python_says_so(spark, t, a, r):
    assert _py_answer(t) == a
    for df in (spark.createDataFrame([(t,)], "t string"),):
        got = df.select(X.extract_answer("t").alias("a"), X.extract_reference("t").alias("r"), X.extract_answer(F.col("t")).alias("b")).first()
        assert (got["a"], got["r"], got["b"]) == (a, r, a)


@pytest.mark.parametrize("fence", ["```python \n", "```　\x0b\n", "```python\n"])
def test_fences_take_any_python_whitespace(spark, fence):
    t = f"see\n{fence}def f(x):\n    return x\n```\nend"
    r = spark.createDataFrame([(t, "f")], "t string, e string").select(X.extract_code("t", "e")).first()[0]
    assert r == "def f(x):\n    return x"
    t = "text def f(x): 1\n\nend"
    assert spark.createDataFrame([(t, "f")], "t string, e string").select(X.extract_code("t", "e")).first()[0] == t  # no "def f" in the block
