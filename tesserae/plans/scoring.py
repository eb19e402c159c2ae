"""Scoring queries over the driver tables.

The driver has no prompt/answer corpus, so predictions and references are
derived deterministically from table columns, identically in Spark and in the
oracle SQL.  Derivations are value functions of each row; every query runs
over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.operators import scoring as S
from tesserae.plans import sqlgen as Q
from tesserae.plans.registry import query, table

FW = "０１２３４５６７８９"


# ------------------------------------------------------------- math answers
def math_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> (domain, prediction, reference): each answer pattern, no
    number, a thousands comma and full-width digits, by ``o_orderkey % 7``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey").cast("string")
    v = F.pmod(F.col("o_orderkey"), F.lit(7))
    pred = (F.when(v == 0, F.concat(F.lit("Final Answer: "), k))
            .when(v == 1, F.concat(F.lit("Work shown above.\n#### "), k))
            .when(v == 2, F.concat(F.lit("答案是 "), (F.col("o_orderkey") + 1).cast("string")))
            .when(v == 3, F.concat(F.lit("x = 5\ny = "), k))
            .when(v == 4, F.lit("I could not solve it."))
            .when(v == 5, F.concat(F.lit("#### 1,"), k))
            .otherwise(F.concat(F.lit("答案： "), F.translate(k, "0123456789", FW))))
    ref = (F.when(F.pmod(F.col("o_custkey"), F.lit(5)) == 0, F.lit("see the worked solution"))
           .otherwise(F.concat(F.lit("Step 1 adds 2 and 3.\n#### "), k)))
    return o.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("domain"),
                    pred.alias("prediction"), ref.alias("reference"))


MATH_CTE = f"""
math AS (
  SELECT o_orderkey AS item_id, o_orderpriority AS domain,
    CASE o_orderkey % 7
      WHEN 0 THEN 'Final Answer: ' || o_orderkey
      WHEN 1 THEN 'Work shown above.' || chr(10) || '#### ' || o_orderkey
      WHEN 2 THEN '答案是 ' || (o_orderkey + 1)
      WHEN 3 THEN 'x = 5' || chr(10) || 'y = ' || o_orderkey
      WHEN 4 THEN 'I could not solve it.'
      WHEN 5 THEN '#### 1,' || o_orderkey
      ELSE '答案： ' || translate(CAST(o_orderkey AS VARCHAR), '0123456789', '{FW}')
    END AS prediction,
    CASE WHEN o_custkey % 5 = 0 THEN 'see the worked solution'
         ELSE 'Step 1 adds 2 and 3.' || chr(10) || '#### ' || o_orderkey END AS reference
  FROM orders
),
verdicts AS (
  SELECT *, pred_answer IS NULL OR ref_answer IS NOT NULL AS counted,
         coalesce(abs(pred_answer - ref_answer) < 1e-6, false) AS correct
  FROM (SELECT *, {Q.extract_answer('prediction')} AS pred_answer,
               {Q.extract_reference('reference')} AS ref_answer FROM math)
)"""


def numeric_accuracy_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = S.numeric_verdicts(math_predictions(spark, sf_dir), "prediction", "reference")
    out = S.with_overall(scored, "domain", S.numeric_accuracy_aggs())
    return out.select("domain", "total_samples", "correct_samples", "no_answer_samples",
                      F.round("exact_match", 6).alias("exact_match"),
                      F.round("no_answer_rate", 6).alias("no_answer_rate"))


@query("numeric_accuracy", "X1 X2 X6 A4 A9 F6", sql=f"""
WITH {MATH_CTE}
SELECT coalesce(domain, 'ALL') AS domain,
  CAST(count_if(counted) AS BIGINT) AS total_samples,
  CAST(count_if(counted AND correct) AS BIGINT) AS correct_samples,
  CAST(count_if(pred_answer IS NULL) AS BIGINT) AS no_answer_samples,
  round(coalesce(count_if(counted AND correct) / nullif(count_if(counted), 0), 0.0), 6) AS exact_match,
  round(coalesce(count_if(pred_answer IS NULL) / nullif(count(*), 0), 0.0), 6) AS no_answer_rate
FROM verdicts GROUP BY ROLLUP (domain)
""")
def numeric_accuracy(spark, sf_dir):
    return numeric_accuracy_df(spark, sf_dir)


@query("answer_extraction", "X1 X2 X6 (per row)", sql=f"""
WITH {MATH_CTE}
SELECT item_id, pred_answer, ref_answer, correct, counted FROM verdicts
""")
def answer_extraction(spark, sf_dir):
    scored = S.numeric_verdicts(math_predictions(spark, sf_dir), "prediction", "reference")
    return scored.select("item_id", "pred_answer", "ref_answer", "correct", "counted")


# ------------------------------------------------------- exact / contains
def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents paired with benchmark by id (zip by id, not position);
    unpaired predictions keep a null reference."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"),
                                                 F.col("text").alias("reference"))
    j = d.join(b, "doc_id", "left")
    v = F.pmod(F.col("doc_id"), F.lit(3))
    pred = (F.when(F.col("reference").isNull(), F.col("text"))
            .when(v == 0, F.concat(F.lit(" \t"), F.col("reference"), F.lit("\n ")))
            .when(v == 1, F.concat(F.lit("Answer: "), F.col("reference"), F.lit(" (end)")))
            .otherwise(F.col("text")))
    return j.select("doc_id", "lang", pred.alias("prediction"), "reference")


PAIRS_CTE = """
pairs AS (
  SELECT d.doc_id, d.lang, b.text AS reference,
    CASE WHEN b.text IS NULL THEN d.text
         WHEN d.doc_id % 3 = 0 THEN ' ' || chr(9) || b.text || chr(10) || ' '
         WHEN d.doc_id % 3 = 1 THEN 'Answer: ' || b.text || ' (end)'
         ELSE d.text END AS prediction
  FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id
)"""


@query("exact_and_contains", "P15 A2 A3 J1", sql=f"""
WITH {PAIRS_CTE}
SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n_predictions,
  round(coalesce(count_if(coalesce({Q.norm('prediction')} = {Q.norm('reference')}, false))
        / nullif(count(*), 0), 0.0), 6) AS exact_match,
  round(coalesce(count_if(coalesce(contains({Q.norm('prediction')}, {Q.norm('reference')}), false))
        / nullif(count(*), 0), 0.0), 6) AS contains_match
FROM pairs GROUP BY ROLLUP (lang)
""")
def exact_and_contains(spark, sf_dir):
    pairs = text_pairs(spark, sf_dir)
    aggs = [F.count(F.lit(1)).alias("n_predictions"),
            *S.exact_match_aggs("prediction", "reference"),
            *S.contains_match_aggs("prediction", "reference")]
    out = S.with_overall(pairs, "lang", aggs)
    return out.select("lang", "n_predictions", F.round("exact_match", 6).alias("exact_match"),
                      F.round("contains_match", 6).alias("contains_match"))


# ------------------------------------------------------------- keywords
def keyword_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    u = F.col("user_id").cast("string")
    pred = (F.when(F.col("event_type") == "error",
                   F.concat(F.lit("Database connection pool exhausted for user "), u, F.lit("; restart needed")))
            .when(F.col("event_type") == "click", F.lit("网络延迟 caused a timeout at the load balancer"))
            .when(F.col("event_type") == "view", F.concat(F.lit("Disk space on /var/log is low, host "), u))
            .when(F.col("event_type") == "purchase", F.lit("内存泄漏; please configure the heap"))
            .otherwise(F.col("props")))
    r = F.pmod(F.col("user_id"), F.lit(4))
    ref = (F.when(r == 0, F.lit("数据库连接池配置过小，在高并发场景下无法满足需求"))
           .when(r == 1, F.lit("Memory leak in the order service; restart the pod"))
           .when(r == 2, F.lit("disk space exhausted by logs"))
           .otherwise(F.lit("network latency between nodes; check CONFIG")))
    return e.select("event_id", "event_type", pred.alias("prediction"), ref.alias("reference"))


KEYWORD_CTE = """
kw AS (
  SELECT event_id, event_type,
    CASE event_type
      WHEN 'error' THEN 'Database connection pool exhausted for user ' || user_id || '; restart needed'
      WHEN 'click' THEN '网络延迟 caused a timeout at the load balancer'
      WHEN 'view' THEN 'Disk space on /var/log is low, host ' || user_id
      WHEN 'purchase' THEN '内存泄漏; please configure the heap'
      ELSE props END AS prediction,
    CASE user_id % 4
      WHEN 0 THEN '数据库连接池配置过小，在高并发场景下无法满足需求'
      WHEN 1 THEN 'Memory leak in the order service; restart the pod'
      WHEN 2 THEN 'disk space exhausted by logs'
      ELSE 'network latency between nodes; check CONFIG' END AS reference
  FROM events
)"""


@query("keyword_extract", "X4 X5 J4 (per row)", sql=f"""
WITH {KEYWORD_CTE}
SELECT event_id, array_to_string(pk, '|') AS pred_keywords, array_to_string(rk, '|') AS ref_keywords,
  len(list_intersect(pk, rk)) > 0 AS keyword_match,
  {Q.any_token_contained('prediction', 'reference')} AS substring_match
FROM (SELECT *, {Q.keywords('prediction')} AS pk, {Q.keywords('reference')} AS rk FROM kw)
""")
def keyword_extract(spark, sf_dir):
    v = S.keyword_verdicts(keyword_texts(spark, sf_dir), "prediction", "reference")
    return v.select("event_id", F.array_join("pred_keywords", "|").alias("pred_keywords"),
                    F.array_join("ref_keywords", "|").alias("ref_keywords"),
                    "keyword_match", "substring_match")


@query("keyword_match", "A7 A8 X4 X5 J4", sql=f"""
WITH {KEYWORD_CTE}
SELECT event_type, count(*) AS total_samples,
  round(coalesce(count_if(len(list_intersect({Q.keywords('prediction')}, {Q.keywords('reference')})) > 0)
        / nullif(count(*), 0), 0.0), 6) AS keyword_match_rate,
  round(coalesce(count_if({Q.any_token_contained('prediction', 'reference')}) / nullif(count(*), 0), 0.0), 6)
    AS substring_match_rate
FROM kw GROUP BY event_type
""")
def keyword_match(spark, sf_dir):
    v = S.keyword_verdicts(keyword_texts(spark, sf_dir), "prediction", "reference")
    out = v.groupBy("event_type").agg(*S.keyword_aggs())
    return out.select("event_type", "total_samples",
                      F.round("keyword_match_rate", 6).alias("keyword_match_rate"),
                      F.round("substring_match_rate", 6).alias("substring_match_rate"))


# ----------------------------------------------------------------- code
def code_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type")
    ep = F.regexp_replace(F.col("p_name"), " ", "_")
    size = F.col("p_size").cast("string")
    v = F.pmod(F.col("p_partkey"), F.lit(5))
    resp = (F.when(v == 0, F.concat(F.lit("Here you go:\n```python\ndef "), ep,
                                    F.lit("(x):\n    return x * "), size, F.lit("\n```\nDone.")))
            .when(v == 1, F.concat(F.lit("```\ndef "), ep, F.lit("(x):\n    return "), size, F.lit("\n```")))
            .when(v == 2, F.concat(F.lit("```python\nimport os\n```\nThen:\ndef "), ep,
                                   F.lit("(a, b):\n    return a + b\n\nprint("), ep, F.lit("(1, 2))")))
            .when(v == 3, F.concat(F.lit("No code, sorry: "), F.col("p_type")))
            .otherwise(F.concat(F.lit("def helper():\n    pass\ndef "), ep, F.lit("(y):\n    return y\nclass K: pass"))))
    return p.select("p_partkey", ep.alias("entry_point"), resp.alias("response"))


CODE_CTE = """
code AS (
  SELECT p_partkey, replace(p_name, ' ', '_') AS entry_point,
    CASE p_partkey % 5
      WHEN 0 THEN 'Here you go:' || chr(10) || '```python' || chr(10) || 'def ' || replace(p_name, ' ', '_')
                  || '(x):' || chr(10) || '    return x * ' || p_size || chr(10) || '```' || chr(10) || 'Done.'
      WHEN 1 THEN '```' || chr(10) || 'def ' || replace(p_name, ' ', '_') || '(x):' || chr(10)
                  || '    return ' || p_size || chr(10) || '```'
      WHEN 2 THEN '```python' || chr(10) || 'import os' || chr(10) || '```' || chr(10) || 'Then:' || chr(10)
                  || 'def ' || replace(p_name, ' ', '_') || '(a, b):' || chr(10) || '    return a + b'
                  || chr(10) || chr(10) || 'print(' || replace(p_name, ' ', '_') || '(1, 2))'
      WHEN 3 THEN 'No code, sorry: ' || p_type
      ELSE 'def helper():' || chr(10) || '    pass' || chr(10) || 'def ' || replace(p_name, ' ', '_')
           || '(y):' || chr(10) || '    return y' || chr(10) || 'class K: pass'
    END AS response
  FROM part
)"""


def _code_ext_cte() -> str:
    ws = "[" + Q._PY_SPACE + "]"
    fence_py = Q.strip(f"regexp_extract_all(response, '(?s)```python{ws}*\\n(.*?)\\n```', 1)[1]")
    fence = Q.strip(f"regexp_extract_all(response, '(?s)```{ws}*\\n(.*?)\\n```', 1)[1]")
    pat3 = (f"'(?s)(def{ws}+' || " + Q.quote_regex("entry_point") +
            r" || '.*?)(?:\n\n|\nclass|\ndef|\z)'")
    bare = Q.strip(f"regexp_extract_all(response, {pat3}, 1)[1]")
    needle = "'def ' || entry_point"
    return f"""
code_x AS (
  SELECT p_partkey, entry_point, response,
    CASE WHEN contains({fence_py}, {needle}) THEN {fence_py}
         WHEN contains({fence}, {needle}) THEN {fence}
         WHEN contains({bare}, {needle}) THEN {bare}
         ELSE response END AS extracted_code
  FROM code
)"""


def _code_sql() -> str:
    return f"""
WITH {CODE_CTE}, {_code_ext_cte()}
SELECT p_partkey, extracted_code, contains(extracted_code, 'def ' || entry_point) AS has_entry_point,
  extracted_code <> response AS was_extracted
FROM code_x
"""


@query("code_fence_extract", "X3", sql=_code_sql())
def code_fence_extract(spark, sf_dir):
    c = code_responses(spark, sf_dir)
    code = X.extract_code("response", "entry_point")
    return c.select("p_partkey", code.alias("extracted_code"),
                    F.contains(code, F.concat(F.lit("def "), F.col("entry_point"))).alias("has_entry_point"),
                    (code != F.col("response")).alias("was_extracted"))


# ---------------------------------------------------------------- pass@k
def code_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount")
    passed = (F.col("l_returnflag") == "N") & (F.col("l_discount") < 0.06)
    return li.select(F.col("l_orderkey").alias("task_id"), "l_linenumber", passed.alias("passed"))


ATTEMPTS_CTE = """
attempts AS (
  SELECT l_orderkey AS task_id, l_linenumber, (l_returnflag = 'N' AND l_discount < 0.06) AS passed
  FROM lineitem
)"""


@query("pass_at_1", "A5", sql=f"""
WITH {ATTEMPTS_CTE}
SELECT l_linenumber, count(*) AS total_samples, CAST(count_if(passed) AS BIGINT) AS passed_samples,
  round(count_if(passed) / count(*), 6) AS pass_at_1
FROM attempts GROUP BY l_linenumber
""")
def pass_at_1(spark, sf_dir):
    out = code_attempts(spark, sf_dir).groupBy("l_linenumber").agg(*S.pass_at_1_aggs("passed"))
    return out.select("l_linenumber", "total_samples", "passed_samples",
                      F.round("pass_at_1", 6).alias("pass_at_1"))


@query("pass_at_k", "A6", sql=f"""
WITH {ATTEMPTS_CTE},
per_task AS (SELECT task_id, count(*) AS n, CAST(count_if(passed) AS BIGINT) AS c FROM attempts GROUP BY task_id),
ks AS (SELECT unnest([1, 5, 10]) AS k)
SELECT k, round(avg(CASE WHEN n < k THEN NULL WHEN c <= 0 THEN 0.0 WHEN n - c < k THEN 1.0
  ELSE 1.0 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / i), lambda a, b: a * b)
  END), 6) AS pass_at_k, CAST(count_if(n >= k) AS BIGINT) AS n_tasks, CAST(count_if(n < k) AS BIGINT) AS n_left_out
FROM per_task, ks GROUP BY k
""")
def pass_at_k(spark, sf_dir):
    out = S.pass_at_k(code_attempts(spark, sf_dir), "task_id", "passed", ks=(1, 5, 10))
    return out.select(F.col("k").cast("int").alias("k"), F.round("pass_at_k", 6).alias("pass_at_k"), "n_tasks", "n_left_out")


# ---------------------------------------------------------- whole evaluation
def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    math = math_predictions(spark, sf_dir).select(
        F.lit("math").alias("domain"), "prediction", "reference", F.lit(None).cast("boolean").alias("passed"))
    code = code_responses(spark, sf_dir).select(
        F.lit("code").alias("domain"), F.col("response").alias("prediction"),
        F.lit(None).cast("string").alias("reference"),
        F.contains(X.extract_code("response", "entry_point"), F.lit("return")).alias("passed"))
    ops = keyword_texts(spark, sf_dir).select(
        F.lit("aiops").alias("domain"), "prediction", "reference", F.lit(None).cast("boolean").alias("passed"))
    web = table(spark, sf_dir, "pages").select(
        F.lit("web").alias("domain"), F.col("url").alias("prediction"), F.lit(None).cast("string").alias("reference"),
        F.lit(None).cast("boolean").alias("passed"))
    return math.unionByName(code).unionByName(ops).unionByName(web)


def _eval_sql() -> str:
    return f"""
WITH {MATH_CTE}, {CODE_CTE}, {KEYWORD_CTE}, {_code_ext_cte()},
rows_ AS (
  SELECT 'math' AS domain, pred_answer, ref_answer, counted, correct, NULL::BOOLEAN AS passed,
         NULL::BOOLEAN AS keyword_match, NULL::BOOLEAN AS substring_match FROM verdicts
  UNION ALL
  SELECT 'code', NULL, NULL, NULL, NULL, contains(extracted_code, 'return'), NULL, NULL FROM code_x
  UNION ALL
  SELECT 'aiops', NULL, NULL, NULL, NULL, NULL,
         len(list_intersect({Q.keywords('prediction')}, {Q.keywords('reference')})) > 0,
         {Q.any_token_contained('prediction', 'reference')} FROM kw
  UNION ALL
  SELECT 'web', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pages
),
agg AS (
  SELECT domain, count(*) AS n_rows,
    CASE WHEN domain = 'math' THEN CAST(count_if(counted) AS BIGINT)
         WHEN domain IN ('code', 'aiops') THEN count(*) END AS total_samples,
    CASE WHEN domain = 'math' THEN coalesce(count_if(counted AND correct) / nullif(count_if(counted), 0), 0.0) END AS exact_match,
    CASE WHEN domain = 'math' THEN count_if(pred_answer IS NULL) / count(*) END AS no_answer_rate,
    CASE WHEN domain = 'code' THEN count_if(passed) / count(*) END AS pass_at_1,
    CASE WHEN domain = 'aiops' THEN count_if(keyword_match) / count(*) END AS keyword_match_rate,
    CASE WHEN domain = 'aiops' THEN count_if(substring_match) / count(*) END AS substring_match_rate
  FROM rows_ GROUP BY domain
)
SELECT domain, n_rows, total_samples, round(exact_match, 6) AS exact_match,
  round(no_answer_rate, 6) AS no_answer_rate, round(pass_at_1, 6) AS pass_at_1,
  round(keyword_match_rate, 6) AS keyword_match_rate, round(substring_match_rate, 6) AS substring_match_rate,
  CASE domain WHEN 'math' THEN 'exact_match' WHEN 'code' THEN 'pass@1' WHEN 'aiops' THEN 'keyword_match_rate' END
    AS headline_metric,
  printf('%.1f%%', CASE domain WHEN 'math' THEN exact_match WHEN 'code' THEN pass_at_1
                   WHEN 'aiops' THEN keyword_match_rate END * 100) AS headline_text,
  domain IN ('math', 'code', 'aiops') AS scored
FROM agg
"""


@query("domain_summary", "G9 J6 A10 U2 A4 A5 A7 A8", sql=_eval_sql())
def domain_summary(spark, sf_dir):
    rep = S.evaluate(eval_rows(spark, sf_dir), "domain", "prediction", "reference", "passed")
    r6 = [F.round(c, 6).alias(c) for c in ("exact_match", "no_answer_rate", "pass_at_1",
                                            "keyword_match_rate", "substring_match_rate")]
    return rep.select("domain", "n_rows", "total_samples", *r6, "headline_metric",
                      F.when(F.col("headline_value").isNotNull(), F.col("headline_text")).alias("headline_text"),
                      "scored")


# ------------------------------------------------------------ humanize
@query("humanize_durations", "P16", sql="""
SELECT event_id, value * user_id * 3.7 AS seconds,
  CASE WHEN value * user_id * 3.7 < 60 THEN printf('%.1fs', value * user_id * 3.7)
       WHEN value * user_id * 3.7 < 3600 THEN printf('%.1fm', value * user_id * 3.7 / 60)
       ELSE printf('%.1fh', value * user_id * 3.7 / 3600) END AS human
FROM events
""")
def humanize_durations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", "user_id")
    secs = F.col("value") * F.col("user_id") * F.lit(3.7)
    return e.select("event_id", secs.alias("seconds"), X.humanize_seconds(secs).alias("human"))


# ------------------------------------------------------------- S7 long form
REPORT_METRICS = ["exact_match", "no_answer_rate", "pass_at_1", "keyword_match_rate", "substring_match_rate"]


@query("evaluation_report", "S7 A9 G9 (long form)", sql=f"""
WITH s AS ({_eval_sql()})
SELECT domain, metric, value FROM (
  SELECT domain, 'total_samples' AS metric, CAST(total_samples AS DOUBLE) AS value FROM s WHERE scored
  {''.join(f"UNION ALL SELECT domain, '{m}', {m} FROM s WHERE {m} IS NOT NULL " for m in REPORT_METRICS)}
  UNION ALL SELECT 'ALL', 'total_samples', CAST(sum(total_samples) AS DOUBLE) FROM s WHERE scored)
""")
def evaluation_report(spark, sf_dir):
    return S.long_report(domain_summary(spark, sf_dir))


@query("substring_match", "A8 X5", sql=f"""
WITH {KEYWORD_CTE}
SELECT event_type, count(*) AS total_samples,
  CAST(count_if({Q.any_token_contained('prediction', 'reference')}) AS BIGINT) AS substring_matches,
  round(count_if({Q.any_token_contained('prediction', 'reference')}) / count(*), 6) AS substring_match_rate
FROM kw GROUP BY event_type
""")
def substring_match(spark, sf_dir):
    t = keyword_texts(spark, sf_dir).withColumn("_m", X.any_token_contained("prediction", "reference"))
    return t.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total_samples"), F.count_if("_m").alias("substring_matches"),
        F.round(F.count_if("_m") / F.count(F.lit(1)), 6).alias("substring_match_rate"))


@query("answer_extraction_thousands", "X1 X2 (mode=thousands)", sql=f"""
WITH {MATH_CTE.split('verdicts AS', 1)[0].rstrip().rstrip(',')}
SELECT item_id, {Q.extract_answer('prediction', 'thousands')} AS pred_answer,
       {Q.extract_reference('reference', 'thousands')} AS ref_answer
FROM math
""")
def answer_extraction_thousands(spark, sf_dir):
    m = math_predictions(spark, sf_dir)
    return m.select("item_id", X.extract_answer("prediction", "thousands").alias("pred_answer"),
                    X.extract_reference("reference", "thousands").alias("ref_answer"))


# ------------------------------------------------------------- S6 / S7 as written
def _verdict_rows_sql() -> str:
    kw = f"SELECT *, {Q.keywords('prediction')} AS pk, {Q.keywords('reference')} AS rk FROM kw"
    return f"""
WITH {MATH_CTE}, {CODE_CTE}, {KEYWORD_CTE}, {_code_ext_cte()},
rows_ AS (
  SELECT 'math' AS domain, prediction, reference, pred_answer, ref_answer, counted, correct, NULL::BOOLEAN AS passed,
         NULL::VARCHAR AS pred_keywords, NULL::VARCHAR AS ref_keywords, NULL::BOOLEAN AS keyword_match, NULL::BOOLEAN AS substring_match
  FROM verdicts
  UNION ALL
  SELECT 'code', response, NULL, NULL, NULL, NULL, NULL, contains(extracted_code, 'return'), NULL, NULL, NULL, NULL FROM code_x
  UNION ALL
  SELECT 'aiops', prediction, reference, NULL, NULL, NULL, NULL, NULL, array_to_string(pk, '|'), array_to_string(rk, '|'),
         len(list_intersect(pk, rk)) > 0, {Q.any_token_contained('prediction', 'reference')} FROM ({kw})
  UNION ALL
  SELECT 'web', url, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pages)"""


VERDICT_FIELDS = ("domain string, prediction string, reference string, pred_answer double, ref_answer double, counted boolean, correct boolean, "
                  "passed boolean, pred_keywords array<string>, ref_keywords array<string>, keyword_match boolean, substring_match boolean")


@query("detailed_results", "S6 S1 S2 X1 X2 X4 X5", sql=f"""{_verdict_rows_sql()}
SELECT domain, md5(prediction) AS prediction_md5, md5(reference) AS reference_md5, pred_answer, ref_answer, counted, correct, passed,
       pred_keywords, ref_keywords, keyword_match, substring_match FROM rows_
""")
def detailed_results(spark, sf_dir):
    """The per-row verdicts of every domain, as the detail output holds them when it is read back."""
    from tesserae.session import scratch_path
    from tesserae.sources import jsonl as J

    out = scratch_path(spark, "detailed")
    J.write_detailed_results(S.with_verdicts(eval_rows(spark, sf_dir)), out)
    d = J.read_jsonl(spark, out, VERDICT_FIELDS)
    return d.select("domain", F.md5("prediction").alias("prediction_md5"), F.md5("reference").alias("reference_md5"), "pred_answer",
                    "ref_answer", "counted", "correct", "passed", F.array_join("pred_keywords", "|").alias("pred_keywords"),
                    F.array_join("ref_keywords", "|").alias("ref_keywords"), "keyword_match", "substring_match")


@query("report_record", "S7 G9 (nested record)", sql=f"""
WITH s AS ({_eval_sql()})
SELECT 'models/student' AS model_path, 'documents' AS eval_data_path, CAST(sum(total_samples) AS BIGINT) AS total_samples, count(*) AS n_domains,
  max(CASE WHEN domain = 'math' THEN exact_match END) AS math_exact_match, max(CASE WHEN domain = 'code' THEN pass_at_1 END) AS code_pass_at_1,
  max(CASE WHEN domain = 'aiops' THEN headline_text END) AS aiops_headline, bool_or(domain = 'web' AND scored) AS web_scored, '0.1' AS temperature
FROM s
""")
def report_record(spark, sf_dir):
    from tesserae.sources import jsonl as J

    rep = J.report_record(S.evaluate(eval_rows(spark, sf_dir)), {"temperature": 0.1, "max_new_tokens": 512},
                          {"model_path": "models/student", "eval_data_path": "documents"})
    of = lambda domain, field: F.col("domain_results").getItem(domain).getField(field)
    return rep.select("model_path", "eval_data_path", "total_samples", F.size("domain_results").cast("bigint").alias("n_domains"),
                      F.round(of("math", "exact_match"), 6).alias("math_exact_match"), F.round(of("code", "pass_at_1"), 6).alias("code_pass_at_1"),
                      of("aiops", "headline_text").alias("aiops_headline"), of("web", "scored").alias("web_scored"),
                      F.col("generation_config").getItem("temperature").alias("temperature"))


@query("metric_by_name", "U1 A2 A3", sql=f"""
WITH {PAIRS_CTE}
SELECT doc_id, coalesce({Q.norm('prediction')} = {Q.norm('reference')}, false) AS exact_match,
       coalesce(contains({Q.norm('prediction')}, {Q.norm('reference')}), false) AS contains
FROM pairs
""")
def metric_by_name(spark, sf_dir):
    pairs = text_pairs(spark, sf_dir)
    return pairs.select("doc_id", *[S.metric(name, "prediction", "reference").alias(name) for name in ("exact_match", "contains")])
