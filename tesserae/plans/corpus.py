"""Corpus queries: normalise, synthesise, union, sample, split, shard, audit
(P1-P4, J5, A1, A16, M1-M10, W1-W3, G5, S4, S5, F4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import render as R
from tesserae.operators import records as REC
from tesserae.operators import reports as REP
from tesserae.operators import sampling as M
from tesserae.plans import sqlgen as Q
from tesserae.plans.registry import query, table

SEED = 42
KEY_SQL = "md5('42:' || CAST(doc_id AS VARCHAR))"


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(*cols) if cols else d


# ------------------------------------------------------------- M1 / M3 / M4
@query("seeded_sample", "M1", sql=f"""
SELECT doc_id, lang FROM documents ORDER BY {KEY_SQL}, doc_id LIMIT 100
""")
def seeded_sample(spark, sf_dir):
    return M.sample_n(documents(spark, sf_dir, "doc_id", "lang"), 100, "doc_id", SEED)


@query("seeded_shuffle", "M3 W1", sql=f"""
SELECT doc_id, row_number() OVER (ORDER BY {KEY_SQL}, doc_id) - 1 AS rank FROM documents
""")
def seeded_shuffle(spark, sf_dir):
    return M.seeded_shuffle(documents(spark, sf_dir, "doc_id"), "doc_id", SEED, "rank")


@query("train_eval_split", "M4", sql=f"""
SELECT doc_id, CASE WHEN rk < least(350, n // 10) THEN 'eval' ELSE 'train' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY {KEY_SQL}, doc_id) - 1 AS rk,
             count(*) OVER () AS n FROM documents)
""")
def train_eval_split(spark, sf_dir):
    return M.label_split(documents(spark, sf_dir, "doc_id"), "doc_id", SEED, cap=350)


# ------------------------------------------------------------- M5 / M6 / M7
CAPS = {"en": 200, "fr": 50, "de": 100, "es": 25}


@query("capped_eval", "M5 W2", sql=f"""
SELECT doc_id, lang, rank_in_domain FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {KEY_SQL}, doc_id) AS rank_in_domain
  FROM documents)
WHERE rank_in_domain <= CASE lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in CAPS.items())} ELSE 0 END
""")
def capped_eval(spark, sf_dir):
    out = M.capped_eval_sample(documents(spark, sf_dir, "doc_id", "lang"), "lang", CAPS, "doc_id", SEED)
    return out.withColumn("rank_in_domain", F.col("rank_in_domain").cast("bigint"))


@query("eval_exclusion", "M5 (exclude_from_train)", sql=f"""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {KEY_SQL}, doc_id) AS k FROM documents)
SELECT doc_id, CASE WHEN k <= CASE lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in CAPS.items())} ELSE 0 END
                    THEN 'eval' ELSE 'train' END AS part FROM r
""")
def eval_exclusion(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "lang")
    held = M.capped_eval_sample(d, "lang", CAPS, "doc_id", SEED, exclude_from_train=True)
    train = M.exclude_eval_from_train(d, held, "doc_id")
    return (held.filter("exclude_from_train").select("doc_id", F.lit("eval").alias("part"))
            .unionByName(train.select("doc_id", F.lit("train").alias("part"))))


@query("mode_samples", "M7 (medium, full)", sql=f"""
SELECT 'medium' AS mode, doc_id, lang FROM (SELECT doc_id, lang FROM documents ORDER BY {KEY_SQL}, doc_id LIMIT 50)
UNION ALL SELECT 'full', doc_id, lang FROM documents
""")
def mode_samples(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "lang")
    parts = [M.mode_sample(d, m, "lang", "doc_id", "doc_id", SEED).select(F.lit(m).alias("mode"), "doc_id", "lang") for m in ("medium", "full")]
    return parts[0].unionByName(parts[1])


def _representative_sql(n: int, domain: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce({domain}, 'unknown') AS dom FROM documents),
q AS (
  SELECT dom, {n} // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY first_seen, dom) - 1
         < {n} % count(*) OVER () THEN 1 ELSE 0 END AS quota
  FROM (SELECT dom, min(doc_id) AS first_seen FROM d GROUP BY dom)
),
r AS (SELECT doc_id, dom, row_number() OVER (PARTITION BY dom ORDER BY {KEY_SQL}, doc_id) AS rank_in_domain FROM d)
SELECT r.doc_id, r.dom AS {domain}, r.rank_in_domain FROM r JOIN q USING (dom) WHERE r.rank_in_domain <= q.quota
"""


@query("representative_sample", "M6 M7 W2", sql=_representative_sql(10, "lang"))
def representative_sample(spark, sf_dir):
    out = M.representative_sample(documents(spark, sf_dir, "doc_id", "lang"), 10, "lang", "doc_id",
                                  "doc_id", SEED)
    return out.withColumn("rank_in_domain", F.col("rank_in_domain").cast("bigint"))


@query("representative_sample_sources", "M6 W2 (remainder rule)", sql=_representative_sql(30, "source"))
def representative_sample_sources(spark, sf_dir):
    out = M.representative_sample(documents(spark, sf_dir, "doc_id", "source"), 30, "source", "doc_id",
                                  "doc_id", SEED)
    return out.withColumn("rank_in_domain", F.col("rank_in_domain").cast("bigint"))


# ------------------------------------------------------------- M8 / M9 / G5
@query("shard_and_batch", "M8 M9 W1 W3 G5", sql="""
SELECT doc_id, shard_id, idx - shard_id * chunk AS pos_in_shard, (idx - shard_id * chunk) // 64 AS batch_id
FROM (SELECT doc_id, idx, chunk,
        CASE WHEN chunk = 0 THEN 2 ELSE least(idx // chunk, 2) END AS shard_id
      FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () // 3 AS chunk
            FROM documents))
""")
def shard_and_batch(spark, sf_dir):
    out = M.assign_shards(documents(spark, sf_dir, "doc_id"), ["doc_id"], k=3, batch_size=64)
    return out.select("doc_id", "shard_id", "pos_in_shard", "batch_id")


# ------------------------------------------------------------- P3 / P4
def _templates_sql() -> str:
    rows = []
    for i, t in enumerate(REC.INCIDENT_TEMPLATES):
        logs = "[" + ", ".join(Q.lit(x) for x in t["logs"]) + "]"
        plan = "[" + ", ".join(Q.lit(x) for x in t["fix_plan"]) + "]"
        rows.append(f"({i}, {Q.lit(t['scenario'])}, {logs}, {Q.lit(t['config_json'])}, "
                    f"{Q.lit(t['metrics_json'])}, {Q.lit(t['root_cause'])}, {plan})")
    return ("tpl(template_idx, scenario, logs, config_json, metrics_json, root_cause, fix_plan) AS "
            f"(VALUES {', '.join(rows)})")


def _incident_prompt_sql() -> str:
    nl = "chr(10)"
    return ("array_to_string(flatten([[" + Q.lit(R.INCIDENT_HEADER) + "], "
            f"list_transform(logs, lambda l: '```' || {nl} || l || {nl} || '```'), "
            f"[{Q.lit(R.INCIDENT_CONFIG)}, '```json' || {nl} || config_json || {nl} || '```', "
            f"{Q.lit(R.INCIDENT_METRICS)}, '```json' || {nl} || metrics_json || {nl} || '```', "
            f"{Q.lit(R.INCIDENT_QUESTION)}]]), {nl})")


INCIDENT_SQL = f"""
WITH {_templates_sql()},
drawn AS (SELECT event_id, CAST({Q.hex_prefix_int("md5('42:' || CAST(event_id AS VARCHAR))")} % 4 AS INTEGER)
          AS template_idx FROM events)
SELECT printf('aiops_%04d', event_id) AS id, 'aiops' AS domain, 'hard' AS difficulty,
  {_incident_prompt_sql()} AS prompt, root_cause AS expected_answer, scenario,
  array_to_string(fix_plan, '|') AS fix_plan
FROM drawn JOIN tpl USING (template_idx)
"""


@query("incident_synthesis", "P3 P4", sql=INCIDENT_SQL)
def incident_synthesis(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id")
    out = REC.synthesize_incidents(ev, "event_id", SEED)
    return out.select("id", "domain", "difficulty", "prompt", "expected_answer",
                      F.col("metadata.scenario").alias("scenario"),
                      F.array_join("metadata.fix_plan", "|").alias("fix_plan"))


# ------------------------------------------------------------- J5 / A1
def source_records(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    d = documents(spark, sf_dir, "doc_id", "text").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
        F.lit("documents").alias("domain"), F.col("text").alias("prompt"))
    p = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("id"),
        F.lit("pages").alias("domain"), F.col("html").alias("prompt"), F.col("url").alias("source_url"))
    b = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("id"),
        F.lit("benchmark").alias("domain"), F.col("text").alias("prompt"))
    return [d, p, b]


@query("corpus_union_counts", "J5 A1", sql="""
SELECT domain, count(*) AS n_records, CAST(sum(length(prompt)) AS BIGINT) AS total_chars,
       count(source_url) AS n_with_url
FROM (SELECT 'documents' AS domain, text AS prompt, NULL AS source_url FROM documents
      UNION ALL SELECT 'pages', html, url FROM pages
      UNION ALL SELECT 'benchmark', text, NULL FROM benchmark)
GROUP BY domain
""")
def corpus_union_counts(spark, sf_dir):
    u = REC.union_corpora(*source_records(spark, sf_dir))
    return u.groupBy("domain").agg(F.count(F.lit(1)).alias("n_records"),
                                   F.sum(F.length("prompt")).alias("total_chars"),
                                   F.count("source_url").alias("n_with_url"))


# ------------------------------------------------- 3.1 prepare a corpus
def raw_math(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    q = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" placed order "),
                 F.col("o_orderkey").cast("string"), F.lit(". What is the order number?"))
    a = F.concat(F.lit("The order number is given.\n#### "), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", q.alias("question"), a.alias("answer"))


def raw_code(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    ep = F.regexp_replace("p_name", " ", "_")
    return p.select(
        "p_partkey", F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("task_id"),
        F.concat(F.lit("def "), ep, F.lit("(x):\n    \"\"\"Scale x.\"\"\"")).alias("prompt"),
        F.concat(F.lit("    return x * "), F.col("p_size").cast("string")).alias("canonical_solution"),
        F.concat(F.lit("assert "), ep, F.lit("(1) == "), F.col("p_size").cast("string")).alias("test"),
        ep.alias("entry_point"))


def prepared_corpus(spark, sf_dir) -> DataFrame:
    math = REC.normalize_math(raw_math(spark, sf_dir), "question", "answer", "o_orderkey", None, SEED,
                              answer_field="original_answer")
    code = REC.normalize_code(raw_code(spark, sf_dir), "task_id", "prompt", "canonical_solution", "test",
                              "entry_point", ["p_partkey"], None, answer_field="original_answer")
    ops = REC.synthesize_incidents(table(spark, sf_dir, "events").select("event_id"), "event_id", SEED,
                                   answer_field="original_answer")
    corpus = REC.union_corpora(math, code, ops)
    return M.label_split(corpus, "id", SEED, cap=350)


PREPARED_SQL = f"""
WITH {_templates_sql()},
math AS (
  SELECT printf('gsm8k_%04d', row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1)
           AS id, 'math' AS domain, 'medium' AS difficulty,
         {Q.lit(R.MATH_INSTRUCTION)} || 'Customer ' || o_custkey || ' placed order ' || o_orderkey
           || '. What is the order number?' AS prompt
  FROM orders),
code AS (
  SELECT 'humaneval_part/' || p_partkey AS id, 'code' AS domain, 'hard' AS difficulty,
         {Q.lit(R.CODE_INSTRUCTION)} || 'def ' || replace(p_name, ' ', '_') || '(x):' || chr(10)
           || '    \"\"\"Scale x.\"\"\"' || {Q.lit(R.CODE_INSTRUCTION_END)} AS prompt
  FROM part),
ops AS (
  SELECT printf('aiops_%04d', event_id) AS id, 'aiops' AS domain, 'hard' AS difficulty,
         {_incident_prompt_sql()} AS prompt
  FROM (SELECT event_id, CAST({Q.hex_prefix_int("md5('42:' || CAST(event_id AS VARCHAR))")} % 4 AS INTEGER)
        AS template_idx FROM events) JOIN tpl USING (template_idx)),
u AS (SELECT * FROM math UNION ALL SELECT * FROM code UNION ALL SELECT * FROM ops),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS rk, count(*) OVER () AS n FROM u)
"""


@query("prepared_records", "P1 P2 P3 J5 M3 M4 W1", sql=PREPARED_SQL + """
SELECT id, domain, difficulty, CASE WHEN rk < least(350, n // 10) THEN 'eval' ELSE 'train' END AS split,
       length(prompt) AS prompt_chars
FROM ranked
""")
def prepared_records(spark, sf_dir):
    return prepared_corpus(spark, sf_dir).select("id", "domain", "difficulty", "split",
                                                 F.length("prompt").cast("bigint").alias("prompt_chars"))


@query("prepared_split_counts", "A1 A16 M4", sql=PREPARED_SQL + """
SELECT CASE WHEN rk < least(350, n // 10) THEN 'eval' ELSE 'train' END AS split, domain, count(*) AS n_records
FROM ranked GROUP BY ALL
""")
def prepared_split_counts(spark, sf_dir):
    return REP.domain_counts(prepared_corpus(spark, sf_dir), ["split", "domain"], "n_records")


# ------------------------------------------------------------- S5
def merge_frames(spark, sf_dir) -> list[DataFrame]:
    d = documents(spark, sf_dir, "doc_id", "lang", "n_chars")
    a = d.filter(F.col("lang").isin("en", "fr")).withColumn("shard", F.lit(0))
    b = d.filter(F.col("lang").isin("fr", "de", "es")).withColumn("shard", F.lit(1))
    return [a, b]


@query("merge_shards", "S5", sql="""
SELECT doc_id, lang, n_chars, max(shard) AS shard FROM (
  SELECT doc_id, lang, n_chars, 0 AS shard FROM documents WHERE lang IN ('en', 'fr')
  UNION ALL SELECT doc_id, lang, n_chars, 1 FROM documents WHERE lang IN ('fr', 'de', 'es'))
GROUP BY doc_id, lang, n_chars
""")
def merge_shards(spark, sf_dir):
    from tesserae.sources.jsonl import merge_frames as merge

    return merge(merge_frames(spark, sf_dir), "doc_id", "shard").select(
        "doc_id", "lang", "n_chars", F.col("shard").cast("int").alias("shard"))


# ------------------------------------------------------------- M10
@query("overlap_audit", "M10 M5 M4", sql=f"""
WITH ranked AS (
  SELECT doc_id, lang, text, row_number() OVER (ORDER BY {KEY_SQL}, doc_id) - 1 AS rk, count(*) OVER () AS n
  FROM documents),
train AS (SELECT DISTINCT md5({Q.norm('text')}) AS h FROM ranked WHERE rk >= least(350, n // 10)),
ev AS (
  SELECT doc_id, lang, text FROM (
    SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY {KEY_SQL}, doc_id) AS r
    FROM documents)
  WHERE r <= CASE lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in CAPS.items())} ELSE 0 END)
SELECT lang, count(*) AS n_eval, CAST(count_if(train.h IS NOT NULL) AS BIGINT) AS n_overlap
FROM ev LEFT JOIN train ON md5({Q.norm('ev.text')}) = train.h GROUP BY lang
""")
def overlap_audit(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "lang", "text")
    split = M.label_split(d, "doc_id", SEED, cap=350)
    train = split.filter(F.col("split") == "train")
    ev = M.capped_eval_sample(d, "lang", CAPS, "doc_id", SEED)
    return M.overlap_audit(ev, train, "text", "lang")


# ------------------------------------------------------------- S4 / F4
def mixed_eval_records(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    shape = F.pmod(F.col("doc_id"), F.lit(3))
    return j.select(
        "doc_id",
        F.when(shape == 0, F.col("text")).alias("prompt"),
        F.when((shape == 0) & (F.col("quality") == 1), F.concat(F.lit("good: "), F.col("source")))
        .alias("teacher_response"),
        F.when(shape == 0, F.col("lang")).alias("original_answer"),
        F.when(shape == 1, F.col("source")).alias("instruction"),
        F.when(shape == 1, F.col("lang")).alias("input"),
        F.when(shape == 1, F.col("n_chars").cast("string")).alias("expected_answer"))


@query("eval_record_normalize", "S4 F4", sql="""
WITH m AS (
  SELECT d.doc_id,
    CASE WHEN d.doc_id % 3 = 0 THEN d.text END AS prompt,
    CASE WHEN d.doc_id % 3 = 0 AND l.quality = 1 THEN 'good: ' || d.source END AS teacher_response,
    CASE WHEN d.doc_id % 3 = 0 THEN d.lang END AS original_answer,
    CASE WHEN d.doc_id % 3 = 1 THEN d.source END AS instruction,
    CASE WHEN d.doc_id % 3 = 1 THEN d.lang END AS input,
    CASE WHEN d.doc_id % 3 = 1 THEN CAST(d.n_chars AS VARCHAR) END AS expected_answer
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id,
  CASE WHEN prompt IS NOT NULL THEN 'prompt' WHEN instruction IS NOT NULL THEN 'instruction' ELSE 'rejected' END AS shape,
  CASE WHEN prompt IS NOT NULL THEN prompt ELSE instruction END AS instruction,
  CASE WHEN prompt IS NOT NULL THEN '' ELSE input END AS input,
  CASE WHEN prompt IS NOT NULL THEN coalesce(teacher_response, original_answer, '') ELSE expected_answer END
    AS expected_answer
FROM m
""")
def eval_record_normalize(spark, sf_dir):
    accepted, rejected = REC.normalize_eval_records(mixed_eval_records(spark, sf_dir))
    cols = ["doc_id", "shape", "instruction", "input", "expected_answer"]
    rej = rejected.select("doc_id", F.lit("rejected").alias("shape"),
                          F.lit(None).cast("string").alias("instruction"),
                          F.lit(None).cast("string").alias("input"),
                          F.lit(None).cast("string").alias("expected_answer"))
    return accepted.select(*cols).unionByName(rej)


# ------------------------------------------------------------- M2 / P2 head
@query("code_normalize_head", "M2 P2", sql=f"""
SELECT 'humaneval_part/' || p_partkey AS id, 'code' AS domain, 'hard' AS difficulty,
  md5({Q.lit(R.CODE_INSTRUCTION)} || 'def ' || replace(p_name, ' ', '_') || '(x):' || chr(10)
      || '    \"\"\"Scale x.\"\"\"' || {Q.lit(R.CODE_INSTRUCTION_END)}) AS prompt_md5,
  replace(p_name, ' ', '_') AS entry_point
FROM part ORDER BY p_partkey LIMIT 164
""")
def code_normalize_head(spark, sf_dir):
    # the reference keeps the first 164 tasks in file order: the limit is the feature
    code = REC.normalize_code(raw_code(spark, sf_dir), "task_id", "prompt", "canonical_solution", "test",
                              "entry_point", ["p_partkey"], 164)
    return code.select("id", "domain", "difficulty", F.md5("prompt").alias("prompt_md5"),
                       F.col("metadata.entry_point").alias("entry_point"))


# ------------------------------------------------------------- F2
@query("reference_texts", "F2 S4", sql="""
WITH m AS (
  SELECT d.doc_id, d.doc_id % 3 AS shape,
    CASE WHEN d.doc_id % 3 = 0 THEN coalesce(CASE WHEN l.quality = 1 THEN 'good: ' || d.source END, d.lang, '')
         WHEN d.doc_id % 3 = 1 THEN CAST(d.n_chars AS VARCHAR) END AS expected_answer
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, length(expected_answer) AS reference_chars FROM m
WHERE shape <> 2 AND length(coalesce(expected_answer, '')) > 0
""")
def reference_texts(spark, sf_dir):
    from tesserae.functions.text import non_empty

    accepted, _ = REC.normalize_eval_records(mixed_eval_records(spark, sf_dir))
    return accepted.filter(non_empty("expected_answer")).select(
        "doc_id", F.length("expected_answer").cast("bigint").alias("reference_chars"))
