"""Chat and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import render as R
from tesserae.operators import records as REC
from tesserae.operators import reports as REP
from tesserae.plans import sqlgen as Q
from tesserae.plans.registry import query, table


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


# ------------------------------------------------------------- P6 / P7
@query("chat_render_plain", "P6 P7", sql=f"""
SELECT conv_id, count(*) AS n_messages,
  md5(string_agg(CASE role WHEN 'user' THEN 'Human: ' WHEN 'assistant' THEN 'Assistant: '
                          WHEN 'system' THEN 'System: ' END || coalesce(text, '') || chr(10), '' ORDER BY turn)
      || 'Assistant:') AS rendered_md5,
  length(string_agg(CASE role WHEN 'user' THEN 'Human: ' WHEN 'assistant' THEN 'Assistant: '
                          WHEN 'system' THEN 'System: ' END || coalesce(text, '') || chr(10), '' ORDER BY turn)
      || 'Assistant:') AS rendered_chars
FROM conversations GROUP BY conv_id
""")
def chat_render_plain(spark, sf_dir):
    chats = REC.render_chats_plain(conversations(spark, sf_dir))
    return chats.select("conv_id", "n_messages", F.md5("rendered").alias("rendered_md5"),
                        F.length("rendered").cast("bigint").alias("rendered_chars"))


# ------------------------------------------------------------- P9 / P10
def user_turns(spark, sf_dir) -> DataFrame:
    """Every user turn as an instruction, with its conversation's first system text.

    The system text is one row per conversation (``min_by`` combines
    map-side), joined back to the turns."""
    c = conversations(spark, sf_dir)
    system = c.filter(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("system_text"))
    turns = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    return turns.join(system, "conv_id", "left")


USER_TURNS_SQL = """
u AS (
  SELECT conv_id, turn, text AS instruction,
    (SELECT arg_min(s.text, s.turn) FROM conversations s WHERE s.role = 'system' AND s.conv_id = c.conv_id) AS system_text
  FROM conversations c WHERE role = 'user')"""


@query("chatml_render", "P9 P10", sql=f"""
WITH {USER_TURNS_SQL},
r AS (
  SELECT conv_id, turn, instruction,
    {Q.lit(R.CHATML_USER)} || CASE WHEN length(coalesce(system_text, '')) > 0
      THEN instruction || chr(10) || system_text ELSE instruction END || {Q.lit(R.CHATML_END_ASSISTANT)} AS chatml
  FROM u)
SELECT conv_id, turn, md5(chatml) AS chatml_md5,
  (CASE WHEN starts_with(chatml, '<|im_start|>') THEN chatml
        ELSE {Q.lit(R.CHATML_USER)} || chatml || {Q.lit(R.CHATML_END_ASSISTANT)} END) = chatml AS idempotent,
  md5(CASE WHEN starts_with(instruction, '<|im_start|>') THEN instruction
           ELSE {Q.lit(R.CHATML_USER)} || instruction || {Q.lit(R.CHATML_END_ASSISTANT)} END) AS ensured_md5
FROM r
""")
def chatml_render(spark, sf_dir):
    chatml = R.render_chatml(F.col("instruction"), F.coalesce(F.col("system_text"), F.lit("")))
    r = user_turns(spark, sf_dir).select("conv_id", "turn", "instruction", chatml.alias("chatml"))
    return r.select("conv_id", "turn", F.md5("chatml").alias("chatml_md5"),
                    (R.ensure_chatml("chatml") == F.col("chatml")).alias("idempotent"),
                    F.md5(R.ensure_chatml("instruction")).alias("ensured_md5"))


# ------------------------------------------------------------- P6 / P7 in bounded rows
SEGMENT_TURNS = 3

_LINE_SQL = """CASE role WHEN 'user' THEN 'Human: ' || coalesce(text, '') || chr(10)
                         WHEN 'assistant' THEN 'Assistant: ' || coalesce(text, '') || chr(10)
                         WHEN 'system' THEN 'System: ' || coalesce(text, '') || chr(10) ELSE '' END"""


@query("chat_segments", "P6 P7 W1", sql=f"""
WITH p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // {SEGMENT_TURNS} AS segment FROM conversations)
SELECT conv_id, segment, min(turn) AS first_turn, count(*) AS n_messages, string_agg(role, '|' ORDER BY turn) AS roles,
  md5(string_agg(coalesce(text, ''), '|' ORDER BY turn)) AS contents_md5, md5(string_agg({_LINE_SQL}, '' ORDER BY turn)) AS rendered_md5
FROM p GROUP BY conv_id, segment
""")
def chat_segments(spark, sf_dir):
    s = REC.chat_segments(conversations(spark, sf_dir), turns_per_segment=SEGMENT_TURNS)
    return s.select("conv_id", "segment", "first_turn", "n_messages",
                    F.array_join(F.transform("messages", lambda m: m["role"]), "|").alias("roles"),
                    F.md5(F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), "|")).alias("contents_md5"),
                    F.md5("rendered").alias("rendered_md5"))


@query("chat_collect", "P6", sql="""
SELECT conv_id, count(*) AS n_messages, string_agg(role, '|' ORDER BY turn) AS roles,
  md5(string_agg(coalesce(text, ''), '|' ORDER BY turn)) AS contents_md5
FROM conversations GROUP BY conv_id
""")
def chat_collect(spark, sf_dir):
    c = REC.collect_chat(conversations(spark, sf_dir))
    return c.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda m: m["role"]), "|").alias("roles"),
                    F.md5(F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), "|")).alias("contents_md5"))


# ------------------------------------------------------- P5 / P8 / P11 / P12
def user_prompts(spark, sf_dir) -> DataFrame:
    return conversations(spark, sf_dir).filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))


def with_answers(prompts: DataFrame, spark, sf_dir) -> DataFrame:
    """Each user turn with the following assistant turn (left join: may be absent)."""
    a = conversations(spark, sf_dir).filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return prompts.join(a, ["conv_id", "turn"], "left")


def turn_pairs(spark, sf_dir) -> DataFrame:
    return with_answers(user_prompts(spark, sf_dir), spark, sf_dir)


PAIRS_SQL = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


@query("messages_build", "P5 P8 P11 P12", sql=f"""
WITH {PAIRS_SQL}
SELECT conv_id, turn,
  CASE WHEN length(coalesce(response, '')) > 0 THEN 2 ELSE 1 END AS n_messages,
  CASE WHEN length(coalesce(response, '')) > 0 THEN 'user|assistant' ELSE 'user' END AS roles,
  md5(prompt || CASE WHEN length(coalesce(response, '')) > 0 THEN '|' || response ELSE '' END) AS contents_md5,
  md5('Human: ' || prompt || chr(10) || chr(10) || 'Assistant:') AS single_turn_md5,
  md5({Q.lit(R.SECTION_QUESTION)} || prompt || {Q.lit(R.SECTION_ANSWER)} || coalesce(response, '')) AS sections_md5,
  length({Q.lit(R.SECTION_QUESTION)} || prompt || {Q.lit(R.SECTION_ANSWER)}) AS prefix_chars,
  coalesce(response, prompt, '') AS training_response
FROM pairs
""")
def messages_build(spark, sf_dir):
    p = turn_pairs(spark, sf_dir)
    msgs = R.to_messages("prompt", "response")
    text, prefix = R.render_sections(F.col("prompt"), R.training_response("response", F.lit(None)))
    return p.select(
        "conv_id", "turn", F.size(msgs).alias("n_messages"),
        F.array_join(F.transform(msgs, lambda m: m["role"]), "|").alias("roles"),
        F.md5(F.array_join(F.transform(msgs, lambda m: m["content"]), "|")).alias("contents_md5"),
        F.md5(R.render_single_turn("prompt")).alias("single_turn_md5"),
        F.md5(text).alias("sections_md5"), F.length(prefix).cast("bigint").alias("prefix_chars"),
        R.training_response("response", "prompt").alias("training_response"))


# ------------------------------------------------------------- A11 / A12 / G10
def text_losses(spark, sf_dir) -> DataFrame:
    """lineitem as per-text losses: role by return flag, loss from discount
    and tax, tokens = quantity."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity")
    role = (F.when(F.col("l_returnflag") == "A", "student").when(F.col("l_returnflag") == "N", "baseline")
            .otherwise("teacher"))
    return li.select(role.alias("role"), "l_linestatus",
                     (F.col("l_discount") * 10 + F.col("l_tax")).alias("loss"),
                     F.col("l_quantity").cast("long").alias("n_tokens"))


LOSSES_SQL = """
losses AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'student' WHEN 'N' THEN 'baseline' ELSE 'teacher' END AS role,
         l_linestatus, l_discount * 10 + l_tax AS loss, CAST(l_quantity AS BIGINT) AS n_tokens
  FROM lineitem),
ppl AS (
  SELECT role, l_linestatus, sum(loss * n_tokens) / CAST(sum(n_tokens) AS DOUBLE) AS avg_loss,
         CAST(sum(n_tokens) AS BIGINT) AS total_tokens, count(*) AS n_texts
  FROM losses GROUP BY role, l_linestatus)"""


@query("perplexity_by_group", "A11", sql=f"""
WITH {LOSSES_SQL}
SELECT role, l_linestatus, round(avg_loss, 6) AS avg_loss, round(exp(avg_loss), 6) AS perplexity,
       total_tokens, n_texts FROM ppl
""")
def perplexity_by_group(spark, sf_dir):
    p = REP.corpus_perplexity(text_losses(spark, sf_dir), ["role", "l_linestatus"])
    return p.select("role", "l_linestatus", F.round("avg_loss", 6).alias("avg_loss"),
                    F.round("perplexity", 6).alias("perplexity"), "total_tokens", "n_texts")


@query("improvement_pct", "A12 G10", sql=f"""
WITH {LOSSES_SQL},
w AS (
  SELECT l_linestatus,
    max(CASE WHEN role = 'student' THEN exp(avg_loss) END) AS sp, max(CASE WHEN role = 'baseline' THEN exp(avg_loss) END) AS bp,
    max(CASE WHEN role = 'teacher' THEN exp(avg_loss) END) AS tp,
    max(CASE WHEN role = 'student' THEN avg_loss END) AS sl, max(CASE WHEN role = 'baseline' THEN avg_loss END) AS bl
  FROM ppl GROUP BY l_linestatus)
SELECT l_linestatus, round(sp, 6) AS student_perplexity, round(bp, 6) AS baseline_perplexity,
  round(tp, 6) AS teacher_perplexity,
  round(CASE WHEN sp <> 0 AND bp <> 0 THEN (bp - sp) / bp * 100 END, 6) AS perplexity_improvement_pct,
  round(CASE WHEN sl <> 0 AND bl <> 0 THEN (bl - sl) / bl * 100 END, 6) AS loss_improvement_pct
FROM w
""")
def improvement_pct(spark, sf_dir):
    p = REP.corpus_perplexity(text_losses(spark, sf_dir), ["role", "l_linestatus"])
    wide = REP.role_pivot(p, ["l_linestatus"], "role", ["perplexity", "avg_loss"],
                          ["student", "baseline", "teacher"])
    sp, bp = F.col("student_perplexity"), F.col("baseline_perplexity")
    sl, bl = F.col("student_avg_loss"), F.col("baseline_avg_loss")
    return wide.select(
        "l_linestatus", F.round(sp, 6).alias("student_perplexity"), F.round(bp, 6).alias("baseline_perplexity"),
        F.round("teacher_perplexity", 6).alias("teacher_perplexity"),
        F.round(REP.improvement_pct(bp, sp), 6).alias("perplexity_improvement_pct"),
        F.round(REP.improvement_pct(bl, sl), 6).alias("loss_improvement_pct"))


@query("generation_length", "A15 G10", sql="""
SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS avg_length, min(length(text)) AS min_length,
       max(length(text)) AS max_length, round(quantile_cont(length(text), 0.5), 6) AS median_length
FROM documents GROUP BY lang
""")
def generation_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "text")
    p = REP.generation_length_profile(d, "text", ["lang"])
    return p.select("lang", "n", F.round("avg_length", 6).alias("avg_length"),
                    F.col("min_length").cast("bigint").alias("min_length"),
                    F.col("max_length").cast("bigint").alias("max_length"),
                    F.round("median_length", 6).alias("median_length"))


# ------------------------------------------------------------- A13 / W5 / W6
@query("convergence", "A13 W6", sql="""
WITH a AS (
  SELECT user_id AS run, count(*) AS n_logged, arg_min(value, event_id) AS initial_loss,
         arg_max(value, event_id) AS final_loss
  FROM events WHERE value IS NOT NULL GROUP BY user_id),
b AS (SELECT *, CASE WHEN n_logged >= 2 AND initial_loss <> 0
                     THEN (initial_loss - final_loss) / initial_loss * 100 END AS imp FROM a)
SELECT run, n_logged, initial_loss, final_loss, round(imp, 6) AS improvement_pct,
  CASE WHEN imp IS NULL THEN NULL WHEN imp > 10 THEN 'excellent' WHEN imp > 5 THEN 'good'
       WHEN imp > 0 THEN 'positive' ELSE 'diverging' END AS verdict
FROM b
""")
def convergence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", "value")
    c = REP.convergence(e, "run", "event_id", "value")
    return c.select("run", "n_logged", "initial_loss", "final_loss",
                    F.round("improvement_pct", 6).alias("improvement_pct"), "verdict")


@query("log_tail", "W5", sql="""
SELECT user_id, event_id, rank_from_end FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank_from_end
  FROM events) WHERE rank_from_end <= 10
""")
def log_tail(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return REP.log_tail(e, "user_id", "event_id", 10).select(
        "user_id", "event_id", F.col("rank_from_end").cast("bigint").alias("rank_from_end"))


# ------------------------------------------------------------- G10
def generations(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    turn = F.pmod(F.col("doc_id"), F.lit(3))
    role = F.when(turn == 0, "student").when(turn == 1, "baseline").otherwise("teacher")
    return d.select(role.alias("role"), F.col("doc_id").alias("prompt_id"), F.col("text").alias("generated"))


@query("teacher_student_report", "G10 A11 A12 A15", sql=f"""
WITH {LOSSES_SQL},
p AS (SELECT role, exp(sum(loss * n_tokens) / CAST(sum(n_tokens) AS DOUBLE)) AS perplexity,
             sum(loss * n_tokens) / CAST(sum(n_tokens) AS DOUBLE) AS loss, count(*) AS n_texts
      FROM losses GROUP BY role),
g AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'student' WHEN 1 THEN 'baseline' ELSE 'teacher' END AS role,
             avg(length(text)) AS avg_generation_length, count(*) AS n_generations
      FROM documents GROUP BY 1),
r AS (SELECT * FROM (VALUES ('student'), ('baseline'), ('teacher')) t(role)),
j AS (SELECT r.role, p.perplexity, p.loss, p.n_texts, g.avg_generation_length, g.n_generations
      FROM r LEFT JOIN p USING (role) LEFT JOIN g USING (role)),
b AS (SELECT max(CASE WHEN role = 'baseline' THEN perplexity END) AS bp,
             max(CASE WHEN role = 'baseline' THEN loss END) AS bl FROM j)
SELECT role, round(perplexity, 6) AS perplexity, round(loss, 6) AS loss, n_texts,
  round(avg_generation_length, 6) AS avg_generation_length, n_generations,
  round(CASE WHEN role = 'student' AND bp <> 0 AND perplexity <> 0 THEN (bp - perplexity) / bp * 100 END, 6)
    AS perplexity_improvement_pct,
  round(CASE WHEN role = 'student' AND bl <> 0 AND loss <> 0 THEN (bl - loss) / bl * 100 END, 6)
    AS loss_improvement_pct,
  CASE WHEN n_texts IS NULL THEN 'no texts' END AS error
FROM j, b
""")
def teacher_student_report(spark, sf_dir):
    losses = text_losses(spark, sf_dir).withColumn("text_id", F.lit(0))
    rep = REP.teacher_student_report(losses, generations(spark, sf_dir))
    return rep.select("role", F.round("perplexity", 6).alias("perplexity"), F.round("loss", 6).alias("loss"),
                      "n_texts", F.round("avg_generation_length", 6).alias("avg_generation_length"),
                      "n_generations", F.round("perplexity_improvement_pct", 6).alias("perplexity_improvement_pct"),
                      F.round("loss_improvement_pct", 6).alias("loss_improvement_pct"), "error")


@query("chatml_idempotent", "P10 (property over every user turn)", sql=f"""
WITH e AS (SELECT CASE WHEN starts_with(text, '<|im_start|>') THEN text
        ELSE {Q.lit(R.CHATML_USER)} || text || {Q.lit(R.CHATML_END_ASSISTANT)} END AS once FROM conversations WHERE role = 'user')
SELECT count(*) AS n_prompts,
  CAST(count_if((CASE WHEN starts_with(once, '<|im_start|>') THEN once
        ELSE {Q.lit(R.CHATML_USER)} || once || {Q.lit(R.CHATML_END_ASSISTANT)} END) = once) AS BIGINT) AS n_idempotent,
  CAST(count_if(starts_with(once, '<|im_start|>user' || chr(10))) AS BIGINT) AS n_wrapped
FROM e
""")
def chatml_idempotent(spark, sf_dir):
    turns = conversations(spark, sf_dir).filter(F.col("role") == "user")
    e = turns.select(R.ensure_chatml("text").alias("once"))
    return e.agg(F.count(F.lit(1)).alias("n_prompts"),
                 F.count_if(R.ensure_chatml("once") == F.col("once")).alias("n_idempotent"),
                 F.count_if(F.col("once").startswith(R.CHATML_USER)).alias("n_wrapped"))
