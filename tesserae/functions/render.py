"""Prompt and chat rendering expressions (P4-P12), all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import py_strip

# ---------------------------------------------------------------------------
# FIXED VALUES (templates whose text must equal the reference's output)
PLAIN_ROLE_PREFIX = {"user": "Human: ", "assistant": "Assistant: ", "system": "System: "}
PLAIN_GENERATION_PROMPT = "Assistant:"
SINGLE_TURN = ("Human: ", "\n\nAssistant:")
CHATML_MARK = "<|im_start|>"
CHATML_USER = "<|im_start|>user\n"
CHATML_END_ASSISTANT = "<|im_end|>\n<|im_start|>assistant\n"
SECTION_QUESTION = "### 问题:\n"
SECTION_ANSWER = "\n\n### 回答:\n"
MATH_INSTRUCTION = "请解决这个数学问题，要求给出详细的解题步骤：\n\n"
CODE_INSTRUCTION = "请完成以下Python函数，要求代码简洁高效：\n\n```python\n"
CODE_INSTRUCTION_END = "\n```\n\n请直接给出完整的函数实现。"
INCIDENT_HEADER = "## 故障场景分析\n\n**系统日志:**"
INCIDENT_CONFIG = "\n**配置信息:**"
INCIDENT_METRICS = "\n**监控指标:**"
INCIDENT_QUESTION = "\n请分析上述日志和配置，找出最可能的根本原因，并给出具体的修复建议。"
# ---------------------------------------------------------------------------

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_messages(prompt, response=None) -> Column:
    """P5: ``[{user, prompt}]`` plus an assistant turn when the response is non-empty."""
    user = F.array(F.struct(F.lit("user").alias("role"), _col(prompt).alias("content")))
    if response is None:
        return user
    r = _col(response)
    assistant = F.array(F.struct(F.lit("assistant").alias("role"), r.alias("content")))
    return F.when(F.coalesce(F.length(r), F.lit(0)) > 0, F.concat(user, assistant)).otherwise(user)


def render_chat_plain(messages, add_generation_prompt: bool | Column = False) -> Column:
    """``Human:``/``Assistant:``/``System:`` lines; other roles are dropped."""
    def line(m):
        role = m["role"]
        prefix = (F.when(role == "user", F.lit(PLAIN_ROLE_PREFIX["user"]))
                  .when(role == "assistant", F.lit(PLAIN_ROLE_PREFIX["assistant"]))
                  .when(role == "system", F.lit(PLAIN_ROLE_PREFIX["system"])))
        return F.concat(prefix, F.coalesce(m["content"], F.lit("")), F.lit("\n"))

    kept = F.filter(_col(messages), lambda m: m["role"].isin("user", "assistant", "system"))
    body = F.array_join(F.transform(kept, line), "")
    flag = add_generation_prompt if isinstance(add_generation_prompt, Column) else F.lit(add_generation_prompt)
    return F.concat(body, F.when(flag, F.lit(PLAIN_GENERATION_PROMPT)).otherwise(F.lit("")))


def render_single_turn(prompt) -> Column:
    """``Human: {p}\\n\\nAssistant:``."""
    return F.concat(F.lit(SINGLE_TURN[0]), _col(prompt), F.lit(SINGLE_TURN[1]))


def render_chatml(instruction, input_text=None) -> Column:
    """ChatML user turn; a non-empty input goes on its own line."""
    ins = _col(instruction)
    if input_text is None:
        return F.concat(F.lit(CHATML_USER), ins, F.lit(CHATML_END_ASSISTANT))
    inp = _col(input_text)
    body = F.when(F.coalesce(F.length(inp), F.lit(0)) > 0, F.concat(ins, F.lit("\n"), inp)).otherwise(ins)
    return F.concat(F.lit(CHATML_USER), body, F.lit(CHATML_END_ASSISTANT))


def ensure_chatml(prompt) -> Column:
    """P10: wrap unless the text already starts with the ChatML marker (idempotent)."""
    p = _col(prompt)
    return F.when(p.startswith(CHATML_MARK), p).otherwise(render_chatml(p))


def render_sections(prompt, response) -> tuple[Column, Column]:
    """(full text, prompt-only prefix) with question/answer headings."""
    prefix = F.concat(F.lit(SECTION_QUESTION), _col(prompt), F.lit(SECTION_ANSWER))
    return F.concat(prefix, _col(response)), prefix


def training_response(teacher_response="teacher_response", expected_answer="expected_answer") -> Column:
    """Teacher response, else expected answer, else ``""`` (null = absent)."""
    return F.coalesce(_col(teacher_response), _col(expected_answer), F.lit(""))


def strip_response(c) -> Column:
    """Strip a decoded response."""
    return py_strip(c)


def math_prompt(question) -> Column:
    """P1 prompt: instruction, blank line, question."""
    return F.concat(F.lit(MATH_INSTRUCTION), _col(question))


def code_prompt(code) -> Column:
    """P2 prompt: the function stub inside a python fence."""
    return F.concat(F.lit(CODE_INSTRUCTION), _col(code), F.lit(CODE_INSTRUCTION_END))


def render_incident_prompt(logs, config_json, metrics_json) -> Column:
    """Header, one fenced block per log line, JSON blocks, closing question."""
    log_blocks = F.transform(_col(logs), lambda line: F.concat(F.lit("```\n"), line, F.lit("\n```")))
    parts = F.concat(
        F.array(F.lit(INCIDENT_HEADER)),
        log_blocks,
        F.array(F.lit(INCIDENT_CONFIG),
                F.concat(F.lit("```json\n"), _col(config_json), F.lit("\n```")),
                F.lit(INCIDENT_METRICS),
                F.concat(F.lit("```json\n"), _col(metrics_json), F.lit("\n```")),
                F.lit(INCIDENT_QUESTION)),
    )
    return F.array_join(parts, "\n")
