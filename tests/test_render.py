from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import render as R


def test_plain_chat_drops_unknown_roles(spark):
    msgs = [("system", "s"), ("user", "u"), ("tool", "t"), ("assistant", "a")]
    df = spark.createDataFrame([(msgs,)], "m array<struct<role:string,content:string>>")
    got = df.select(R.render_chat_plain("m", True)).first()[0]
    assert got == "System: s\nHuman: u\nAssistant: a\nAssistant:"
    assert df.select(R.render_chat_plain("m", False)).first()[0] == "System: s\nHuman: u\nAssistant: a\n"


def test_chatml_and_idempotence(spark):
    df = spark.createDataFrame([("q", ""), ("q", "in")], "i string, x string")
    got = [r[0] for r in df.select(R.render_chatml("i", "x")).collect()]
    assert got == ["<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n",
                   "<|im_start|>user\nq\nin<|im_end|>\n<|im_start|>assistant\n"]
    once = df.select(R.render_chatml("i", "x").alias("c"))
    assert [r[0] for r in once.select(R.ensure_chatml("c")).collect()] == got


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=30))
def test_ensure_chatml_idempotent(spark, s):
    df = spark.createDataFrame([(s,)], "p string")
    once = df.select(R.ensure_chatml("p").alias("p"))
    twice = once.select(R.ensure_chatml("p").alias("p"))
    assert once.first()[0] == twice.first()[0]


def test_training_response_and_messages(spark):
    df = spark.createDataFrame([("", "e"), (None, "e"), (None, None)], "t string, e string")
    assert [r[0] for r in df.select(R.training_response("t", "e")).collect()] == ["", "e", ""]
    m = spark.createDataFrame([("p", "r"), ("p", ""), ("p", None)], "p string, r string")
    sizes = [r[0] for r in m.select(F.size(R.to_messages("p", "r"))).collect()]
    assert sizes == [2, 1, 1]


def test_single_turn_and_sections(spark):
    df = spark.createDataFrame([("q", "a")], "p string, r string")
    text, prefix = R.render_sections(F.col("p"), F.col("r"))
    row = df.select(R.render_single_turn("p"), text, prefix).first()
    assert row[0] == "Human: q\n\nAssistant:"
    assert row[1] == "### 问题:\nq\n\n### 回答:\na"
    assert row[2] == "### 问题:\nq\n\n### 回答:\n"


def test_incident_prompt_layout(spark):
    from tesserae.operators.records import INCIDENT_TEMPLATES
    import json

    t = INCIDENT_TEMPLATES[0]
    df = spark.createDataFrame([(t["logs"], t["config_json"], t["metrics_json"])],
                               "logs array<string>, c string, m string")
    got = df.select(R.render_incident_prompt("logs", "c", "m")).first()[0]
    parts = ["## 故障场景分析\n\n**系统日志:**"] + [f"```\n{x}\n```" for x in t["logs"]] + [
        "\n**配置信息:**", f"```json\n{t['config_json']}\n```", "\n**监控指标:**",
        f"```json\n{t['metrics_json']}\n```",
        "\n请分析上述日志和配置，找出最可能的根本原因，并给出具体的修复建议。"]
    assert got == "\n".join(parts)
    # stored JSON is what an indent-2, non-ASCII-preserving dump produces
    assert json.dumps(json.loads(t["config_json"]), ensure_ascii=False, indent=2) == t["config_json"]


def test_chunked_chat_render_equals_array_render(spark):
    from tesserae.operators import records as REC

    rows = [(1, t, ["user", "assistant", "system", "tool"][t % 4], f"m{t}") for t in range(11)] + \
           [(2, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a = {r[0]: r[1] for r in REC.render_chats_plain(df, turns_per_chunk=3).select("conv_id", "rendered").collect()}
    chats = REC.collect_chat(df)
    b = {r[0]: r[1] for r in chats.select("conv_id", R.render_chat_plain("messages", True)).collect()}
    assert a == b
