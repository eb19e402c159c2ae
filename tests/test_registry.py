"""Scorers by domain, chats in segments, top logits by threshold, subword encoders."""

import glob
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import logits as LG
from tesserae.functions import tokens as TK
from tesserae.operators import records as REC
from tesserae.operators import scoring as S
from tesserae.operators import tokens as TO


def test_a_fourth_domain_needs_no_edit_to_evaluate(spark, monkeypatch):
    monkeypatch.setattr(S, "SCORERS", dict(S.SCORERS))
    S.register_scorer("qa", S.Scorer(
        (lambda p, r, v: {"qa_match": S.exact_match_verdict(p, r)},),
        lambda: {"total_samples": F.count(F.lit(1)), "exact_match": F.avg(F.col("qa_match").cast("double")), "longest": F.max("qa_match").cast("double")},
        "exact_match", "exact"))
    df = spark.createDataFrame([("qa", " Yes", "yes", None), ("qa", "no", "yes", None), ("math", "#### 4", "#### 4", None), ("x", "a", "a", None)],
                               "domain string, prediction string, reference string, passed boolean")
    report = S.evaluate(df)
    got = {r["domain"]: r for r in report.collect()}
    assert got["qa"]["exact_match"] == 0.5 and got["qa"]["headline_metric"] == "exact" and got["qa"]["headline_text"] == "50.0%"
    assert got["math"]["exact_match"] == 1.0 and got["math"]["longest"] is None and not got["x"]["scored"]
    long = {(r["domain"], r["metric"]): r["value"] for r in S.long_report(report).collect()}
    assert long["qa", "longest"] == 1.0 and long["ALL", "total_samples"] == 3.0 and not any(d == "x" for d, _ in long)
    assert S.with_verdicts(df).filter("domain = 'math'").first()["qa_match"] is None


def test_a_chat_with_a_third_of_all_rows_becomes_bounded_rows(spark):
    turns = [("hot", i % 7, "user" if i % 2 else "assistant", f"t{i}") for i in range(1000)] + [("c", 0, "tool", None), ("c", 1, "system", None)] + \
            [(None, 5, "user", "x")] + [(f"c{i}", j, "user", f"{i}-{j}") for i in range(100) for j in range(20)]
    df = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string").repartition(5)
    out = REC.chat_segments(df, turns_per_segment=64)
    rows = out.collect()
    assert max(r["n_messages"] for r in rows) == 64 and sum(r["n_messages"] for r in rows) == len(turns)
    hot = sorted((r for r in rows if r["conv_id"] == "hot"), key=lambda r: r["segment"])
    assert [r["segment"] for r in hot] == list(range(16))
    contents = [m["content"] for r in hot for m in r["messages"]]
    assert sorted(contents) == sorted(t[3] for t in turns if t[0] == "hot")
    number = {t[3]: t[1] for t in turns}
    assert [number[c] for c in contents] == sorted(number[c] for c in contents)
    assert "".join(r["rendered"] for r in hot).count("\n") == 1000
    c = next(r for r in rows if r["conv_id"] == "c")
    assert c["rendered"] == "System: \n" and [m["role"] for m in c["messages"]] == ["tool", "system"]
    whole = {r["conv_id"]: r["rendered"] for r in REC.render_chats_plain(df.filter("conv_id LIKE 'c%'"), add_generation_prompt=False).collect()}
    cut = {}
    for r in sorted((r for r in rows if (r["conv_id"] or "").startswith("c")), key=lambda r: r["segment"]):
        cut[r["conv_id"]] = cut.get(r["conv_id"], "") + r["rendered"]
    assert cut == whole
    # grouped by (conversation, segment), never by the conversation alone
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in p and all("segment" in x for x in p.split("\n") if "collect_list" in x)


@pytest.mark.parametrize("v, k", [(3, 20), (20, 20), (80, 20), (81, 20), (1000, 20), (5000, 1), (777, 7)])
def test_top_k_equals_a_sort(spark, v, k):
    rng = np.random.default_rng(v)
    rows = [rng.normal(size=v), np.round(rng.normal(size=v)), np.zeros(v), np.arange(v), -np.arange(v), np.where(rng.random(v) < 0.5, -0.0, 0.0)]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "i int, x array<double>")
    for r in df.select("i", LG.top_k("x", k).alias("t")).collect():
        x = rows[r["i"]]
        want = np.lexsort((np.arange(v), -x))[:k]
        assert [t["index"] for t in r["t"]] == want.tolist()
        assert [t["value"] for t in r["t"]] == [x[i] for i in want]


def test_top_k_of_odd_arrays(spark):
    df = spark.createDataFrame([([None, 1.0, float("nan"), 2.0, float("-inf")],), ([],), (None,)], "x array<double>")
    got = [r[0] for r in df.select(LG.top_k("x", 2)).collect()]
    assert [[t["index"] for t in g] for g in got[:2]] == [[3, 1], []] and not got[2]


def test_top_k_time_grows_linearly(spark):
    def seconds(v, n):
        df = spark.range(n, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(v)), lambda i: F.hash(i, F.col("id")).cast("double")).alias("x"))
        df = spark.createDataFrame(df.collect(), df.schema).coalesce(1).cache()
        df.count()
        run = lambda: df.select(F.sum(LG.top_k("x", 20)[0]["value"])).collect()
        run()
        t = time.time()
        run()
        return time.time() - t

    assert seconds(50_000, 40) < 3 * seconds(10_000, 200) + 0.5  # as many logits


def vocabulary_path():
    found = glob.glob(os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "word_bpe_*.json"))
    if not found:
        pytest.skip("no tokenizer file")
    return found[0]


def test_subword_examples_uncut(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    own = Tokenizer.from_file(path)
    ids = lambda t: own.encode(t, add_special_tokens=False).ids
    rows = [("What is tokenisation?", "Cutting text " * 900), ("é 数据", None), ("", ""), ("p", "r")]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "id string, prompt string, response string")
    tok = TK.subword_tokenizer(spark, path)
    ex = TO.supervised_examples(df, tokenizer=tok)
    plan = ex._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("encode_batches(") <= 6  # both encodings in one pass over the rows
    from tesserae.functions import render as R
    text, prefix = (df.select("id", c.alias("t")).collect() for c in R.render_sections(F.col("prompt"), F.coalesce("response", F.lit(""))))
    text, prefix = ({r["id"]: r["t"] for r in x} for x in (text, prefix))
    for r in ex.collect():
        want, n = ids(text[r["id"]]), len(ids(prefix[r["id"]]))
        assert r["input_ids"] == want and r["full_len"] == len(want) and r["prompt_len"] == n
        assert r["labels"] == [-100] * min(n, len(want)) + want[n:] and r["attention_mask"] == [1] * len(want)
    assert max(r["full_len"] for r in ex.collect()) > 1500
    cut = TO.supervised_examples(df, max_length=5, tokenizer=tok)
    assert {len(r["input_ids"]) for r in cut.collect()} <= {0, 1, 2, 3, 4, 5} and cut.agg(F.max("full_len")).first()[0] > 1500
    padded = TO.pad_batches(ex.withColumn("batch_id", F.lit(0)))
    assert padded.select(F.size("input_ids")).distinct().count() == 1
    assert padded.filter(TK.true_length("attention_mask") != F.col("full_len")).count() == 0
    prompts = {r["prompt"]: r["input_ids"] for r in TO.prompt_only_examples(df, tokenizer=tok).collect()}
    assert prompts["p"] == ids(R.CHATML_USER + "p" + R.CHATML_END_ASSISTANT)
    prof = TO.length_profile(ex.withColumn("batch_id", F.lit(0)), "full_len", [4, 100_000]).collect()
    assert {r["max_length"]: r["truncation_rate"] for r in prof}[100_000] == 0


def test_a_missing_id_is_the_index_of_the_content(spark):
    rows = [(f"p{i % 5}", f"r{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "prompt string, response string")
    a, b = ({(r["prompt"], r["response"]): r["id"] for r in TO.supervised_examples(x, domain_col=None).collect()} for x in (df, df.repartition(7)))
    assert a == b and sorted(a.values(), key=int) == [str(i) for i in range(40)]


def test_template_gaps_lose_no_rows(spark):
    spark_rows = REC.incident_templates(spark).collect()
    gappy = spark.createDataFrame([(10 * i + 3, *tuple(r)[1:]) for i, r in enumerate(spark_rows)], REC.TEMPLATE_SCHEMA)
    driver = spark.range(200).withColumnRenamed("id", "i")
    got = sorted(tuple(r) for r in REC.synthesize_incidents(driver, "i", 42, gappy).select("id", "prompt").collect())
    assert got == sorted(tuple(r) for r in REC.synthesize_incidents(driver, "i", 42).select("id", "prompt").collect())
    with pytest.raises(ValueError, match="repeated"):
        REC.synthesize_incidents(driver, "i", 42, gappy.unionAll(gappy))


def test_merge_refuses_null_ids_and_breaks_ties(spark):
    from tesserae.sources.jsonl import merge_frames

    rows = [(1, "a", 0), (1, "b", 0), (2, "c", 0), (2, "a", 1)]
    df = spark.createDataFrame(rows, "id long, v string, shard int")
    for parts in (1, 5):
        assert sorted(tuple(r) for r in merge_frames([df.repartition(parts)], "id", "shard").collect()) == [(1, "b", 0), (2, "a", 1)]
    with pytest.raises(Exception, match="null ids in column id"):
        merge_frames([df, spark.createDataFrame([(None, "x", 2)], df.schema)], "id", "shard").collect()


def test_blank_eval_lines_of_any_whitespace_are_refused(spark, tmp_path):
    from tesserae.sources import jsonl as J

    p = tmp_path / "e.jsonl"
    p.write_text(json.dumps({"prompt": "p"}) + "\n\t 　\n", encoding="utf-8")
    with pytest.raises(Exception, match="blank line"):
        J.load_eval_records(spark, str(p))[0].collect()


def test_how_sources_are_split_changes_no_corpus(spark, tmp_path):
    from tesserae import jobs

    math = [{"question": f"q{i}", "answer": f"#### {i}"} for i in range(80)]
    code = [{"task_id": f"T/{i}", "prompt": f"def f{i}(x):", "canonical_solution": "s", "test": "t", "entry_point": f"f{i}"} for i in range(12)]
    seen = []
    for k, (m, c) in enumerate(((math, code), (math[::-1], code[5:] + code[:5]))):
        for name, rows in (("math", m), ("code", c)):
            (tmp_path / f"{name}{k}.json").write_text(json.dumps(rows))
        jobs.prepare_corpus(spark, str(tmp_path / f"math{k}.json"), str(tmp_path / f"code{k}.json"), str(tmp_path / f"out{k}"), 20, 5, 10)
        seen.append(sorted(line for p in (tmp_path / f"out{k}").rglob("part-*.json") for line in p.read_text().splitlines()))
    assert seen[0] == seen[1] and sum('"code"' in x for x in seen[0]) == 5
    assert {json.loads(x)["id"] for x in seen[0] if '"code"' in x} == {f"humaneval_T/{i}" for i in range(5)}  # T/2 before T/10
