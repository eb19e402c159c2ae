import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tesserae.sources import jsonl as J

SCHEMA = "id string, prompt string, n long"


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_jsonl_edge_rows(spark):
    d = tempfile.mkdtemp(prefix="tesserae-io-")
    p = os.path.join(d, "a.jsonl")
    _write(p, '{"id": "1", "prompt": "héllo 数据", "n": 1}\n\n   \n{"id": "2", "extra": 5}\n'
              '{"id": "3", "prompt": null, "n": 3}\n')
    rows = sorted(tuple(r) for r in J.read_jsonl(spark, p, SCHEMA).collect())
    assert rows == [("1", "héllo 数据", 1), ("2", None, None), ("3", None, 3)]
    bad = os.path.join(d, "b.jsonl")
    _write(bad, '{"id": "1"}\n{not json}\n')
    with pytest.raises(Exception):
        J.read_jsonl(spark, bad, SCHEMA).collect()


def test_write_round_trip_keeps_nulls_and_unicode(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="tesserae-io-"), "out")
    df = spark.createDataFrame([("1", "数据", None)], SCHEMA)
    J.write_jsonl(df, out)
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read() for f in os.listdir(out)
                   if f.endswith(".json"))
    assert '"n":null' in text and "数据" in text
    assert [tuple(r) for r in J.read_jsonl(spark, out, SCHEMA).collect()] == [("1", "数据", None)]


def test_json_array(spark):
    d = tempfile.mkdtemp(prefix="tesserae-io-")
    p = os.path.join(d, "raw.json")
    _write(p, json.dumps([{"id": "1", "prompt": "q"}, {"id": "2", "prompt": "r"}], indent=2))
    assert J.read_json_array(spark, p, SCHEMA).count() == 2


def test_merge_shards_one_row_per_id(spark):
    d = tempfile.mkdtemp(prefix="tesserae-io-")
    a, b = os.path.join(d, "a.jsonl"), os.path.join(d, "b.jsonl")
    _write(a, '{"id": "1", "prompt": "old", "n": 1}\n{"id": "2", "prompt": "x", "n": 2}\n')
    _write(b, '{"id": "1", "prompt": "new", "n": 1}\n{"id": "3", "prompt": "y", "n": 3}\n')
    merged = J.merge_shards(spark, [a, b, os.path.join(d, "missing.jsonl")], SCHEMA, os.path.join(d, "out"))
    got = {r["id"]: r["prompt"] for r in merged.collect()}
    assert got == {"1": "new", "2": "x", "3": "y"}
    assert os.path.exists(a) and os.path.exists(b)


def test_load_eval_records_shapes(spark):
    d = tempfile.mkdtemp(prefix="tesserae-io-")
    p = os.path.join(d, "eval.jsonl")
    _write(p, '{"prompt": "p1", "teacher_response": "t"}\n{"prompt": "p2", "original_answer": "o"}\n'
              '{"prompt": "p3", "teacher_response": null}\n{"instruction": "i", "input": "x", "expected_answer": "e"}\n'
              '{"other": 1}\n')
    acc, rej = J.load_eval_records(spark, p)
    got = sorted((r["instruction"], r["input"], r["expected_answer"]) for r in acc.collect())
    assert got == [("i", "x", "e"), ("p1", "", "t"), ("p2", "", "o"), ("p3", "", "")]
    assert rej.count() == 1
    blank = os.path.join(d, "blank.jsonl")
    _write(blank, '{"prompt": "p"}\n\n')
    with pytest.raises(Exception, match="blank line"):  # one scan: raised where the line is read
        J.load_eval_records(spark, blank)[0].count()
    default = spark.createDataFrame([("q", "", "")], "instruction string, input string, expected_answer string")
    got_default, _ = J.load_eval_records(spark, os.path.join(d, "nope.jsonl"), default)
    assert got_default.count() == 1


def test_detailed_results_and_report(spark):
    from tesserae.operators.scoring import evaluate

    d = tempfile.mkdtemp(prefix="tesserae-io-")
    rows = [("math", "#### 4", "#### 4", None), ("code", "x", None, True)]
    df = spark.createDataFrame(rows, "domain string, prediction string, reference string, passed boolean")
    J.write_detailed_results(df, os.path.join(d, "detail"))
    assert {"domain=code", "domain=math"} <= set(os.listdir(os.path.join(d, "detail")))
    rep = J.write_report(evaluate(df), os.path.join(d, "report"), {"temperature": 0.1})
    r = rep.first()
    assert r["total_samples"] == 2 and set(r["domain_results"].keys()) == {"math", "code"}
