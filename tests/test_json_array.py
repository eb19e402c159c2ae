"""S3: files of one JSON array, read by several tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tesserae.sources import json_array as A
from tesserae.sources import jsonl as J

SCHEMA = "id long, text string, inner struct<a:string,list:array<struct<b:string>>>, none string"
TEXTS = ["plain", "a } b { c ] [", 'quote " and \\ back', "\\\\", '\\"}', "{}", "数据 é 😀", "", "line\nbreak\ttab", '"}', "}" * 9, "x" * 300]


def records(n, seed=1):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(TEXTS) for _ in range(rng.randint(0, 4)))
    return [{"id": i, "text": text(), "inner": {"a": text(), "list": [{"b": text()} for _ in range(rng.randint(0, 3))]}, "extra": [[{}], {"z": "]"}]}
            for i in range(n)]


def flat(r):
    return r["id"], r["text"], r["inner"]["a"], tuple(x["b"] for x in r["inner"]["list"])


def read(spark, path, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        elements = A.array_elements(spark, path)
        rows = J.read_json_array(spark, path, SCHEMA).collect()
        return [flat(r) for r in rows], spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions(), elements.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("indent, unicode", [(None, True), (2, False)])
@pytest.mark.parametrize("size", ["97b", "1k", "20k"])
def test_arrays_read_in_splits(spark, tmp_path, indent, unicode, size):
    path = str(tmp_path / "raw.json")
    data = records(60)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=indent, ensure_ascii=unicode)
    rows, tasks, n = read(spark, path, size)
    assert sorted(rows) == sorted(flat(r) for r in data) and n == 60
    assert tasks > 1 or size == "20k"


def test_several_files_empty_arrays_and_long_objects(spark, tmp_path):
    data = records(20, 3)
    data[7]["text"] = "long } " * 5000  # one object over many splits
    for i, part in enumerate((data[:9], [], data[9:])):
        (tmp_path / f"{i}.json").write_text(("\n " if i else "") + json.dumps(part) + "\n", encoding="utf-8")
    rows, _, n = read(spark, str(tmp_path), "500b")
    assert sorted(rows) == sorted(flat(r) for r in data) and n == 20


@pytest.mark.parametrize("text", ['[{"id": 1}', '{"id": 1}]', '[{"id": 1}, 5]', '[{"id": 1}, "x"]', '[{"id": "x}]', '[{"id": 1}]]', '[{"id": [}]'])
def test_what_is_no_array_of_objects_is_an_error(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception):
        J.read_json_array(spark, str(path), "id long").collect()


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, t, (t, [(t,)]), None) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    path = str(tmp_path / "out")
    J.write_json_array(df, path)
    files = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert sum(len(json.loads(p.read_text(encoding="utf-8"))) for p in files) == len(TEXTS)  # each file is an array
    back = J.read_json_array(spark, path, SCHEMA)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    J.write_json_array(df.limit(0), str(tmp_path / "none"))
    assert J.read_json_array(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_only_parts_of_crossing_elements_are_shuffled(spark, tmp_path):
    path = str(tmp_path / "raw.json")
    with open(path, "w") as f:
        json.dump([{"id": i, "text": "t" * 50} for i in range(2000)], f)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        raw = A.array_elements(spark, path)
        assert raw.agg(F.countDistinct("text")).first()[0] == 2000
        plan = raw._jdf.queryExecution().optimizedPlan().toString()
        # the only grouping is of named parts; whole elements go past it
        assert plan.count("Aggregate") == 1 and "isnotnull(element" in plan.split("Aggregate", 1)[1] and "isnull(element" in plan.split("Aggregate", 1)[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Exception, match="splits|array"):  # read with other splits than were scanned
        raw.collect()
