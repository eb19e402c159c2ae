from pyspark.sql import functions as F

from tesserae.functions import tokens as TK
from tesserae.operators import tokens as TO


def test_mask_prompt(spark):
    df = spark.createDataFrame([([7, 8, 9],)], "ids array<int>")
    assert df.select(TK.mask_prompt("ids", 2)).first()[0] == [-100, -100, 9]
    assert df.select(TK.mask_prompt("ids", 5)).first()[0] == [-100, -100, -100]


def test_pad_batch(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [1, 1, 1], [-100, 2, 3]), (0, [5], [1], [5])],
                               "batch_id int, input_ids array<int>, attention_mask array<int>, labels array<int>")
    got = {tuple(r["input_ids"]): r for r in TO.pad_batches(df).collect()}
    r = got[(5, 0, 0)]
    assert r["attention_mask"] == [1, 0, 0] and r["labels"] == [5, -100, -100] and r["width"] == 3


def test_supervised_examples_properties(spark):
    df = spark.createDataFrame([("what is two plus two", "four"), ("hi", None), ("a " * 50, "b " * 50)],
                               "prompt string, response string")
    ex = TO.supervised_examples(df, max_length=64, domain_col=None)
    for r in ex.collect():
        n = len(r["input_ids"])
        assert len(r["labels"]) == n == len(r["attention_mask"]) and n <= 64
        masked = sum(1 for x in r["labels"] if x == -100)
        assert masked == min(r["prompt_len"], n)
        assert masked + sum(1 for x in r["labels"] if x != -100) == n
        assert r["domain"] == "unknown"


def test_tokenizer_deterministic(spark):
    df = spark.createDataFrame([("a b  a　c",)], "t string")
    ids = df.select(TK.encode("t")).first()[0]
    assert len(ids) == 4 and ids[0] == ids[2] and all(0 < i < 32000 for i in ids)


def test_prompt_only(spark):
    df = spark.createDataFrame([("hello world",)], "prompt string")
    r = TO.prompt_only_examples(df).first()
    assert r["labels"] == r["input_ids"]


def test_true_length(spark):
    df = spark.createDataFrame([([1, 1, 0],)], "m array<int>")
    assert df.select(TK.true_length("m"), TK.cut_to(F.array(F.lit(4), F.lit(5), F.lit(6)), TK.true_length("m"))).first() \
        == (2, [4, 5])
