"""Revisits: derived captures, slices of hot URLs, repeated responses, empty tables."""

from collections import Counter

from pyspark.sql import functions as F

from tesserae.llm import warc

R = "record_id long, url string, at long, kind string, headers map<string,string>, payload_digest string, cuts int, tie string"


def test_slices_hold_about_as_many_records_each(spark):
    for n, cuts in ((16, list(range(10, 2500, 10))), (4, [3, 5, 9]), (3, []), (2, [7, 8, 9, 10])):
        df = spark.range(0, 2600).select(F.col("id").alias("at"), warc.time_slice(F.col("id"), cuts, n).alias("s"))
        got = {r["at"]: r["s"] for r in df.collect()}
        assert all(s == sum(c <= at for c in cuts) for at, s in got.items())


def test_a_burst_of_one_url_is_split(spark, monkeypatch):
    seen = []
    store = warc.stored
    monkeypatch.setattr(warc, "stored", lambda df, name: seen.append(store(df, name)) or seen[-1])
    rows = [(0, "http://h/x", 0, "response", {"ETag": "a"}, "d0", 1, "t")] + \
           [(i, "http://h/x", 10**9 + i, "revisit" if i % 10 else "response", {"ETag": "a"}, f"d{i}", 1, "t") for i in range(1, 2000)]
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, R)).collect()}
    assert all(r["response_id"] == i - i % 10 and r["outcome"] == "matched" for i, r in got.items()) and len(got) == 1800
    sizes = [r["count"] for r in seen[0].groupBy("slice").count().collect()]
    assert len(sizes) > 200 and max(sizes) <= 20


def test_repeated_responses_resolve_by_their_content(spark):
    rows = [(1, "http://h/x", 5, "response", {"ETag": t, "X": x}, d, 1, "t") for t, x, d in (("a", "1", "d1"), ("a", "2", "d2"), ("a", "3", "d2"))]
    rows += [(2, "http://h/x", 6, "revisit", {"ETag": "a"}, None, 1, "t")] * 2 + [(1, "http://h/x", 5, "revisit", {"ETag": "a"}, None, 1, "t")]
    for parts in (1, 4):
        got = [(r["record_id"], r["outcome"], r["payload_digest"], (r["headers"] or {}).get("x")) for r in
               warc.resolve_revisits(spark.createDataFrame(rows, R).repartition(parts)).collect()]
        assert sorted(got, key=str) == [(1, "no_response", None, None)] + [(2, "matched", "d2", "3")] * 2  # of one place in time is not earlier


def test_empty_and_null_records(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], R)).collect() == []
    rows = [(None, None, None, "revisit", None, None, 1, None), (None, "http://h/", None, None, None, None, 1, None), (1, "", 2, "revisit", {}, None, 1, None)]
    assert {r["outcome"] for r in warc.resolve_revisits(spark.createDataFrame(rows, R)).collect()} == {"no_response"}
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.resolve_revisits(warc.captures(pages)).collect() == []


def by_rule(records):
    """The captures' outcomes in plain Python, URL by URL."""
    low = lambda h: {k.lower(): v for k, v in h.items()}
    out, groups = {}, {}
    for r in records:
        groups.setdefault(r["canonical"], []).append(r)
    for rows in groups.values():
        last = None
        for r in sorted(rows, key=lambda r: (r["at"], r["record_id"])):
            if r["kind"] == "response":
                last = r
                continue
            if last is None:
                out[r["record_id"]] = (None, "no_response", None)
                continue
            mine, theirs = low(r["headers"]), low(last["headers"])
            verdict = "unverified"
            for k in ("etag", "last-modified"):
                if k in mine and k in theirs:
                    verdict = "matched" if mine[k].removeprefix("W/") == theirs[k].removeprefix("W/") else "mismatch"
                    break
            merged = theirs | {k: v for k, v in mine.items() if k not in warc.WITHHELD} if verdict == "matched" else None
            out[r["record_id"]] = (last["record_id"], verdict, merged)
    return out


def test_captures_of_pages_meet_every_outcome(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    records = warc.captures(pages).withColumn("canonical", warc.canonical_url(F.col("url")))
    rows = records.collect()
    n = pages.count()
    assert len(rows) == warc.CAPTURES * n == len({r["record_id"] for r in rows})
    got = {r["record_id"]: (r["response_id"], r["outcome"], r["headers"]) for r in warc.resolve_revisits(records).collect()}
    assert got == by_rule(rows)
    counts = Counter(o for _, o, _ in got.values())
    assert set(counts) == {"matched", "mismatch", "unverified", "no_response"} and min(counts.values()) > n / 20 and counts["matched"] > n
