"""Not-modified revisits: an as-of join to the latest earlier full response of the same canonical URL.

The join is a window in time order within (URL, time slice), and a second one
over the slices' last responses, so a URL that holds a large part of all
records is split by time and no task gets all of it.  Slices are cut at
quantiles of the times, so they hold about as many records each, however
the times are spread; records of one time are in one slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import lower_ascii, stored

#: Time slices, of about as many records each: SLICES coarse ones of as many fine ones.
SLICES = 16
#: Header fields of a 304 that describe its own (absent) body or the connection, and so never replace stored ones.
WITHHELD = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type",
            "keep-alive", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, path without a closing slash, query without ``utm_`` fields, sorted; no scheme or fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"#[\s\S]*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(lower_ascii(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?([\s\S]*)$", 1)
    fields = F.array_sort(F.filter(F.split(query, "&", -1), lambda f: (f != "") & ~f.startswith("utm_")))
    return F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit("")))


def header_map(headers: Column) -> Column:
    """Lower-case names; of a repeated name the last value; null is no header."""
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(pairs, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda e: F.lower(e["key"]) == k), -1)["value"]))


def merged_headers(stored_headers: Column, update: Column) -> Column:
    """The stored response's headers with the permitted ones of the 304 in their place."""
    new = F.map_filter(update, lambda k, v: ~k.isin(*WITHHELD))
    return F.map_concat(F.map_filter(stored_headers, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def time_slice(at: Column, cuts: list[int], n: int = SLICES) -> Column:
    """The number of ``cuts`` (rising) up to ``at``: first among every n-th, then among the n behind it."""
    if not cuts:
        return F.lit(0)
    upto = lambda values: F.size(F.filter(values, lambda c: c <= at))
    numbers = lambda values: F.array(*[F.lit(v).cast("long") for v in values]).cast("array<long>")
    parts = [cuts[i:i + n] for i in range(0, len(cuts), n)]
    coarse = F.greatest(upto(numbers([p[0] for p in parts])) - 1, F.lit(0))
    return coarse * n + upto(F.element_at(F.array(*[numbers(p) for p in parts]), coarse + 1))


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per revisit: ``record_id, canonical_url, response_id, outcome, headers, payload_digest``.

    ``records``: ``record_id, url, at`` (long), ``kind`` (``response`` or
    ``revisit``; others are left out), ``headers`` (map), ``payload_digest``.
    Earlier means a smaller (at, record_id).  Outcomes: ``matched`` (equal
    ETags by weak comparison or, where one side has none, equal Last-Modified),
    ``mismatch``, ``unverified`` (nothing to compare), ``no_response`` (none
    earlier, a null url or a null time).  Headers and digest are those of the
    stored response, updated by the 304's permitted headers, when matched, else
    null.  A repeated revisit row gives a row each; of responses of equal (at,
    record_id) the one of the largest digest, then of the largest headers' text,
    counts as the last.  No records, no rows."""
    h = header_map(F.col("headers"))
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", F.when(F.col("url").isNotNull(), canonical_url(F.col("url"))).alias("canonical_url"),
        F.col("at").cast("long").alias("at"), (F.col("kind") == "revisit").alias("revisit"), h.alias("headers"),
        F.col("payload_digest"))
    points = [i / slices**2 for i in range(1, slices**2)]
    cuts = sorted(set(rows.agg(F.percentile_approx("at", points, 10_000)).first()[0] or [])) if points else []
    rows = rows.withColumn("slice", time_slice(F.col("at"), cuts, slices))
    full = F.when(~F.col("revisit") & F.col("at").isNotNull(),
                  F.struct("record_id", "headers", "payload_digest"))
    tie = F.struct(F.col("payload_digest").alias("d"), F.array_join(F.array_sort(F.transform(
        F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("\n"), e["value"]))), "\n").alias("h"))
    rows = stored(rows.withColumn("full", full).withColumn("tie", tie), "captures")
    usable = rows.where("canonical_url IS NOT NULL AND at IS NOT NULL")
    near = Window.partitionBy("canonical_url", "slice").orderBy("at", "record_id", F.desc("revisit"), "tie").rowsBetween(Window.unboundedPreceding, -1)
    close = usable.withColumn("found", F.last("full", ignorenulls=True).over(near)).where("revisit")
    lasts = usable.groupBy("canonical_url", "slice").agg(
        F.max(F.when(F.col("full").isNotNull(), F.struct("at", "record_id", "tie"))).alias("key"))
    lasts = lasts.join(usable.where("full IS NOT NULL").select("canonical_url", "slice", F.struct("at", "record_id", "tie").alias("key"), "full")
                       .dropDuplicates(["canonical_url", "slice", "key"]), ["canonical_url", "slice", "key"], "left")
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("canonical_url", "slice", F.last("full", ignorenulls=True).over(before).alias("carried"))
    resolved = close.join(carried, ["canonical_url", "slice"], "left").withColumn("found", F.coalesce("found", "carried"))
    lost = rows.where("revisit AND (canonical_url IS NULL OR at IS NULL)").withColumn("found", F.lit(None).cast(rows.schema["full"].dataType))
    resolved = resolved.drop("carried").unionByName(lost)
    etag = lambda m: F.regexp_replace(F.try_element_at(m, F.lit("etag")), "^W/", "")
    changed = lambda m: F.try_element_at(m, F.lit("last-modified"))
    mine, theirs = F.col("headers"), F.col("found.headers")
    verdict = (F.when(F.col("found").isNull(), "no_response")
               .when(etag(mine).isNotNull() & etag(theirs).isNotNull(), F.when(etag(mine) == etag(theirs), "matched").otherwise("mismatch"))
               .when(changed(mine).isNotNull() & changed(theirs).isNotNull(),
                     F.when(changed(mine) == changed(theirs), "matched").otherwise("mismatch"))
               .otherwise("unverified"))
    ok = F.col("outcome") == "matched"
    return resolved.withColumn("outcome", verdict).select(
        "record_id", "canonical_url", F.col("found.record_id").alias("response_id"), "outcome",
        F.when(ok, merged_headers(theirs, mine)).alias("headers"), F.when(ok, F.col("found.payload_digest")).alias("payload_digest"))


#: Captures of a page, and how much later each is than the one before (page ids are the first ones' times).
CAPTURES, LATER = 5, 100_003


def captures(pages: DataFrame) -> DataFrame:
    """Capture records from ``pages``: CAPTURES of every page, at times far apart.

    First a full response (for a seventh of the pages a revisit, which then has
    none before it), then revisits; the third capture is by the page id a
    revisit with another validator, one without any, a new full response, or a
    revisit by Last-Modified.  Later ones carry the validator of the last
    response.  Records are numbered ``page_id * CAPTURES + capture``; a null
    page id gives records without number or time."""
    i, kind = F.col("page_id"), F.col("page_id") % 4
    base = pages.select("page_id", "url", F.md5("html").alias("digest"), F.length("html").cast("string").alias("size"),
                        F.substring(F.md5(canonical_url(F.col("url"))), 1, 8).alias("name"))
    rows = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(CAPTURES - 1))))
    j = F.col("j")
    response = ((j == 0) & (F.coalesce(i % 7, F.lit(0)) != 3)) | ((j == 2) & (kind == 2))
    version = F.when((kind == 2) & (j >= 2), "1").otherwise("0")
    seen = F.when((j == 2) & (kind == 0), "other").otherwise(version)  # what this capture's validator says
    tag = F.concat(F.lit('"'), "name", F.lit("-"), seen, F.lit('"'))
    tag = F.when(response, tag).otherwise(F.concat(F.lit("W/"), tag))
    day = F.concat(F.lit("day "), seen)
    dated = kind == 3  # these pages have no ETag
    bare = ~response & (j == 2) & (kind == 1)
    pairs = F.array(F.struct(F.lit("Date").alias("k"), F.concat(F.lit("day "), F.coalesce(i, F.lit(0)).cast("string"), F.lit("."), j.cast("string")).alias("v")),
                    F.struct(F.lit("Content-Length").alias("k"), F.when(response, F.col("size")).otherwise("0").alias("v")),
                    F.struct(F.when(response, "Content-Type").otherwise("Cache-Control").alias("k"), F.when(response, "text/html").otherwise("max-age=60").alias("v")),
                    F.struct(F.when(bare, "X-Bare").when(dated, "Last-Modified").otherwise("ETag").alias("k"), F.when(bare, "yes").when(dated, day).otherwise(tag).alias("v")))
    return rows.select((i * CAPTURES + j).alias("record_id"), "url", (i + j * LATER).alias("at"), F.when(response, "response").otherwise("revisit").alias("kind"),
                       F.map_from_entries(pairs).alias("headers"), F.when(response, F.concat("digest", F.lit("-"), version)).alias("payload_digest"))
