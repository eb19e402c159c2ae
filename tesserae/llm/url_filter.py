"""URL filter: rules first, then the ratio of two variable-order character models.

The models are Markov models of the accepted and the rejected URLs (those that
a rule decides) over the characters themselves.  A character is predicted from
the up to ORDER characters before it; each context backs off to the next
shorter one by Witten-Bell interpolation, down to single characters, with room
for characters never seen.  The counts are a table that grows with the URLs and
is joined by shuffles; only a few totals pass the driver.  The score of a URL is
the mean log-likelihood difference of its characters.  The cut is calibrated on
decided URLs that were left out of the counts (a fifth, by hash): it lies between
the two classes' means there, in proportion to their spreads.
Everything is DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import lower_ascii, stored

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Characters of context; signs before the first character and behind the last (URLs hold no control characters).
ORDER, START, END = 5, "\x02", "\x03"
#: One decided URL in so many is left out of the counts and calibrates the cut.
HELD = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its string and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest comes first in the end
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def symbols(host: Column, path: Column) -> Column:
    """The text that the models see: ORDER starts, the characters of host and path, end."""
    return F.concat(F.lit(START * ORDER), host, path, F.lit(END))


def left_out(s: Column) -> Column:
    """Texts that calibrate the cut instead of being counted."""
    return F.crc32(s) % HELD == 0


def _grams(rows: DataFrame) -> DataFrame:
    """The rows with each character behind its ORDER characters of context."""
    at = F.explode(F.sequence(F.lit(1), F.length("s") - ORDER)).alias("i")
    return rows.select("*", at).withColumn("gram", F.expr(f"substring(s, i, {ORDER + 1})")).drop("i")


def _suffixes(rows: DataFrame) -> DataFrame:
    """``rows`` of ``gram`` with each of its suffixes: the character behind ``k`` = 0 to ORDER characters."""
    k = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")
    return rows.select("*", k).withColumn("hx", F.expr(f"substring(gram, {ORDER + 1} - k, k + 1)")).withColumn("h", F.expr("substring(hx, 1, k)"))


def _ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``gram, ratio``: the log-likelihood difference of every wanted gram's last character.

    ``counts``: ``gram, good, bad``.  The counts of all suffixes are one table, and
    those of their contexts another; each wanted gram is joined with the rows of
    its suffixes and folded from the shortest to the longest.  The context of no
    character, which all share, is a row of totals instead."""
    seen = stored(_suffixes(counts).groupBy("hx", "h", "k").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "suffixes")
    contexts = seen.where("k > 0").groupBy("h").agg(*[F.sum(c).alias(f"{c}_all") for c in ("good", "bad")],
                                                    *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("good", "bad")])
    totals = seen.where("k = 0").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count("*").alias("kinds")).first()
    rows = _suffixes(wanted.select("gram").distinct())
    # rows without context look for none: the gram, longer than any context, spreads them
    rows = rows.withColumn("h", F.when(F.col("k") == 0, F.col("gram")).otherwise(F.col("h")))
    rows = rows.join(seen.select("hx", "good", "bad"), "hx", "left").join(contexts, "h", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    fields = F.struct("k", *[zero(f"{c}{x}") for c in ("good", "bad") for x in ("", "_all", "_kinds")])
    folded = rows.groupBy("gram").agg(F.array_sort(F.collect_list(fields)).alias("f"))  # ORDER + 1 entries each

    def probability(c: str) -> Column:
        def step(p: Column, f: Column) -> Column:
            lower = (f[c] + 0.5) / F.lit(float((totals[c] or 0) + 0.5 * (totals["kinds"] + 1)))
            higher = F.when(f[f"{c}_all"] == 0, p).otherwise((f[c] + f[f"{c}_kinds"] * p) / (f[f"{c}_all"] + f[f"{c}_kinds"]))
            return F.when(f["k"] == 0, lower).otherwise(higher)
        return F.aggregate("f", F.lit(0.0), step)

    return folded.select("gram", (F.log(probability("good")) - F.log(probability("bad"))).alias("ratio"))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, score``.

    Null urls and those without ``://`` have an empty host and path and are
    judged by the models like any other.  Repeated rows and ids are judged row
    by row.  Where no accepted or no rejected URL is left to count there is nothing to
    learn from, and undecided URLs are allowed with score 0.  Where none of a class
    is left out for the cut, it is set on the counted URLs."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), symbols(F.col("host"), F.col("path")).alias("s"))
    texts = rows.groupBy("s").agg(F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"),
                                  F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"))
    texts = stored(texts.withColumn("held", left_out(F.col("s"))), "urls")
    taught = texts.where("NOT held").agg(F.sum("good"), F.sum("bad")).first()
    if not (taught[0] and taught[1]):
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"),
                           F.lit(0.0).alias("score"))
    grams = _grams(texts)
    counts = stored(grams.groupBy("gram").agg(*[F.sum(F.when(~F.col("held"), F.col(c)).otherwise(0)).alias(c) for c in ("good", "bad")]), "counts")
    ratios = stored(_ratios(counts.where("good + bad > 0"), counts), "ratios")
    scores = grams.join(ratios, "gram").groupBy("s", "good", "bad", "held").agg(F.round(F.avg("ratio"), 6).alias("score"))
    scores = stored(scores, "scores")
    cut = _cut(scores)
    learned = F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block"))
    return (rows.join(scores.select("s", "score"), "s", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score"))


def _cut(scores: DataFrame) -> float:
    """Between the classes' mean scores, in proportion to their spreads, on the URLs left out of the counts."""
    for rows in (scores.where("held"), scores):
        sums = [F.sum(F.col(c) * F.pow("score", F.lit(k))).alias(f"{c}{k}") for c in ("good", "bad") for k in (0, 1, 2)]
        x = rows.agg(*sums).first()
        if x["good0"] and x["bad0"]:
            break
    mean = {c: x[f"{c}1"] / x[f"{c}0"] for c in ("good", "bad")}
    spread = {c: max(x[f"{c}2"] / x[f"{c}0"] - mean[c] ** 2, 1e-12) ** 0.5 for c in ("good", "bad")}
    return round((mean["good"] * spread["bad"] + mean["bad"] * spread["good"]) / (spread["good"] + spread["bad"]), 6)
