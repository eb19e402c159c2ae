"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.decontaminate import contamination
from tesserae.llm.divergence import source_divergence
from tesserae.llm.fingerprints import exact_duplicates
from tesserae.llm.forest import near_duplicates
from tesserae.llm.packing import pack
from tesserae.llm.passages import shared_passages
from tesserae.llm.quality import quality
from tesserae.llm.repeats import digest, remove_repeats
from tesserae.llm.token_count import token_counts
from tesserae.llm.toxicity import toxicity
from tesserae.llm.url_filter import judge_urls
from tesserae.llm.vector_codes import vector_codes
from tesserae.llm.warc import captures, resolve_revisits


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_pieces(pack(_table(spark, sf_dir, "documents"), tokenizer_path()))


def digest_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(_table(spark, sf_dir, "documents"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(_table(spark, sf_dir, "documents")))


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolve_revisits(captures(_table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return r.withColumn("headers", F.array_join(lines, "\n"))


def divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def code_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_EXACT_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""

_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_CONTAMINATION_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS.format(_LOWER)} AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i, w FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM bw),
d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM g),
dw AS (SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS i, w FROM d, lens WHERE len(w) >= n),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN g ON g.n = dw.n AND g.gram = array_to_string(w[i:i + dw.n - 1], ' ')),
pos AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h),
hit AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

_DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
f AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (g.total + v) AS p,
             1 + 1000000000::HUGEINT * (lang_n + 1) // (v.total + v) AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT lang, a.source, b.source AS item, coalesce(s, 0) AS value FROM g AS a JOIN g AS b USING (lang)
         LEFT JOIN (SELECT lang, x.source AS xs, y.source AS ys, sum((x.p - y.p) * (x.p - y.p) // y.p) AS s
                    FROM f AS x JOIN f AS y USING (lang, term) GROUP BY ALL) AS z USING (lang)
         WHERE a.source <> b.source AND (z.xs IS NULL OR (xs = a.source AND ys = b.source))),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= 200"""



def _codebook_round(k: int) -> str:
    """Distances to the codebooks ``b<k>``, the nearest entries and, but for the last round, the codebooks after them."""
    near = f"""
d{k} AS (SELECT vec_id, part, e, list_sum(list_transform(list_zip(x, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
      FROM parts JOIN b{k} USING (part)),
a{k} AS (SELECT vec_id, part, min(struct_pack(dist, e)) AS best FROM d{k} GROUP BY ALL)"""
    return near + f""",
s{k} AS (SELECT part, best.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{k} JOIN parts USING (vec_id, part), range(1, 5) AS r(i) GROUP BY ALL),
b{k + 1} AS (SELECT part, e, coalesce(m, b) AS b FROM b{k}
       LEFT JOIN (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{k} GROUP BY ALL) USING (part, e))""" if k < 2 else near

_CODES_SQL = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, part, v[len(v) // 16 * part + 1 : len(v) // 16 * (part + 1)] AS x FROM v, range(16) AS r(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS b FROM parts
       WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
{_codebook_round(0)},
{_codebook_round(1)},
{_codebook_round(2)},
codes AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.dist)::BIGINT AS error FROM a2 GROUP BY ALL),
books AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY part, e)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM codes JOIN v USING (vec_id), books"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup,
    "op2_url_filter": url_filter,
    "op3_exact_dedup": exact_dedup,
    "op4_packing": packing,
    "op5_suffix_dedup": suffix_dedup,
    "op6_toxicity": toxicity_scores,
    "op7_decontamination": decontamination,
    "op8_jaccard_join": jaccard_join,
    "op9_token_count": token_count,
    "op10_warc_revisits": warc_revisits,
    "op11_source_divergence": divergence_audit,
    "op12_vector_codes": code_vectors,
    "op13_quality": quality_scores,
}

ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": _EXACT_SQL, "op7_decontamination": _CONTAMINATION_SQL,
                              "op11_source_divergence": _DIVERGENCE_SQL, "op12_vector_codes": _CODES_SQL}
