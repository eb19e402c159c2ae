"""Seeded sampling, shuffling, splitting and sharding.

Contract (the reference's ``random`` calls cannot be reproduced and need not
be): exact sizes, determinism for a seed, independence from partitioning.
Every order is ``md5('<seed>:<id>')`` with the id as tie-break, so DuckDB or
any other engine can recompute the same choice.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import md5_key
from tesserae.session import reliable_checkpoint

KEY = "_sample_key"
# ``orderBy(...).limit(n)`` keeps n rows per partition and merges them in one
# task: fine while n is small.  Above this, samples go through the
# distributed index (W1) instead.
TAKE_ORDERED_MAX = 100_000
# Caps of a split up to which its ids and its id check share one evaluation.
ONE_PASS_MAX = 10_000
# Upper bound on seeded-index buckets (the per-bucket count table's size).
MAX_BUCKETS = 1 << 20


# Target bytes per partition when an operator fixes its own partition count
# (an explicit count is not resized by AQE).
TARGET_PARTITION_BYTES = 128 * 1024 * 1024
MAX_PARTITIONS = 1_000_000
UNKNOWN_BYTES = 1 << 62
# Tasks that share the first level of a group's top rows.
SALTS = 64
# Domains whose quotas are gathered and broadcast; more are joined by a shuffle.
MAX_LOCAL_DOMAINS = 100_000


def _input_bytes(df: DataFrame) -> int:
    """Bytes of the relations the plan reads (sum over its leaves).  Derived
    operators' estimates are not used: without CBO a join is estimated as the
    product of its inputs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        v = leaves.apply(i).stats().sizeInBytes()
        size = v if isinstance(v, int) else int(v.toString())
        if size < UNKNOWN_BYTES:  # a local table or an RDD has no size, only Spark's default of 8 EB
            total += size
    return total


def parallelism(df: DataFrame) -> int:
    """Partition count for an explicit repartition of ``df``: enough for
    ~128 MB of input per partition (from the sizes of the scanned relations;
    no job), and at least the cluster's core count so every core has work."""
    base = int(df.sparkSession.sparkContext.defaultParallelism)
    try:
        size = _input_bytes(df)
    except Exception:  # noqa: BLE001 - estimates are best effort
        size = 0
    return max(base, min(MAX_PARTITIONS, -(-size // TARGET_PARTITION_BYTES)))


def content_hash(df: DataFrame) -> Column:
    """A hash of the row, over every column that can be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()] or [F.lit(0)])


def seeded_key(df: DataFrame, id_col: str, seed: int = 42, name: str = KEY, content: bool = False) -> DataFrame:
    """The seeded order's key: md5 of the seed and the id.

    With ``content`` a row without an id is keyed by its content instead, so rows
    with null ids are drawn, shuffled and capped like any others and don't meet
    in one task; only rows equal in every column share a key, and those can
    stand for each other.  That key needs every column, so callers ask for it
    only where the rows are passed on whole or null ids were found."""
    key = md5_key(seed, F.col(id_col))
    if content:
        key = F.coalesce(key, md5_key(seed, F.concat(F.lit("null:"), content_hash(df).cast("string"))))
    return df.withColumn(name, key)


def key_index(df: DataFrame, order_cols: list[str], num_partitions: int | None = None) -> tuple[DataFrame, int, bool]:
    """W1 over the key columns alone: a row for each different key, its 0-based
    position ``_at`` in the order, the number of rows, and whether keys are unique.

    The key columns are range-partitioned, counted by key in that layout and
    sorted; only this narrow table is pinned, by a reliable checkpoint.  A
    histogram of its partitions (a row each) gives the offsets, which are
    broadcast: a prefix sum in two levels, without a task that sees all keys.
    """
    spark = df.sparkSession
    n_parts = num_partitions or parallelism(df)
    # equal keys share a range, so the count by key needs no further shuffle
    counted = df.select(*order_cols).repartitionByRange(n_parts, *order_cols).groupBy(*order_cols).agg(F.count(F.lit(1)).alias("_n"))
    tagged = reliable_checkpoint(counted.sortWithinPartitions(*order_cols).withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
    parts = {r["_pid"]: r for r in tagged.groupBy("_pid").agg(F.sum("_n").alias("rows"), F.max("_n").alias("most")).collect()}
    offsets, total = [], 0
    for p in sorted(parts):
        offsets.append((p, total))
        total += parts[p]["rows"]
    unique = all(r["most"] == 1 for r in parts.values())
    if unique:
        within = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    else:  # a partition is about as large as any other, so its running sum is one task's work
        within = F.sum("_n").over(Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1))
        within = F.coalesce(within, F.lit(0))
    off_df = spark.createDataFrame(offsets, "_pid long, _off long")
    keyed = tagged.withColumn("_within", within).join(F.broadcast(off_df), "_pid")
    return keyed.select(*order_cols, (F.col("_off") + F.col("_within")).alias("_at")), total, unique


def with_index(df: DataFrame, order_cols: list[str], index_col: str = "idx",
               num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """Dense 0..n-1 index in the given order, without a single partition.

    :func:`key_index` numbers the keys; the rows get their number by a join on
    the key, so their other columns are neither range-partitioned nor
    checkpointed.  Null keys count as keys, first in the order.  The order
    should be total (end it with a unique column): rows of equal keys are
    numbered by their content, which takes one task for each such key.
    Returns (indexed df, row count).
    """
    index, n, unique = key_index(df, order_cols, num_partitions)
    if unique and set(order_cols) == set(df.columns):  # nothing to join back
        return index.select(*df.columns, F.col("_at").alias(index_col)), n
    index = index.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order_cols)], "_at")
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(order_cols)])
    out = df.join(index, same).drop(*[f"_k{i}" for i in range(len(order_cols))])
    if not unique:
        twin = F.row_number().over(Window.partitionBy(*order_cols).orderBy(content_hash(df))) - 1
        out = out.withColumn("_at", F.col("_at") + twin)
    return out.withColumnRenamed("_at", index_col), n


def _key_prefix(key: Column) -> Column:
    """First 32 bits of the md5 hex key: order-preserving and uniform."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def count_unique_ids(df: DataFrame, id_col: str) -> int:
    """The number of rows, after checking that no id is null or repeated.

    Operators that pair, sample or split by id would otherwise lose or
    multiply rows.  Combines map-side, so a hot id is one row a task."""
    per_id = df.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    n, nulls, repeats = per_id.agg(F.sum("n"), F.sum(F.when(F.col("id").isNull(), F.col("n"))),
                                   F.count_if(F.col("id").isNotNull() & (F.col("n") > 1))).first()
    if nulls or repeats:
        raise ValueError(f"column {id_col}: {nulls or 0} rows with a null id, {repeats} repeated ids")
    return n or 0


def seeded_index(df: DataFrame, id_col: str, index_col: str = "idx", num_partitions: int | None = None,
                 seed: int = 42) -> tuple[DataFrame, int]:
    """W1 for the seeded order ``(md5 key, id)``: no sort of the whole table,
    no checkpoint.

    md5 keys are uniform, so B buckets of the 32-bit key prefix (B = 4 x the
    partitions) split the rows evenly and are monotone in the order.  One
    aggregate gives the per-bucket counts (B rows, bounded by B, broadcast as a
    table of offsets); rows are hash-partitioned by bucket and ranked
    inside their bucket by a window that reuses that partitioning.  Rows
    without an id show up there as a bucket of their own; only then all rows
    are keyed again with their content for such rows.  Buckets only grow with
    repeated ids, which the split refuses (:func:`count_unique_ids`).  ``df``
    may have its key already.
    """
    n_parts = num_partitions or parallelism(df)
    n_buckets = max(1, min(4 * n_parts, MAX_BUCKETS))
    bucket = F.shiftright(_key_prefix(F.col(KEY)) * F.lit(n_buckets), 32).cast("int")
    # one row per bucket: bounded by n_buckets (at most MAX_BUCKETS)
    sizes = lambda keyed: {r[0]: r[1] for r in keyed.groupBy(bucket).agg(F.count(F.lit(1))).collect()}
    keyed = df if KEY in df.columns else seeded_key(df, id_col, seed)
    counts = sizes(keyed)
    if None in counts:
        keyed = seeded_key(df.drop(KEY), id_col, seed, content=True)
        counts = sizes(keyed)
    offsets, running = [], 0
    for i in range(n_buckets):
        offsets.append(running)
        running += counts.get(i, 0)
    w = Window.partitionBy("_bucket").orderBy(KEY, id_col)
    ranked = keyed.withColumn("_bucket", bucket).repartition(n_parts, "_bucket").withColumn("_rn", F.row_number().over(w))
    off_df = keyed.sparkSession.createDataFrame(list(enumerate(offsets)), "_bucket int, _off long")
    out = (ranked.join(F.broadcast(off_df), "_bucket")
           .withColumn(index_col, F.col("_off") + F.col("_rn") - 1).drop("_off"))
    out = out.drop("_bucket", "_rn")
    return out, running


def sample_n(df: DataFrame, n: int | None, id_col: str, seed: int = 42,
             keep_key: bool = False, total: int | None = None) -> DataFrame:
    """M1: exactly ``min(n, count)`` rows without replacement, seeded.

    The n smallest md5 keys are found without a global sort: md5 keys are
    uniform, so the rows whose 32-bit key prefix is below ``~1.2 n / N`` of
    the range are a small superset of the answer (checked by a count; the
    bound doubles until it holds).  All keys below the prefix bound sort
    before all keys above it, so the top n of the candidates are the global
    top n.  The candidates (about 1.2 n rows) are then ordered exactly.
    """
    if n is None:
        out = seeded_key(df, id_col, seed, content=keep_key)
    else:
        # both in one pass over the id column
        rows, nulls = df.agg(F.count(F.lit(1)), F.count_if(F.col(id_col).isNull())).first()
        total = rows if total is None else total
        keyed = seeded_key(df, id_col, seed, content=nulls > 0)
        if n >= total:
            out = keyed
        else:
            frac = min(1.0, 1.2 * n / total + 64.0 / total)
            while True:
                bound = int(frac * (1 << 32))
                cand = keyed.filter(_key_prefix(F.col(KEY)) < F.lit(bound)) if frac < 1.0 else keyed
                if frac >= 1.0 or cand.count() >= n:
                    break
                frac = min(1.0, frac * 2)
            if n <= TAKE_ORDERED_MAX:
                out = cand.orderBy(KEY, id_col).limit(n)
            else:
                indexed, _ = seeded_index(cand, id_col, "_sample_idx", seed=seed)
                out = indexed.filter(F.col("_sample_idx") < n).drop("_sample_idx")
    return out if keep_key else out.drop(KEY)


def _first_ids(df: DataFrame, k: int, id_col: str, seed: int, total: int) -> DataFrame:
    """The ids of the first k rows of the seeded order, as a small local
    table (k <= TAKE_ORDERED_MAX, so at most that many ids pass the driver).
    Same prefix prefilter as :func:`sample_n`; the collect doubles as the
    size check."""
    spark = df.sparkSession
    schema = df.select(id_col).schema
    if k <= 0:
        return spark.createDataFrame([], schema)
    keyed = seeded_key(df.select(id_col), id_col, seed)
    frac = min(1.0, 1.2 * k / max(total, 1) + 64.0 / max(total, 1))
    while True:
        cand = keyed.filter(_key_prefix(F.col(KEY)) < F.lit(int(frac * (1 << 32)))) if frac < 1.0 else keyed
        rows = cand.orderBy(KEY, id_col).limit(k).select(id_col).collect()
        if len(rows) >= min(k, total) or frac >= 1.0:
            break
        frac = min(1.0, frac * 2)
    return spark.createDataFrame(rows, schema)


def _eval_ids(df: DataFrame, id_col: str, seed: int, cap: int | None, frac_div: int) -> tuple[int, DataFrame | None]:
    """M4's number of eval rows, and their ids as a small local table (None beyond TAKE_ORDERED_MAX).

    Checks that no id is null or repeated.  With a small cap the check and the
    first ``cap`` ids come from one evaluation of ``df``: both read the same
    shuffle by id."""
    if cap is None or cap > ONE_PASS_MAX:
        n = count_unique_ids(df, id_col)
        k = eval_size(n, cap, frac_div)
        return k, _first_ids(df, k, id_col, seed, n) if k <= TAKE_ORDERED_MAX else None
    per_id = df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    check = per_id.agg(F.any_value("_id").alias("_id"), F.sum("_n").alias("_n"), F.sum(F.when(F.col("_id").isNull(), F.col("_n"))).alias("_nulls"),
                       F.count_if(F.col("_id").isNotNull() & (F.col("_n") > 1)).alias("_repeats"), F.lit("").alias("_key"))
    nothing = F.lit(None).cast("long")
    first = per_id.select("_id", "_n", nothing.alias("_nulls"), nothing.alias("_repeats"), md5_key(seed, F.col("_id")).alias("_key"))
    rows = check.unionAll(first.orderBy("_key", "_id").limit(cap)).collect()
    stats = next(r for r in rows if r["_key"] == "")
    if stats["_nulls"] or stats["_repeats"]:
        raise ValueError(f"column {id_col}: {stats['_nulls'] or 0} rows with a null id, {stats['_repeats']} repeated ids")
    k = eval_size(stats["_n"] or 0, cap, frac_div)
    ids = sorted((r for r in rows if r["_key"] != ""), key=lambda r: (r["_key"], r["_id"]))[:k]
    return k, df.sparkSession.createDataFrame([(r["_id"],) for r in ids], df.select(id_col).schema)


def head_n(df: DataFrame, n: int | None, order_cols: list[str]) -> DataFrame:
    """M2: first n rows in an explicit order (the reference's file order)."""
    if n is None:
        return df
    if n <= TAKE_ORDERED_MAX:
        return df.orderBy(*order_cols).limit(n)
    indexed, _ = with_index(df, list(order_cols), "_head_idx")
    return indexed.filter(F.col("_head_idx") < n).drop("_head_idx")


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42, rank_col: str = "rank") -> DataFrame:
    """M3: the rows with their 0-based position in the seeded permutation."""
    indexed, _ = seeded_index(df, id_col, rank_col, seed=seed)
    return indexed.drop(KEY)


def eval_size(n: int, cap: int | None = 350, frac_div: int = 10) -> int:
    """M4 rule: ``min(cap, n // 10)``."""
    k = n // frac_div
    return k if cap is None else min(cap, k)


def train_eval_split(df: DataFrame, id_col: str, seed: int = 42, cap: int | None = 350,
                     frac_div: int = 10) -> tuple[DataFrame, DataFrame]:
    """M4: eval = first ``min(cap, count // 10)`` shuffled rows, train = the rest.

    The two outputs are disjoint and cover the input; null or repeated ids
    raise.  With a cap the eval
    side is at most ``cap`` ids, so the anti-join broadcasts a bounded set and
    the large side is never shuffled.
    """
    k, ids = _eval_ids(df, id_col, seed, cap, frac_div)
    if ids is not None:
        ids = F.broadcast(ids)
        return df.join(ids, id_col, "left_semi"), df.join(ids, id_col, "left_anti")
    keyed = seeded_key(df, id_col, seed)
    indexed, _ = seeded_index(keyed, id_col, "_split_idx")
    is_eval = F.col("_split_idx") < k
    return (indexed.filter(is_eval).drop(KEY, "_split_idx"),
            indexed.filter(~is_eval).drop(KEY, "_split_idx"))


def label_split(df: DataFrame, id_col: str, seed: int = 42, cap: int | None = 350,
                frac_div: int = 10, split_col: str = "split") -> DataFrame:
    """M4 as one labelled table: ``split`` is ``eval`` or ``train``."""
    k, ids = _eval_ids(df, id_col, seed, cap, frac_div)
    if ids is not None:
        ids = ids.withColumn(split_col, F.lit("eval"))
        return (df.join(F.broadcast(ids), id_col, "left")
                .withColumn(split_col, F.coalesce(F.col(split_col), F.lit("train"))))
    keyed = seeded_key(df, id_col, seed)
    indexed, _ = seeded_index(keyed, id_col, "_split_idx")
    return (indexed.withColumn(split_col, F.when(F.col("_split_idx") < k, "eval").otherwise("train"))
            .drop(KEY, "_split_idx"))


def top_per_group(df: DataFrame, group_cols: list[str], order: list[Column | str], k: int, rank_col: str,
                  salt_cols: list[str], salts: int = SALTS) -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1, in two levels.

    The first level keeps the top ``k`` of each (group, salt), the second the
    top ``k`` of what is left.  The top ``k`` of a union are among the tops of
    its parts, so the result is exact; a group with a third of all rows is cut
    down by ``salts`` tasks, and its last task sees at most ``k * salts`` rows.
    ``salt_cols`` should differ from row to row (an id)."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_cols), F.lit(salts)))
    part = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    kept = salted.withColumn("_place", F.row_number().over(part)).filter(F.col("_place") <= k).drop("_place", "_salt")
    whole = Window.partitionBy(*group_cols).orderBy(*order)
    return kept.withColumn(rank_col, F.row_number().over(whole)).filter(F.col(rank_col) <= k)


def capped_eval_sample(df: DataFrame, domain_col: str, caps: dict[str, int], id_col: str,
                       seed: int = 42, default_cap: int = 0, rank_col: str = "rank_in_domain",
                       exclude_from_train: bool = False, flag_col: str = "exclude_from_train"
                       ) -> DataFrame:
    """M5: up to ``caps[domain]`` seeded rows per domain.

    A hot domain is cut down in two levels (:func:`top_per_group`).  Per-domain
    caps come from a map literal, so no join is needed.
    """
    keyed = seeded_key(df, id_col, seed, content=True)
    max_cap = max(list(caps.values()) + [default_cap])
    cap_map = F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))])
    ranked = top_per_group(keyed, [domain_col], [KEY, id_col], max_cap, rank_col, [KEY])
    cap = F.coalesce(F.try_element_at(cap_map, F.col(domain_col)), F.lit(default_cap))
    out = ranked.filter(F.col(rank_col) <= cap).drop(KEY)
    if exclude_from_train:
        out = out.withColumn(flag_col, F.lit(True))
    return out


def exclude_eval_from_train(train: DataFrame, eval_df: DataFrame, id_col: str,
                            max_broadcast_rows: int = 5_000_000) -> DataFrame:
    """M5 with ``exclude_from_train``: drop the eval rows from train so the
    two are disjoint (the reference samples eval from train and keeps both).
    A capped eval set is bounded by the sum of its caps; it is broadcast
    after its size is checked, so train is never shuffled."""
    ids = eval_df.select(id_col).distinct()
    small = ids.count() <= max_broadcast_rows
    return train.join(F.broadcast(ids) if small else ids, id_col, "left_anti")


def domain_quotas(df: DataFrame, n: int, domain_col: str, seq_col: str) -> DataFrame:
    """M6 quotas: ``n // d`` each, the remainder one each to the first domains
    in order of first appearance.  One row per domain."""
    stats = (df.groupBy(domain_col)
             .agg(F.min(seq_col).alias("_first_seen"), F.count(F.lit(1)).alias("_size")))
    # One row per domain: a single ordered window over it is bounded by the
    # number of domains, not by the data.
    order = Window.orderBy("_first_seen", domain_col)
    d = F.count(F.lit(1)).over(Window.partitionBy())
    i = F.row_number().over(order) - 1
    return (stats.withColumn("_i", i).withColumn("_d", d)
            .withColumn("quota", F.floor(F.lit(n) / F.col("_d")).cast("long")
                        + F.when(F.col("_i") < F.pmod(F.lit(n), F.col("_d")), 1).otherwise(0))
            .select(domain_col, "quota", "_first_seen", "_size"))


def representative_sample(df: DataFrame, n: int, domain_col: str, seq_col: str, id_col: str,
                          seed: int = 42, rank_col: str = "rank_in_domain") -> DataFrame:
    """M6: equal quota per domain; a short domain is not topped up.

    A null domain counts as ``unknown``.  Empty input gives empty output.
    The quota table has one row per domain; it is gathered and broadcast
    only up to ``MAX_LOCAL_DOMAINS`` domains.  The input is read twice: for the
    quotas and for the rows.
    """
    dom = "_domain"
    base = df.withColumn(dom, F.coalesce(F.col(domain_col).cast("string"), F.lit("unknown")))
    quotas = domain_quotas(base, n, dom, seq_col).select(dom, "quota")
    rows = quotas.limit(MAX_LOCAL_DOMAINS + 1).collect()
    if not rows:
        return df.limit(0).withColumn(rank_col, F.lit(None).cast("int"))
    if len(rows) <= MAX_LOCAL_DOMAINS:
        quotas, n_domains = F.broadcast(df.sparkSession.createDataFrame(rows, quotas.schema)), len(rows)
    else:
        n_domains = quotas.count()
    # the largest quota is a literal, so every level is pruned map-side
    max_quota = n // n_domains + (1 if n % n_domains else 0)
    keyed = seeded_key(base, id_col, seed, content=True)
    ranked = top_per_group(keyed, [dom], [KEY, id_col], max_quota, rank_col, [KEY])
    return (ranked.join(quotas, dom).filter(F.col(rank_col) <= F.col("quota"))
            .drop(KEY, "quota", dom))


def mode_sample(df: DataFrame, mode: str, domain_col: str, seq_col: str, id_col: str,
                seed: int = 42) -> DataFrame:
    """M7: quick = M6(10), medium = M1(50), full = everything."""
    if mode == "quick":
        return representative_sample(df, 10, domain_col, seq_col, id_col, seed).drop("rank_in_domain")
    if mode == "medium":
        return sample_n(df, 50, id_col, seed)
    if mode == "full":
        return df
    raise ValueError(f"unknown mode: {mode}")


def shard_column(idx: Column, n: int, k: int) -> Column:
    """M8: contiguous chunks of ``n // k``; the last shard takes the remainder.
    With ``n < k`` every row goes to the last shard (chunk size 0)."""
    chunk = n // k
    if chunk == 0:
        return F.lit(k - 1).cast("long")
    return F.least(F.floor(idx / F.lit(chunk)).cast("long"), F.lit(k - 1).cast("long"))


def assign_shards(df: DataFrame, order_cols: list[str], k: int, batch_size: int,
                  shard_col: str = "shard_id", batch_col: str = "batch_id",
                  index_col: str = "idx") -> DataFrame:
    """M8 + M9 + W3 + G5: shard, position in shard and batch per row."""
    indexed, n = with_index(df, order_cols, index_col)
    chunk = n // k
    shard = shard_column(F.col(index_col), n, k)
    in_shard = F.col(index_col) - F.col(shard_col) * F.lit(chunk)
    return (indexed.withColumn(shard_col, shard)
            .withColumn("pos_in_shard", in_shard)
            .withColumn(batch_col, F.floor(F.col("pos_in_shard") / F.lit(batch_size)).cast("long")))


def assign_batches(df: DataFrame, order_cols: list[str], batch_size: int,
                   batch_col: str = "batch_id", index_col: str = "idx") -> DataFrame:
    """M9: ``batch = index // batch_size`` over the whole input."""
    indexed, _ = with_index(df, order_cols, index_col)
    return indexed.withColumn(batch_col, F.floor(F.col(index_col) / F.lit(batch_size)).cast("long"))


def overlap_audit(eval_df: DataFrame, train_df: DataFrame, text_col: str,
                  group_col: str | None = None, broadcast_max_rows: int = 5_000_000) -> DataFrame:
    """Eval rows whose normalised text also occurs in train, by group.

    The eval hashes (checked to be at most ``broadcast_max_rows``) are
    broadcast and the train side is semi-joined against them map-side, so the
    large train table is scanned once and never shuffled; only the matching
    hashes (at most the eval size) reach the final join.  Above the bound a
    shuffled semi-join is used (AQE splits skewed keys).
    """
    from tesserae.functions.text import normalize_text

    h = F.md5(normalize_text(F.col(text_col)))
    keys = [group_col] if group_col else []
    # the eval side is read three times below: materialise it once
    e = reliable_checkpoint(eval_df.select(*keys, h.alias("_h")))
    eval_h = e.select("_h").distinct()
    small = eval_h.count() <= broadcast_max_rows
    probe = F.broadcast(eval_h) if small else eval_h
    hits = (train_df.select(h.alias("_h")).join(probe, "_h", "left_semi").distinct()
            .withColumn("_hit", F.lit(True)))
    # hits are a subset of the eval hashes, so they share its size bound
    out = e.join(F.broadcast(hits) if small else hits, "_h", "left")
    return (out.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_eval"),
                 F.count_if(F.col("_hit").isNotNull()).alias("n_overlap")))
