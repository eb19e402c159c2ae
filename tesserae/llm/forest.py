"""N-gram Jaccard join by a MinHash LSH forest.

Each of ``TREES`` trees sorts the documents by a signature of ``DEPTH``
min-hashes; a trie node at depth k is the group of documents that share the
signature's first k values.  From full depth, prefixes are shortened as long
as the recall at the similarity asked for is below the target, and, per
document, until its group would exceed ``SMALL`` sets:

* the largest group of at most SMALL different sets is paired completely;
* each larger group on the way up to the shortest prefix links its members to
  one of them, drawn by hash, so a group of any size gives one candidate a
  member and a tree.

Each set carries a parity: of PARITY buckets of hashes, whether it has an odd
number of shingles in each.  Sets differ in at least as many shingles as their
parities in places, so pairs that differ in too many cannot reach the
similarity and are never proposed.  Candidates whose whole signatures agree in too few places to reach the
similarity are left out, the others verified on their exact sets.  Large
groups whose members these links leave in more than one class get an exact
join by prefix filter: two sets of that similarity share one of the rarest
shingles of each, so members of different classes are joined on those."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import batch, binary_parts, blocks, ddl, identified, marked, stored, tidy, with_rid
from tesserae.llm.components import components
from tesserae.llm.words import mix, windows, words

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.999
TREES, DEPTH, SMALL = 16, 6, 8
#: Trees whose longest prefixes are verified first; what they join need not be proposed again by the others.
EARLY = 4
#: Sets of a class, and their shingles, that are counted against as many others in one task.
COUNTED, COUNTED_SHINGLES = 1024, 1 << 20
#: Shingles at a time in which the sets of two blocks are compared.
_COLUMNS = 1 << 11
#: Longs of a set's parity, and their names.
WORDS = 4
PARITY = [f"odd{w}" for w in range(WORDS)]
#: Agreement that a candidate's signatures must have: six standard deviations below the similarity.
SLACK = 6.0

_rng = np.random.default_rng(8)
_FACTOR = (_rng.integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

_SIGNED = {"rid": pa.int64(), "id": pa.int64(), "n": pa.int64(), "set": pa.int64(), "signature": pa.binary(),
           **{c: pa.int64() for c in PARITY}}
_SETS = {"rep": pa.int64(), "shingles": pa.binary()}
_ROWS = {"rep": pa.int64(), "class": pa.int64(), "size": pa.int64(), "shingle": pa.int64()}
_PAIRS = {"a": pa.int64(), "b": pa.int64()}
_DEGREES = {"rep": pa.int64(), "n": pa.int64()}


def shortest_prefix(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair of that similarity meets in some tree with probability ``recall``."""
    for k in range(depth, 1, -1):
        if 1 - (1 - similarity**k) ** trees >= recall:
            return k
    return 1


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(shingle, row)``, sorted and distinct; a text of fewer words, but not none, is one shingle."""
    name, _, _, row = words(data, off)
    h = windows(name, n)
    r = row[:len(h)]
    same = r == row[n - 1:] if len(h) else np.zeros(0, bool)
    h, r = h[same], r[same]
    count = np.bincount(row, minlength=len(off) - 1)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        begin = np.searchsorted(row, few)
        short = np.array([windows(name[b:b + count[d]], count[d])[0] for b, d in zip(begin, few, strict=True)], np.uint64)
        h, r = np.r_[h, short], np.r_[r, few]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[first], r[first]


def _sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rid, ids = b.column("rid").to_numpy(), b.column("id")
        for i, j, data, off in blocks(b.column("text")):
            h, r = shingle_sets(data, off)
            n = np.bincount(r, minlength=j - i)
            some = np.flatnonzero(n)
            name = np.zeros(j - i, np.uint64)
            odd = np.zeros((WORDS, j - i), np.uint64)
            low = np.full((j - i, len(_FACTOR)), 0xFFFFFFFF, np.uint32)
            if len(some):
                begin = np.r_[0, np.cumsum(n[some])[:-1]]
                mixed = mix(h.copy())
                name[some] = np.add.reduceat(mixed, begin)
                bucket = mixed % np.uint64(64 * WORDS)
                bit = np.uint64(1) << (bucket & np.uint64(63))
                for w in range(WORDS):
                    odd[w, some] = np.bitwise_xor.reduceat(np.where(bucket >> np.uint64(6) == w, bit, np.uint64(0)), begin)
                for k, f in enumerate(_FACTOR):
                    low[some, k] = np.minimum.reduceat(((h * f) >> np.uint64(32)).astype(np.uint32), begin)
            yield batch(_SIGNED, rid[i:j], ids.slice(i, j - i), n, mix(name).view(np.int64), [x.tobytes() for x in low],
                        *odd.view(np.int64))


def _near(similarity: float, a: list[Column], b: list[Column]) -> Column:
    """Whether two sets, of which the size and the parity are given, may reach the similarity.

    Sets of similarity s differ in (1 - s) / (1 + s) of the sum of their sizes."""
    differ = functools.reduce(Column.__add__, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:], strict=True)))
    return differ <= (a[0] + b[0]) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _agree(least: int):
    """Pairs whose signatures agree in at least ``least`` places."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            one, two = (np.frombuffer(binary_parts(b.column(c))[0].tobytes(), np.uint32) if b.num_rows else np.zeros(0, np.uint32)
                        for c in ("x", "y"))
            one, two = one.reshape(-1, len(_FACTOR)), two.reshape(-1, len(_FACTOR))
            keep = pa.array((one == two).sum(axis=1) >= least)
            yield batch(_PAIRS, b.column("a").filter(keep), b.column("b").filter(keep))

    return run


def _read_sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rep = b.column("rid").to_numpy()
        for i, j, data, off in blocks(b.column("text")):
            h, r = shingle_sets(data, off)
            at = np.searchsorted(r, np.arange(j - i + 1))
            yield batch(_SETS, rep[i:j], [h[at[k]:at[k + 1]].tobytes() for k in range(j - i)])


def _shingle_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rep, named = b.column("rid").to_numpy(), b.column("class").to_numpy()
        for i, j, data, off in blocks(b.column("text")):
            h, r = shingle_sets(data, off)
            yield batch(_ROWS, rep[i:j][r], named[i:j][r], np.bincount(r, minlength=j - i)[r], h.view(np.int64))


def _verify(similarity: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True)) if len(one) and len(two) else 0
                keep.append(both >= similarity * (len(one) + len(two) - both) and both > 0)
            yield batch(_PAIRS, b.column("a").filter(pa.array(keep, pa.bool_())), b.column("b").filter(pa.array(keep, pa.bool_())))

    return run


def _texts_of(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """``base`` (rid, text) joined with ``wanted`` (rid and more).

    Texts are sifted on the map side first, by the marks of the ids wanted; the
    join that follows is exact and shuffles hardly any other text."""
    return marked(base.select("rid", "text"), wanted).where("marked").drop("marked").join(wanted, "rid")


def _count_links(similarity: float):
    """Of each set of two blocks (or of one): its links to sets of the other (the same) block."""

    def run(t: pa.Table) -> pa.Table:
        rep, block = t.column("rep").to_numpy(), t.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        rep, block = rep[order], block[order]
        column = t.column("shingles").combine_chunks()
        sets = [np.frombuffer(column[i].as_buffer(), np.uint64) for i in order.tolist()]
        size = np.array([len(x) for x in sets], np.int64)
        _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = n > 1
        keep = shared[col]
        col, row = (np.cumsum(shared) - 1)[col[keep]], np.repeat(np.arange(len(sets)), size)[keep]
        by_column = np.argsort(col, kind="stable")
        col, row = col[by_column], row[by_column]
        # one block against the other; a block alone against itself
        cut = int(np.searchsorted(block, block[0], "right"))
        one, two = (slice(0, cut), slice(cut, None)) if cut < len(sets) else (slice(None), slice(None))
        both = np.zeros((len(sets[one]), len(sets[two])), np.float32)
        x = np.zeros((len(sets), _COLUMNS), np.float32)
        for first in range(0, int(shared.sum()), _COLUMNS):
            i, j = np.searchsorted(col, [first, first + _COLUMNS])
            x[row[i:j], col[i:j] - first] = 1
            both += x[one] @ x[two].T
            x[row[i:j], col[i:j] - first] = 0
        link = (both >= similarity * (size[one][:, None] + size[two] - both)) & (both > 0)
        if cut < len(sets):
            found = np.r_[link.sum(axis=1), link.sum(axis=0)]
        else:
            np.fill_diagonal(link, False)
            found = link.sum(axis=1)
        return pa.Table.from_batches([batch(_DEGREES, rep, found)])

    return run


def _degrees(links: DataFrame, crowded: DataFrame, classes: DataFrame, base: DataFrame, similarity: float) -> DataFrame:
    """``rep, n_links``: the number of sets that reach the similarity with each set.

    A pair of which one set is in no large group was a candidate and is in
    ``links``.  Pairs of members of large groups are of one class if they
    reach the similarity, so each class is dealt by hash into blocks of about
    COUNTED sets (fewer of large ones, COUNTED_SHINGLES together) and every two
    blocks are counted in a task of their own."""
    members = stored(crowded.select("rep").distinct().join(classes, "rep").select(F.col("rep").alias("rid"), F.col("component").alias("class")), "members")
    for s in "ab":
        links = links.join(members.select(F.col("rid").alias(s), F.lit(1).alias(f"in_{s}")), s, "left")
    apart = links.where("in_a IS NULL OR in_b IS NULL")
    apart = apart.select(F.col("a").alias("rep")).unionByName(apart.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n"))
    sets = stored(_texts_of(base, members.select("rid")).select("rid", "text").mapInArrow(tidy(_read_sets), ddl(_SETS)), "members_sets")
    total = sets.select(F.col("rep").alias("rid"), (F.length("shingles") / 8).alias("n")).join(members, "rid").groupBy("class").agg(
        F.ceil(F.greatest(F.count("*") / COUNTED, F.sum("n") / COUNTED_SHINGLES)).cast("long").alias("blocks"))
    wide = total.where("blocks > 1")
    dealt = members.join(wide, "class", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.select(F.col("rid").alias("rep"), "class", "blocks", F.pmod(F.xxhash64("rid"), "blocks").alias("block"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("rep", "class", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    inside = (sets.join(dealt, "rep").groupBy("class", "lo", "hi").applyInArrow(_count_links(similarity), ddl(_DEGREES)))
    return inside.unionByName(apart).groupBy("rep").agg(F.sum("n").alias("n_links"))


def _candidates(reps: DataFrame, shortest: int, similarity: float = SIMILARITY, early: bool = True) -> tuple[list[DataFrame], DataFrame]:
    """For each prefix length, from the shortest, ``a < b``: the pairs that the
    forest proposes there, those of the longest apart for the EARLY trees (if
    ``early``), which come last; ``p, rep``: the large groups of the shortest prefix."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t")
    traits = ["n_set", *PARITY]
    rows = reps.select("rep", "signature", F.col("n").alias("n_set"), *PARITY, tree)
    prefix = [F.xxhash64("t", F.expr(f"substring(signature, t * {4 * DEPTH} + 1, {4 * k})")).alias(f"p{k}")
              for k in range(shortest, DEPTH + 1)]
    rows = rows.select("rep", "t", *traits, *prefix)
    found, crowded = [], None
    for k in range(shortest, DEPTH + 1):
        p = f"p{k}"
        # groups are counted by their prefix alone, and hubs drawn in large ones only: most rows are in no group
        rows = stored(rows.join(rows.groupBy(p).agg(F.count("*").alias("n")).where("n > 1"), p), "groups")
        small, large = rows.where(F.col("n") <= SMALL), rows.where(F.col("n") > SMALL)
        if crowded is None:
            crowded = large.select(F.col(p).alias("p"), "rep")
        hub = [F.min_by(c, F.xxhash64(p, "rep")).alias(f"hub_{c}") for c in ("rep", *traits)]
        a, b = (small.select(p, "t", F.col("rep").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in traits)) for s in "ab")
        near = _near(similarity, *([F.col(f"{c}_{s}") for c in traits] for s in "ab"))
        pairs = a.join(b, [p, "t"]).where("a < b").where(near).select("a", "b", "t")  # one shuffle serves both sides
        rows = large.drop(p, "n")  # longer prefixes matter only within the large groups
        large = large.join(large.groupBy(p).agg(*hub), p)
        near = _near(similarity, [F.col(c) for c in traits], [F.col(f"hub_{c}") for c in traits])
        pairs = pairs.unionByName(large.where("hub_rep <> rep").where(near)
                                  .select(F.least("hub_rep", "rep").alias("a"), F.greatest("hub_rep", "rep").alias("b"), "t"))
        for part in ("t >= 0",) if k < DEPTH or not early else (f"t >= {EARLY}", f"t < {EARLY}"):
            found.append(pairs.where(part).select("a", "b").distinct())
    return found, crowded


def _verified(pairs: DataFrame, reps: DataFrame, base: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` whose shingle sets reach the similarity."""
    sides = reps.select(F.col("rep").alias("a"), F.col("signature").alias("x")), reps.select(F.col("rep").alias("b"), F.col("signature").alias("y"))
    places = len(_FACTOR)
    least = max(1, int(places * similarity - SLACK * (places * similarity * (1 - similarity)) ** 0.5))
    likely = stored(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "x", "y")
                    .mapInArrow(tidy(_agree(least)), ddl(_PAIRS)), "candidates")
    wanted = likely.select(F.col("a").alias("rid")).unionByName(likely.select(F.col("b").alias("rid"))).distinct()
    texts = stored(_texts_of(base, wanted).mapInArrow(tidy(_read_sets), ddl(_SETS)), "shingles")
    return stored(likely.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
                  .mapInArrow(tidy(_verify(similarity)), ddl(_PAIRS)), "links")


def _stars(classes: DataFrame) -> DataFrame:
    """Links of every member of a class to its first: what is found later is joined to these, in few rounds."""
    return classes.select(F.col("rep").alias("a"), F.col("component").alias("b"))


def _climb(candidates: list[DataFrame], crowded: DataFrame, reps: DataFrame, base: DataFrame, similarity: float, of,
           at_once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Verified links and their classes, from the longest prefix to the shortest (or ``at_once``: the classes are the same).

    The longest prefixes of a few trees, which only large groups need, are verified first.  Of
    all other pairs those are left out whose sets both are in large
    groups and in one class by then: they can add nothing to the classes, and
    the links inside those classes are counted by themselves."""
    first = functools.reduce(DataFrame.unionByName, candidates).distinct() if at_once else stored(candidates[-1], "first_pairs")
    links = _verified(first, reps, base, similarity)
    classes = of(links)
    if at_once:
        return links, classes
    inside = crowded.select("rep").distinct().join(classes, "rep").select(F.col("rep").alias("member"), "component")
    one, two = (inside.select(F.col("member").alias(s), F.col("component").alias(f"class_{s}")) for s in "ab")
    rest = functools.reduce(DataFrame.unionByName, candidates[:-1]).distinct() if len(candidates) > 1 else first.limit(0)
    rest = rest.join(first, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left")
    rest = rest.where("class_a IS NULL OR class_b IS NULL OR class_a <> class_b").select("a", "b")
    more = _verified(stored(rest, "pairs"), reps, base, similarity)
    return links.unionByName(more), of(_stars(classes).unionByName(more))


def _across(crowded: DataFrame, classes: DataFrame, base: DataFrame, similarity: float) -> DataFrame:
    """``a < b``: every pair that can reach the similarity, of different classes, in the large groups that hold several.

    In one order of all shingles, rarest first, two similar sets share one of
    the first ``size - ceil(similarity * size) + 1`` of each, and behind the
    first that they share both have enough left to reach the similarity.
    Their parities are taken from the shingles as these are ordered."""
    named = crowded.join(classes, "rep", "left").select("p", "rep", F.coalesce("component", "rep").alias("class"))
    mixed = named.groupBy("p").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("p")
    doubtful = named.join(mixed, "p").select(F.col("rep").alias("rid"), "class").distinct()
    doubtful = stored(doubtful, "doubtful_ids")
    rows = stored(_texts_of(base, doubtful).mapInArrow(tidy(_shingle_rows), ddl(_ROWS)), "doubtful")
    count = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("n", "shingle"))
    bucket = F.pmod(F.xxhash64("shingle"), F.lit(64 * WORDS)).cast("int")
    bit = lambda w: F.when(bucket.between(64 * w, 64 * w + 63), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(shingle), {64 * WORDS}) AS INT) - {64 * w})")).otherwise(F.lit(0).cast("long"))
    odd = {c: F.bit_xor(bit(w)).over(Window.partitionBy("rep")) for w, c in enumerate(PARITY)}
    first = (rows.join(count, "shingle").withColumn("place", place).withColumns(odd)
             .where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1)
             .where("lo <> hi").select("shingle", "rep", "class", "size", (F.col("size") - F.col("place") + 1).alias("left"), *PARITY))
    one, two = (first.toDF("shingle", s, *(f"{c}_{s}" for c in ("class", "size", "left", *PARITY))) for s in "ab")
    near = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * similarity - 1e-9
    near = near & _near(similarity, *([F.col(f"{c}_{s}") for c in ("size", *PARITY)] for s in "ab"))
    enough = F.least("left_a", "left_b") >= (F.col("size_a") + F.col("size_b")) * (similarity / (1 + similarity)) - 1e-9
    return one.join(two, "shingle").where("a < b AND class_a <> class_b").where(near & enough).select("a", "b").distinct()


def _classes(base: DataFrame, similarity: float, recall: float, counted: bool = False, at_once: bool = False) -> DataFrame:
    """``rid, id, set_class, class`` of every row of ``base`` (rid, id, text), and ``n_links`` where ``counted``.

    ``at_once`` verifies all candidates in one round: more of them in large
    groups, but fewer jobs, and the driver keeps fewer plans."""
    signed = stored(base.mapInArrow(tidy(_sign), ddl(_SIGNED)), "signatures")
    sets = signed.where("n > 0").groupBy("set", "n").agg(F.min("rid").alias("rep"))
    reps = stored(sets.join(signed.select(F.col("rid").alias("rep"), "signature", *PARITY), "rep").select("rep", "signature", "n", *PARITY), "sets")
    candidates, crowded = _candidates(reps, shortest_prefix(similarity, recall), similarity, early=not at_once)
    of = lambda e: stored(components(e).select(F.col("node").alias("rep"), "component"), "classes")
    links, classes = _climb(candidates, crowded, reps, base, similarity, of, at_once)
    more = _verified(_across(crowded, classes, base, similarity), reps, base, similarity)
    if not more.isEmpty():
        links = links.unionByName(more)
        classes = of(_stars(classes).unionByName(more))
    named = sets.join(classes, "rep", "left").select("set", "n", "rep", F.coalesce("component", "rep").alias("class"))
    if counted:
        degree = stored(_degrees(links, crowded, classes, base, similarity), "degrees")
        named = named.join(degree, "rep", "left")
    rows = signed.select("rid", "id", "set", "n").join(named, ["set", "n"], "left")
    rows = rows.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")) if counted else rows
    return rows.select("rid", "id", F.coalesce("rep", "rid").alias("set_class"), F.coalesce("class", "rid").alias("class"),
                       *(["n_links"] if counted else []))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, set_id, class_id, n_links``.

    ``set_id``: the smallest id of the documents with the same shingle set;
    ``class_id``: that of the documents joined by links (equal ids: not
    linked to an earlier one).  ``n_links``: the number of other sets that
    reach the similarity with the document's set, in groups of any size.  Null, empty and wordless texts are
    classes of their own.  Null or repeated ids are numbered row by row, as in
    ``identified``, and the class ids are then those numbers."""
    c = _classes(identified(docs, id_col, text_col), similarity, recall, counted=True)
    return c.select(F.col("id").alias("doc_id"), F.col("set_class").alias("set_id"), F.col("class").alias("class_id"), "n_links")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The first row, by id, of each class, with all columns of ``docs``."""
    rows = with_rid(docs, id_col, text_col)
    c = _classes(rows.select("rid", F.col("rid").alias("id"), "text"), similarity, recall)
    return rows.join(c.where("rid <> class").select("rid"), "rid", "left_anti").select("row.*")
