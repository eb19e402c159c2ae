"""The whole pipeline against its rules in plain Python, stage by stage, on a small corpus with awkward rows."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def prose(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 3000, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    texts = {i: prose(rng, 80) for i in range(120)}
    labels = [(i, 1, 0) for i in range(120)]
    for i in range(120, 240):  # toxic ones, all labelled but for the last twenty
        texts[i] = f"{prose(rng, 40)} vileword nastyword {prose(rng, 20)}"
        labels += [(i, 1, 1)] if i < 220 else []
    base = prose(rng, 150)
    bench = [prose(rng, 40) for _ in range(3)]
    texts |= {300: "Some Words of a copied text, " + base, 301: "some words OF a copied text, " + base, 302: base, 303: base + " tail", 304: base + " other end",
              305: bench[0], 306: f"{bench[1][:200]} {prose(rng, 30)}", 307: f"{prose(rng, 900)} {bench[2]}", 308: "", 309: "...", 310: "one", 311: "ONE"}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    rows += [(400, None, None, None, None), (401, None, "en", "s", 0), (None, prose(rng, 90), "en", "s", 1), (None, prose(rng, 70), "en", "s", 1),
             (5, prose(rng, 60), "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)) + [(9, None), (10, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def key(r):
    return r["doc_id"], r["text"]


def exact_by_rule(rows):
    """Of equal texts the largest id stays; rows without an id come after all others."""
    best = {}
    for r in rows:
        t = lower(r["text"])
        if t not in best or (r["doc_id"] is None, r["doc_id"] or 0) > (best[t]["doc_id"] is None, best[t]["doc_id"] or 0):
            best[t] = r
    return Counter(map(key, best.values()))


def near_by_rule(rows):
    """The first row, by id, of each class of rows joined by similarity 0.8 of five-word shingles."""
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    sets = []
    for r in rows:
        w = WORD.findall(lower(r["text"]))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return Counter(key(r) for i, r in enumerate(rows) if find(i) == i)


def clean_by_rule(rows, items):
    windows = set()
    for t in items:
        w = WORD.findall(lower(t))
        windows |= {tuple(w[i:i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    out = Counter()
    for r in rows:
        w, hit = WORD.findall(lower(r["text"])), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            out[key(r)] += 1
    return out


def test_each_stage_follows_its_rule(spark, folder):
    from tokenizers import Tokenizer

    from tesserae.llm.queries import tokenizer_path
    from tesserae.llm.toxicity import toxicity

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), DOCS).repartition(2)
        assert docs.columns == [f.split()[0] for f in DOCS.split(", ")]
        kept[name] = before, Counter(map(key, docs.collect()))
    rows, got = kept["toxicity"]
    judged = toxicity(spark.createDataFrame(rows, DOCS), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert Counter(r["doc_id"] for r in judged if not r["predicted"]) == Counter(i for i, _ in got.elements())
    assert not any(i in range(120, 240) for i, _ in got) and all((r["doc_id"], r["text"]) in got for r in rows if r["doc_id"] not in range(120, 240))
    rows, got = kept["exact_dedup"]
    assert got == exact_by_rule(rows) and 300 not in {i for i, _ in got} and 301 in {i for i, _ in got}
    rows, got = kept["near_dedup"]
    assert got == near_by_rule(rows) and sum(i in range(301, 305) for i, _ in got) == 1
    rows, got = kept["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert got == clean_by_rule(rows, items) and 305 not in {i for i, _ in got} and 307 in {i for i, _ in got}
    # packing: every document's tokens, once, in sequences of at most 2048
    pieces = corpus_pipeline.run(spark, folder).collect()
    own = Tokenizer.from_file(tokenizer_path())
    sizes = Counter((i, len(own.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in got.elements())
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0) == sizes
    assert sum(r["length"] for r in pieces) == sum(n * k for (_, n), k in sizes.items())
    room = Counter()
    for r in pieces:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 2048


def test_the_pipeline_of_no_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
