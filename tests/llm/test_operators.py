"""Each operator against a plain version of its rule, on small tables and on awkward ones."""

import hashlib
import json
import math
import re
import time
import zlib
from collections import Counter as Bag

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import common, decontaminate, fingerprints, forest, packing, passages, repeats, token_count, toxicity, url_filter, warc
from tesserae.llm.queries import QUERIES, digest_pieces, tokenizer_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, id string, row string, part int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def table(spark, texts):
    """Documents of these texts, or of (id, text) pairs, with columns whose names clash with inner ones."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", None, None, 1, "x", "r", 2) for i, t in rows], DOCS)


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}a" for x in rng.integers(0, vocabulary, n))


BASE = prose(1, 120)
AWKWARD = [(1, None), (2, ""), (None, BASE), (None, None), (3, BASE), (3, BASE), (4, BASE.upper()), (5, "é" * 90 + "ß" * 90),
           (6, "a" * 500), (7, prose(2, 30_000)), (8, "..."), (9, "one two"), (10, BASE + " tail of it"), (3, "another text")]


def removed_by_rule(docs, length):
    """op5 by its definition: {rid: kept bytes}, documents in order."""
    seen, out = set(), []
    for data in docs:
        gone = np.zeros(len(data), bool)
        fresh = []
        for i in range(len(data) - length + 1):
            w = data[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            else:
                seen.add(w)
        out.append((gone, fresh))
    return [g for g, _ in out]


def same_as_rule(got, docs, length):
    for (rid, data), r in zip(docs, got, strict=True):
        assert r["rid"] == rid
    gone = removed_by_rule([d for _, d in docs], length)
    for g, (_, data), r in zip(gone, docs, got, strict=True):
        edge = np.flatnonzero(np.diff(np.r_[False, g, False]))
        assert r["removed"] == edge.tolist()
        assert bytes(r["kept"]) == bytes(np.frombuffer(data, np.uint8)[~g])
        assert r["n_bytes"] == len(data)


def test_repeats_follow_the_rule(spark):
    rng = np.random.default_rng(3)
    parts = [prose(s, 40, 50) for s in range(6)]
    texts = []
    for k in range(60):
        pieces = [parts[i] for i in rng.integers(0, 6, 3)] + [prose(100 + k, 10)]
        t = " ".join(pieces)
        cut = int(rng.integers(0, 30))
        texts.append(t[cut:] if k % 3 else t)
    texts += ["a" * 700, "ab" * 400, texts[0], "é" * 130, "short"]
    docs = table(spark, texts).repartition(5)
    got = repeats.remove_repeats(docs).orderBy("rid").collect()
    same_as_rule(got, [(i, t.encode()) for i, t in enumerate(texts)], 100)
    got = repeats.remove_repeats(docs, length=40).orderBy("rid").collect()
    same_as_rule(got, [(i, t.encode()) for i, t in enumerate(texts)], 40)


def test_repeats_cross_block_edges(spark, monkeypatch):
    texts = [prose(k % 4, 300) for k in range(8)]
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    whole = repeats.runs(data, off, 100)
    monkeypatch.setattr(repeats, "SPAN", 97)
    cut = repeats.runs(data, off, 100)
    assert cut[4].sum() == whole[4].sum() == sum(len(t) - 99 for t in texts)


def test_exact_duplicates(spark):
    texts = [BASE, BASE.upper(), BASE + "!", None, "", "É", "é", BASE]
    got = {r["doc_id"]: r for r in fingerprints.exact_duplicates(table(spark, texts)).collect()}
    norm = [lower(t or "") for t in texts]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(same), len(same), i == max(same))
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_fingerprints_compose_and_collisions_split(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    b = fingerprints.BASES[0]
    poly = 0
    for x in data[:2000].tolist():
        poly = (poly * b + x + 1) % fingerprints.PRIME
    assert fingerprints.chunk_hash(data[:2000], b) == poly
    left, right = fingerprints.chunk_hash(data[:700], b), fingerprints.chunk_hash(data[700:2000], b)
    assert fingerprints.combine(left, right, 1300, b) == poly
    assert fingerprints.fingerprint(data) != fingerprints.fingerprint(data[::-1].copy())
    # documents of one length whose fingerprints are made equal are told apart by the comparison
    rows = spark.createDataFrame([(1, "aaaa"), (2, "aaab"), (3, "aaaa"), (4, "zz")], "rid long, text string").withColumn("id", F.col("rid"))
    real = fingerprints.stored

    def forged(df, name):
        return real(df.withColumn("fp", F.lit(7).cast("long")) if name == "fingerprints" else df, name)

    monkeypatch.setattr(fingerprints, "stored", forged)
    from tesserae.llm.common import ready
    ready(spark)
    got = {r["rid"]: (r["keep"], r["size"]) for r in fingerprints._groups(rows).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def hits_by_rule(texts, items):
    out = []
    known = [(i, WORD.findall(lower(t or ""))) for i, t in items]
    for t in texts:
        w = WORD.findall(lower(t or ""))
        hit, found = set(), set()
        for i, g in known:
            n = min(13, len(g))
            grams = {tuple(g[k:k + n]) for k in range(len(g) - n + 1)} if g else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k:k + n]) in grams:
                    hit.update(range(k, k + n))
                    found.add(i)
        out.append((len(w), len(hit), sorted(map(str, found))))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 7])
def test_contamination(spark, limit):
    items = [(1, prose(9, 40)), (2, "only four words here"), (10, prose(9, 20)), (4, ""), (5, None), (6, "--"), (7, prose(9, 13))]
    texts = [prose(8, 100) + " " + prose(9, 40)[:90] + " " + prose(8, 5), "x ONLY, four! words. HERE y", None, "", "only four words",
             prose(9, 40), prose(7, 2000) + " " + prose(9, 14), "only four words here " * 3]
    from tesserae.llm.common import identified
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.hits(identified(table(spark, texts)), bench, limit)
    got = found.mapInArrow(decontaminate._report, decontaminate.ddl(decontaminate._OUT)).orderBy("doc_id").collect()
    for r, (n, hit, names) in zip(got, hits_by_rule(texts, items), strict=True):
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(names))
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(table(spark, texts), bench).collect()) == [
        r["doc_id"] for r in got if not r["contaminated"]]


def check_pieces(rows, ids, size=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for pieces, total in [(p, len(ids[d])) for d, p in by_doc.items()] + [(p, None) for p in by_seq.values()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert total in (None, at) and (total is not None or at <= size)
    assert set(by_doc) == set(ids)
    return sum(0 if n & (n - 1) == 0 else size - n for n in (sum(x for _, x in p) for p in by_seq.values()))


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = ["", None, "One two.  Three\nfour!\tfive six\x1cseven <|endoftext|> é don't 12,3", prose(4, 9000), "a" * 4000, *[prose(s, s % 70 + 1) for s in range(80)]]
    t = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in enumerate(texts)}
    rows = digest_pieces(packing.pack(table(spark, texts).coalesce(1), tokenizer_path())).collect()
    pad = check_pieces(rows, ids)
    assert pad <= 0.01 * sum(map(len, ids.values()))


def test_cuts_are_cheapest():
    rng = np.random.default_rng(6)
    for _ in range(60):
        at = np.r_[0, np.cumsum(rng.integers(1, 7, rng.integers(1, 14)))]
        cost = rng.integers(0, 5, len(at)).astype(float)
        size = int(rng.integers(7, 15))

        def price(ends):
            return sum(size - (b - a) + cost[list(at).index(b)] for a, b in zip([0, *ends], ends, strict=False))

        best = [0.0] + [math.inf] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + size - (at[j] - at[i]) + cost[j] for i in range(j) if at[j] - at[i] <= size)
        ends = packing.cuts(at, cost, size)
        assert price(ends) == best[-1]


def classes_by_rule(texts, similarity=0.8):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) >= similarity * len(a | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return root


def test_near_duplicates(spark):
    rng = np.random.default_rng(7)
    texts = [None, "", "a b", "A, b", "..."]
    for k in range(12):
        w = prose(50 + k, 150, 5000).split()
        for _ in range(25 if k == 0 else 4):  # one family larger than SMALL
            v = list(w)
            for _ in range(int(rng.integers(0, 4))):
                v[int(rng.integers(0, len(v)))] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(v))
    got = {r["doc_id"]: r for r in forest.near_duplicates(table(spark, texts)).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == classes_by_rule(texts)
    kept = sorted(r["doc_id"] for r in forest.drop_near_duplicates(table(spark, texts)).collect())
    assert kept == sorted(set(classes_by_rule(texts)))
    k = forest.shortest_prefix()
    assert 1 - (1 - 0.8**k) ** forest.TREES >= 0.999


@pytest.mark.parametrize("block", [256, 16])
def test_links_of_large_groups_are_counted(spark, monkeypatch, block):
    """Every set's number of links is exact in families larger than SMALL, in one block or several."""
    monkeypatch.setattr(forest, "COUNTED", block)
    rng = np.random.default_rng(13)
    texts = [None, "one two"]
    for k, (copies, edits) in enumerate([(25, 1), (90, 3), (4, 1)]):
        w = prose(100 + k, 200, 5000).split()
        for _ in range(copies):
            v = list(w)
            for _ in range(edits):
                v[int(rng.integers(0, len(v)))] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(v))
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} if t else set() for t in texts]
    want = [sum(5 * len(a & b) >= 4 * len(a | b) and len(a & b) > 0 and a != b for b in sets) for a in sets]
    got = {r["doc_id"]: r["n_links"] for r in forest.near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want and want[2] == 24


def test_chain_of_near_duplicates(spark):
    """Texts of one large group that are similar only by way of others are one class."""
    rng = np.random.default_rng(11)
    texts = []
    for k in range(3):
        w = prose(90 + k, 200, 5000).split()
        for step in range(40):
            w[step * 5] = f"s{step}n{k}"
            texts.append(" ".join(w))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    got = {r["doc_id"]: r["class_id"] for r in forest.near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_rule(texts)
    assert len(set(got.values())) == 3


def test_pairs_across_classes(spark):
    """The prefix filter alone proposes every similar pair of a large group in which nothing is linked yet."""
    from tesserae.llm.common import ddl, identified

    rng = np.random.default_rng(12)
    w = prose(70, 60, 5000).split()
    texts = []
    for _ in range(30):
        v = list(w)
        for _ in range(int(rng.integers(0, 3))):
            v[int(rng.integers(0, len(v)))] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(v))
    texts = sorted(set(texts))
    base = identified(table(spark, texts))
    reps = base.mapInArrow(forest._sign, ddl(forest._SIGNED)).select(F.col("rid").alias("rep"), "signature")
    crowded = reps.select(F.lit(1).alias("p"), "rep")
    alone = spark.createDataFrame([], "rep long, component long")
    pairs = forest._verified(forest._across(crowded, alone, base, 0.8), reps, base, 0.8)
    grams = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))
            if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want


def test_new_parts_of_many_texts_are_encoded_together(monkeypatch):
    texts = [f"word{i} näme{i}! x{i}'s  \n{'abc' * i}" for i in range(60)] + ["", " "]
    one, many = packing.Encoder(tokenizer_path()), packing.Encoder(tokenizer_path())
    calls = []
    learn = packing.Encoder._learn
    monkeypatch.setattr(packing.Encoder, "_learn", lambda self, new: (calls.append(len(new)), learn(self, new))[1])
    got = list(many.many(texts))
    assert len(calls) == 1
    monkeypatch.setattr(packing, "TOGETHER", 500)
    monkeypatch.setattr(packing, "KNOWN", 100)  # remembered parts are dropped on the way
    assert list(packing.Encoder(tokenizer_path()).many(texts)) == got == [one(t) for t in texts]


def test_forms_of_a_word_are_encoded_once(monkeypatch):
    """A word's capitals and the signs behind it need no encoding of their own; across batches it is encoded once."""
    from tokenizers import Tokenizer

    texts = ["Word word, WORD! (word)", "word; Ärger ärger.\nÄRGER!!! wörd's", "σΣ Σας. İ e\u0301! <|ENDOFTEXT|> word<|endoftext|>.", "", " , "]
    learned = []
    learn = packing.Encoder._learn
    monkeypatch.setattr(packing.Encoder, "_learn", lambda self, new: (learned.extend(new), learn(self, new))[1])
    encode, t = packing.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for _ in range(2):
        for text, ids in zip(texts, encode.many(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert len(learned) == len(set(learned))
    assert {"word", "ärger", ",", "!", "!!!", ";", "."} <= set(learned)
    assert not {"Word", "word,", "WORD!", "word;", "Ärger", "ärger.", "ÄRGER!!!"} & set(learned)


def test_tokenizers_with_other_rules_encode_parts_whole(tmp_path):
    """Without the rules by which letters and signs part, no part is lower-cased or cut."""
    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as f:
        rules = json.load(f)
    rules["normalizer"]["normalizers"].pop()  # keeps capitals
    plain = tmp_path / "cased.json"
    plain.write_text(json.dumps(rules))
    rules["normalizer"] = None
    rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S+"  # keeps signs with words
    whole = tmp_path / "whole.json"
    whole.write_text(json.dumps(rules))
    texts = ["Word word, WORD! wörd", "WÖRD... a's"]
    for path in (str(plain), str(whole)):
        encode, t = packing.Encoder(path), Tokenizer.from_file(path)
        assert [np.frombuffer(x, "<u4").tolist() for x in encode.many(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_pairs_that_cannot_reach_the_similarity_are_not_proposed(spark):
    """Members of a large group that share too few shingles are sifted by their parities; no similar pair is."""
    from tesserae.llm.common import ddl, identified

    rng = np.random.default_rng(21)
    w = prose(71, 120, 5000).split()
    texts = []
    for changes in [2] * 40 + [14] * 200:
        v = list(w)
        for at in rng.choice(len(v), changes, replace=False):
            v[int(at)] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(v))
    base = identified(table(spark, texts))
    reps = base.mapInArrow(forest._sign, ddl(forest._SIGNED)).withColumnRenamed("rid", "rep")
    grams = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    ratio = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    found, crowded = forest._candidates(reps, 1, 0.8)
    pairs = {(r["a"], r["b"]) for f in found for r in f.collect()}
    # without the sift nearly all members are linked to a hub, hardly any of which is similar
    assert pairs and sum(ratio(a, b) >= 0.7 for a, b in pairs) > len(pairs) / 2
    alone = spark.createDataFrame([], "rep long, component long")
    across = {(r["a"], r["b"]) for r in forest._across(crowded, alone, base, 0.8).collect()}
    met = {r["rep"] for r in crowded.select("rep").distinct().collect()}
    want = {(a, b) for a in met for b in met if a < b and ratio(a, b) >= 0.8}
    assert want and want <= across and all(ratio(a, b) >= 0.6 for a, b in across)


def test_components(spark):
    from tesserae.llm.components import components

    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Links that hang on their smallest node already are neither shuffled nor written again."""
    from tesserae.llm import components

    kept = []
    store = components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: (kept.append(name), store(df, name))[1])
    links = [(0, i) for i in range(1, 30)] + [(50, 40), (41, 40), (40, 40)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(30)} | {40: 40, 41: 40, 50: 40} and kept == ["links"]
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_marked_rows_hold_all_wanted(spark):
    """Rows are marked by id, null and repeated ids included; of the others hardly any."""
    from tesserae.llm.common import marked

    rows = spark.createDataFrame([(i,) for i in [*range(-300, 300), 5, None]], "rid long")
    want = {-300, -1, 0, 5, 64, 299}
    got = [r["rid"] for r in marked(rows, spark.createDataFrame([(i,) for i in want], "rid long")).where("marked").collect()]
    assert set(got) == want and got.count(5) == 2
    assert marked(rows, rows.limit(0)).where("marked OR marked IS NULL").count() == 0


def test_swapped_terms_score_alike(spark):
    """Neutral mentions of one group, seen only in toxic rows, must not make a text toxic."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        filler = [f"word{x}" for x in rng.integers(0, 40, 12)]
        toxic = i % 3 == 0
        words = filler + (["horrid"] if toxic else []) + (["muslims"] if toxic and i % 2 else [])
        rows.append((" ".join(words) + ".", int(toxic)))
    labelled = spark.createDataFrame(rows, "text string, label int")
    neutral = [f"word{k} muslims word{k + 1}" for k in range(20)]

    def scores(model):
        blocks = [np.frombuffer(t.encode(), np.uint8) for t in neutral]
        off = np.r_[0, np.cumsum([len(b) for b in blocks])]
        name, _, row = toxicity.features(np.concatenate(blocks), off)
        return model.score(name, row, len(blocks)).mean()

    from tesserae.llm.common import ready
    ready(spark)
    fair, plain = toxicity.train(labelled, counterfactual=3.0), toxicity.train(labelled, counterfactual=0.0)
    assert scores(fair) < scores(plain)


def test_swaps_take_the_stems_along(spark):
    """At the production weight a neutral mention scores as with another term, below the threshold, though the term has stems."""
    from tesserae.llm.common import ready
    ready(spark)
    rng = np.random.default_rng(9)
    rows = []
    for i in range(3000):
        toxic = i % 6 == 0
        named = rng.random() < (0.5 if toxic else 0.05)
        words = [f"word{x}" for x in rng.integers(0, 40, 12)] + ["horrid"] * (toxic and rng.random() < 0.6) + ["muslims"] * named
        rows.append((" ".join(words) + ".", int(toxic)))
    model = toxicity.train(spark.createDataFrame(rows, "text string, label int"))

    def score(text):
        data = np.frombuffer(text.encode(), np.uint8)
        name, _, row = toxicity.features(data, np.array([0, len(data)]))
        return float(model.score(name, row, 1)[0])

    for k in range(20):
        one, two = (score(f"word{k} {term} word{k + 1}") for term in ("muslims", "christians"))
        assert abs(one - two) < 0.05 and max(one, two) < model.threshold, (k, one, two)
    assert score("word1 horrid word2") > model.threshold


def test_training_counts_every_row(spark, monkeypatch):
    """Rows that share a passage, and short rows, all reach training; only verified near copies share one weight."""
    passage = prose(5, 60)
    docs = [(i, f"{passage} {prose(200 + i, 100, 5000)}") for i in range(40)]
    docs += [(100 + i, f"short{i}") for i in range(20)] + [(200 + i, BASE + f" tail{i}") for i in range(10)]
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda labelled, threshold: seen.extend(labelled.collect()))
    labels = spark.createDataFrame([(i, 0) for i, _ in docs], "doc_id long, toxic int")
    held = {r["id"] for r in spark.createDataFrame([(i,) for i, _ in docs], "id long").where(toxicity.held_out(F.col("id"))).collect()}
    toxicity.train_on(table(spark, docs), labels)
    assert sorted(r["text"] for r in seen) == sorted(t for i, t in docs if i not in held)
    copies = [r["weight"] for r in seen if r["text"].startswith(BASE)]
    assert len(copies) > 1 and abs(sum(copies) - toxicity.ONE) <= len(copies)
    assert all(r["weight"] == toxicity.ONE for r in seen if not r["text"].startswith(BASE))


@pytest.mark.parametrize("few", [500_000, 0])
def test_only_texts_that_share_a_weight_are_shuffled(spark, monkeypatch, few):
    """Training reads the texts of rows without near copies where they are, with many labels too; every row keeps its weight."""
    docs = [(i, f"{prose(300 + i, 60, 5000)}") for i in range(40)] + [(100 + i, BASE + f" tail{i}") for i in range(8)]
    docs += [(7, prose(900, 60, 5000)), (None, prose(901, 60, 5000))]
    seen, plans = [], []

    def train(labelled, threshold):
        seen.extend(labelled.collect())
        plans.append(labelled._jdf.queryExecution().sparkPlan().toString())

    monkeypatch.setattr(toxicity, "train", train)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", few)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs[:48]], "doc_id long, toxic int")
    toxicity.train_on(table(spark, docs), labels)
    held = {r["id"] for r in labels.select(F.col("doc_id").alias("id")).where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert sorted((r["text"], r["label"]) for r in seen) == sorted((t, i % 2) for i, t in docs if i is not None and i not in held)
    copies = [r for r in seen if r["text"].startswith(BASE)]
    for label in {r["label"] for r in copies}:
        share = [r["weight"] for r in copies if r["label"] == label]
        assert abs(sum(share) - toxicity.ONE) <= len(share)
    assert all(r["weight"] == toxicity.ONE for r in seen if not r["text"].startswith(BASE))
    assert plans[0].startswith("Union") and plans[0].count("SortMergeJoin") + plans[0].count("ShuffledHashJoin") <= 1


def test_toxicity_held_out(spark, sf001):
    """Held-out rows of a larger table: most of the toxic are caught, nearly all others left alone."""
    sf = sf001.replace("0.001", "0.1")
    rows = QUERIES["op6_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["n"] for r in rows.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n[1, 0]) and n.get((0, 1), 0) <= 0.02 * n[0, 0]


def model_by_rule(texts, good, bad):
    """The variable-order models in plain Python: a text's score."""
    order = url_filter.ORDER
    seen = {c: Bag() for c in "gb"}
    for t, *n in zip(texts, good, bad, strict=True):
        for i in range(order, len(t)):
            for k in range(order + 1):
                for c, x in zip("gb", n, strict=True):
                    seen[c][t[i - k:i + 1]] += x
    kinds = sum(len(x) == 1 for x in {h for c in "gb" for h, n in seen[c].items() if n})
    total, after = {c: Bag() for c in "gb"}, {c: Bag() for c in "gb"}
    for c in "gb":
        for hx, n in seen[c].items():
            total[c][hx[:-1]] += n
            after[c][hx[:-1]] += n > 0

    def p(c, h, x):
        if not h:
            return (seen[c][x] + 0.5) / (total[c][""] + 0.5 * (kinds + 1))
        lower = p(c, h[1:], x)
        return (seen[c][h + x] + after[c][h] * lower) / (total[c][h] + after[c][h]) if total[c][h] else lower

    return lambda t: float(np.mean([math.log(p("g", t[i - order:i], t[i])) - math.log(p("b", t[i - order:i], t[i])) for i in range(order, len(t))]))


def test_url_filter(spark):
    urls = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12", "https://example.org/en/2#a", "http://notorg/x", "x.org/",
            "http://b.com/fr/q", "http://b.com/de/q/9", "http://b.com/nl/q", "http://c.net/fr/q", None, "", "http://d.org", "http://é.net/ü",
            "http://b.com/nl/q", "http://long.net/" + "a1/" * 5000] + [f"http://s{i}.com/{'fr' if i % 2 else 'de'}/p{i}" for i in range(30)]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, s int")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    texts, ruled = [], []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=(0, None, None))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule[1])
        if rule[2]:
            assert got[i]["verdict"] == rule[2]
        ruled.append(rule[2])
        texts.append(url_filter.START * url_filter.ORDER + host + path + url_filter.END)
    held = [zlib.crc32(t.encode()) % url_filter.HELD == 0 for t in texts]
    model = model_by_rule(texts, *([x == v and not h for x, h in zip(ruled, held, strict=True)] for v in ("allow", "block")))
    score = [model(t) for t in texts]
    assert all(abs(got[i]["score"] - s) < 2e-6 for i, s in enumerate(score))
    aside = held if all(v in {x for x, h in zip(ruled, held, strict=True) if h} for v in ("allow", "block")) else [True] * len(texts)
    a, b = (np.array([s for s, x, h in zip(score, ruled, aside, strict=True) if x == v and h]) for v in ("allow", "block"))
    a_spread, b_spread = max(a.std(), 1e-6), max(b.std(), 1e-6)
    cut = (a.mean() * b_spread + b.mean() * a_spread) / (a_spread + b_spread)
    for i, s in enumerate(score):
        if not ruled[i] and abs(s - cut) > 1e-5:
            assert got[i]["verdict"] == ("allow" if s >= cut else "block")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages.where("page_id = 8")).collect()} == {"allow"}
    # digits, signs and letters of any script tell URLs apart, and repeated rows are judged one by one
    odd = ["http://z.net/2020/αβγ", "http://z.net/1999/дец", "http://z.net/1999/!!!", "http://z.net/1999/!!!"]
    taught = [(800 + i, f"http://q{i}.com/fr/де{i}", "h", 1) for i in range(20)]
    more = pages.unionAll(spark.createDataFrame(taught + [(900 + min(i, 2), u, "h", 1) for i, u in enumerate(odd)], pages.schema))
    scores = [r["score"] for r in url_filter.judge_urls(more).where("page_id >= 900").orderBy("page_id").collect()]
    assert len(scores) == 4 and len(set(scores)) == 3


def test_url_counts_grow_with_the_urls_and_stay_native(spark, monkeypatch):
    tables = {}
    store = url_filter.stored
    monkeypatch.setattr(url_filter, "stored", lambda df, name: tables.setdefault(name, []).append(store(df, name)) or tables[name][-1])
    for n in (40, 400):
        urls = [(i, f"http://s{i * 7919 % 1000}.com/{'fr' if i % 2 else 'de'}/{i * 104729 % 99991:x}") for i in range(n)]
        out = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))
    few, many = (t.count() for t in tables["suffixes"])
    assert many > 4 * few


def test_revisits(spark):
    R = "record_id long, url string, at long, kind string, headers map<string,string>, payload_digest string, slice int"
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        kind = "revisit" if rng.random() < 0.4 else "response" if rng.random() < 0.95 else "request"
        tag = f'"{rng.integers(0, 2)}"'
        h = {"ETag": ("W/" if rng.random() < 0.5 else "") + tag, "Content-Length": str(i), "X": str(i)} if rng.random() < 0.8 else (
            {"last-modified": "d" + str(rng.integers(0, 2))} if rng.random() < 0.7 else None)
        url = f"http://{'WWW.' if i % 2 else ''}h{rng.integers(0, 3)}.org/p{'/' if i % 3 else ''}" if i % 29 else None
        rows.append((i, url, int(rng.integers(0, 60)) if i % 31 else None, kind, h, f"d{i}", 1))
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, R), slices=7).collect()}
    canon = lambda u: u.split("://")[1].lower().removeprefix("www.").rstrip("/")
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    assert set(got) == {r[0] for r in rows if r[3] == "revisit"}
    for i, url, at, kind, h, _, _ in rows:
        if kind != "revisit":
            continue
        past = [r for r in rows if r[3] == "response" and url and r[1] and at is not None and r[2] is not None
                and canon(r[1]) == canon(url) and (r[2], r[0]) < (at, i)]
        if not past:
            assert (got[i]["outcome"], got[i]["response_id"], got[i]["headers"]) == ("no_response", None, None)
            continue
        last = max(past, key=lambda r: (r[2], r[0]))
        mine, theirs = low(h), low(last[4])
        outcome = "unverified"
        for k, norm in (("etag", lambda x: x.removeprefix("W/")), ("last-modified", str)):
            if k in mine and k in theirs:
                outcome = "matched" if norm(mine[k]) == norm(theirs[k]) else "mismatch"
                break
        assert (got[i]["response_id"], got[i]["outcome"]) == (last[0], outcome)
        if outcome == "matched":
            assert got[i]["headers"] == theirs | {k: v for k, v in mine.items() if k not in warc.WITHHELD}
            assert got[i]["payload_digest"] == last[5]


def test_token_counts_match_the_tokenizer(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = tokenizer_path("piece_bpe_32k.model")
    proto = pb.ModelProto()
    proto.ParseFromString(open(path, "rb").read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores, read as a unigram model
    for p in proto.pieces:
        p.score = p.score if p.score > -1e6 else token_count.FLOOR
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = ["", "Hello world", "  two  spaces ", "tab\tand\nline", "日本語のテキスト 漢字", "emoji 🙂🙂 \u0000x", prose(3, 60), "naïve café",
             "aaaaaaaaaaaaaaaaaaaaaaaa", "1234567890 " * 5, "▁ raw ▁mark", "the The THE thethethe"]
    got = {r["doc_id"]: r for r in token_count.token_counts(table(spark, [*texts, None]), path).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == [len(sp.encode(t)) for t in texts]
    assert got[len(texts)]["n_tokens"] == 0 and got[4]["n_bytes"] == len(texts[4].encode())


def test_viterbi_against_all_segmentations():
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.5), ("aab", -2.0), ("bb", -1.5)]
    c = token_count.Counter(pieces, byte_pieces=True)
    score = dict(pieces)

    def every(t):
        if not t:
            yield 0.0, 0
        for k in range(1, len(t) + 1):
            if t[:k] in score:
                for s, n in every(t[k:]):
                    yield s + score[t[:k]], n + 1

    rng = np.random.default_rng(2)
    for _ in range(60):
        t = "".join(rng.choice(list("ab"), 9))
        best = max(s for s, _ in every(t))
        assert c.path(t) in {n for s, n in every(t) if s == best}
    assert c.path("ab") == 1  # equal scores: the piece that starts first
    assert c.path("aéa") == 4


def test_chains_are_best():
    rng = np.random.default_rng(4)
    for _ in range(40):
        m = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (14, 2))})
        best = []
        for i, (a, b) in enumerate(m):
            best.append(passages.GAIN + max([0.0] + [best[j] - passages.GAP * (a - x + b - y) for j, (x, y) in enumerate(m[:i]) if x < a and y < b]))
        found = passages.chains([a for a, _ in m], [b for _, b in m])
        assert abs(found[0][0] - max(best)) < 1e-9
        assert sorted(x for _, path in found for x in path) == list(range(len(m)))


def test_passages_with_edits_are_found(spark):
    rng = np.random.default_rng(5)
    shared = prose(77, 80, 10**6).split()
    texts, planted = [], {}
    for k in range(40):
        w = prose(200 + k, 150, 10**6).split()
        if k % 4 == 0:
            v = list(shared)
            for _ in range(3 if k else 0):
                v[int(rng.integers(5, 75))] = f"edit{k}"
            at = int(rng.integers(0, 140))
            w[at:at] = v
            planted[k] = at
        texts.append(" ".join(w))
    texts += [texts[1]] * 3 + ["", None, "few words"]
    rows = passages.shared_passages(table(spark, texts)).collect()
    assert {r["doc_id"] for r in rows} == set(planted) - {0} | {40, 41, 42}
    assert all(r["source_id"] < r["doc_id"] for r in rows)
    for k in set(planted) - {0}:
        covered = set()
        for r in rows:
            if r["doc_id"] == k:
                covered.update(range(r["start"], r["end"]))
                assert texts[r["source_id"]].split()[r["source_start"]] == texts[k].split()[r["start"]]
        assert len(covered & set(range(planted[k], planted[k] + 80))) >= 50 and len(covered) <= 84
    whole = {r["doc_id"]: r for r in rows if r["doc_id"] >= 40}
    assert all(r["source_id"] == 1 and r["n_edits"] == 0 and r["n_equal"] >= 130 for r in whole.values())
    gone = passages.shared_passages(table(spark, AWKWARD)).collect()
    assert len(gone) >= 3 and passages.shared_passages(table(spark, AWKWARD).limit(0)).collect() == []


OPERATORS = {
    "exact": lambda d, b, lab: fingerprints.exact_duplicates(d),
    "drop_exact": lambda d, b, lab: fingerprints.drop_exact_duplicates(d),
    "contamination": lambda d, b, lab: decontaminate.contamination(d, b),
    "decontaminated": lambda d, b, lab: decontaminate.decontaminated(d, b),
    "repeats": lambda d, b, lab: repeats.digest(repeats.remove_repeats(d)),
    "near": lambda d, b, lab: forest.near_duplicates(d),
    "drop_near": lambda d, b, lab: forest.drop_near_duplicates(d),
    "pack": lambda d, b, lab: packing.pack(d, tokenizer_path()),
    "tokens": lambda d, b, lab: token_count.token_counts(d, tokenizer_path("piece_bpe_32k.model")),
    "toxicity": lambda d, b, lab: toxicity.toxicity(d, lab),
    "drop_toxic": lambda d, b, lab: toxicity.drop_toxic(d, lab),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_tables(spark, name):
    bench = spark.createDataFrame([(1, BASE), (1, BASE), (None, "x"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 1), (3, 0, 0), (None, 1, 1), (4, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, AWKWARD)
    rows = OPERATORS[name](docs, bench, labels).collect()
    if name == "exact":
        assert len(rows) == len(AWKWARD) and sum(r["kept"] for r in rows) == len({lower(t or "") for _, t in AWKWARD})
    elif name in ("drop_exact", "drop_near", "decontaminated", "drop_toxic"):
        assert (rows or name == "drop_toxic") and all(set(r.asDict()) == set(docs.columns) for r in rows)
    elif name != "pack":
        assert len(rows) == len(AWKWARD)
    if name == "repeats":
        assert sum(r["n_removed"] == r["n_bytes"] and r["n_bytes"] > 100 for r in rows) == 2  # the copies of BASE
    assert OPERATORS[name](docs.limit(0), bench, labels.limit(0)).collect() == []
    OPERATORS[name](docs, bench.limit(0), labels.limit(0)).collect()


def test_suffix_dedup_shuffles_the_texts_once(spark):
    """Both joins with the texts read one shuffle, and the answer is that of the rule."""
    texts = [(7, BASE), (8, "x " + BASE), (9, BASE[:150] + prose(3, 40)), (10, None), (11, prose(4, 60)), (12, prose(4, 60))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = repeats.remove_repeats(table(spark, texts))
        rows = sorted(found.collect(), key=lambda r: r["rid"])
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ReusedExchange" in plan
    same_as_rule(rows, [(i, (t or "").encode()) for i, t in texts], repeats.LENGTH)


def test_stored_leaves_no_shuffle_files(spark):
    """What was shuffled for a scratch table goes once it is written."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getPath() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    rows = common.stored(spark.range(20_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    left, until = files() - before, time.monotonic() + 20
    while left and time.monotonic() < until:
        time.sleep(0.2)
        left = files() - before
    assert not left
    assert sum(r["count"] for r in rows.collect()) == 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_workers_let_go_of_what_packing_kept(spark):
    """A worker's known parts stay for further tasks of packing and go with the first task of another operator."""
    docs = table(spark, [BASE, prose(5, 50)]).coalesce(1)

    def kept(keep):
        def run(it):
            for b in it:
                yield common.batch({"n": pa.int64()}, [len(common.KEPT)] * b.num_rows)

        return [r["n"] for r in docs.select("doc_id").mapInArrow(common.tidy(run, keep), "n long").collect()]

    for _ in range(8):  # a worker may be another one each time
        packing.pack(docs, tokenizer_path()).collect()
        if kept(keep=True)[0]:
            break
    else:
        pytest.skip("no worker was used twice")
    assert not any(kept(keep=False)[0] for _ in range(8))
    assert [len(r["ids"]) for r in packing.pack(docs, tokenizer_path()).collect()]
