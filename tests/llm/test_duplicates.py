"""Jaccard join, substring removal, components, pipeline: against brute force, skew and odd inputs."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from synthloom.llm import jaccard, recompression, substrings
from synthloom.llm.components import components

ODD = [(1, None, 9), (2, "", 9), (3, " \n", 9), (4, "one two", 9), (5, "one two", 9), (5, "one two", 9), (None, "one two", 9), (7, "w " * 20000, 9)]
COLUMNS = "doc_id long, text string, _id int"


def near_texts(seed=0):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):  # many near copies of one text
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    for i in range(20):
        texts.append(" ".join(f"{i}v{rng.randrange(50)}" for _ in range(rng.randrange(3, 80))))
    return texts + texts[:5] + texts[60:65]


def brute_links(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    n = [0] * len(texts)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root, n


@pytest.mark.parametrize("block", [512, 16])
def test_links_and_classes(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", block)
    monkeypatch.setattr(jaccard, "EXACT_BLOCK", block)
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()}
    root, n = brute_links(texts)
    assert got == {i: (root[i], n[i]) for i in range(len(texts))}
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == sorted(set(root))


def test_jaccard_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, COLUMNS)
    rows = jaccard.near_duplicates(docs).collect()
    assert len(rows) == len(ODD) and sorted(r.n_links for r in rows) == [0, 0, 0, 0, 3, 3, 3, 3]
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "7", "None"]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0 and jaccard.one_of_each(docs.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 1)], COLUMNS)
    assert jaccard.one_of_each(again).count() == 1


def test_pruning_keeps_what_may_reach_the_threshold():
    keep = jaccard.least_matches()
    assert keep == sorted(keep) and all(k < 0.8 * n for k, n in zip(keep, jaccard.LOOKS, strict=True)) and keep[-1] > 70


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    single = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: r for x, r in root.items() if x not in single}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_kept(texts, window):
    words = [(t or "").split() for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = {(d, i + k) for at in seen.values() if len(at) > 1 for d, i in at for k in range(window)}
    return [" ".join(x for i, x in enumerate(w) if (d, i) not in gone) for d, w in enumerate(words)]


@pytest.mark.parametrize(("window", "chunk"), [(35, 1 << 20), (12, 50)])
def test_repeats(spark, monkeypatch, window, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = random.Random(4)
    passages = [[f"p{k}_{i}" for i in range(rng.randrange(20, 90))] for k in range(4)]
    texts = []
    for d in range(40):
        t = [f"d{d}_{i}" for i in range(rng.randrange(60))]
        for p in rng.sample(passages, rng.randrange(3)):
            a = rng.randrange(max(1, len(p) - 40))
            t[rng.randrange(len(t) + 1) : 0] = p[a : a + rng.randrange(20, 90)]
        texts.append(" ".join(t))
    texts += ["a " * 100, "b a " * 60, "a " * 34, texts[0], texts[0], "same " * 200 + "end", None, "", " x\x1cy " * 40, " ".join(rng.choice("ab") for _ in range(2000))]
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, _key int").repartition(3)
    spaces = str.maketrans({" ": "N", "\x1c": "C"})
    want = sorted(x.translate(spaces) for x in brute_kept([None if t is None else t.translate(spaces) for t in texts], window))
    rows = substrings.without_repeats(docs, window).collect()
    assert sorted(r.text.translate(spaces) for r in rows) == want
    assert all(r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_symbols_are_the_same_wherever_their_context_is():
    rng = np.random.default_rng(3)
    passage = rng.integers(1, 2**60, 80, dtype=np.uint64)
    one = np.concatenate([rng.integers(1, 2**60, 30, dtype=np.uint64), passage, rng.integers(1, 2**60, 50, dtype=np.uint64)])
    two = np.concatenate([rng.integers(1, 2**60, 7, dtype=np.uint64), passage, rng.integers(1, 2**60, 3, dtype=np.uint64)])

    def inside(x, at):
        s = recompression.recompress(x, np.array([len(x)]))
        held = (s.low >= at) & (s.high <= at + 80)
        return set(zip(s.name[held].tolist(), (s.start[held] - at).tolist()))

    assert inside(one, 30) == inside(two, 7) and len(inside(one, 30)) > 5


@pytest.mark.parametrize("window", [8, 12, 20, 35])
def test_no_repeated_window_is_closed(window):
    rng = np.random.default_rng(window)
    for trial in range(40):
        passages = [rng.integers(1, 3 + trial * 5, window + 12, dtype=np.uint64) for _ in range(3)]
        docs = [np.concatenate([rng.integers(1, 3 + trial * 5, rng.integers(0, 30), dtype=np.uint64), passages[rng.integers(3)][rng.integers(0, 8) :], rng.integers(1, 3 + trial * 5, rng.integers(0, 30), dtype=np.uint64)]) for _ in range(25)]
        hashes, lengths = recompression.mixed(np.concatenate(docs)), np.array([len(d) for d in docs])
        name, doc, ordinal, *_ = substrings._symbols(hashes, lengths, window)
        _, repeats = substrings._told_apart(name)
        shared = pa.array([ordinal[(doc == d) & repeats].tolist() or None for d in range(len(docs))], pa.list_(pa.int32()))
        at, _, _ = substrings._open(hashes, lengths, shared, window)
        seen = {}
        for d, begin in enumerate(np.cumsum(lengths) - lengths):
            for i in range(lengths[d] - window + 1):
                seen.setdefault(tuple(hashes[begin + i : begin + i + window].tolist()), []).append(begin + i)
        assert {i for places in seen.values() if len(places) > 1 for i in places} <= set(at.tolist())


def test_keys_told_apart():
    first, repeats = substrings._told_apart(np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 1], np.uint64))
    assert first.tolist() == [True, True, False, True] and repeats.tolist() == [True, False, True, False]


def test_window_hashes():
    x = np.tile(np.random.default_rng(5).integers(1, 2**60, 10, dtype=np.uint64), 5)
    h = recompression.window_hashes(x, 7)
    assert len(h) == 44 and (h[:34] == h[10:]).all() and len(np.unique(h)) == 10


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in c.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, sf)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        if name == "near_duplicates":
            rows = before.select("doc_id", "text").orderBy("doc_id").collect()
            root, _ = brute_links([r.text for r in rows])
            assert sorted(r.doc_id for r in kept.collect()) == sorted(rows[i].doc_id for i in set(root))
    assert kept.filter(F.col("text").rlike(r"@[a-z0-9]+\.")).count() == 0
    out = c.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in kept.collect()}


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(9)

    def prose(n):
        return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('klmnrst')}{rng.randrange(9)}" for _ in range(n))

    shared = prose(90)
    rows = [(i, prose(60 + i), "en", "ab"[i % 2], None, i) for i in range(30)]
    rows += [(50, shared, "en", "a", 5, 1)] * 6 + [(51, shared + " more", None, "b", 5, 1), (None, prose(80), "de", None, None, None), (52, prose(20000), "fr", "b", 1, 1)]
    rows += [(53, None, "en", "a", None, 1), (54, "", "en", "a", 0, 1), (55, " \n ", "en", "a", 3, 1), (56, prose(70) + " mail me@x.org", "en", "a", 9, 1), (57, prose(60), "en", "c", 9, 2)]
    columns = "doc_id long, text string, lang string, source string, n_chars int, _key int"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in c.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), docs.schema)
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
        if name == "quality":
            assert [i for _, i in ids if i >= 50] == [50] * 6 + [51, 52, 56, 57] and len(ids) == 41
        if name == "near_duplicates":
            assert [i for _, i in ids if i >= 50] == [50, 52, 56, 57] and len(ids) == 35
    out = c.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in kept.collect()}
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert c.run(spark, str(tmp_path / "none")).count() == 0
