"""Packing, sharding, mixing, quality: against brute force, and odd inputs."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from synthloom.llm import mixing, packing, quality, sharding
from synthloom.llm.queries import QUERIES, SQL
from tests.helpers import same

ODD = [(1, None, "a", "x"), (2, "", None, "x"), (3, "one two", "a", "x"), (3, "one two", "a", "x"), (None, "tailé \U0001f600 end", "b", None), (5, "w " * 9000, "b", "y")]
COLUMNS = "doc_id long, text string, source string, size string"


def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, tmp_path, name):
    same(spark, QUERIES[name], SQL[name], sf, tmp_path)


def test_packing_of_documents(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.TOKENIZER)
    rows = QUERIES["op1_packing"](spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want = [(k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        assert sorted(pieces[doc]) == want
    for held in sequences.values():
        held.sort()
        assert [a for a, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]] and sum(n for _, n in held) <= 4096
    assert len(sequences) <= -(-sum(r.length for r in rows) // 4096) + 1


def lower_bound(lengths, room):
    """Bins that are needed at least: those above half a room, and what of the rest doesn't fit beside them (Martello and Toth)."""
    best = 0
    for k in range(room // 2 + 1):
        large, middle = lengths[lengths > room - k], lengths[(lengths > room // 2) & (lengths <= room - k)]
        rest = lengths[(lengths >= k) & (lengths <= room // 2)].sum() - (len(middle) * room - middle.sum())
        best = max(best, len(large) + len(middle) + max(0, -(-rest // room)))
    return best


def test_best_two_fit():
    # greedy fills 6 + 3 of 10; the 3 gives way to two 2s
    bins, offsets = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert [bins[0], bins[2], bins[3]] == [0, 0, 0] and bins[1] == 1
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 101, 500)
    bins, offsets = packing.best_two_fit(lengths, 100)
    for b in np.unique(bins):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert (np.cumsum(lengths[at]) - lengths[at] == offsets[at]).all() and lengths[at].sum() <= 100
    assert len(np.unique(bins)) == lower_bound(lengths, 100)


def test_packing_of_odd_rows(spark):
    rows = packing.pack(odd(spark)).collect()
    assert len(rows) == 8 and sum(r.doc_id == 5 for r in rows) == 3 and sorted(r.length for r in rows)[:2] == [1, 1]
    assert packing.pack(odd(spark).limit(0)).count() == 0
    assert sum(r.doc_id is None for r in rows) == 1


def test_words_code_like_whole_texts():
    coder = packing.WordIds(packing.TOKENIZER)
    texts = ["Don't STOP, it's 12,5 Été. x y", "a\x1cb İstanbul ΣΣ 한글 é", "<|endoftext|> www.a.b ...", "", " \n"]
    want = [np.array(coder.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    for _ in range(2):
        ids, edges = coder.of(pa.array(texts))
        assert [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] == want


def test_shards_are_contiguous_and_balanced(spark, sf):
    rows = QUERIES["op2_sharding"](spark, sf).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(rows, key=lambda r: (r.text_crc32, r.doc_id))
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    assert [r.shard for r in order] == sorted(r.shard for r in rows)
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    for k in range(8):
        held = [r for r in order if r.shard == k]
        assert [r.slot for r in held] == list(range(len(held)))
        assert abs(sum(r.size for r in held) - total / 8) <= largest


def test_shards_of_odd_rows(spark, tmp_path):
    rows = sharding.byte_shards(odd(spark), 3).collect()
    assert len(rows) == 6 and sum(r.size == 1 for r in rows) == 2
    assert sharding.byte_shards(odd(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.byte_shards(odd(spark), 0)
    docs = spark.createDataFrame([(i, "x" * i) for i in range(20)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 20


def test_targets_fill_up_to_the_ceiling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(1.5 * 2060)
    assert all(got[s] <= 2 * n + 1e-9 for s, n in (("a", 10), ("b", 1000), ("c", 1000), (None, 50)))


def test_mix_of_odd_rows(spark):
    rows = mixing.mix(odd(spark)).collect()
    assert len(rows) == 6 and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(odd(spark).limit(0)).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd(spark).repartition(5)).collect()))


def test_mixed_documents_repeat_whole_rows(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") < 200, "a").otherwise("b").alias("source"), F.lit(1).alias("_row"), F.lit(2).alias("_at"))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    want = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert all(abs(taken[s] - t) <= 7 for s, t in want.items())


def test_mix_gives_what_it_takes_where_rows_repeat(spark):
    rows = [(7, "five words are in it", "b", 1)] * 2000 + [(i, "w " * (1 + i % 5), "a", i) for i in range(900)] + [(None, "x y", None, 3)] * 3 + [(1, None, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, _more int").repartition(7)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    given = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    mixed = mixing.mix(docs.withColumn("k", F.unhex(F.md5(F.concat_ws(":", F.xxhash64("doc_id", "source").cast("string"), F.hex(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))))))), id_col="k")
    taken = {r.source: (r.n, r.target) for r in mixed.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("target")).collect()}
    assert all(given[s] == n and abs(n - target) <= 3 for s, (n, target) in taken.items())
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_open_ends_of_all_groups_are_packed_together(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), (F.col("id") * 7919 % 1500).cast("int")).alias("text"))
    few = docs.unionByName(spark.range(1).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text")).crossJoin(spark.range(500)).drop("id"))
    rows = packing.pack(few, group_rows=64).collect()
    assert len(rows) == 3500 and len({(r.sequence_id, r.offset) for r in rows}) == 3500
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in filled.values():
        held.sort()
        assert [a for a, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]] and sum(n for _, n in held) <= 4096
    assert len(filled) <= -(-sum(r.length for r in rows) // 4096) * 1.02 + 2


def brute_repeats(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})


def test_repeated_words(spark):
    texts = ["a b c a b c", "a a a a a", "a b", "", "x y z w x y z q x y", " ".join("ab"[i * i % 3 % 2] for i in range(300)), " ".join(str(i) for i in range(500))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", quality.features(F.col("t"))["n_repeat_words"].alias("n")).collect()}
    assert got == {i: brute_repeats(t.split()) for i, t in enumerate(texts)}
    # with four bits of hash nearly all windows collide, and are told apart by their words
    few = {r.i: r.n for r in df.select("i", quality.repeated_words(quality.words_of(F.col("t")), place_bits=60).alias("n")).collect()}
    assert few == got


def test_cascade_keeps_clean_documents(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    junk = {"symbols": clean.replace(" ", " # "), "capitals": clean.upper(), "few": "a b", "repeats": "same words here " * 40, "none": None}
    docs = spark.createDataFrame([("clean", clean), *junk.items()], "doc_id string, text string")
    assert [r.doc_id for r in quality.kept_documents(docs).collect()] == ["clean"]
    order = [r.name for r, _, _ in quality.ordered_rules(docs)]
    assert sorted(order) == sorted(r.name for r in quality.RULES)
    assert all([r.name for r, _, _ in quality.ordered_rules(docs)] == order for _ in range(10))
    assert quality.kept_documents(docs.limit(0)).count() == 0


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(None, "a"), (None, "b"), (1, "c"), (1, "c"), (1, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS shard", "7 AS slot", "text AS _at")
    sharding.write_shards(docs, str(tmp_path / "s"), 2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(rows, key=str) and {r.shard for r in back.collect()} == {0, 1}
