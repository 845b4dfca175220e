import random
import zlib

import pytest

from synthloom.llm import variants
from synthloom.llm.variants import letter_runs, misspelt, op11_variants, spelling_variants, word_counts


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=10):
    out = {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) if near[w] else None for w in words}
    form = {w: best[w] if best[w] and words[best[w]] >= ratio * words[w] else None for w in words}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def ours(df, ratio=10):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(df, ratio).collect()}


@pytest.mark.parametrize("ranges", [1 << 17, 40, 7])
def test_near_words_equal_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(variants, "RANGE_WORDS", ranges)
    rng = random.Random(ranges)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 6))): rng.choice([2, 3, 30, 400, 5000]) for _ in range(300)}
    # a third of all words share both their beginning and their end
    words |= {f"aaa{''.join(rng.choice('abc') for _ in range(rng.randint(2, 4)))}zzz": rng.randint(2, 90) for _ in range(150)}
    words |= {"é" * k: k for k in range(1, 90)}
    words |= {"x" * 3000: 2, "x" * 1500 + "y" + "x" * 1500: 40, "x" * 2999: 5}
    assert ours(spark.createDataFrame(list(words.items()), "word string, n long")) == brute(words)


def test_rows_that_repeat_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("house", 20), ("house", 20), ("hous", 4), (None, 7), ("", 9)], "word string, n long")
    assert ours(df) == {"house": (None, "house", 40, 1, None), "hous": ("house", "house", 4, 1, 40)}
    assert ours(df.limit(0)) == {}
    with pytest.raises(ValueError):
        spelling_variants(df, 1)


def test_runs_and_deletions():
    assert letter_runs("Ab×cÉ dİe’ab×cÉ") == {"ab×cÉ".encode("latin-1"): 2, b"d": 1, b"e": 1}
    every = 1
    word = "wördlich"
    h = zlib.crc32(f"12:{word}".encode())
    assert misspelt(12, word.encode("latin-1"), every).decode("latin-1") == word[: h % 8] + word[h % 8 + 1 :]


def test_counts_add_over_rows_of_any_kind(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD_WORDS", 3)
    rows = [(1, "Letters letters LETTERS lettres", "x"), (1, "letters", "x"), (None, None, None), (2, "", "y"), (3, "abcdefgh " * 50_000, "z"), (4, "short", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert {r.word: r.n for r in word_counts(df).collect()} == {"letters": 4, "abcdefgh": 50_000}
    assert {r.word: r.n for r in word_counts(df, 5, 1).collect()} == {"letters": 4, "lettres": 1, "abcdefgh": 50_000, "short": 1}
    assert word_counts(df.limit(0)).count() == 0


def test_query_reads_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op11_variants(spark, str(tmp_path)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert op11_variants(spark, str(tmp_path)).count() == 0
