"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

Words of one length in their forward order and in the order of their reversals are points (forward rank, reverse rank). An
edit at one position leaves a prefix, which is an interval of forward ranks, and a suffix, which is an interval of reverse
ranks; the words that the edit leads to are the points in that rectangle, which a wavelet tree over the reverse ranks reports.

Spark deals words in ranges of each order. A word is split where both halves span fewest ranges: edits behind the split are
asked of the ranges of the forward order that its first half spans, edits before it of those of the reverse order that its
second half spans. A range holds about RANGE_WORDS words, so tasks are bounded whatever beginnings or endings are common.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthloom.llm.common import discard, measured, parts, slices, table, written

#: Words of a range of either order, and bytes of them, in the mean.
RANGE_WORDS, RANGE_BYTES = 1 << 17, 4 << 20
#: Code points of a word that take part in a cut between ranges.
CUT = 64
#: A task tells so many words apart before it passes their counts on.
HELD_WORDS = 200_000
#: Bytes of search keys, and words asked, at a time.
KEY_BYTES, ASKED = 16 << 20, 1 << 16

# A-Z to a-z; what is no letter of [A-Za-zÀ-ÿ] to a space.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def letter_runs(text: str, at_least: int = 1) -> Counter[bytes]:
    """The maximal runs of Latin-1 letters of a text, A-Z lower-cased, as Latin-1 bytes, with their counts."""
    return Counter(w for w in text.encode("latin-1", "replace").translate(_LOWER).split() if len(w) >= at_least)


def misspelt(doc_id: object, run: bytes, every: int) -> bytes:
    """The run, without its code point h % length if `every` divides h, the CRC-32 of '<doc_id>:<run>' in UTF-8."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, drop_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the letter runs of whole texts with at least `min_length` code points and `min_count` occurrences.

    drop_every, if not 0, deletes a code point of a run of a document by misspelt(). Null and empty texts have no runs; a
    null id is written as nothing; repeated rows count each; other columns are not read. Tasks add up counts before they shuffle.
    """
    every = drop_every

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def passed() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for run, texts in slices(batch, "t"):
                for doc_id, text in zip(run.column("i").to_pylist(), texts, strict=True):
                    for w, n in letter_runs(text, min_length).items():
                        w = misspelt(doc_id, w, every) if every else w
                        if len(w) >= min_length:
                            held[w] = held.get(w, 0) + n
                    if len(held) >= HELD_WORDS:
                        yield passed()
                        held.clear()
        yield passed()

    runs = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).mapInArrow(counted, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Points:
    """The words of one length in a range: sorted, sorted reversed, and a wavelet tree (one bit of the ranks a level)."""

    def __init__(self, rows: np.ndarray, n: np.ndarray):
        self.length = rows.shape[1]
        at = np.argsort(_keys(rows), kind="stable")
        self.rows, self.n = rows[at], n[at]
        self.sorted = _keys(self.rows)
        backward = _keys(self.rows[:, ::-1])
        self.order = np.argsort(backward, kind="stable")
        self.reversed = backward[self.order]
        rank = np.empty(len(at), np.int64)
        rank[self.order] = np.arange(len(at))
        self.levels = []
        for b in reversed(range(max(1, int(len(at) - 1).bit_length()))):
            one = (rank >> b) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - one)])
            self.levels.append((b, zeros))
            rank = np.concatenate([rank[one == 0], rank[one == 1]])

    def report(self, f1: np.ndarray, f2: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, word) for every point with a forward rank in [f1, f2) and a reverse rank in [r1, r2)."""
        q, value = np.arange(len(f1)), np.zeros(len(f1), np.int64)
        a, b = f1, f2
        for bit, zeros in self.levels:
            za, zb = zeros[a], zeros[b]
            a, b = np.concatenate([za, zeros[-1] + a - za]), np.concatenate([zb, zeros[-1] + b - zb])
            q, value = np.concatenate([q, q]), np.concatenate([value, value + (1 << bit)])
            some = (a < b) & (value < r2[q]) & (value + (1 << bit) > r1[q])
            q, value, a, b = q[some], value[some], a[some], b[some]
        return q, self.order[value]


def _keys(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _shared(rows: np.ndarray, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The length of the common prefix of each key with the row at `at`; -1 where there is none."""
    inside = (at >= 0) & (at < len(rows))
    differ = rows[np.where(inside, at, 0)] != keys
    return np.where(inside, np.where(differ.any(1), differ.argmax(1), keys.shape[1]), -1)


def _longest(ordered: np.ndarray, keys: np.ndarray, but_itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """The longest prefix of each key that a word (another one) has, and whether the key itself is a word."""
    rows = ordered.view(np.uint8).reshape(len(ordered), -1)
    at = np.searchsorted(ordered, _keys(keys))
    there = ordered[np.minimum(at, len(ordered) - 1)] == _keys(keys) if but_itself else np.zeros(len(keys), bool)
    there &= at < len(ordered)
    return np.maximum(_shared(rows, keys, at - 1), _shared(rows, keys, at + there)), there


def _interval(ordered: np.ndarray, keys: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of the words that begin with the first lengths[k] bytes of keys[k]."""
    beyond = np.arange(keys.shape[1]) >= lengths[:, None]
    return np.searchsorted(ordered, _keys(np.where(beyond, 0, keys).astype(np.uint8))), np.searchsorted(ordered, _keys(np.where(beyond, 255, keys).astype(np.uint8)), "right")


def pairs(points: Points, asked: np.ndarray, split: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row of asked, word of points) where one edit at a position from the row's split on leads from the row to the word.

    The edit is a replacement if both have one length, a deletion if asked words are one longer; of the deletions in a run
    of equal letters, which lead to one word, the last one counts (the first one in reversed words, so that it is the same).
    """
    length, replaced = asked.shape[1], asked.shape[1] == points.length
    forward, reverse = asked[:, : points.length], asked[:, ::-1][:, : points.length]
    prefix, itself = _longest(points.sorted, forward, replaced)
    suffix, _ = _longest(points.reversed, reverse, replaced)
    first = np.maximum(split, length - 1 - suffix)
    count = np.maximum(np.minimum(length - 1, prefix) - first + 1, 0)
    q = np.repeat(np.arange(len(asked)), count)
    i = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + first[q]
    if not replaced:
        beside = i - 1 if backward else i + 1
        edge = (beside < 0) | (beside >= length)
        last = edge | (asked[q, i] != asked[q, np.where(edge, i, beside)])
        q, i = q[last], i[last]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, KEY_BYTES // (4 * length))
    for a in range(0, len(q), step):
        at, where = q[a : a + step], i[a : a + step]
        f1, f2 = _interval(points.sorted, forward[at], where)
        some = f2 - f1 > itself[at]
        at, where, f1, f2 = at[some], where[some], f1[some], f2[some]
        r1, r2 = _interval(points.reversed, reverse[at], length - 1 - where)
        some = r2 - r1 > itself[at]
        rect, word = points.report(f1[some], f2[some], r1[some], r2[some])
        found.append((at[some][rect], word))
    q, word = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    if replaced:
        other = points.sorted[word] != _keys(asked)[q]
        q, word = q[other], word[other]
    return q, word


def _matrix(keys: Sequence[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(-1, length)


def _best(of: np.ndarray, owners: np.ndarray, rows: np.ndarray, n: np.ndarray, backward: bool) -> pa.RecordBatch:
    """For each of the words `of` that pairs name as owners: how many, and the one (rows, n) of largest n, the least of these."""
    if backward:
        rows, of = rows[:, ::-1], of[:, ::-1]
    word = _keys(rows)
    at = np.lexsort((word, -n, owners))
    which, first, near = np.unique(owners[at], return_index=True, return_counts=True)
    head = at[first]
    text = lambda rows: pa.array([w.decode("latin-1") for w in _keys(rows).tolist()], pa.string())
    return pa.RecordBatch.from_arrays([text(of[which]), pa.array(near, pa.int64()), pa.array(n[head], pa.int64()), text(rows[head])], ["word", "near", "best_n", "best"])


def answered(index: dict[int, Points], asked: dict[int, list[tuple[bytes, int, int]]], backward: bool) -> Iterator[pa.RecordBatch]:
    """Partial (word, near, best_n, best) of the words asked, and of the words that a deletion in an asked one leads to."""
    for length, rows in asked.items():
        words = _matrix([w for w, _, _ in rows], length)
        n, split = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        for points in (index[k] for k in (length, length - 1) if k in index):
            q, v = pairs(points, words, split, backward)
            if len(q):
                yield _best(words, q, points.rows[v], points.n[v], backward)
                if points.length < length:
                    yield _best(points.rows, v, words[q], n[q], backward)


def _cuts(words: DataFrame, key: str, ranges: int) -> list[tuple[int, str]]:
    """Where ranges of equal numbers of words begin, in the order of (length, key): `ranges` short values."""
    dealt = words.select(F.length("word").alias("l"), F.expr(key).alias("k")).repartitionByRange(ranges, "l", "k")
    firsts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("l", "k")).alias("f")).select("f.l", F.left("f.k", F.lit(CUT)).alias("k"))
    return sorted({(r.l, r.k) for r in firsts.collect()})


def spans(cuts: Sequence[tuple[int, str]], length: int, prefix: str) -> range:
    """The ranges that words of a length with a prefix lie in."""
    return range(max(0, bisect_right(cuts, (length, prefix)) - 1), max(1, bisect_right(cuts, (length, f"{prefix}Ā"))))


def _routes(forward: Sequence[tuple[int, str]], backward: Sequence[tuple[int, str]], word: str) -> tuple[int, set[int], set[int]]:
    """The split of a word, and the ranges of both orders that its edits are asked of: as few as any split gives."""
    turned, length = word[::-1], len(word)

    def at(m: int) -> tuple[int, set[int], set[int]]:
        a, b = ({r for k in (length, length - 1) for r in spans(cuts, k, w[:h])} for cuts, w, h in ((forward, word, m), (backward, turned, length - m)))
        return m, a, b

    middle = at(length // 2)
    if len(middle[1]) + len(middle[2]) <= 6:
        return middle
    return min((at(m) for m in range(max(1, length // 2 - 32), min(length, length // 2 + 33))), key=lambda x: (len(x[1]) + len(x[2]), abs(2 * x[0] - length)))


def _near(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best) of the words that have near ones."""
    spark = words.sparkSession
    size = words.agg(F.count(F.lit(1)), F.sum(F.length("word"))).first()
    ranges = max(1, -(-size[0] // RANGE_WORDS), -(-(size[1] or 0) // RANGE_BYTES))
    forward, backward = _cuts(words, "word", ranges), _cuts(words, "reverse(word)", ranges)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                split, ahead, behind = _routes(forward, backward, word)
                turned, length = word[::-1], len(word)
                out.append((0, spans(forward, length, word)[0], 0, word, n, 0))
                out.append((1, spans(backward, length, turned)[0], 0, turned, n, 0))
                out.extend((0, r, 1, word, n, split) for r in ahead)
                out.extend((1, r, 1, turned, n, length - split) for r in behind)
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32()), strict=True)], ["side", "range", "asks", "key", "n", "split"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index, asked, waiting = None, {}, None, {}, 0
        for batch in batches:
            side, at, asks = (batch.column(k).to_numpy() for k in range(3))
            change = np.flatnonzero(np.diff(side) | np.diff(at) | np.diff(asks)) + 1
            for a, b in pairwise([0, *change.tolist(), batch.num_rows] if batch.num_rows else [0]):
                group = (int(side[a]), int(at[a]))
                if group != now:
                    if waiting:
                        yield from answered(index, asked, bool(now[0]))
                    now, held, index, asked, waiting = group, {}, None, {}, 0
                run = batch.slice(a, b - a)
                keys = [k.encode("latin-1") for k in run.column("key").to_pylist()]
                if not asks[a]:
                    for k, n in zip(keys, run.column("n").to_pylist(), strict=True):
                        held.setdefault(len(k), []).append((k, n))
                    continue
                if index is None:
                    index = {length: Points(_matrix([k for k, _ in rows], length), np.array([n for _, n in rows], np.int64)) for length, rows in held.items()}
                    held = {}
                for k, n, split in zip(keys, run.column("n").to_pylist(), run.column("split").to_pylist(), strict=True):
                    asked.setdefault(len(k), []).append((k, n, split))
                waiting += b - a
                if waiting >= ASKED:
                    yield from answered(index, asked, bool(now[0]))
                    asked, waiting = {}, 0
        if waiting:
            yield from answered(index, asked, bool(now[0]))

    rows = words.select("word", "n").mapInArrow(routed, "side int, range int, asks int, key string, n long, split int")
    dealt = rows.repartition(max(parts(spark), 2 * ranges), "side", "range").sortWithinPartitions("side", "range", "asks")
    found = dealt.mapInArrow(searched, "word string, near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("near"), top.alias("b")).select("word", "near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. A form occurs many times as often as its word, so chains are
    as short as the logarithm of the largest count, and doubling ends after that number's logarithm of rounds."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = written(now.select("word", "root").join(measured(ahead, row_bytes=96), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        discard(now)
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        now = after


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Words (word, n) of Latin-1 letters with their near words: n_near, form, form_n and root.

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word of
    largest n, of equal ones the least in code-point order, if it occurs at least `ratio` (more than 1) times as often; root
    is what the forms lead to, the word itself without one. Words must be different, not empty and not null; rows that repeat
    a word, nulls and empty words are left out by adding up and filtering here. No rows give no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    once = written(words.filter(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n")), "words")
    near = _near(once)
    form = F.col("best_n") >= F.col("n") * ratio
    held = written(
        once.join(near, "word", "left").select(
            "word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")
        ),
        "near",
    )
    last = roots(held.filter("form is not null").select("word", "form"))
    return held.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents. Null and empty texts have no words, a null id counts as no digits;
    repeated rows count each; very long texts are read whole."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), drop_every=31))


OP11_SQL = """
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
lower_runs AS (
  SELECT id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY ALL),
coded AS (SELECT w, n, hex(encode(id || ':' || w)) AS x FROM lower_runs),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS h
  FROM coded, t),
dropped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM dropped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT * FROM (
    SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word)),
ranked AS (SELECT word, other, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(other)) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN r.other END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
chain AS (
  WITH RECURSIVE c AS (SELECT word, word AS root, form AS ahead FROM formed UNION ALL SELECT c.word, f.word, f.form FROM c JOIN formed f ON f.word = c.ahead)
  SELECT word, root FROM c WHERE ahead IS NULL)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word
"""
