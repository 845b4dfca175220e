"""Removal of long word sequences that occur more than once, found by recompression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthloom.llm.common import discard, measured, slices, table, text_key, text_of, written
from synthloom.llm.recompression import LONGEST_PAIRED, ROUNDS, mixed, recompress, window_hashes

WINDOW = 35
#: Rows that a task tells apart at a time before they are shuffled.
CHUNK = 1 << 20


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts (bytes.split() parts at just the six spaces), and each text's number of them."""
    words = [x.split() for x in texts]
    digest = xxhash.xxh3_64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter((digest(w) for ws in words for w in ws), np.uint64, int(lengths.sum())), lengths


def _symbols(hashes: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All symbols after the last round: name, document, ordinal in it, the span of windows that hold the context, and
    whether one can: then the symbol is a witness of these windows.

    A window that occurs twice holds the same witnesses both times. So a witness whose name occurs once among all symbols
    shows that its windows do. (Elsewhere the same symbol may have a wider context, and be no witness: it counts all the same.)
    """
    s = recompress(hashes, lengths, ROUNDS, LONGEST_PAIRED)
    begins = np.cumsum(lengths) - lengths
    doc = np.searchsorted(begins + lengths, s.start, side="right")
    ordinal = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return s.name, doc, ordinal, np.maximum(s.high - window, begins[doc]), s.low, s.high - s.low <= window


def _told_apart(*key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with a key of one or two columns: which are the first of theirs, and which have a key that repeats."""
    n = len(key[0])
    order = np.lexsort(key[::-1])
    new = np.ones(n, bool)
    for k in key:
        k = k[order]
        new[1:] &= k[1:] == k[:-1]
    new[1:] = ~new[1:]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    first, repeats = np.zeros(n, bool), np.zeros(n, bool)
    first[order[starts]] = True
    repeats[order] = np.repeat(sizes > 1, sizes)
    return first, repeats


def _once_a_task(parts: Iterator[tuple[np.ndarray, ...]], keys: int, names: list[str], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows of arrays, the first `keys` of them a key, with _kind by what a task's rows show: 0 the key is seen once, 1 it
    repeats, and this row stands for all of them, 2 it repeats, and another row stands for it. Tasks with more than `chunk`
    rows tell apart so many at a time; so a key has a row of kind 0 or 1 at most for each chunk, however many rows it has.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        first, repeats = _told_apart(*columns[:keys])
        kind = np.where(repeats, np.where(first, 1, 2), 0).astype(np.int8)
        batch = pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns), pa.array(kind)], names=[*names, "_kind"])
        for at in range(0, batch.num_rows, 1 << 16):
            yield batch.slice(at, 1 << 16)

    for part in parts:
        held.append(part)
        if sum(len(x[0]) for x in held) >= chunk:
            yield from flush()
    if held:
        yield from flush()


def _repeated(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """The columns of the rows of _once_a_task() whose key occurs more than once: as their task knew, or as another task's row shows.

    Only one row for each key and task is shuffled: a key that most texts hold is no more work than the number of tasks.
    """
    met = rows.filter("_kind < 2").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return rows.filter("_kind > 0").select(*columns).unionByName(met.filter("_kind = 0 and _n > 1").select(*columns))


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_key, _whole, _starts, _ends): what to remove from each text, by the hash of the text; texts without it have no row.

    1. Texts that several rows share are wholly repeated; one row of each stands for them below.
    2. Recompression names the symbols of every text, the same in all tasks. Counting names shows which occur once.
    3. Windows all of whose witnesses occur twice or more, or that have none, are named by 128 bits of their words, and
       those names counted: no repeated window is missing among them.
    """
    chunk = CHUNK
    keyed = docs.select(text_key(docs[text_col]).alias("_key"), docs[id_col].alias("_id"), text_of(docs[text_col]).cast("binary").alias("_text"))
    copies = keyed.groupBy("_key").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    copies = written(copies, "copies")
    sources = keyed.join(measured(copies, row_bytes=64), "_key", "left").filter(F.col("_copies").isNull() | F.col("_id").eqNullSafe(F.col("_rep")))
    sources = written(sources.select(F.monotonically_increasing_id().alias("_t"), "_key", "_text"), "sources")

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                for run, texts in slices(batch, "_text"):
                    name, doc, ordinal, *_ = _symbols(*_words(texts), window)
                    yield name, run.column("_t").to_numpy()[doc], ordinal.astype(np.int32)

        return _once_a_task(parts(), 1, ["_name", "_t", "_ordinal"], chunk)

    named = written(sources.select("_t", "_text").mapInArrow(symbols, "_name long, _t long, _ordinal int, _kind byte"), "symbols")
    marks = _repeated(named, ["_name"], "_t", "_ordinal").groupBy("_t").agg(F.collect_list("_ordinal").alias("_shared"))
    marks = written(marks, "marks")
    discard(named)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                for run, texts in slices(batch, "_text"):
                    hashes, lengths = _words(texts)
                    at, where, place = _open(hashes, lengths, run.column("_shared"), window)
                    yield *(x[at] for x in (window_hashes(hashes, window), window_hashes(mixed(hashes), window))), run.column("_t").to_numpy()[where], place

        return _once_a_task(parts(), 2, ["_window", "_window2", "_t", "_place"], chunk)

    candidates = sources.select("_t", "_text").join(marks, "_t", "left")
    hashed = written(candidates.mapInArrow(windows, "_window long, _window2 long, _t long, _place int, _kind byte"), "windows")
    places = _repeated(hashed, ["_window", "_window2"], "_t", "_place").groupBy("_t").agg(F.sort_array(F.collect_set("_place")).alias("_places"))
    places = written(places, "places")
    spans = sources.select("_t", "_key").join(measured(places, "_places"), "_t").select("_key", F.lit(False).alias("_whole"), *_merged(F.col("_places"), window))
    copied = copies.select("_key", F.lit(True).alias("_whole"), F.array().cast("array<int>").alias("_starts"), F.array().cast("array<int>").alias("_ends"))
    out = written(spans.join(measured(copies.select("_key")), "_key", "left_anti").unionByName(copied), "spans")
    for done in (copies, sources, marks, hashed, places):
        discard(done)
    return out


def _open(hashes: np.ndarray, lengths: np.ndarray, shared: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that no witness of a name seen once shows to occur once: place in hashes, document, place in it."""
    _, doc, _, first, last, witness = _symbols(hashes, lengths, window)
    of = np.searchsorted(doc, np.arange(len(lengths)))
    counts = pc.fill_null(pc.list_value_length(shared), 0).to_numpy(zero_copy_only=False)
    single = witness.copy()
    single[np.repeat(of, counts) + shared.flatten().to_numpy()] = False
    closed = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(closed, first[single], 1)
    np.add.at(closed, last[single] + 1, -1)
    begins = np.cumsum(lengths) - lengths
    where = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(hashes)) - begins[where]
    at = np.flatnonzero((np.cumsum(closed)[: len(hashes)] == 0) & (place + window <= lengths[where]))
    return at, where[at], place[at].astype(np.int32)


def _merged(places: Column, window: int) -> tuple[Column, Column]:
    """The starts and ends of the unions of the windows at the given places, which are in order."""
    starts = F.filter(places, lambda x, i: (i == 0) | (x > F.coalesce(F.get(places, i - 1), F.lit(-window)) + window))
    ends = F.filter(places, lambda x, i: F.coalesce(F.get(places, i + 1) > x + window, F.lit(True)))
    return starts.alias("_starts"), F.transform(ends, lambda x: x + window).alias("_ends")


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with what is left of its words once each word in a repeated window is removed.

    A window is `window` consecutive words of one text; it is repeated if the same words begin anywhere else, in the same
    text, another one or a copy. Returns id_col, text (kept words joined by one space), n_words, n_removed and kept_sha256.
    Null, empty and short texts have no window and lose nothing; repeated rows are copies of each other and lose all their
    words if they have a window; null ids are kept; texts of any length are read whole; an empty table gives no row; other
    columns are not read, whatever their names.

    Texts and windows are told apart by 128 bits. Names of symbols have 64: two that collide only leave windows to be counted.
    """
    spans = repeated_spans(docs, window, id_col, text_col)
    text = text_of(docs[text_col])
    keyed = docs.select(docs[id_col].alias(id_col), text_key(text).alias("_key"), text.cast("binary").alias("_text"))
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, texts in slices(batch, "_text"):
                left, n, removed, digest = [], [], [], []
                rows = zip(texts, *(run.column(c).to_pylist() for c in ("_whole", "_starts", "_ends")), strict=True)
                for text, whole, starts, ends in rows:
                    words = text.split()
                    n.append(len(words))
                    if whole and len(words) >= window:
                        words = []
                    elif starts:
                        edges = [0, *(x for pair in zip(starts, ends, strict=True) for x in pair), len(words)]
                        words = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                    removed.append(n[-1] - len(words))
                    kept = b" ".join(words)
                    left.append(kept.decode("utf-8", "replace"))
                    digest.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [run.column(id_col), pa.array(left, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=schema.names
                )

    joined = keyed.join(measured(spans, "_starts", "_ends"), "_key", "left").select(id_col, "_text", "_whole", "_starts", "_ends")
    return joined.mapInArrow(cut, schema)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without word sequences of 35 or more that occur more than once."""
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT k, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), r AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1
), c AS (
  SELECT k, list(DISTINCT i + j) AS gone FROM r, (SELECT unnest(range(0, 35)) AS j) GROUP BY k
), e AS (
  SELECT d.k, doc_id, w, p, list_contains(coalesce(gone, []), p) AS out
  FROM (SELECT k, doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) d LEFT JOIN c USING (k)
), kept AS (
  SELECT k, count(*) FILTER (out) AS n, string_agg(w[p], ' ' ORDER BY p) FILTER (NOT out) AS t FROM e GROUP BY k
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""
