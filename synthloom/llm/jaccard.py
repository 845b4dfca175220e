"""Near-duplicate join on word n-grams: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthloom.llm.common import discard, fresh, measured, slices, table, text_key, text_of, written
from synthloom.llm.components import components
from synthloom.llm.recompression import mixed, window_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: MinHash values, and the chance that texts at the threshold share none of their bands (0.8: bands of 4, once in 2e7 pairs).
HASHES, MISSED = 128, 1e-6
#: A pair is dropped when the posterior probability that it reaches the threshold falls below this.
TOLERANCE = 1e-6
#: Values compared so far at each look.
LOOKS = (8, 16, 32, 64, 128)
#: Texts of a bucket, or of a component, that meet in a task; larger groups are dealt out in blocks of this size. A
#: component's blocks hold so many shingles at most on average, too: texts may be long.
BUCKET_BLOCK, EXACT_BLOCK = 512, 128
BLOCK_SHINGLES = 1 << 20


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The set of each text's k-word shingles as sorted 64-bit hashes; shorter texts have one shingle of all their words."""
    digest = xxhash.xxh3_64_intdigest
    out = []
    for text in texts:
        words = text.split()
        h = np.fromiter(map(digest, words), np.uint64, len(words))
        if 0 < len(h) < k:
            h = mixed(np.array([digest(b" ".join(words))], np.uint64) ^ np.uint64(len(h)))
        else:
            h = window_hashes(h, k)
        out.append(np.unique(h))
    return out


def permutations(n: int = HASHES, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed).integers(0, 1 << 32, (2, n), dtype=np.uint64).astype(np.uint32)
    return (draw[0] | np.uint32(1))[:, None], draw[1][:, None]


def minhash(shingles: np.ndarray, multipliers: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a set; blocks of shingles keep the working array small."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 2048):
        values = h[at : at + 2048] * multipliers + shifts
        values ^= values >> np.uint32(15)
        least = np.minimum(least, (values * np.uint32(0x2C1B3C6D)).min(axis=1))
    return least


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, looks: tuple[int, ...] = LOOKS) -> list[int]:
    """For each look at n values, the fewest equal ones that keep a pair.

    With a uniform prior on the similarity S, P(S >= t | m of n equal) is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in looks:
        total, m = 0.0, 0
        while (total := total + math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append(m)
    return out


def band_width(threshold: float = THRESHOLD) -> int:
    """The most values a band can have for pairs at the threshold to share one but for a chance of MISSED."""
    fit = [r for r in range(1, HASHES + 1) if (1 - threshold**r) ** (HASHES // r) <= MISSED]
    if not fit:
        raise ValueError(f"{HASHES} values can't find pairs of similarity {threshold}")
    return max(fit)


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(_id, _key, _set, _size, _sig, _short): per row its text's hash, its shingle set's hash and size, MinHash values whole and by their upper halves."""
    text = text_of(docs[text_col])
    keyed = docs.select(docs[id_col].alias("_id"), text_key(text).alias("_key"), text.cast("binary").alias("_text"))
    schema = T.StructType(
        [T.StructField("_id", docs.schema[id_col].dataType), *T.StructType.fromDDL("_key binary, _set long, _size int, _sig binary, _short binary").fields]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers, shifts = permutations()
        for batch in batches:
            for run, texts in slices(batch, "_text"):
                sets = shingle_sets(texts, shingle)
                names = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                signatures = [minhash(s, multipliers, shifts) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        run.column("_id"),
                        run.column("_key"),
                        pa.array(mixed(names).view(np.int64)),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([s.tobytes() for s in signatures], pa.binary()),
                        pa.array([(s >> np.uint32(16)).astype(np.uint16).tobytes() for s in signatures], pa.binary()),
                    ],
                    names=schema.names,
                )

    return keyed.mapInArrow(sign, schema)


def _blocks(rows: DataFrame, n: str) -> DataFrame:
    """rows with _lo, _hi, _mine: of groups that are cut in n blocks, each row goes to the tasks that pair its block with every block."""
    mine = F.pmod(F.xxhash64("_set"), F.col(n)).cast("int")
    dealt = rows.withColumn("_mine", mine).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    return dealt.withColumn("_lo", F.least("_mine", "_with")).withColumn("_hi", F.greatest("_mine", "_with")).drop("_with")


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, "_set")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of sorted rows that hold whole groups only, with the places where groups begin (and the end)."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        starts = _starts(rest, keys)
        if len(starts) > 2:
            cut = int(starts[-2])
            yield rest.slice(0, cut).combine_chunks(), starts[:-1]
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), _starts(rest, keys)


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    n = rows.num_rows
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        x = rows.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), n)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that links i-j tie each of n rows to."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _surviving(short: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, keep: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i, j that sizes allow and that no look at their MinHash values drops."""
    fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    i, j = i[fits], j[fits]
    equal = np.zeros(len(i), np.int32)
    for k, (done, look) in enumerate(zip((0, *LOOKS), LOOKS, strict=False)):
        equal = equal + (short[i, done:look] == short[j, done:look]).sum(axis=1)
        stays = equal >= keep[k]
        i, j, equal = i[stays], j[stays], equal[stays]
    return i, j


def _values(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("_short").to_pylist()), np.uint16).reshape(rows.num_rows, HASHES)


def _likely(batches: Iterator[pa.RecordBatch], keep: list[int], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of each bucket task, links (a, b) that join what pairs surviving the incremental comparison join."""
    for rows, starts in _whole_groups(batches, ["_bucket", "_lo", "_hi"]):
        sets = rows.column("_set").to_numpy()
        size = rows.column("_size").to_numpy()
        mine, lo, hi = (rows.column(c).to_numpy() for c in ("_mine", "_lo", "_hi"))
        short = _values(rows)
        ends = np.repeat(starts[1:], np.diff(starts))
        after = ends - np.arange(len(sets)) - 1
        kept_i, kept_j = [], []
        at = 0
        while at < len(sets):  # rows whose pairs come to about a million at a time
            upto = max(at + 1, int(np.searchsorted(np.cumsum(after[at:]), 1 << 20)) + at)
            a = np.arange(at, min(upto, len(sets)))
            i = np.repeat(a, after[a])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[a]) - after[a], after[a])
            apart = (lo[i] == hi[i]) | (mine[i] != mine[j])
            i, j = _surviving(short, size, i[apart], j[apart], keep, threshold)
            kept_i.append(i)
            kept_j.append(j)
            at = int(a[-1]) + 1
        root = _roots(len(sets), np.concatenate(kept_i), np.concatenate(kept_j))
        tied = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(sets[tied]), pa.array(sets[root[tied]])], names=["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], keep: list[int], threshold: Fraction) -> Iterator[pa.RecordBatch]:
    """Of each component task, every text's exact links: (_set, the rows linked to it, a text that they tie it to).

    Pairs are pruned by their MinHash values first; only what survives is looked up in the shingle sets.
    """
    for rows, starts in _whole_groups(batches, ["_component", "_lo", "_hi"]):
        columns = {c: rows.column(c).to_numpy() for c in ("_set", "_copies", "_mine", "_lo", "_hi")}
        short = _values(rows)
        lists = rows.column("_shingles")
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            # rows that repeat id and text bring the same set more than once
            at = a + np.unique(columns["_set"][a:b], return_index=True)[1]
            sets, copies = columns["_set"][at], columns["_copies"][at]
            shingles = [np.frombuffer(lists[int(k)].as_py(), np.uint64) for k in at]
            size = np.array([len(x) for x in shingles])
            within = columns["_lo"][a] == columns["_hi"][a]
            left = np.flatnonzero(columns["_mine"][at] == columns["_lo"][a])
            right = left if within else np.flatnonzero(columns["_mine"][at] == columns["_hi"][a])
            i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
            if within:
                i, j = i[i < j], j[i < j]
            i, j = _surviving(short[at], size, i, j, keep, float(threshold))
            common = _intersections(shingles, i, j)
            near = common * (threshold.numerator + threshold.denominator) >= threshold.numerator * (size[i] + size[j])
            i, j = i[near], j[near]
            linked = np.bincount(i, copies[j], len(at)) + np.bincount(j, copies[i], len(at))
            root = _roots(len(at), i, j)
            some = linked > 0
            yield pa.RecordBatch.from_arrays([pa.array(sets[some]), pa.array(linked[some].astype(np.int64)), pa.array(sets[root][some])], names=["_set", "_linked", "_root"])


def _intersections(shingles: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles texts i and j have in common, pair by pair; shingles of one text only are left out first."""
    if not len(i):
        return np.zeros(0, np.int64)
    left, right = np.unique(i), np.unique(j)
    asked = np.union1d(left, right)
    values, inverse, count = np.unique(np.concatenate([shingles[k] for k in asked]), return_inverse=True, return_counts=True)
    doc = np.repeat(asked, [len(shingles[k]) for k in asked])
    shared = count[inverse] > 1
    doc, column = doc[shared], (np.cumsum(count > 1) - 1)[inverse[shared]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    n = int(column[-1]) + 1 if len(column) else 0
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, n, 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        present = np.zeros((len(shingles), min(4096, n - at)), np.float32)
        present[doc[a:b], column[a:b] - at] = 1
        out += present[left] @ present[right].T
    return out[np.searchsorted(left, i), np.searchsorted(right, j)].astype(np.int64)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its class and its number of links; a link joins rows whose shingle sets have a Jaccard similarity of threshold or more.

    1. Rows of equal shingle sets (copies) are one text from here on.
    2. Texts that share a band of MinHash values are compared a few values at a time and dropped once the posterior
       probability of reaching the threshold is below TOLERANCE. Buckets of any size are done in full, in blocks. What
       survives is kept as the components that it joins, not as pairs: a group of m texts has m^2 / 2 of these.
    3. In the blocks of a component, the pairs that survive the same comparison are verified on whole shingle sets. Tasks
       return a text's number of links and one text that they tie it to, so rows grow with the texts, not their square.

    Returns _id (as id_col), _key (hash of the text), class_id and class_key (the least id and its text's hash in the class,
    a class being what links connect), n_links. Texts without a word have no link and are classes of their own; null ids
    sort before others; repeated rows are copies; an empty table gives no row; very long texts meet few others in a task;
    other columns are not read, so their names (class_id among them) don't matter, but id_col can't be named like a result.
    """
    width = band_width(threshold)
    marked = written(_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    texts = written(
        marked.filter("_size > 0")
        .groupBy("_set")
        .agg(
            F.min(F.struct(F.col("_id").isNotNull().alias("known"), "_id", "_key")).alias("_rep"),
            F.count(F.lit(1)).alias("_copies"),
            F.first("_size").alias("_size"),
            F.first("_sig").alias("_sig"),
            F.first("_short").alias("_short"),
        ),
        "texts",
    )
    bands = F.array(*(F.xxhash64(F.lit(b), F.substring("_sig", 4 * width * b + 1, 4 * width)) for b in range(HASHES // width)))
    rows = texts.select("_set", F.explode(bands).alias("_bucket"))
    full = written(rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_in")).filter("_in > 1"), "buckets")
    n_blocks = F.ceil(F.col("_in") / BUCKET_BLOCK).cast("int")
    met = _blocks(rows.join(measured(full), "_bucket").withColumn("_in", n_blocks), "_in").drop("_in")
    keep = least_matches(threshold)
    compared = _grouped(met.join(texts.select("_set", "_size", "_short"), "_set"), ["_bucket", "_lo", "_hi"])
    likely = components(compared.mapInArrow(lambda x: _likely(x, keep, threshold), "a long, b long"))
    likely = written(likely.select(F.col("node").alias("_set"), F.col("root").alias("_component")), "likely")
    discard(full)

    held = likely.join(texts.select("_set", "_size", "_copies", "_rep", "_short"), "_set")
    n_blocks = F.ceil(F.greatest(F.count(F.lit(1)) / EXACT_BLOCK, F.sum("_size") / BLOCK_SHINGLES)).cast("int")
    sizes = written(held.groupBy("_component").agg(n_blocks.alias("_in")), "component-sizes")
    wanted = held.join(measured(sizes), "_component")
    wanted = written(wanted.select("_set", "_component", "_in", "_copies", "_short", F.col("_rep._id").alias("_rid"), F.col("_rep._key").alias("_key")), "wanted")
    text = text_of(docs[text_col])
    keyed = docs.select(docs[id_col].alias("_id"), text_key(text).alias("_key"), text.cast("binary").alias("_text"))
    sources = keyed.join(measured(wanted, row_bytes=384), "_key").filter(F.col("_id").eqNullSafe(F.col("_rid"))).select("_set", "_component", "_in", "_copies", "_short", "_text")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, some in slices(batch, "_text"):
                sets = pa.array([s.tobytes() for s in shingle_sets(some, shingle)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in kept), sets], names=[*kept, "_shingles"])

    kept = ("_set", "_component", "_in", "_copies", "_short")
    expanded = sources.mapInArrow(expand, "_set long, _component long, _in int, _copies long, _short binary, _shingles binary")
    tasks = _grouped(_blocks(expanded, "_in").drop("_in"), ["_component", "_lo", "_hi"])
    exact = Fraction(str(threshold))
    links = written(tasks.mapInArrow(lambda x: _verified(x, keep, exact), "_set long, _linked long, _root long"), "links")
    classes = components(links.select(F.col("_set").alias("a"), F.col("_root").alias("b"))).select(F.col("node").alias("_set"), "root")
    linked = links.groupBy("_set").agg(F.sum("_linked").alias("_linked"))

    joined = texts.select("_set", "_copies", "_rep").join(linked, "_set", "left").join(classes, "_set", "left")
    joined = joined.filter("_copies > 1 or _linked is not null").select("_set", "_copies", "_rep", "_linked", F.coalesce("root", "_set").alias("_root"))
    joined = written(joined, "classes")
    heads = written(joined.groupBy("_root").agg(F.min("_rep").alias("_head")), "heads")
    told = written(
        joined.join(measured(heads), "_root").select("_set", (F.col("_copies") - 1 + F.coalesce("_linked", F.lit(0))).alias("_n"), F.col("_head._id").alias("_cid"), F.col("_head._key").alias("_ckey")), "told"
    )
    for done in (likely, sizes, wanted, links, texts, joined, heads):
        discard(done)
    lone = F.col("_n").isNull() | (F.col("_size") == 0)
    return marked.select("_id", "_key", "_set", "_size").join(measured(told, row_bytes=96), "_set", "left").select(
        F.col("_id").alias(id_col),
        "_key",
        F.when(lone, F.col("_id")).otherwise(F.col("_cid")).alias("class_id"),
        F.when(lone, F.col("_key")).otherwise(F.col("_ckey")).alias("class_key"),
        F.when(lone, F.lit(0)).otherwise(F.col("_n")).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of near_duplicates(): the one of least id. Texts without a word all stay.

    Of rows that repeat id and text one stays, any of them; null ids are least; an empty table stays empty; texts of any
    length are read whole; other columns are carried along, whatever their names.
    """
    found = near_duplicates(docs, threshold, shingle, id_col, text_col)
    i, k = fresh(docs, "id"), fresh(docs, "key")
    stays = F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col("_key") == F.col("class_key"))
    out_of = found.filter(F.col("n_links") > 0).select(F.col(id_col).alias(i), F.col("_key").alias(k), stays.alias("_stays"))
    judged = written(out_of.groupBy(i, k, "_stays").agg(F.count(F.lit(1)).alias("_rows")), "judged").select(i, k, "_stays", "_rows")
    gone, repeated = judged.filter(~F.col("_stays")).select(i, k), judged.filter("_stays and _rows > 1").select(i, k)
    same = (text_key(docs[text_col]) == F.col(k)) & docs[id_col].eqNullSafe(F.col(i))
    kept = docs.join(measured(gone), same, "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(measured(repeated), same, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(measured(repeated), same, "left_anti").unionByName(once)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate class and number of links."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), z AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT p.a, p.b FROM p JOIN z x ON x.doc_id = p.a JOIN z y ON y.doc_id = p.b WHERE 9 * p.n >= 4 * (x.n + y.n)
), c AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, c.root FROM c JOIN l ON c.node = l.a
), r AS (
  SELECT node, min(root) AS root FROM c GROUP BY node
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT doc_id, root AS class_id, coalesce(n.n, 0)::BIGINT AS n_links FROM documents JOIN r ON node = doc_id LEFT JOIN n ON a = doc_id
"""
