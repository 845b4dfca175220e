"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthloom.llm.common import discard, slices, small, table, written

#: Labelled rows of each language that the model is fitted on at most, drawn from all of them by a hash; pieces that are cut
#: from each one's whole text where it lies; and training sequences that are made of these.
TRAIN_ROWS = 400
PIECES = 8
SEQUENCES, SEQUENCE = 5000, 32
#: Words of more letters are left out of pieces: what comes to the driver is bounded in bytes, too.
LONGEST_WORD = 64
#: Hashed feature space.
BITS = 16
STEPS, RATE, DECAY = 50, 0.15, 1e-6
#: Words of a chain that are taken in one block, and distinct words whose scores a worker keeps.
BLOCK = 64
#: Words of a text that are held at once; a longer text is one chain all the same, read twice.
AT_ONCE = 1 << 17
KNOWN_WORDS = 300_000
NGRAMS = (2, 3, 4)
AFFIXES = (1, 2, 3, 5)
UNDECIDED = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> list[str]:
    """Runs of letters, in lower case; runs of other signs that count as parts of words are none."""
    return [w for w in _LETTERS.findall(text.lower()) if _is_word(w)]


def _is_word(run: str) -> bool:
    return run.isalpha() or any(map(str.isalpha, run))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of every feature of every word: the word itself (lexicon), its affixes, and n-grams of bytes with word ends."""
    raw = [b"^" + w.encode("utf-8", "replace") + b"$" for w in words]
    sizes = np.array([len(x) for x in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(raw)), sizes)
    left = np.arange(len(flat)) - begins[word]  # bytes of the word before each
    right = sizes[word] - left  # and from it on
    mask = np.uint64((1 << BITS) - 1)

    def spread(x: np.ndarray, kind: int) -> np.ndarray:
        x = (x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) & mask

    # hash of the word up to and including each byte, and from each byte on, by prefix sums
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max(initial=0)), 0x100000001B3, np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat + np.uint64(1)) * powers[left], dtype=np.uint64)])
    upto = sums[1:] - sums[begins[word]]
    ids, of = [spread(upto[begins + sizes - 1], 1)], [np.arange(len(raw))]
    for n in AFFIXES:
        has = np.flatnonzero(sizes - 2 >= n)
        ids.append(spread(upto[begins[has] + n], 100 + n))
        tail = np.zeros(len(has), np.uint64)
        for k in range(n):
            tail = tail * np.uint64(0x100000001B3) + flat[begins[has] + sizes[has] - 2 - k] + np.uint64(1)
        ids.append(spread(tail, 200 + n))
        of += [has, has]
    for n in NGRAMS:
        at = np.flatnonzero(right >= n)
        gram = np.zeros(len(at), np.uint64)
        for k in range(n):
            gram = gram * np.uint64(0x100000001B3) + flat[at + k] + np.uint64(1)
        ids.append(spread(gram, 300 + n))
        of.append(word[at])
    return np.concatenate(of), np.concatenate(ids).astype(np.int64)


def scores(weights: np.ndarray, words: list[str]) -> np.ndarray:
    """Each word's score for each label; a feature counts by its share of the word's features, so length doesn't matter."""
    of, ids = features(words)
    return _gathered(weights, of, ids, len(words))


def _gathered(weights: np.ndarray, of: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(of, weights[ids, k], n) for k in range(weights.shape[1])], axis=1)


@dataclass
class Crf:
    """Labels, feature weights (features x labels), and transition scores (from x to)."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def carries(self, psi: np.ndarray, inside: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """For each block, the matrix that carries the forward vector before it to that of its last word."""
        total, _, k = psi.shape
        step = np.exp(self.transitions)
        carry = np.tile(np.eye(k), (total, 1, 1))
        for t in range(BLOCK):
            moved = carry @ step if t else np.where(begins[:, None, None], carry, carry @ step)
            moved = moved * psi[:, t, None, :]
            moved /= moved.sum(axis=(1, 2), keepdims=True)
            carry = np.where(inside[:, t, None, None], moved, carry)
        return carry

    def blocks(self, emissions: np.ndarray, lengths: np.ndarray, goes_on: bool) -> tuple[np.ndarray, ...]:
        """Of chains cut into blocks: the number of each chain's blocks, the words' potentials, which of them there are, and
        which blocks begin a chain (none if the first one goes on with an earlier part)."""
        n_blocks = -(-lengths // BLOCK)
        chain = np.repeat(np.arange(len(lengths)), n_blocks)
        number = np.arange(int(n_blocks.sum())) - (np.cumsum(n_blocks) - n_blocks)[chain]
        size = np.minimum(BLOCK, lengths[chain] - number * BLOCK)
        begin = (np.cumsum(lengths) - lengths)[chain] + number * BLOCK
        at = np.minimum(begin[:, None] + np.arange(BLOCK), len(emissions) - 1)
        inside = np.arange(BLOCK) < size[:, None]
        psi = np.exp(emissions - emissions.max(axis=1, keepdims=True))[at]
        return n_blocks, psi, inside, (number == 0) & (not goes_on)

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of every word of several chains that lie one after another, by forward-backward."""
        return self.forward_backward(emissions, lengths, before, after)[0]

    def links(self, p: np.ndarray, forward: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities of the labels (from, to) of the words at the places `at` and of those after them, in one chain each.

        The forward vector before a word's own potential is known from the word before; the word's marginal divided by it is
        what the word and all after it say."""
        step = np.exp(self.transitions)
        joint = forward[at][:, :, None] * step * (p[at + 1] / (forward[at] @ step))[:, None, :]
        return joint / joint.sum(axis=(1, 2), keepdims=True)

    def forward_backward(self, emissions: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(label probabilities, forward vectors) of every word of several chains.

        Chains are cut into blocks of BLOCK words. The matrix that carries a block's first forward vector to its last is
        made for all blocks at once; chaining these gives each block its ends, and the words inside follow, again for all
        blocks at once. The result is that of the word-by-word recursion. `before` and `after` are the forward and backward
        vectors at the ends of the words where these are part of one longer chain.
        """
        k = emissions.shape[1]
        if not len(emissions):
            return np.zeros((0, k)), np.zeros((0, k))
        n_blocks, psi, inside, begins = self.blocks(emissions, lengths, before is not None)
        total = len(psi)
        first_block = np.cumsum(n_blocks) - n_blocks
        step = np.exp(self.transitions)
        carry = self.carries(psi, inside, begins)
        enter, leave = np.ones((total, k)), np.ones((total, k))
        if before is not None:
            enter[0] = before
        if after is not None:
            leave[-1] = after
        for b in range(1, int(n_blocks.max())):
            now = first_block[n_blocks > b] + b
            v = np.einsum("ni,nij->nj", enter[now - 1], carry[now - 1])
            enter[now] = v / v.sum(axis=1, keepdims=True)
        for b in range(int(n_blocks.max()) - 1, 0, -1):
            now = first_block[n_blocks > b] + b
            v = np.einsum("nij,nj->ni", carry[now], leave[now])
            leave[now - 1] = v / v.sum(axis=1, keepdims=True)
        forward, backward = np.empty((total, BLOCK, k)), np.empty((total, BLOCK, k))
        v = enter
        for t in range(BLOCK):
            moved = v @ step if t else np.where(begins[:, None], v, v @ step)
            moved = moved * psi[:, t]
            v = np.where(inside[:, t, None], moved / moved.sum(axis=1, keepdims=True), v)
            forward[:, t] = v
        v = leave
        for t in range(BLOCK - 1, -1, -1):
            backward[:, t] = v
            moved = (psi[:, t] * v) @ step.T
            v = np.where(inside[:, t, None], moved / moved.sum(axis=1, keepdims=True), v)
        both = (forward * backward)[inside]
        return both / both.sum(axis=1, keepdims=True), forward[inside]

    def carried(self, emissions: np.ndarray, goes_on: bool) -> np.ndarray:
        """The matrix that carries the forward vector before a part of a chain to that of its last word."""
        _, psi, inside, begins = self.blocks(emissions, np.array([len(emissions)]), goes_on)
        whole = np.eye(emissions.shape[1])
        for carry in self.carries(psi, inside, begins):
            whole = whole @ carry
            whole /= whole.sum()
        return whole


def fitted(texts: list[str], langs: list[str], seed: int = 3) -> Crf:
    """A field fitted by gradient ascent (Adam) on the conditional likelihood of labelled word sequences.

    Every word of a text carries the text's language. Sequences are cut from anywhere in the texts, and every second one
    is made of two pieces of texts of different languages, so that transitions between languages are learned.
    """
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    held = [(words_in(x), labels.index(y)) for x, y in zip(texts, langs, strict=True)]
    held = [(w, y) for w, y in held if w]
    weights, transitions = np.zeros((1 << BITS, len(labels))), np.zeros((len(labels), len(labels)))
    if not held or len(labels) < 2:
        return Crf(labels, weights, transitions)
    vocabulary: dict[str, int] = {}
    by_label = [[i for i, (_, y) in enumerate(held) if y == k] for k in range(len(labels))]
    present = [k for k in range(len(labels)) if by_label[k]]

    def piece(k: int, n: int) -> tuple[list[int], list[int]]:
        words, _ = held[by_label[k][rng.integers(len(by_label[k]))]]
        at = int(rng.integers(max(1, len(words) - n + 1)))
        return [vocabulary.setdefault(w, len(vocabulary)) for w in words[at : at + n]], [k] * len(words[at : at + n])

    x, y = np.zeros((SEQUENCES, SEQUENCE), np.int64), np.full((SEQUENCES, SEQUENCE), -1)
    for s in range(SEQUENCES):
        cut = int(rng.integers(1, SEQUENCE)) if s % 2 else SEQUENCE
        a = present[rng.integers(len(present))]
        words, label = piece(a, cut)
        if s % 2:
            more = piece(present[rng.integers(len(present))], SEQUENCE - cut)
            words, label = words + more[0], label + more[1]
        x[s, : len(words)], y[s, : len(words)] = words, label
    of, ids = features(list(vocabulary))
    inside = y >= 0
    lengths = inside.sum(axis=1)
    word, label = x[inside], y[inside]
    last = np.cumsum(lengths) - 1
    linked = np.ones(len(word), bool)
    linked[last] = False
    from_at = np.flatnonzero(linked)
    model = Crf(labels, weights, transitions)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, transitions)]
    for step in range(1, STEPS + 1):
        emissions = _gathered(model.weights, of, ids, len(vocabulary))[word]
        p, forward = model.forward_backward(emissions, lengths)
        error = -p
        error[np.arange(len(word)), label] += 1
        by_word = np.stack([np.bincount(word, error[:, k], len(vocabulary)) for k in range(len(labels))], axis=1)
        g_weights = np.stack([np.bincount(ids, by_word[of, k], 1 << BITS) for k in range(len(labels))], axis=1) / len(word)
        joint = model.links(p, forward, from_at)
        seen = np.zeros_like(transitions)
        np.add.at(seen, (label[from_at], label[from_at + 1]), 1)
        g_transitions = (seen - joint.sum(axis=0)) / len(word)
        for value, gradient, (m, v) in zip((model.weights, model.transitions), (g_weights, g_transitions), moments, strict=True):
            gradient = gradient - DECAY * value
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


class Reader:
    """A model with the emission scores of words met so far."""

    def __init__(self, model: Crf) -> None:
        self.model = model
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(model.labels)))

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.known, self.table = {}, self.table[:0]
        at = list(map(self.known.get, words))
        if None in at:
            new = list({w for w, k in zip(words, at, strict=True) if k is None})
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.table = np.concatenate([self.table, scores(self.model.weights, new)])
            at = list(map(self.known.__getitem__, words))
        return self.table[np.array(at, np.int64)]

    def predicted(self, texts: list[str], at_once: int = AT_ONCE) -> tuple[list[str], list[float]]:
        """The label with the largest share of each text's words, and that share, as expected by the field. Of labels that
        tie the first one is taken."""
        if not self.model.labels:
            return [UNDECIDED] * len(texts), [0.0] * len(texts)
        short = [len(x) <= 2 * at_once for x in texts]  # words are parted by something
        words = [words_in(x) if s else [] for x, s in zip(texts, short, strict=True)]
        lengths = np.array([len(w) for w in words], np.int64)
        sums = np.zeros((1, len(self.model.labels)))
        if lengths.sum():
            p = self.model.marginals(self.emissions([w for ws in words for w in ws]), lengths)
            sums = np.concatenate([sums, np.cumsum(p, axis=0)])
        ends = np.cumsum(lengths)
        share = sums[ends] - sums[ends - lengths]
        for i, text in enumerate(texts):
            if not short[i]:
                lengths[i], share[i] = self.long(text, at_once)
        share = share / np.maximum(lengths, 1)[:, None]
        best = share.argmax(axis=1)
        label = [self.model.labels[k] if n else UNDECIDED for k, n in zip(best, lengths, strict=True)]
        return label, np.where(lengths > 0, np.clip(share.max(axis=1), 0, 1), 0.0).tolist()

    def long(self, text: str, at_once: int = AT_ONCE) -> tuple[int, np.ndarray]:
        """The number of a text's words and the expected number of each label, with at_once words held at a time: a first
        reading carries the ends of all parts, a second one gives the words inside their marginals."""
        text = text.lower()
        k = len(self.model.labels)
        carries = [self.model.carried(self.emissions(part), i > 0) for i, part in enumerate(_parts(text, at_once))]
        before, after = [np.ones(k)], [np.ones(k)]
        for carry in carries[:-1]:
            v = before[-1] @ carry
            before.append(v / v.sum())
        for carry in carries[:0:-1]:
            v = carry @ after[-1]
            after.append(v / v.sum())
        n, total = 0, np.zeros(k)
        for i, part in enumerate(_parts(text, at_once)):
            p = self.model.marginals(self.emissions(part), np.array([len(part)]), before[i] if i else None, after[len(carries) - 1 - i])
            n, total = n + len(part), total + p.sum(axis=0)
        return n, total


def _parts(text: str, at_once: int) -> Iterator[list[str]]:
    """The words of a text in lower case, so many at a time."""
    words = (m[0] for m in _LETTERS.finditer(text) if _is_word(m[0]))
    while part := list(islice(words, at_once)):
        yield part


def sampled(
    labelled: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pieces: int = PIECES
) -> tuple[list[str], list[str]]:
    """Pieces of texts and their languages, from at most `rows` rows of each language: those of least hash of id and text.

    The same rows are drawn however the table lies, and rows that repeat are drawn once. A language's hashes are first cut
    in random parts, so a frequent one isn't ranked in one task. Pieces are cut where the texts lie, at places drawn from the
    hash, from anywhere in the whole text.
    """
    some = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    hashed = some.select(F.col(lang_col).alias("y"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("x"))
    drawn = hashed.select("y", "h").distinct().withColumn("_part", F.pmod("h", F.lit(64)))
    for by in (["y", "_part"], ["y"]):
        drawn = drawn.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("_r") <= rows)
    drawn = written(drawn.select("y", "h"), "drawn")
    chosen = hashed.join(small(drawn, 48), ["y", "h"]).dropDuplicates(["y", "h"]).select("y", "h", "x")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, h, n, x = [], [], [], []
            for lang, number, text in zip(*(batch.column(c).to_pylist() for c in ("y", "h", "x")), strict=True):
                words = [w for w in words_in(text) if len(w) <= LONGEST_WORD]
                rng = np.random.default_rng(number & (2**63 - 1))
                for k in range(min(pieces, -(-len(words) // SEQUENCE))):
                    at = int(rng.integers(max(1, len(words) - SEQUENCE + 1)))
                    y.append(lang)
                    h.append(number)
                    n.append(k)
                    x.append(" ".join(words[at : at + SEQUENCE]))
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.string()), pa.array(h, pa.int64()), pa.array(n, pa.int32()), pa.array(x, pa.string())], names=["y", "h", "n", "x"])

    got = chosen.mapInArrow(cut, "y string, h long, n int, x string").orderBy("h", "y", "n").collect()
    discard(drawn)
    return [r.x for r in got], [r.y for r in got]


def identified(docs: DataFrame, model: Crf, text_col: str = "text", label_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with its text's language and the share of its words that are of it.

    Null texts and texts without a letter get "und" and 0; whole texts are read; other columns and repeated rows are kept,
    but for columns that already have the new names, which are replaced. Of labels that tie the first in order is taken; an
    empty table gives no row; a very long text is one chain, but only a part of its words is held at a time.
    """
    others = [c for c in docs.columns if c not in (label_col, score_col)]
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(label_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            for run, texts in slices(batch, text_col):
                label, score = reader.predicted(texts)
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in others), pa.array(label, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.select(*others).mapInArrow(read, schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the two thirds that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fitted(*sampled(docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))))
    read = identified(docs.select("doc_id", "text"), model)
    return read.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
