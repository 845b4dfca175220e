"""Toxicity by weak supervision: many voters, a generative model of them, and a linear classifier on its posterior labels.

Voters are lexicons and patterns. Some are fixed below; the others are words and parts of words that a bounded sample of
labelled rows shows to be commoner in toxic texts, each with the share of a text's words from which it votes. The label model
(expectation-maximisation over votes, the given label being one voter more) estimates how often each voter fires in either
class and how far voters are correlated, and weighs those down that repeat each other. The classifier is a logistic
regression on how often a text has each part, fitted to the posterior labels; it alone scores all rows, in one pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthloom.llm.common import discard, parts, slices, table, written

#: Labelled rows of each class that fitting uses, those of least hash; and pieces of words that the classifier knows.
TRAIN_ROWS, CANDIDATES, PIECES, VOTERS = 1500, 1500, 256, 48
#: A text votes by a piece if more than this share of its words have it (0: any); the mined piece carries its own.
SHARES = (0.0, 0.002, 0.005, 0.01, 0.02)
LENGTHS = (4, 5, 6, 7)
#: Longer words have no part in mining pieces (they do in scores), and aren't kept in a task's memory of words.
LONG_WORD, REMEMBERED = 256, 200_000
RIDGE = 1.0

# Words that insult, despise, curse and threaten.
INSULTS = "bastard buffoon clown coward creep cretin dimwit dumbass fool freak halfwit idiot idiots imbecile jackass jerk liar loser losers lunatic moron morons nitwit parasite pig psycho rat scum scumbag simpleton slob swine vermin weasel wimp"
CONTEMPT = "awful brainless clueless contemptible despicable disgusting dumb filthy garbage gross hopeless ignorant lousy pathetic repulsive revolting rubbish shameful sickening spineless stupid trash ugly useless vile worthless"
CURSES = "ass asshole bitch bullshit crap damn fuck fucking shit shitty"
THREATS = "beat burn crush destroy die hang hate hurt kill smash strangle suffer"
LEXICONS = [frozenset(x.split()) for x in (INSULTS, CONTEMPT, CURSES, THREATS)]

_WORD = re.compile(r"[^\W\d_]+")
_ADDRESSED = re.compile(rf"\b(?:you|your|youre|you're)\b[^.!?\n]{{0,40}}\b(?:{'|'.join(sorted(LEXICONS[0] | LEXICONS[1]))})\b")
#: The fixed voters: the lexicons, and a text's reader named beside a word of the first two.
FIXED = len(LEXICONS) + 1


def pieces_of(word: str) -> Iterator[str]:
    """A word, marked as whole, and its parts of LENGTHS letters."""
    yield f"={word}"
    for k in LENGTHS:
        for a in range(len(word) - k + 1):
            yield word[a : a + k]


@dataclass(frozen=True)
class Model:
    """The pieces and the share each votes from; weights of presence, of share, and the intercept."""

    pieces: tuple[str, ...]
    shares: tuple[float, ...]
    weights: np.ndarray


class Counts:
    """How many words of a text each lexicon and piece is in. Remembers what words hold, up to a number of words."""

    def __init__(self, pieces: tuple[str, ...]):
        self.at = {p: FIXED + k for k, p in enumerate(pieces)}
        self.known: dict[str, tuple[int, ...]] = {}

    def holds(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            found = (*(k for k, lexicon in enumerate(LEXICONS) if word in lexicon), *{self.at[p] for p in pieces_of(word) if p in self.at})
            if len(word) <= LONG_WORD:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def of(self, text: str) -> tuple[dict[int, int], int]:
        """({voter or piece: words that hold it}, words)."""
        text = text.lower()
        words, counts = Counter(_WORD.findall(text)), {}
        for word, n in words.items():
            for k in self.holds(word):
                counts[k] = counts.get(k, 0) + n
        if 0 in counts or 1 in counts:
            addressed = len(_ADDRESSED.findall(text))
            if addressed:
                counts[FIXED - 1] = addressed
        return counts, words.total()


def _presence(n: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, np.log1p(n) / math.log(8))


def _share(n: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, n / np.maximum(words, 1) / SHARES[-1])


def label_model(votes: np.ndarray, given: np.ndarray, weight: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1 for each row, each voter's firing rates in class 1 and 0, each voter's weight).

    votes are 0 or 1, a voter a column; the given label is the last voter. Voters taken as independent within classes would
    count copies of a voter as often as there are, so the correlations that are left within classes divide their say.
    """
    x = np.column_stack([votes, given]).astype(float)
    posterior = np.where(given > 0, 0.95, 0.02)
    say = np.ones(x.shape[1])
    for k in range(rounds):
        in_one, in_zero = posterior * weight, (1 - posterior) * weight
        rates = np.vstack([(w @ x + 0.5) / (w.sum() + 1) for w in (in_one, in_zero)])
        if k < 10:
            left = sum(_correlation(votes.astype(float), w) * w.sum() for w in (in_one, in_zero)) / weight.sum()
            np.fill_diagonal(left, 0)
            say[:-1] = 1 / (1 + np.maximum(left, 0).sum(1))
        fired, quiet = np.log(rates[0] / rates[1]), np.log((1 - rates[0]) / (1 - rates[1]))
        prior = (in_one.sum() + 0.5) / (weight.sum() + 1)
        logit = math.log(prior / (1 - prior)) + (x * fired + (1 - x) * quiet) @ say
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior, rates, say


def _correlation(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    centred = x - (weight @ x) / max(weight.sum(), 1e-9)
    covariance = (centred * weight[:, None]).T @ centred
    spread = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
    return covariance / np.outer(spread, spread)


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge regression for soft targets by Newton's method; the last column of x, the intercept, isn't shrunk."""
    w, weight = np.zeros(x.shape[1]), weight / weight.mean()
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - target)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, n): texts by class (1 first) and share in which a piece is held by more than that share of the words."""
    held: dict[str, list[int]] = {}

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.list_(pa.int64()))], ["piece", "n"])

    for batch in batches:
        for run, texts in slices(batch, "text"):
            for toxic, text in zip(run.column("toxic").to_pylist(), texts, strict=True):
                words, found = Counter(_WORD.findall(text.lower())), Counter()
                for word, n in words.items():
                    if len(word) <= LONG_WORD:
                        for p in set(pieces_of(word)):
                            found[p] += n
                total = words.total()
                for p, n in found.items():
                    row = held.setdefault(p, [0] * 2 * len(SHARES))
                    for k, share in enumerate(SHARES):
                        if n <= share * total:
                            break
                        row[(0 if toxic else len(SHARES)) + k] += 1
                if len(held) >= REMEMBERED:
                    yield passed()
                    held.clear()
    yield passed()


def _candidates(train: DataFrame, ones: int, zeros: int) -> list[tuple[str, float]]:
    """(piece, share): the pieces that tell the classes apart most clearly."""
    counts = train.mapInArrow(_mined, "piece string, n array<long>")
    summed = counts.groupBy("piece").agg(*(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(2 * len(SHARES))))
    scores = []
    for k in range(len(SHARES)):
        a, b = F.col(f"n{k}"), F.col(f"n{len(SHARES) + k}")
        p = (a + b) / F.lit(ones + zeros)
        z = F.round((a / ones - b / zeros) / F.sqrt(p * (1 - p) * (1 / ones + 1 / zeros) + 1e-9), 9)
        scores.append(F.struct(z.alias("z"), F.lit(-k).alias("k"), a.alias("a"), b.alias("b")))
    best = summed.filter(F.col("n0") >= max(3, ones // 250)).select("piece", F.greatest(*scores).alias("s")).filter("s.z > 3")
    rows = best.orderBy(F.desc("s.z"), F.desc(F.length("piece")), "piece").limit(CANDIDATES).collect()
    kept: list[tuple[str, float]] = []
    for r in rows:  # what holds or is held by a clearer piece says nothing of its own
        word = r.piece.strip("=")
        if not any(word in k or k.strip("=") in word for k, _ in kept):
            kept.append((r.piece, SHARES[-r.s.k]))
    return kept[:PIECES]


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the texts whose id has a label, 0 or 1; of an id with several labels the largest counts.

    At most TRAIN_ROWS rows of each class take part, those whose ids have the least hashes. Without rows of both classes, the
    fixed lexicons alone score.
    """
    spark = docs.sparkSession
    ids = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    ids = ids.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    ordered = ids.withColumn("h", F.xxhash64(F.col("_id").cast("string"))).orderBy("h", "_id")
    drawn = [ordered.filter(F.col("toxic") == y).limit(TRAIN_ROWS) for y in (1, 0)]
    chosen = written(drawn[0].unionByName(drawn[1]).drop("h"), "labelled")  # 2 x TRAIN_ROWS rows at most
    train = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "toxic", "text")
    train = written(train.repartition(parts(spark), "_id"), "train")
    totals = {r.toxic: r["count"] for r in ids.groupBy("toxic").count().collect()}
    held = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    found = _candidates(train.select("toxic", "text"), held[1], held[0]) if len(held) == 2 else []
    pieces, shares = tuple(p for p, _ in found), tuple(s for _, s in found)
    width = FIXED + len(pieces)
    if len(held) < 2:
        return Model(pieces, shares, np.concatenate([np.full(FIXED, 4.0), np.full(FIXED, 4.0), [-3.0]]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(pieces)
        for batch in batches:
            for run, texts in slices(batch, "text"):
                rows = [counts.of(t) for t in texts]
                where = [pa.array([list(f(c)) for c, _ in rows], pa.list_(pa.int64())) for f in (dict.keys, dict.values)]
                yield pa.RecordBatch.from_arrays([run.column("_id"), run.column("toxic"), *where, pa.array([n for _, n in rows], pa.int64())], ["_id", "toxic", "at", "n", "words"])

    kind = train.schema["_id"].dataType.simpleString()
    rows = train.mapInArrow(counted, f"_id {kind}, toxic int, at array<long>, n array<long>, words long").orderBy("_id", "words").collect()
    discard(train)
    x, words = np.zeros((len(rows), width)), np.array([r.words for r in rows], float)[:, None]
    for k, r in enumerate(rows):
        x[k, r["at"]] = r.n
    toxic = np.array([r.toxic for r in rows])
    weight = np.where(toxic == 1, totals[1] / held[1], totals[0] / held[0])
    over = np.array([0.0] * FIXED + list(shares))
    votes = (x > over * words) & (x > 0)
    posterior, _, _ = label_model(votes[:, : FIXED + VOTERS], toxic, weight)
    weights = logistic(np.hstack([_presence(x), _share(x, words), np.ones((len(x), 1))]), posterior, weight)
    return Model(pieces, shares, weights)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row from its whole text alone. Null and empty texts have the score of a text without any
    piece; ids may be null or repeat; other columns are not read."""
    width = FIXED + len(model.pieces)
    presence, share, base = model.weights[:width], model.weights[width:-1], float(model.weights[-1])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(model.pieces)
        for batch in batches:
            for run, texts in slices(batch, "t"):
                logits = np.full(len(texts), base)
                for k, text in enumerate(texts):
                    found, words = counts.of(text)
                    if found:
                        at, n = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), float, len(found))
                        logits[k] += _presence(n) @ presence[at] + _share(n, np.array(words)) @ share[at]
                yield pa.RecordBatch.from_arrays([run.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30))))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("t")).mapInArrow(score, f"`{id_col}` {kind}, score double")


def held_out(id_col: str = "doc_id", of: int = 4, part: int = 2) -> Column:
    """Whether the CRC-32 of the id as text (null: no text) leaves `part` when divided by `of`."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of == part


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of those that aren't held out.

    Labels other than 0 and 1 are left out; null and empty texts get the classifier's intercept; repeated rows get equal
    scores; an empty table gives no row.
    """
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    out = scored(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
