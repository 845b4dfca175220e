"""Locally consistent recompression of word sequences, on many documents at once.

A round replaces each run of one symbol, or each pair of adjacent symbols of which the left one draws "left" and the right
one "right" from a hash of the symbol, by a new symbol. The new name is a 64-bit hash of what it replaces: equal pairs get
equal names in every task of a cluster, so no dictionary of names has to be shuffled. With each symbol goes its context,
the interval of words that alone decides that the symbol is there: wherever these words occur again, away from a
document's ends, so does the symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The rounds, and the most words a symbol may span to be paired.
ROUNDS = ("run", *["pair"] * 7)
LONGEST_PAIRED = 6

_FAR = np.int64(1) << np.int64(40)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Symbols:
    """Symbols of several documents one after another: name, first word, whether a document begins, and context [low, high)."""

    name: np.ndarray
    start: np.ndarray
    first: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def kept(self, keep: np.ndarray) -> Symbols:
        return Symbols(*(x[keep] for x in (self.name, self.start, self.first, self.low, self.high)))


def words_as_symbols(hashes: np.ndarray, lengths: np.ndarray) -> Symbols:
    n = len(hashes)
    first = np.zeros(n, bool)
    begins = np.cumsum(lengths) - lengths
    first[begins[lengths > 0]] = True
    at = np.arange(n, dtype=np.int64)
    return Symbols(hashes, at, first, at.copy(), at + 1)


def _next(x: np.ndarray, last: np.ndarray, beyond: np.int64) -> np.ndarray:
    """x of the following symbol, `beyond` at a document's end."""
    out = np.append(x[1:], beyond)
    out[last] = beyond
    return out


def _before(x: np.ndarray, first: np.ndarray, beyond: np.int64) -> np.ndarray:
    out = np.insert(x[:-1], 0, beyond)
    out[first] = beyond
    return out


def runs(s: Symbols) -> Symbols:
    """Each maximal run of a symbol becomes one; that it ends where it does is up to its neighbours."""
    if not len(s.name):
        return s
    begins = np.insert((s.name[1:] != s.name[:-1]) | s.first[1:], 0, True)
    at = np.flatnonzero(begins)
    count = np.diff(np.append(at, len(s.name)))
    name = np.where(count > 1, mixed(s.name[at] * _A + count.astype(np.uint64)), s.name[at])
    out = Symbols(name, s.start[at], s.first[at], np.minimum.reduceat(s.low, at), np.maximum.reduceat(s.high, at))
    last = np.append(out.first[1:], True)
    low = np.minimum(out.low, np.minimum(_before(out.low, out.first, -_FAR), _next(out.low, last, _FAR)))
    high = np.maximum(out.high, np.maximum(_before(out.high, out.first, -_FAR), _next(out.high, last, _FAR)))
    return Symbols(out.name, out.start, out.first, low, high)


def pairs(s: Symbols, salt: int, longest: int, n_words: int) -> Symbols:
    """Each left symbol with a right one after it becomes one symbol; the others depend on the neighbour they did not join."""
    if not len(s.name):
        return s
    last = np.append(s.first[1:], True)
    short = np.diff(np.append(s.start, n_words)) <= longest
    right = mixed(s.name ^ mixed(np.array([salt], dtype=np.uint64))) >> np.uint64(63) == 1
    lefts, rights = short & ~right, short & right
    joins = np.append(lefts[:-1] & rights[1:] & ~s.first[1:], False)
    joined = np.insert(joins[:-1], 0, False)
    next_low, next_high = _next(s.low, last, _FAR), _next(s.high, last, _FAR)
    before_low, before_high = _before(s.low, s.first, -_FAR), _before(s.high, s.first, -_FAR)
    low = np.where(lefts, np.minimum(s.low, next_low), np.where(rights & ~joined, np.minimum(s.low, before_low), s.low))
    high = np.where(lefts, np.maximum(s.high, next_high), np.where(rights & ~joined, np.maximum(s.high, before_high), s.high))
    at = np.flatnonzero(joins)
    name = s.name.copy()
    name[at] = mixed(s.name[at] * _A + mixed(s.name[at + 1] * _B + _C))
    return Symbols(name, s.start, s.first, low, high).kept(~joined)


def recompress(hashes: np.ndarray, lengths: np.ndarray, rounds: tuple[str, ...] = ROUNDS, longest: int = LONGEST_PAIRED) -> Symbols:
    """The symbols after the given rounds, of documents with `lengths` words whose hashes lie one after another."""
    s = words_as_symbols(hashes, lengths)
    for k, kind in enumerate(rounds):
        s = runs(s) if kind == "run" else pairs(s, k + 1, longest, len(hashes))
    return s


def window_hashes(hashes: np.ndarray, window: int) -> np.ndarray:
    """A hash of each `window` consecutive words of an array, from prefix sums: len(hashes) - window + 1 values."""
    n = len(hashes)
    if n < window:
        return np.empty(0, np.uint64)
    base = np.uint64(0xD6E8FEB86659FD93)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]), dtype=np.uint64)
    inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)])
    return mixed((sums[window:] - sums[:-window]) * inverses[: n - window + 1])
