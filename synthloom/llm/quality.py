"""Quality rules as a short-circuit cascade, natively: measured on a sample, ordered by rejection per cost."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthloom.functions.text import let
from synthloom.llm.common import SPACES, table, text_of, trimmed, words_of

#: Rows of the sample on which cost and selectivity are measured. The verdict doesn't depend on it, only the order does.
SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeated_words(words: Column, place_bits: int | None = None) -> Column:
    """Words within 3-word windows that the text holds twice or more, the first included. Exact for texts of any length.

    Windows are sorted as longs, each the upper bits of its hash and, in as few bits as the text needs (or place_bits), its
    place; so equal windows are neighbours. If any neighbours of equal bits are of different words, the windows are sorted
    by their words instead. The places of the windows that repeat, in order, then give the words they cover: 3 each, less
    the overlap.
    """

    def with_bits(w: Column, bits: Column) -> Column:
        def packed(i: Column) -> Column:
            h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))

        def head(x: Column) -> Column:
            return F.call_function("shiftright", x, bits)

        def place(x: Column) -> Column:
            return (x - F.call_function("shiftleft", head(x), bits)).cast("int")

        def in_runs(s: Column) -> Column:
            def marks(x: Column, j: Column) -> Column:
                before, after = F.when(j > 0, F.get(s, j - 1)), F.get(s, j + 1)
                return F.coalesce(head(x) == head(before), F.lit(False)) | F.coalesce(head(x) == head(after), F.lit(False))

            return F.filter(s, marks)

        def places(r: Column) -> Column:
            def differs(j: Column) -> Column:
                x, before = F.get(r, j), F.get(r, j - 1)
                alike = F.lit(True)
                for k in range(3):
                    alike &= F.get(w, place(x) + k) == F.get(w, place(before) + k)
                return (head(x) == head(before)) & ~alike

            collide = F.when(F.size(r) > 1, F.exists(F.sequence(F.lit(1), F.size(r) - 1), differs)).otherwise(F.lit(False))
            return F.when(collide, _places_by_words(w)).otherwise(F.sort_array(F.transform(r, place)))

        windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), packed))
        return let(windows, lambda s: let(in_runs(s), lambda r: let(places(r), _covered)))

    def counted(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w))) if place_bits is None else F.lit(place_bits)
        return F.when(F.size(w) > 3, let(bits, lambda b: with_bits(w, b))).otherwise(F.lit(0).cast("long"))

    return let(words, counted)


def _places_by_words(w: Column) -> Column:
    """The places of the windows that repeat, told apart by their very words."""

    def window(i: Column) -> Column:
        return F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))

    def repeats(s: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

        return F.filter(s, lambda x, j: same(x, F.when(j > 0, F.get(s, j - 1))) | same(x, F.get(s, j + 1)))

    ordered = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))
    return let(ordered, lambda s: F.sort_array(F.transform(repeats(s), lambda x: x["i"])))


def _covered(places: Column) -> Column:
    """How many words windows at the given places, in order, cover."""
    steps = F.transform(places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def features(text: Column, words: Column | None = None) -> dict[str, Column]:
    """What the rules read, as expressions of a text (and its words, if they are at hand); each is computed only where a rule
    asks for it."""
    text = text_of(text)
    words = words_of(text) if words is None else words
    lines = F.filter(F.split(text, "\n"), lambda x: trimmed(x) != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_capitals": (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


@dataclass(frozen=True)
class Rule:
    """A name and what fails it, as a condition on features."""

    name: str
    fails: Callable[[Mapping[str, Column]], Column]


BASE = (
    Rule("few_words", lambda f: f["n_words"] < 50),
    Rule("repeats", lambda f: f["n_repeat_words"] * 100 > f["n_words"] * 50),
)
RULES = (
    *BASE,
    Rule("symbols", lambda f: f["n_symbols"] * 10 > f["n_words"]),
    Rule("capitals", lambda f: f["n_capitals"] * 2 > f["word_chars"]),
    Rule("word_length", lambda f: (f["word_chars"] < f["n_words"] * 2) | (f["word_chars"] > f["n_words"] * 20)),
    Rule("dup_lines", lambda f: f["n_dup_lines"] * 2 > f["n_lines"]),
)


class Asked(dict):
    """Features that remember which of them were asked for."""

    def __init__(self, found: Mapping[str, Column]):
        super().__init__(found)
        self.names: set[str] = set()

    def __getitem__(self, name: str) -> Column:
        self.names.add(name)
        return super().__getitem__(name)


def operations(text: Column, words: Column) -> dict[str, Column]:
    """How many steps each feature takes on a text that is parted into words: code points read, items looked at, and items
    times their logarithm where they are sorted or told apart."""
    chars, n = F.length(text_of(text)).cast("double"), F.size(words).cast("double")
    lines = chars - F.length(F.translate(text_of(text), "\n", "")) + 1
    return {
        "n_words": F.lit(1.0),
        "word_chars": 2 * chars,
        "n_symbols": 3 * chars,
        "n_capitals": 3 * chars,
        "n_lines": 2 * chars + lines,
        "n_dup_lines": 3 * chars + 2 * lines,
        "n_repeat_words": 3 * chars + 8 * n + n * F.log2(n + 2),
    }


def ordered_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text", seed: int = 5) -> list[tuple[Rule, float, float]]:
    """The rules by rejection per cost, with the steps that each takes on a text in the mean and the share of rows it rejects.

    Both are measured on a sample drawn from all rows, in one job. Steps are those of operations() for the features that a
    rule asks for: unlike seconds, they are the same in every run and beside any other work.
    """
    n = docs.count()
    text = docs.select(docs[text_col].alias("text"))
    if n > sample_rows:
        text = text.sample(fraction=min(1.0, sample_rows / n), seed=seed)
    sample = text.withColumn("w", words_of(F.col("text")))
    steps, asked, fails = operations(F.col("text"), F.col("w")), [], []
    for rule in rules:
        f = Asked(features(F.col("text"), F.col("w")))
        fails.append(rule.fails(f))
        asked.append(f.names)
    costs = [sum((steps[name] for name in sorted(names)), F.lit(1.0)) for names in asked]
    got = sample.agg(F.count(F.lit(1)), *(F.count_if(x) for x in fails), *(F.coalesce(F.avg(c), F.lit(1.0)) for c in costs)).first()
    found = [(rule, got[1 + len(rules) + k], got[1 + k] / max(1, got[0])) for k, rule in enumerate(rules)]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def verdict(rules: Sequence[Rule], f: Mapping[str, Column]) -> Column:
    """The name of the first rule that fails, null if none does. Later rules aren't computed for a row that failed."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.fails(f), F.lit(rule.name)).otherwise(out)
    return out


def rejections(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> Column:
    """verdict() as an expression of docs' text, its rules in measured order. A text is parted into words once for all rules."""
    order = [rule for rule, _, _ in ordered_rules(docs, rules, sample_rows, text_col)]
    return let(words_of(docs[text_col]), lambda w: verdict(order, features(docs[text_col], w)))


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """The rows that pass every rule, unchanged.

    Null and blank texts have no words and fail; texts of any length are judged whole; repeated rows are judged alike; of
    rules that tie in rejection per cost the cheaper and then the first by name leads; an empty table stays empty; other
    columns are carried along, whatever their names.
    """
    return docs.filter(rejections(docs, rules, sample_rows, text_col).isNull())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; what no column asks for is only computed where the cascade comes to it.

    Null texts have no words and fail; rows that repeat are counted and judged alike; an empty table gives no row.
    """
    docs = table(spark, sf_dir, "documents")
    order = [rule for rule, _, _ in ordered_rules(docs)]
    asked = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    parted = docs.select("doc_id", "text", words_of(docs["text"]).alias("w"))
    found = features(F.col("text"), F.col("w"))
    counted = parted.select("doc_id", "text", *(found[k].alias(k) for k in asked))
    columns = {**features(F.col("text")), **{k: F.col(k) for k in asked}}
    base = F.lit(False)
    for rule in BASE:
        base |= rule.fails(columns)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(order, columns).isNull())
    return counted.withColumn("base_failed", base).select("doc_id", *asked, "base_failed", kept.alias("kept"))


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT k, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS s
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
), r AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM g) WHERE n > 1
), c AS (
  SELECT k, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) v(j) GROUP BY k
), f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_capitals,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (k)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_symbols * 10 > n_words) AND NOT (n_capitals * 2 > word_chars)
         AND NOT (word_chars < n_words * 2 OR word_chars > n_words * 20) AND NOT (n_dup_lines * 2 > n_lines) AS kept
FROM b
"""
