"""Personal data: pattern spans, and the terms of whole texts that give protected entities away, natively.

A term's disclosure of an entity is the share of the entity's information that the term brings, by how often both are in
one text. Entities are what the patterns find, and what many such finds have in common: the domain of a mail address, the
network of an IP address, the issuer of a card, the head of a phone number. Terms above the threshold are generalised to
the narrowest class of words that is below it by the corpus's own counts, and removed where no class is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthloom.functions.text import let
from synthloom.llm.common import BROADCAST_BYTES, discard, fresh, small, table, text_key, text_of, written

# The patterns are written possessively and anchored to where a run begins: they find the same leftmost matches as their
# plain forms, in time linear in the text and without recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
KINDS = (*PATTERNS, "term")
MASKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_VALID = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: Share of an entity's information from which on a term is generalised, or removed where no class of it stays below.
DISCLOSED_AT = 0.7
#: Different texts in which a term must be with an entity: one text alone is no estimate.
SUPPORT = 2
#: Texts at the entity's base rate that every estimate starts from: few joint texts are no certainty.
PRIOR = 4
#: A term: letters and digits of any number, with single hyphens and apostrophes between them.
TERM = r"[\p{L}\p{M}\p{N}]++(?:['\u2019-][\p{L}\p{M}\p{N}]++)*+"
_PART_OF_TERM = r"[\p{L}\p{M}\p{N}]"
SPAN = "struct<start:int,kind:int,end:int,value:string>"
SPANS = f"array<{SPAN}>"
NO_ACTION = "_key binary, _told array<string>, _levels array<int>"
#: Items after which a scan starts a new array, and code points of the blocks that long texts are cut in.
SCAN_BLOCK, TEXT_BLOCK = 256, 4096


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check that doubles every second digit from the right."""
    figures = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    summed = F.transform(figures, lambda c, i: F.when(i % 2 == 1, F.translate(c, "0123456789", "0246813579")).otherwise(c).cast("int"))
    return F.aggregate(summed, F.lit(0), lambda total, x: total + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(IP_VALID)
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(F.translate(match, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def scanned(items: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """The outputs of a scan from the left over an array that isn't empty: step(state, item) gives the next state, an int
    that starts at 0, and an output of type `out`. Outputs gather in blocks, so many of them don't cost their square."""
    none = F.array().cast(f"array<{out}>")

    def one(acc: Column, x: Column) -> Column:
        state, value = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(value.cast(out))).alias("out"))

    def block(acc: Column, items: Column) -> Column:
        inner = F.aggregate(items, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    n = F.ceil(F.size(items) / SCAN_BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(items, b * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)))
    start = F.struct(F.lit(0).alias("state"), F.array().cast(f"array<array<{out}>>").alias("out"))
    return F.flatten(F.aggregate(blocks, start, block)["out"])


def located(text: Column, pattern: Column, kind: int, keep: Callable[[Column], Column]) -> Column:
    """The spans of a pattern's matches that keep(match) accepts, in order: (start, kind, end) in code points, and the match.

    A match begins after the gaps up to it and the matches before it; what lies between matches is what split() returns.
    """

    def walk(matches: Column) -> Column:
        def step(at: Column, x: Column) -> tuple[Column, Column]:
            start = at + F.length(x["gap"])
            end = start + F.length(x["match"])
            return end, F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("value"))

        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        spans = scanned(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), step, SPAN)
        return F.when(F.size(matches) == 0, F.array().cast(SPANS)).otherwise(F.filter(spans, lambda s: keep(s["value"])))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), walk)


def base_spans(text: Column) -> Column:
    """The pattern spans of a text, by start, then kind."""

    def found(k: int, kind: str) -> Column:
        spans = located(text, F.lit(PATTERNS[kind]), k, lambda match: valid(kind, match))
        return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(F.array().cast(SPANS)) if kind in NEEDS else spans

    return F.array_sort(F.concat(*(found(k, kind) for k, kind in enumerate(PATTERNS))))


def described(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(x) for x in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def entities(spans: Column) -> Column:
    """What pattern spans protect: each find by itself, and what it has in common with others."""

    def named(s: Column) -> Column:
        value = F.when(s["kind"] >= 2, F.translate(s["value"], "+ ().-", "")).otherwise(F.lower(s["value"]))
        names = F.array(*(F.lit(x) for x in PATTERNS))
        shared = (
            F.when(s["kind"] == 0, F.concat(F.lit("domain:"), F.substring_index(value, "@", -1)))
            .when(s["kind"] == 1, F.concat(F.lit("network:"), F.substring_index(value, ".", 3)))
            .when(s["kind"] == 2, F.concat(F.lit("issuer:"), F.substring(value, 1, 6)))
            .otherwise(F.concat(F.lit("exchange:"), F.substring(value, 1, 5)))
        )
        return F.array(F.concat_ws(":", F.get(names, s["kind"]), value), shared)

    return F.array_distinct(F.flatten(F.transform(spans, named)))


def terms_of(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def classes_of(term: Column) -> Column:
    """The classes that a term generalises to, from narrow to wide: terms of its kind (letters, digits, both) and length, and of
    its kind. Neither says a letter of it."""
    kind = F.when(term.rlike(r"^[\p{L}\p{M}]+$"), "word").when(term.rlike(r"^\p{N}+$"), "number").otherwise("code")
    return F.array(F.concat(F.lit("["), kind, F.lit(" of "), F.length(term).cast("string"), F.lit("]")), F.concat(F.lit("["), kind, F.lit("]")))


def spliced(text: Column, spans: Column, mask: Callable[[Column], Column]) -> Column:
    """The text with mask(span) for each span, in order of their starts; one that begins inside an earlier one goes with it."""
    kept = "struct<low:int,high:int,mask:string>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        piece = F.struct(at.alias("low"), s["start"].alias("high"), mask(s).alias("mask"))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, piece)

    def joined(blocks: Column, width: Column) -> Column:
        def between(low: Column, high: Column) -> Column:
            a, b = F.floor(low / width).cast("int"), F.floor((high - 1) / width).cast("int")
            within = F.substr(F.get(blocks, a), low - a * width + 1, high - low)
            across = F.concat(
                F.substr(F.get(blocks, a), low - a * width + 1, width), F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substr(F.get(blocks, b), F.lit(1), high - b * width)
            )
            return F.when(high <= low, F.lit("")).when(a == b, within).otherwise(across)

        pieces = scanned(spans, step, kept)
        masked = F.array_join(F.transform(F.filter(pieces, lambda p: p.isNotNull()), lambda p: F.concat(between(p["low"], p["high"]), p["mask"])), "")
        return F.concat(masked, between(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    def cut(long: Column) -> Column:
        blocks = F.when(long, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{TEXT_BLOCK}}}+"), F.lit(0))).otherwise(F.array(text))
        return let(blocks, lambda b: joined(b, F.when(long, F.lit(TEXT_BLOCK)).otherwise(F.lit(1 << 30))))

    return F.when(F.size(spans) == 0, text).otherwise(cut(F.length(text) > 2 * TEXT_BLOCK))


def disclosed(n_term: Column, n_entity: Column, both: Column, n: int, prior: float = PRIOR) -> Column:
    """The share of an entity's information, -log2 p(entity), that a term gives: log2 of p(entity | term) / p(entity).

    p(entity | term) is estimated from the texts with both and the texts with the term, and `prior` texts at the base rate.
    """
    rate = n_entity / F.lit(float(max(2, n)))
    given = (both + prior * rate) / (n_term + prior)
    return F.when(rate < 1, F.log2(given / rate) / -F.log2(rate)).otherwise(F.lit(0.0))


def actions_on(rows: DataFrame, at: float = DISCLOSED_AT, support: int = SUPPORT, prior: float = PRIOR) -> DataFrame:
    """(_key, _told, _levels) for each text of which terms give its entities away: these terms, those that begin alike with
    the longer one first, and how far each is to be generalised: to its first class, its second one, or removed (3).

    rows has _row, _key, _text and _base. All counts are of different texts, so copies estimate nothing. Words are counted
    where they are, by partial sums; what is shuffled are counts, and the (text, term) rows of texts with a protected entity.
    """
    copies = written(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first")).filter("n > 1"), "pii-copies")
    extra = rows.select("_key", "_row").join(small(copies, 48), "_key").filter(F.col("_row") != F.col("first")).select("_row")
    extra = written(extra, "pii-extra")
    n_extra = extra.count()
    texts = rows if not n_extra else rows.join(small(extra, 16, n_extra), "_row", "left_anti")
    n_texts = rows.count() - n_extra

    spotted = texts.filter(F.size("_base") > 0)
    named = written(spotted.select("_row", F.explode(entities(F.col("_base"))).alias("entity")), "pii-named")
    # no term can be in more texts with an entity than the entity is in: those below the support give no pair
    counted = written(named.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity") >= support), "pii-counted")
    (largest,) = counted.agg(F.max("n_entity")).first()
    if largest is None:
        return rows.sparkSession.createDataFrame([], NO_ACTION)
    # entities of the same texts have the same counts with every term: they are one, named by 128 bits of these texts
    held = named.join(small(counted.drop("n_entity"), 96), "entity")
    alike = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), *(F.bit_xor(F.xxhash64("_row", F.lit(k))).alias(f"x{k}") for k in (0, 1)))
    alike = written(alike.select(F.col("entity").alias("_of"), F.concat_ws(":", "n_entity", "x0", "x1").alias("group"), "n_entity"), "pii-alike")
    held = held.join(small(alike, 144), F.col("entity") == F.col("_of")).select("_row", F.col("group").alias("entity"), "n_entity").distinct()
    held = written(held, "pii-held")
    near = spotted.join(small(held.select("_row").distinct(), 16), "_row", "left_semi")
    around = spliced(F.col("_text"), F.col("_base"), lambda s: F.lit(" "))
    beside = written(near.select("_row", F.explode(terms_of(around)).alias("term")), "pii-beside")

    # a term is in as many texts at least as it is in texts with entities, and with an entity in as many at most as the
    # entity is in: most pairs can't reach the threshold whatever the counts
    n_near = beside.groupBy("term").agg(F.count(F.lit(1)).alias("n_near")).filter(F.col("n_near") >= support)
    reach = disclosed(F.col("n_near"), F.col("n_entity"), F.least("n_near", "n_entity"), n_texts, prior)
    rare = written(n_near, "pii-near")
    pairs = written(beside.join(small(rare, 64), "term").join(small(held, 112), "_row").filter(reach >= at), "pii-pairs")
    joint = pairs.groupBy("entity", "term", "n_entity", "n_near").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= support)
    joint = written(joint.filter(disclosed(F.col("n_near"), F.col("n_entity"), F.col("both"), n_texts, prior) >= at), "pii-joint")
    if joint.isEmpty():
        return rows.sparkSession.createDataFrame([], NO_ACTION)

    asked = joint.select("term").distinct()
    asked = written(asked.select(F.explode(F.concat(F.array("term"), classes_of(F.col("term")))).alias("word")).distinct(), "pii-asked")
    n_word = written(_texts_with(texts, asked), "pii-frequency")
    n_term = F.greatest("n_near", F.coalesce("n_word", F.lit(0)))  # a term that stands alone once entities are cut out isn't a word
    told = joint.join(small(n_word, 64), F.col("term") == F.col("word"), "left")
    told = told.filter(disclosed(n_term, F.col("n_entity"), F.col("both"), n_texts, prior) >= at).select("entity", "term", "n_entity")
    told = written(told, "pii-told")

    # how much each class of a told term gives away of the entity
    classed = told.select("entity", "n_entity", F.posexplode(classes_of(F.col("term"))).alias("level", "word")).distinct()
    classed = written(classed, "pii-classed")
    members = beside.select("_row", F.explode(classes_of(F.col("term"))).alias("word")).join(small(classed.select("word").distinct(), 48), "word", "left_semi").distinct()
    wide = members.join(small(held.select("_row", "entity"), 96), "_row").join(small(classed, 128), ["entity", "word"])
    wide = wide.groupBy("entity", "word", "n_entity").agg(F.count(F.lit(1)).alias("both")).join(small(n_word, 64), "word", "left")
    safe = disclosed(F.greatest("both", F.coalesce("n_word", F.lit(0))), F.col("n_entity"), F.col("both"), n_texts, prior) < at
    safe = written(wide.filter(safe).select("entity", "word"), "pii-safe")
    levels = told.select("entity", "term", F.posexplode(classes_of(F.col("term"))).alias("level", "word")).join(small(safe, 96), ["entity", "word"])
    levels = levels.groupBy("entity", "term").agg((F.min("level") + 1).alias("level"))
    told = written(told.join(levels, ["entity", "term"], "left").select("entity", "term", F.coalesce("level", F.lit(3)).alias("level")), "pii-levels")

    mine = pairs.select("_row", "entity", "term").join(small(told, 128), ["entity", "term"]).groupBy("_row", "term").agg(F.max("level").alias("level"))
    ordered = F.sort_array(F.collect_list(F.struct("term", "level")), asc=False)
    by_row = written(mine.groupBy("_row").agg(ordered.alias("t")), "pii-by-row")
    actions = rows.select("_row", "_key").join(small(by_row, 512), "_row").select("_key", F.col("t.term").alias("_told"), F.col("t.level").alias("_levels"))
    actions = written(actions, "pii-actions")
    for done in (copies, extra, named, counted, alike, held, beside, rare, pairs, joint, asked, n_word, told, classed, safe, by_row):
        discard(done)
    return actions


def _texts_with(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, n_word): the number of texts that hold each asked word, a term or a class of terms."""

    def words(terms: Column) -> Column:
        return F.array_distinct(F.concat(terms, F.flatten(F.transform(terms, classes_of))))

    rows = asked.count()
    if not rows:
        return asked.withColumn("n_word", F.lit(0).cast("long"))
    every = texts.select(F.explode(let(terms_of(F.col("_text")), words)).alias("word"))
    if rows * 64 <= BROADCAST_BYTES:  # else all words are counted, and the asked ones picked from the counts
        every = every.join(F.broadcast(asked), "word", "left_semi")
    return every.groupBy("word").agg(F.count(F.lit(1)).alias("n_word")).join(small(asked, 64, rows), "word", "left_semi")


def found(docs: DataFrame, text_col: str = "text", **how) -> tuple[DataFrame, dict[str, str]]:
    """docs with more columns, and their names: base (pattern spans), spans (all spans), told and levels (of terms).

    A term span is a whole-word occurrence, in any case, of a term that gives away an entity of this very text; it
    never overlaps a pattern span. Null texts are empty; whole texts are read, in time linear in their length, times the
    number of terms told in a text where there are any;
    repeated rows and copies of a text get the same spans; of spans that begin alike the first kind stands first; an empty
    table gives no row; columns of any names are carried along. The rows are written once with what the patterns find.
    """
    names = {k: fresh(docs, k) for k in ("row", "key", "base", "spans", "told", "levels", "of")}
    text = text_of(docs[text_col])
    wide = docs.withColumns({names["row"]: F.monotonically_increasing_id(), names["key"]: text_key(text), names["base"]: base_spans(text)})
    wide = written(wide, "pii-rows")
    slim = wide.select(*(F.col(names[k]).alias(f"_{k}") for k in ("row", "key", "base")), text_of(wide[text_col]).alias("_text"))
    actions = actions_on(slim, **how).select(*(F.col(f"_{k}").alias(names[n]) for k, n in (("key", "of"), ("told", "told"), ("levels", "levels"))))
    joined = wide.join(small(actions, 512), F.col(names["key"]) == F.col(names["of"]), "left").drop(names["of"], names["row"])
    text, base, told = text_of(joined[text_col]), F.col(names["base"]), F.col(names["told"])
    pattern = F.concat(F.lit(rf"(?iu)(?<!{_PART_OF_TERM})(?:"), F.array_join(told, "|"), F.lit(rf")(?!{_PART_OF_TERM})"))
    terms = located(text, pattern, len(PATTERNS), lambda m: F.lit(True))
    clear = F.filter(terms, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.withColumn(names["spans"], F.when(told.isNotNull(), F.array_sort(F.concat(base, clear))).otherwise(base)), names


def masked(text: Column, spans: Column, told: Column, levels: Column) -> Column:
    """The text with entities masked by kind, and terms replaced by the class they are generalised to or removed."""
    masks = F.array(*(F.lit(x) for x in MASKS))

    def mask(s: Column) -> Column:
        term = F.lower(s["value"])
        level = F.coalesce(F.get(levels, F.array_position(told, term).cast("int") - 1), F.lit(3))
        return F.when(s["kind"] < len(MASKS), F.get(masks, s["kind"])).otherwise(F.coalesce(F.get(classes_of(term), level - 1), F.lit("")))

    return spliced(text, spans, mask)


def sanitised(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = None, **how) -> DataFrame:
    """docs with personal data masked in its text; n_chars_col, if named, is set to the new length.

    Null texts stay null; rows, order of columns and the other columns are kept; repeated rows are treated alike; an empty
    table stays empty. found() says what is personal data.
    """
    wide, names = found(docs, text_col, **how)
    text = masked(F.col(text_col), *(F.col(names[k]) for k in ("spans", "told", "levels")))
    out = wide.withColumn(text_col, F.when(F.col(text_col).isNull(), F.col(text_col)).otherwise(text))
    if n_chars_col:
        out = out.withColumn(n_chars_col, F.when(F.col(text_col).isNull(), F.col(n_chars_col)).otherwise(F.length(text_col)).cast(docs.schema[n_chars_col].dataType))
    return out.select(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the pattern spans, and all spans. found() states the odd cases."""
    wide, names = found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = F.col(names["base"]), F.col(names["spans"])

    def of_kind(k: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return wide.select("doc_id", *counts, F.sha2(described(base), 256).alias("base_sha256"), described(spans).alias("spans"))
