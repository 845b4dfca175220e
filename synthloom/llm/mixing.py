"""Mixing sources to target weights by Efraimidis-Spirakis sampling, natively."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthloom.llm.common import fresh, n_words_of, running, small, table, text_key, text_of, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: The characters whose share lowers a document's quality weight.
JUNK = "#*$%&|<>0123456789"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quality_weight(n_chars: Column, n_clean: Column, n_plain: Column, n_words: Column) -> Column:
    """0.05 to 1.05, from what the quality rules also look at: few digits and markup, few capitals, and enough words.

    The squared share of code points that are neither digits nor markup (n_clean), times the share that are no capitals
    (n_plain), times n / (n + 50) of n words, above a floor.
    """
    clean = n_clean.cast("double") / n_chars
    weight = clean * clean * (n_plain.cast("double") / n_chars) * (n_words.cast("double") / (n_words + 50))
    return F.lit(0.05) + F.when(n_chars == 0, F.lit(0.0)).otherwise(weight)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(source, source_size), a row a source, with each source's target in words.

    Sources in code point order, null last, take the weights in turn. `share` of all words is dealt by weight; no target
    passes `most` times its source's size, and the excess goes to the others by weight until none is above. That fixed
    point is level * weight below the ceiling: with sources sorted by ceiling / weight, the level follows from prefix sums,
    so no loop is needed. Both orders are range-partitioned: sources may be as many as hosts are.
    """
    named = running(sizes.withColumn("_none", F.col("source").isNull()), [], ["_none", "source"], "source_size", "sources")
    turn = (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), turn)
    ranked = named.withColumns({"_w": w, "_cap": F.col("source_size") * float(most)}).drop("_before", "_rank")
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    filled = running(ranked, [], ["_ratio", "_none", "source"], "_cap", "ceilings", ("_w",))
    words, every_w = (x or 0 for x in ranked.agg(F.sum("source_size"), F.sum("_w")).first())
    filled = filled.withColumn("_level", (F.lit(float(words) * float(share)) - F.col("_before")) / (F.lit(float(every_w)) - F.col("_before__w")))
    # the first source, by ratio, that the level leaves below its ceiling sets the level for all that follow
    first = filled.agg(F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "source", "_level"))).alias("at")).first()["at"]
    target = F.col("_cap") if first is None else F.least(F.col("_cap"), F.lit(first["_level"]) * F.col("_w"))
    return filled.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
) -> DataFrame:
    """How often the mix takes each row: whole epochs of its source first, then a weighted sample for the rest.

    Each row gets the key -ln(u) / quality, u being a hash of seed, id and text, so reruns agree on any cluster. Within a
    source, rows in key order are prefix-summed; a row is in the fractional pass if the middle of its span lies below the
    words still wanted, so a source misses its target by at most half of one row.

    Returns id_col, size (words), source_size, target, copies (int), taken (words, repeats counted) and the source as
    `source`. Null texts have no words and take none; a null source is a source of its own; repeated rows are told apart
    by nothing and all stay; sources of no words have target 0; texts of any length count whole; an empty table gives no
    row; other columns are not read.
    """
    if most < share:
        raise ValueError("targets cannot be met when most is below share")
    text = text_of(docs[text_col])
    salt = F.md5(F.concat_ws(":", F.lit(str(seed)), docs[id_col].cast("string"), F.md5(text)))
    u = (F.conv(F.substring(salt, 1, 13), 16, 10).cast("double") + 1.0) / F.lit(float(2**52 + 1))
    if quality is None:
        # lengths first, as columns: an expression that several others read is computed once
        read = {"_chars": F.length(text), "_clean": F.length(F.translate(text, JUNK, "")), "_plain": F.length(F.translate(text, CAPITALS, ""))}
        weight = quality_weight(F.col("_chars"), F.col("_clean"), F.col("_plain"), F.col("size"))
    else:
        read, weight = {"_quality": quality}, F.col("_quality")
    sized = docs.select(docs[id_col].alias("_id"), docs[source_col].alias("source"), n_words_of(text).alias("size"), u.alias("_u"), *(c.alias(n) for n, c in read.items()))
    keyed = sized.select("_id", "source", "size", (-F.log("_u") / weight).alias("_key"))
    ordered = running(keyed, ["source"], ["_key", "_id"], "size", "mix")
    sizes = written(ordered.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    targets = written(source_targets(sizes, weights, share, most), "targets").select(F.col("source").alias("_source"), "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    picked = (F.col("size") > 0) & (F.col("_before") * 2 + F.col("size") <= rest * 2)
    return (
        ordered.join(small(targets, 96), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_epochs", epochs)
        .withColumn("copies", (F.col("_epochs") + picked.cast("int")).cast("int"))
        .select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs as often as mix() takes them, with docs' own columns.

    A row is known by the hash of its id, text and source. Of rows that repeat all three, mix() may take some once more than
    others: as many of them, numbered by their place, are given one copy more, so the words given are those that mix()
    takes. Null texts are never taken; null ids and sources are kept; very long texts, ties and other columns are carried
    along as they are; an empty table stays empty.
    """
    row, at, least, more, turn = (fresh(docs, x) for x in ("row", "at", "least", "more", "turn"))
    keyed = docs.withColumn(row, F.unhex(F.md5(F.concat_ws(":", F.xxhash64(id_col, source_col).cast("string"), F.hex(text_key(docs[text_col]))))))
    taken = mix(keyed.select(row, text_col, source_col), id_col=row, text_col=text_col, source_col=source_col, **how)
    # of equal rows copies differ by one at most: the fractional pass takes each once
    counts = taken.groupBy(F.col(row).alias(at)).agg(F.min("copies").alias(least), F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    counts = counts.select(at, least, (F.col("_all") - F.col("_rows") * F.col(least)).alias(more)).filter(F.col("_all") > 0)
    counts = written(counts, "taken")
    given = keyed.join(small(counts, 64), F.col(row) == F.col(at))
    even = given.filter(F.col(more) == 0).withColumn(turn, F.col(least))
    uneven = given.filter(F.col(more) > 0)
    whole = docs.columns
    out = even.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(turn)))).select(*whole)
    if counts.filter(F.col(more) > 0).isEmpty():
        return out
    names = {c: f"_c{i}" for i, c in enumerate(whole)}
    packed = uneven.select(*(F.col(c).alias(n) for c, n in names.items()), F.col(row).alias("_of"), F.col(least).alias("_least"), F.col(more).alias("_more"), F.lit(1).alias("_one"))
    numbered = running(packed, ["_of"], [], "_one", "repeated-rows")
    copies = F.col("_least") + (F.col("_rank") < F.col("_more")).cast("int")
    again = numbered.withColumn("_copies", copies).filter("_copies > 0").withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.unionByName(again.select(*(F.col(n).alias(c) for c, n in names.items())))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 5, 2, 1 to 150% of their words."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), k AS (
  SELECT doc_id, source,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5(concat_ws(':', '17', doc_id::VARCHAR, md5(text))), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370497.0)
           / (0.05 + CASE WHEN length(text) = 0 THEN 0.0
                          ELSE (length(translate(text, '#*$%&|<>0123456789', ''))::DOUBLE / length(text))
                               * (length(translate(text, '#*$%&|<>0123456789', ''))::DOUBLE / length(text))
                               * (length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))::DOUBLE / length(text))
                               * (len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::DOUBLE / (len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 50)) END) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM k GROUP BY source
), r AS (
  SELECT source, source_size, w, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM s
), f AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(cap) OVER u - cap)) / (sum(w) OVER () - sum(w) OVER u + w) AS level
  FROM r WINDOW u AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), l AS (
  SELECT level FROM f WHERE level <= ratio ORDER BY ratio, source NULLS FIRST LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM l) IS NULL THEN cap ELSE least(cap, (SELECT level FROM l) * w) END AS target FROM f
), o AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND before * 2 + size <= (target - epochs * source_size) * 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""
