"""Samples without replacement that depend on nothing but seed and row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthloom.functions.text import uniform


#: Rows that one task may merge; more are picked by a bound on their keys.
MERGED = 100_000
#: Parts in which a pass counts the keys between two bounds.
BINS = 4096


def _least(df: DataFrame, key: Column, k: int, tie: Column) -> DataFrame:
    """The k rows of least key, of equal ones those of least tie. Few are merged from what each partition keeps; of many, all
    below a bound are taken and only those at the bound, MERGED at most, are merged."""
    keyed = df.withColumn("_sample_key", key.cast("double"))
    if k <= MERGED:
        return keyed.orderBy("_sample_key", tie).limit(k).drop("_sample_key")
    low, high, before = _bounds(keyed.select("_sample_key"), k)
    below = keyed.filter(F.col("_sample_key") < low)
    at = keyed.filter(F.col("_sample_key").between(low, high)).orderBy("_sample_key", tie).limit(k - before)
    return below.unionByName(at).drop("_sample_key")


def _bounds(keys: DataFrame, k: int) -> tuple[float, float, int]:
    """(low, high, keys below low): bounds that hold the k-th least key and MERGED keys at most, or one value.

    Each pass counts the keys of BINS parts of what is left, so a few passes find the bounds among any number of keys."""
    n, low, high = keys.agg(F.count("_sample_key"), F.min("_sample_key"), F.max("_sample_key")).first()
    before = 0
    while n > MERGED and low < high:
        inside = keys.filter(F.col("_sample_key").between(low, high))
        part = F.least(F.lit(BINS - 1), F.floor((F.col("_sample_key") - low) / (high - low) * BINS))
        counts = inside.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("_sample_key").alias("low"), F.max("_sample_key").alias("high"))
        for r in sorted(counts.collect(), key=lambda r: r.p):  # BINS rows at most
            n, low, high = r.n, r.low, r.high
            if before + n >= k:
                break
            before += n
        else:  # fewer than k keys: all are taken
            return float("inf"), float("inf"), before
    return low, high, before


def uniform_sample(df: DataFrame, max_rows: int, seed: int = 42, order: str = "_ord") -> DataFrame:
    """max_rows rows, each as likely, in their order; all rows if max_rows is 0 or less or there are no more."""
    return df if max_rows <= 0 else _least(df, uniform(seed, F.col(order)), max_rows, F.col(order)).orderBy(order)


def weighted_sample(df: DataFrame, max_rows: int, weight: str = "complexity", seed: int = 42, order: str = "_ord") -> DataFrame:
    """max_rows rows drawn one by one with chances by weight (1 at least), in their order: those of largest u^(1/w)."""
    if max_rows <= 0:
        return df
    w = F.greatest(F.coalesce(F.col(weight), F.lit(1)), F.lit(1)).cast("double")
    return _least(df, -(F.log(uniform(seed, F.col(order))) / w), max_rows, F.col(order)).orderBy(order)


def stratified_sample(df: DataFrame, per_stratum: int, stratum: str, seed: int = 42, order: str = "_ord") -> DataFrame:
    """Up to per_stratum rows of each stratum. A stratum's rows are first cut in random parts, each to per_stratum rows, so a large one isn't ranked in one task."""
    u = uniform(seed, F.col(order))
    parts = 64
    cut = Window.partitionBy(stratum, "_part").orderBy("_u", order)
    rank = Window.partitionBy(stratum).orderBy("_u", order)
    near = df.withColumn("_u", u).withColumn("_part", F.floor(F.col("_u") * parts * 1024) % parts)
    near = near.withColumn("_r", F.row_number().over(cut)).filter(F.col("_r") <= per_stratum)
    return near.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= per_stratum).drop("_u", "_part", "_r").orderBy(order)


STRATEGIES = {"uniform": uniform_sample, "complexity_weighted": weighted_sample}


def sample(df: DataFrame, max_rows: int, strategy: str = "complexity_weighted", seed: int = 42, order: str = "_ord") -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown sampling strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](df, max_rows, seed=seed, order=order)
