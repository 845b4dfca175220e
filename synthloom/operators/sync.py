"""Incremental synchronisation of a dataset with its sources, by content hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthloom.functions.identity import body_sha, prompt_version, row_id
from synthloom.tables import written


def facts(dataset_type: str) -> dict[str, Column]:
    """What a manifest holds of a symbol: id, symbol_fqn, symbol_kind, dataset_type, prompt_version, body_sha."""
    s = F.col("symbol")
    kind = F.lit(dataset_type)
    version = prompt_version(kind)
    return {
        "id": row_id(s["fully_qualified_name"], kind, version),
        "symbol_fqn": s["fully_qualified_name"],
        "symbol_kind": s["kind"],
        "dataset_type": kind,
        "prompt_version": version,
        "body_sha": body_sha(F.coalesce(s["body_text"], F.lit(""))),
    }


def current_rows(symbols: DataFrame, dataset_type: str) -> DataFrame:
    """What the manifest of a dataset of all symbols would hold."""
    return symbols.select(*(c.alias(name) for name, c in facts(dataset_type).items()))


def _once(df: DataFrame, what: str) -> DataFrame:
    """(id, sha): an id that occurs twice raises when it is read (overloads share a name, for one)."""
    held = df.groupBy("id").agg(F.max("body_sha").alias("sha"), F.count(F.lit(1)).alias("n"))
    repeated = F.raise_error(F.concat(F.lit(f"{what} id "), F.col("id"), F.lit(" occurs "), F.col("n").cast("string"), F.lit(" times")))
    return held.select("id", F.when(F.col("n") > 1, repeated.cast("string")).otherwise(F.col("sha")).alias("sha"))


def diff(manifest: DataFrame | None, current: DataFrame) -> DataFrame:
    """Each id with status new, unchanged, stale or orphan, and both hashes. No manifest: all is new. Ids must be unique on
    either side; that is counted by the id that the join shuffles by, so it costs no shuffle of its own."""
    now = _once(current, "current").withColumnRenamed("sha", "new_sha")
    if manifest is None:
        return now.select("id", F.lit("new").alias("status"), F.lit(None).cast("string").alias("old_sha"), "new_sha")
    old = _once(manifest, "manifest").withColumnRenamed("sha", "old_sha")
    status = (
        F.when(F.col("old_sha").isNull(), "new").when(F.col("new_sha").isNull(), "orphan").when(F.col("old_sha") == F.col("new_sha"), "unchanged").otherwise("stale")
    )
    return old.join(now, "id", "full_outer").select("id", status.alias("status"), "old_sha", "new_sha")


def plan(differences: DataFrame) -> DataFrame:
    """One row of counts, and of the model calls that a sync would make."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "stale", "unchanged", "orphan")]
    return differences.agg(*counts).withColumn("estimated_calls", F.col("n_new") + F.col("n_stale"))


ORPHANS = ("drop", "keep", "archive")


def apply(existing: DataFrame, manifest: DataFrame | None, current: DataFrame, make_rows: Callable[[DataFrame], DataFrame], orphans: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(rows after the sync, archived rows). existing and made rows have (id, row_offset, ...) and (id, ...).

    make_rows gets the ids that are new or stale and returns a row for each it could make; a stale row that wasn't remade
    keeps its old content and hash. Old rows keep their places, new ones follow, and offsets are dealt anew.
    """
    if orphans not in ORPHANS:
        raise ValueError(f"unknown orphan policy {orphans!r}; known: {', '.join(ORPHANS)}")
    status = written(diff(manifest, current), "diff")
    made = written(make_rows(status.filter(F.col("status").isin("new", "stale")).select("id", "status", F.col("new_sha").alias("body_sha"))), "made")
    content = [c for c in existing.columns if c not in ("id", "row_offset", "body_sha")]
    fresh = made.select("id", F.lit(True).alias("_made"), F.col("body_sha").alias("_sha"), *(F.col(c).alias(f"_new_{c}") for c in content))
    old = existing.join(status.select("id", "status", "old_sha"), "id")
    gone = old.filter(F.col("status") == "orphan") if orphans == "archive" else old.limit(0)
    stay = old if orphans == "keep" else old.filter(F.col("status") != "orphan")
    updated = stay.join(fresh, "id", "left").select(
        "id",
        F.col("row_offset").cast("long").alias("_at"),
        F.when(F.col("_made"), F.col("_sha")).otherwise(F.col("old_sha")).alias("body_sha"),
        *(F.when(F.col("_made"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in content),
    )
    new = made.join(status.filter(F.col("status") == "new").select("id"), "id", "left_semi").select("id", F.lit(None).cast("long").alias("_at"), "body_sha", *content)
    return numbered(updated.unionByName(new)), gone.select("id", "row_offset", *content)


def numbered(rows: DataFrame, at: str = "_at", tie: str = "id") -> DataFrame:
    """rows with row_offset from 0 by `at` (null last), then `tie`: ranges are sorted apart and offset by the counts before them."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(at).asc_nulls_last(), F.col(tie).asc()]
    ranged = written(rows.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_pid").count()  # a row a partition
    before = counts.select(F.col("_pid"), (F.sum("count").over(Window.orderBy("_pid")) - F.col("count")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_pid").withColumn("row_offset", F.col("_before") + F.col("_local") - 1).drop("_pid", "_local", "_before", at)


POLICIES = ("ours", "theirs", "newer", "regenerate", "prompt")


def merge(ours: DataFrame, theirs: DataFrame, policy: str = "newer") -> DataFrame:
    """Two datasets' rows (id, body_sha, generated_at, ...) by id; where both have one and they differ, the policy decides.

    Of equally new ones, ours. Under regenerate and prompt ours stay too, marked so that the caller makes these rows anew or
    asks: `merged` is that policy's name instead of "conflict".
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown merge policy {policy!r}; known: {', '.join(POLICIES)}")
    content = [c for c in ours.columns if c != "id"]
    a = ours.select("id", F.lit(True).alias("_a"), *(F.col(c).alias(f"_a_{c}") for c in content))
    b = theirs.select("id", F.lit(True).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in content))
    other = {"ours": F.lit(False), "theirs": F.lit(True), "newer": F.coalesce(F.col("_b_generated_at") > F.col("_a_generated_at"), F.lit(False)) if "generated_at" in content else F.lit(False), "regenerate": F.lit(False), "prompt": F.lit(False)}[policy]
    same = F.col("_a_body_sha") == F.col("_b_body_sha")
    use_b = F.col("_a").isNull() | (F.col("_b").isNotNull() & ~same & other)
    side = F.when(F.col("_a").isNull(), "theirs").when(F.col("_b").isNull(), "ours").when(same, "same").otherwise(policy if policy in ("regenerate", "prompt") else "conflict")
    return a.join(b, "id", "full_outer").select("id", *(F.when(use_b, F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c) for c in content), side.alias("merged"))
