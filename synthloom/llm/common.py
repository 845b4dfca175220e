"""What the corpus operators share: scratch tables, word rules, range-ordered prefix sums, checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from synthloom.tables import BROADCAST_BYTES, discard, small, written

__all__ = ["discard", "small", "written"]

#: A word is a maximal run of anything but these six characters.
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def measured(df: DataFrame, *arrays: str, row_bytes: int = 48, item_bytes: int = 8) -> DataFrame:
    """small() with the rows and the items of the array columns counted."""
    items = [F.coalesce(F.sum(F.size(c)), F.lit(0)) for c in arrays]
    rows, *sizes = df.agg(F.count(F.lit(1)), *items).first()
    return F.broadcast(df) if rows * row_bytes + sum(sizes) * item_bytes <= BROADCAST_BYTES else df


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name in taken:
        name = f"_{name}"
    return name


def runs(batch: pa.RecordBatch, column: str, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose values in a text or binary column come to about `size` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes, dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list]]:
    """runs() with the values of the column, null as empty."""
    kind = batch.schema.field(column).type
    empty = b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else ""
    for run in runs(batch, column, size):
        yield run, [x or empty for x in run.column(column).to_pylist()]


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def trimmed(column: Column) -> Column:
    return F.btrim(column, F.lit(SPACES))


def words_of(column: Column) -> Column:
    """The words of a text, natively. Null and blank texts have none."""
    text = trimmed(text_of(column))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, GAP))


def n_words_of(column: Column) -> Column:
    text = trimmed(text_of(column))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, GAP))).cast("long")


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text, null as empty."""
    return F.unhex(F.md5(text_of(text).cast("binary")))


def running(keyed: DataFrame, within: Sequence[str], order: Sequence[str], size: str, name: str, also: Sequence[str] = ()) -> DataFrame:
    """keyed with _before (total of `size` over earlier rows of the same `within` values), _rank (their count), and
    _before_<c> for each column in `also`.

    The rows are written first, so what they are computed from runs once. They are range-partitioned by (within, order),
    so neither a group that holds most rows nor a run of ties meets in one task; each partition's totals (one row per
    partition and group) give the offset of the next ones. Rows that agree in every ordering column are told apart by their
    place in the written table: they differ in nothing that is returned.
    """
    spark = keyed.sparkSession
    ordered = [*within, *order, "_tie"]
    rows = written(keyed, f"{name}-rows")
    ranged = written(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts(spark), *ordered).withColumn("_pid", F.spark_partition_id()), name)
    discard(rows)
    summed = {"_before": size, **{f"_before_{c}": c for c in also}}
    totals = ranged.groupBy("_pid", *within).agg(F.count(F.lit(1)).alias("_rows"), *(F.sum(c).alias(f"_total{b}") for b, c in summed.items()))
    earlier = Window.partitionBy(*within).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_pid").alias("_opid"),
        *(F.col(c).alias(f"_o_{c}") for c in within),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows0"),
        *(F.coalesce(F.sum(f"_total{b}").over(earlier), F.lit(0)).alias(f"_offset{b}") for b in summed),
    )
    local = Window.partitionBy("_pid", *within).orderBy(*order, "_tie")
    above = local.rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_pid") == F.col("_opid")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    counted = ranged.withColumns({"_rows1": F.row_number().over(local) - 1, **{f"_local{b}": F.coalesce(F.sum(c).over(above), F.lit(0)) for b, c in summed.items()}})
    joined = counted.join(offsets, same).withColumn("_rank", F.col("_rows0") + F.col("_rows1"))
    joined = joined.withColumns({b: F.col(f"_offset{b}") + F.col(f"_local{b}") for b in summed})
    return joined.drop("_tie", "_pid", "_opid", "_rows0", "_rows1", *(f"_o_{c}" for c in within), *(f"_{x}{b}" for x in ("offset", "local") for b in summed))
