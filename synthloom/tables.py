"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its measured rows times the stated bytes a row stay below this.
BROADCAST_BYTES = 32 << 20


def scratch(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; a temporary one where that is unset on a local master."""
    kept = getattr(spark.sparkContext, "_synthloom_scratch", None)
    if kept:
        return kept
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="synthloom-")
    path = f"{base.rstrip('/')}/synthloom-{uuid.uuid4().hex}"
    spark.sparkContext._synthloom_scratch = path
    atexit.register(dropped, spark, path)
    return path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a scratch table; a stopped session is left alone."""
    if spark.sparkContext._jsc is None:
        return
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the gateway may be gone at exit
        return


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs nothing that came before."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._synthloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind written() once nothing lazy reads them any more."""
    path = getattr(df, "_synthloom_path", None)
    if path:
        dropped(df.sparkSession, path)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it is measured to be small, else unchanged (a shuffle join then)."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: A key that holds more than this share of the rows is joined by broadcast: there are at most 1 / HOT such keys.
HOT = 1e-3
#: What a row of a lookup table may take; HOT keys of that size stay below the broadcast bound.
_ROW_BYTES = 4096


def looked_up(rows: DataFrame, table: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """rows joined with a table of unique keys `on`, without a task for a key that many rows share.

    rows is read three times, so it should be a written table. Keys above HOT of the rows are few by their definition, and
    their part of the table is broadcast; the others are shuffled. Under "left", rows of null keys are kept and not shuffled.
    """
    assert _ROW_BYTES / HOT <= BROADCAST_BYTES
    keyed = rows.filter(F.col(on).isNotNull())
    n = keyed.count()
    hot = keyed.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(1000.0, HOT * n)).select(on)
    hot = F.broadcast(written(hot, "hot"))
    often = keyed.join(hot, on, "left_semi").join(F.broadcast(table.join(hot, on, "left_semi")), on, how)
    out = keyed.join(hot, on, "left_anti").join(table, on, how).unionByName(often)
    if how != "left":
        return out
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name != on]
    return out.unionByName(rows.filter(F.col(on).isNull()).select("*", *none))
