"""Incremental runs over streams: stateless chains by micro-batch, and duplicates against what was kept before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def exact_stream_dedup(stream: DataFrame, columns: list[str], time_col: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """First arrivals of each key; with a time column, state is dropped once the watermark has passed."""
    if time_col is None:
        return stream.dropDuplicates(columns)
    return stream.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(columns)


def run_batches(stream: DataFrame, chain: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply a chain to each micro-batch and write it below batch=<id>: a batch that is tried again replaces its own output."""

    def each(batch: DataFrame, number: int) -> None:
        chain(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_against_kept(spark: SparkSession, batch: DataFrame, text_col: str, kept_path: str, number: int) -> DataFrame:
    """The batch's first row of each text that no earlier batch kept; their hashes are kept for the next ones."""
    from pyspark.errors import AnalysisException

    hashed = batch.withColumn("_sha", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    firsts = hashed.groupBy("_sha").agg(F.min("_ord").alias("_ord"))
    try:
        known = spark.read.parquet(kept_path).filter(F.col("batch") < number).select("_sha")
        firsts = firsts.join(known, "_sha", "left_anti")
    except AnalysisException:  # nothing was kept yet
        pass
    firsts.write.mode("overwrite").parquet(f"{kept_path}/batch={number}")
    kept = spark.read.parquet(f"{kept_path}/batch={number}")
    return batch.join(kept.select("_ord"), "_ord", "left_semi")
