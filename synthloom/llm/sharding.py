"""Contiguous shards of near-equal byte size, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthloom.llm.common import discard, fresh, running, table, text_of, written

SHARDS = 8


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Give every row a shard from 0 and a slot in it, so that shards are contiguous and near equal in bytes.

    Rows are put in the order of (CRC-32 of the text, id): copies of a text lie side by side, and at most the copies at a
    cut are parted. A row weighs its UTF-8 bytes plus 1; it belongs to the shard in whose span of the global byte range
    its middle falls, so no shard's size is off by more than the larger of the rows at its two cuts.

    Returns id_col, size, text_crc32, shard, slot, and start (the bytes before the row). Null texts weigh 1, with the
    CRC-32 of no bytes. Null ids are kept and sort first; repeated rows are all kept; an empty table gives no row. Other
    columns are not read, whatever their names.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = text_of(docs[text_col])
    keyed = docs.select(
        docs[id_col].alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = running(keyed, [], ["text_crc32", "_id"], "size", "shards")
    total = keyed.agg(F.sum("size")).first()[0] or 1
    middle = (F.col("_before") * 2 + F.col("size")).cast("double") / 2
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(total))).cast("int")))
    starts = placed.groupBy(F.col("shard").alias("_shard")).agg(F.min("_rank").alias("_first"))  # a row a shard
    return placed.join(F.broadcast(starts), F.col("shard") == F.col("_shard")).select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"), F.col("_before").alias("start")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs below path as shard=0, shard=1, ..., every row once, whatever its id: null and repeated ids are rows of
    their own. Columns named shard or slot are replaced; an empty table writes no shard.

    docs are written first, each row with a number of its own, and joined to their places by it. Each shard is written by
    several tasks, dealt by slot, so a large shard never meets in one.
    """
    at, to = fresh(docs, "at"), fresh(docs, "to")
    rows = written(docs.drop("shard", "slot").withColumn(at, F.monotonically_increasing_id()), "shard-rows")
    where = byte_shards(rows.select(at, text_col), shards, at, text_col).select(F.col(at).alias(to), "shard", "slot")
    out = rows.join(where, F.col(at) == F.col(to)).drop(at, to)
    out.repartition("shard", F.floor(F.col("slot") / 65536)).write.partitionBy("shard").parquet(path)
    discard(rows)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 byte-balanced shards."""
    return byte_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "start"
    )
