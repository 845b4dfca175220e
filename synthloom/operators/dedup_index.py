"""Near duplicates batch by batch, against an index of the rows that earlier batches kept.

The index is two folders of a path: `bands`, a Spark table of (band, order) clustered by band, so that no later batch shuffles
it, and `signatures`. Both are partitioned by batch. A batch reads the batches before it and overwrites its own part, so one
that is tried again, whole or after it died, changes nothing. Batches one after another keep what one run over all their rows
keeps, if orders rise from batch to batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from synthloom.operators.dedup import BLOCK, _banded, greedy_keep, in_groups, pairs_in, required, signature
from synthloom.tables import small, written

#: Clusters of the bands' table; a batch shuffles its own bands to as many.
CLUSTERS = 64


def bands_table(spark: SparkSession, path: str, kind: str, clusters: int = CLUSTERS) -> str:
    """The name of the bands' table, which is made, or found again by a new session, where its files lie."""
    name = f"synthloom_bands_{hashlib.md5(path.encode()).hexdigest()[:16]}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (b BIGINT, o {kind}, batch BIGINT) USING parquet PARTITIONED BY (batch) CLUSTERED BY (b) SORTED BY (b) INTO {clusters} BUCKETS LOCATION '{path}/bands'"
    )
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bands")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return name


def _known(spark: SparkSession, path: str, kind: str, number: int) -> DataFrame:
    """(o, _sig) that batches before this one kept."""
    held = spark.read.option("recursiveFileLookup", False).schema(f"o {kind}, _sig array<bigint>, batch bigint")
    return held.parquet(f"{path}/signatures").filter(F.col("batch") < number).select("o", "_sig")


def gone_by(news: DataFrame, known: DataFrame, signatures: DataFrame, t: int) -> DataFrame:
    """(o) of the new rows that have t values equal or more with a known one; news and known are (o, b), signatures (o, _sig, new).

    A bucket's new and known rows are cut in blocks, and each pair of blocks meets in one task, which passes on the rows that
    go and no pairs.
    """
    kind = news.schema["o"].dataType.simpleString()

    def compare(group: pa.Table, starts: np.ndarray) -> pa.Table:
        new = group.column("new").to_numpy()
        sig = group.column("_sig").combine_chunks().flatten().to_numpy().reshape(len(new), -1)
        lost = np.zeros(len(new), bool)
        for i, j in pairs_in(starts):
            i, j = i[new[i] != new[j]], j[new[i] != new[j]]
            near = (sig[i] == sig[j]).sum(axis=1) >= t
            lost[np.where(new[i], i, j)[near]] = True
        return pa.table({"o": group.column("o").filter(pa.array(lost))})

    counts = news.groupBy("b").agg(F.count(F.lit(1)).alias("n")).join(known.groupBy("b").agg(F.count(F.lit(1)).alias("m")), "b")
    blocks = counts.select("b", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("n", "m")))

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64("o"), F.col(mine)).cast("int")
        return rows.join(blocks, "b").select("o", "b", own.alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)).select("o", "b", "n", "m")

    met = dealt(news, "n", "m").withColumn("new", F.lit(True)).unionByName(dealt(known, "m", "n").withColumn("new", F.lit(False)))
    return in_groups(met.join(signatures, ["o", "new"]), ["b", "n", "m"], compare, f"o {kind}").distinct()


def near_dedup_batch(
    batch: DataFrame, path: str, number: int, field: str = "response", threshold: float = 0.85, num_hashes: int = 128, shingle_size: int = 3, seed: int = 42, order: str = "_ord"
) -> DataFrame:
    """The rows of a batch that no kept row of an earlier batch, and no earlier row of this one that stays, is a near duplicate
    of. order must be unique in all batches, and larger than in all before. No rows give no rows."""
    spark = batch.sparkSession
    t = required(threshold, num_hashes)
    signed = written(batch.select(F.col(order).alias("o"), signature(F.col(field), num_hashes, shingle_size, seed).alias("_sig")), "signed")
    kind = signed.schema["o"].dataType.simpleString()
    table = bands_table(spark, path, kind)
    news = written(_banded(signed, t, num_hashes), "bands")
    left = signed
    if number and spark.table(table).filter(F.col("batch") < number).limit(1).count():
        known = written(spark.table(table).filter(F.col("batch") < number).select("o", "b").join(news.select("b").distinct(), "b", "left_semi"), "known")
        old = _known(spark, path, kind, number).join(known.select("o").distinct(), "o", "left_semi")
        both = signed.withColumn("new", F.lit(True)).unionByName(old.withColumn("new", F.lit(False)))
        gone = written(gone_by(news, known, both, t), "gone")
        left = signed.join(gone, "o", "left_anti")
    kept = written(greedy_keep(left.withColumnRenamed("o", order), threshold, num_hashes, order), "kept").withColumnRenamed(order, "o")
    stay = small(kept, 24)
    signed.join(stay, "o", "left_semi").write.mode("overwrite").parquet(f"{path}/signatures/batch={number}")
    rows = news.join(stay, "o", "left_semi").select("b", "o")
    rows.repartition(CLUSTERS, "b").createOrReplaceTempView(f"{table}_rows")
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (batch = {int(number)}) SELECT b, o FROM {table}_rows")
    return batch.join(stay.withColumnRenamed("o", order), order, "left_semi")


def near_dedup_stream(stream: DataFrame, path: str, out: str, checkpoint: str, then: Callable[[DataFrame], DataFrame] = lambda df: df, **options) -> StreamingQuery:
    """near_dedup_batch() on each micro-batch, written below out/batch=<id>; a batch that is tried again replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        rows = written(batch, "batch")
        then(near_dedup_batch(rows, path, number, **options)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
