"""A ledger of model replies, kept by what was asked, so that retries and runs that are started again pay for no call twice.

Tasks write replies while they run, one Parquet file a chunk of calls, named by the chunk's keys: a task that is tried again
asks the same chunks, finds the files of its first attempt, and calls for the rest only. A run that is started again reads all
files that any run left. Failed calls are not kept.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthloom.providers.base import Options, Provider
from synthloom.sources.snapshots import opened
from synthloom.tables import looked_up, written

#: Calls that a task makes before it writes them down: what an attempt that dies can lose, and the rows of a file.
CHUNK = 256
SCHEMA = "key string, raw string"
_ARROW = pa.schema([("key", pa.string()), ("raw", pa.string())])


def fingerprint(messages: Column, options: Options, label: str = "") -> Column:
    """The key of a call: a hash of the provider, the options and every message."""
    settings = [F.lit(label), *(F.lit("" if v is None else str(v)) for v in asdict(options).values())]
    return F.sha2(F.to_json(F.struct(F.array(*settings).alias("settings"), messages.alias("messages"))), 256)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, raw) of a ledger, each key once; empty if there is none yet."""
    fs, at = opened(path)
    fs.create_dir(at)
    return spark.read.schema(SCHEMA).parquet(path).groupBy("key").agg(F.min("raw").alias("raw"))


def _kept(fs: pa.fs.FileSystem, path: str) -> dict[str, str]:
    if fs.get_file_info(path).is_file:
        t = pq.read_table(path, filesystem=fs)
        return dict(zip(t["key"].to_pylist(), t["raw"].to_pylist(), strict=True))
    return {}


def _keep(fs: pa.fs.FileSystem, path: str, replies: dict[str, str]) -> None:
    """The file appears whole: Spark passes over names that begin with a dot."""
    half = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    pq.write_table(pa.table({"key": list(replies), "raw": list(replies.values())}, _ARROW), half, filesystem=fs)
    fs.move(half, path)


def replied(asked: DataFrame, make: Callable[[], Provider], options: Options, path: str, workers: int = 4, chunk: int = CHUNK, messages: str = "_messages", keep: bool = True) -> DataFrame:
    """asked with `_reply`, a struct (raw, error, kept): kept if the ledger held the reply before this run. Without keep, the
    messages go, and are not shuffled with the rows.

    The calls are made at once, one for each different key: rows that ask the same get one reply. Rows of null messages get a
    null reply. A key that many rows share is joined by broadcast. Another run may write to the ledger at the same time; both
    may then pay for a call, and the lesser of its replies is read from then on.
    """
    spark = asked.sparkSession
    label = getattr(make, "label", "")
    keyed = written(asked.withColumn("_key", F.when(F.col(messages).isNotNull(), fingerprint(F.col(messages), options, label))), "asked", "zstd")
    known = written(read(spark, path), "ledger")
    want = keyed.filter("_key is not null").groupBy("_key").agg(F.min_by(messages, "_key").alias("messages"))
    want = want.join(known.select(F.col("key").alias("_key")), "_key", "left_anti")
    # tasks read a table, so that an attempt gets the rows of the one before it, in their order
    # (the grouping has dealt them by key already)
    want = written(want.sortWithinPartitions("_key"), "calls", "zstd")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = opened(path)
        model = make()

        def one(turns: list) -> tuple[str | None, str | None]:
            try:
                return model.complete([dict(t.asDict() if hasattr(t, "asDict") else t) for t in turns], options), None
            except Exception as e:
                return None, str(e)

        with ThreadPoolExecutor(max(1, workers)) as pool:
            for batch in batches:
                for i in range(0, len(batch), chunk):
                    keys, turns = list(batch["_key"][i : i + chunk]), list(batch["messages"][i : i + chunk])
                    file = f"{at}/{hashlib.sha256(''.join(keys).encode()).hexdigest()}.parquet"
                    have = _kept(fs, file)
                    todo = [k for k, key in enumerate(keys) if key not in have]
                    got = dict(zip(todo, pool.map(one, [turns[k] for k in todo]), strict=True))
                    new = {keys[k]: raw for k, (raw, _) in got.items() if raw is not None}
                    if new:
                        _keep(fs, file, {**have, **new})
                    yield pd.DataFrame([(key, *(got[k] if k in got else (have[key], None))) for k, key in enumerate(keys)], columns=["_key", "raw", "error"], dtype=object)

    fresh = want.mapInPandas(call, "_key string, raw string, error string").withColumn("kept", F.lit(False))
    held = known.select(F.col("key").alias("_key"), "raw", F.lit(None).cast("string").alias("error"), F.lit(True).alias("kept"))
    held = held.join(keyed.select("_key"), "_key", "left_semi")
    answers = written(fresh.unionByName(held).select("_key", F.struct("raw", "error", "kept").alias("_reply")), "replies")
    return looked_up(keyed if keep else keyed.drop(messages), answers, "_key", "left").drop("_key")


def compacted(spark: SparkSession, path: str, files: int = 16) -> int:
    """Rewrite a ledger's files as a few; returns the replies it holds. No other run may write to it meanwhile.

    The new files are there before an old one goes, and a reply that both hold counts once, so a run that dies loses nothing.
    """
    fs, at = opened(path)
    fs.create_dir(at)
    old = [f.path for f in fs.get_file_info(pa.fs.FileSelector(at)) if f.is_file]
    rows = written(read(spark, path), "ledger")
    n = rows.count()
    if n:
        rows.repartition(max(1, min(files, n)), "key").write.mode("append").parquet(path)
    for f in old:
        fs.delete_file(f)
    return n
