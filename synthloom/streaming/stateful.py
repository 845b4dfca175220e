"""Stateful operators over streams: weighted samples of windows, and first arrivals, with state that ends by timers.

State is kept in RocksDB and is bounded: a reservoir holds at most its number of rows for each window, stratum and part, and a
key that was seen is forgotten after its time. Both emit each row once, so sinks may append.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from synthloom.functions.text import uniform

#: A stratum's rows are kept in so many reservoirs, each by its own task, and merged after.
PARTS = 16
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keeps_state(spark: SparkSession) -> None:
    """Let queries of this session keep the kinds of state that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Reservoir(StatefulProcessor):
    """The rows of least sample key of a window, given out when the watermark has passed its end."""

    def __init__(self, k: int, held: T.StructType):
        self.k, self.held = k, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.held)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        before = list(self.rows.get()) if self.rows.exists() else []
        if not before:
            self.handle.registerTimer(int(key[2]))
        new = ((r["_key"], r["_ord"], r["_row"]) for r in rows)
        least = heapq.nsmallest(self.k, chain(map(tuple, before), new))
        self.rows.put(least)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        held = list(self.rows.get()) if self.rows.exists() else []
        self.rows.clear()
        for sample_key, order, row in held:
            yield Row(_end=int(key[2]), _stratum=key[0], _key=sample_key, _ord=order, _row=row)

    def close(self) -> None:
        pass


def sample_key(weight: str | None, seed: int, order: str) -> Column:
    """The key by which weighted_sample() and uniform_sample() take rows, the least first."""
    u = uniform(seed, F.col(order))
    return u if weight is None else -(F.log(u) / F.greatest(F.coalesce(F.col(weight), F.lit(1)), F.lit(1)).cast("double"))


def windowed_reservoirs(
    stream: DataFrame, k: int, time_col: str, window: str = "1 day", watermark: str = "1 hour", stratum: str | None = None, weight: str | None = None, seed: int = 42, order: str = "_ord"
) -> DataFrame:
    """(_end, _stratum, _key, _ord, _row): for each window that the watermark has passed, up to k rows of each stratum and
    part. merged() makes the sample of them. Rows later than the watermark, and rows without a time, are left out; a null
    stratum is one of its own; order must be unique."""
    keeps_state(stream.sparkSession)
    kind = stream.schema[order].dataType
    held = T.StructType([T.StructField("_key", T.DoubleType()), T.StructField("_ord", kind), T.StructField("_row", T.StringType())])
    out = T.StructType([T.StructField("_end", T.LongType()), T.StructField("_stratum", T.StringType()), *held.fields])
    named = (F.col(stratum) if stratum else F.lit(None)).cast("string")
    rows = stream.withColumn("_time", F.col(time_col).cast("timestamp")).withWatermark("_time", watermark).select(
        named.alias("_stratum"),
        F.pmod(F.xxhash64(order), F.lit(PARTS)).cast("int").alias("_part"),
        F.unix_millis(F.window("_time", window)["end"]).alias("_end"),
        sample_key(weight, seed, order).alias("_key"),
        F.col(order).alias("_ord"),
        F.to_json(F.struct(*stream.columns)).alias("_row"),
        "_time",
    )
    return rows.filter(F.col("_end").isNotNull()).groupBy("_stratum", "_part", "_end").transformWithState(Reservoir(k, held), out, "Append", "EventTime")


def merged(reservoirs: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """The k rows of least key of each window and stratum, from at most PARTS x k; with the window's end as `window_end`."""
    rank = F.row_number().over(Window.partitionBy("_end", "_stratum").orderBy("_key", "_ord"))
    least = reservoirs.withColumn("_r", rank).filter(F.col("_r") <= k)
    return least.select(F.timestamp_millis("_end").alias("window_end"), F.from_json("_row", schema).alias("r")).select("window_end", "r.*")


class Firsts(StatefulProcessor):
    """The earliest row of a key, then none until its time is over."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("until", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        until = self.seen.get()[0] if self.seen.exists() else None
        for r in sorted(rows, key=lambda r: (r["_at"], r["_row"])):
            if until is None or r["_at"] >= until:
                until = r["_at"] + self.millis
                self.handle.registerTimer(until)
                yield Row(_row=r["_row"])
        if until is not None:
            self.seen.update((until,))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if self.seen.exists() and self.seen.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_arrivals(stream: DataFrame, columns: list[str], time_col: str, millis: int, watermark: str = "1 hour") -> DataFrame:
    """The rows of a stream whose key in `columns` was not given out within `millis` before their time; of one batch's rows of
    a key the earlier ones come first. A key's state ends when the watermark has passed that time."""
    keeps_state(stream.sparkSession)
    timed = stream.withColumn("_time", F.col(time_col).cast("timestamp")).withWatermark("_time", watermark)
    rows = timed.select(F.xxhash64(*columns).alias("_h"), F.to_json(F.struct(*columns)).alias("_k"), F.unix_millis("_time").alias("_at"), F.to_json(F.struct(*stream.columns)).alias("_row"), "_time")
    out = rows.filter("_at IS NOT NULL").groupBy("_h", "_k").transformWithState(Firsts(millis), T.StructType([T.StructField("_row", T.StringType())]), "Append", "EventTime")
    return out.select(F.from_json("_row", stream.schema).alias("r")).select("r.*")
