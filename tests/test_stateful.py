from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from synthloom.streaming.stateful import first_arrivals, merged, sample_key, windowed_reservoirs

START = datetime(2024, 1, 1)


@pytest.fixture
def events(spark, tmp_path):
    rows = [(k, START + timedelta(minutes=7 * k + (-90 if k % 11 == 0 else 0)), None if k % 9 == 0 else "ab"[k % 2], k % 6) for k in range(900)]
    df = spark.createDataFrame(rows, "_ord long, at timestamp, kind string, w int")
    for n in range(3):
        df.filter(f"_ord >= {300 * n} and _ord < {300 * n + 300}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    return df, stream


def run(stream, tmp_path, name):
    out = str(tmp_path / name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return out


def test_a_streams_sample_is_that_of_the_same_rows(spark, events, tmp_path):
    df, stream = events
    found = run(windowed_reservoirs(stream, 4, "at", "1 day", "3 hours", "kind", "w"), tmp_path, "sample")
    held = spark.read.parquet(found)
    got = {(r.window_end, r.kind, r._ord) for r in merged(held, 4, df.schema).collect()}
    ends = df.withColumn("e", F.window("at", "1 day")["end"]).withColumn("k", sample_key("w", 42, "_ord"))
    closed = ends.filter(F.col("e") <= F.lit(df.agg(F.max("at")).first()[0] - timedelta(hours=3)))
    rank = F.row_number().over(Window.partitionBy("e", "kind").orderBy("k", "_ord"))
    want = {(r.e, r.kind, r._ord) for r in closed.withColumn("r", rank).filter("r <= 4").collect()}
    assert got == want and len(want) > 30
    assert held.groupBy("_end", "_stratum").count().agg(F.max("count")).first()[0] <= 4 * 16


def test_first_arrivals_forget_after_their_time(spark, events, tmp_path):
    df, stream = events
    stream = stream.withColumn("key", F.col("w"))
    got = sorted(r._ord for r in spark.read.parquet(run(first_arrivals(stream, ["key"], "at", 6 * 3600 * 1000, "3 hours"), tmp_path, "firsts")).collect())
    until, want = {}, []
    for start in range(0, 900, 300):  # a batch's rows of a key are taken by time
        for r in sorted(df.filter(f"_ord >= {start} and _ord < {start + 300}").collect(), key=lambda r: r["at"]):
            if r.w not in until or r["at"] >= until[r.w]:
                until[r.w] = r["at"] + timedelta(hours=6)
                want.append(r._ord)
    assert got == sorted(want) and 50 < len(want) < 500
