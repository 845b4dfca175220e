import random

import pytest
from pyspark.sql import functions as F

from synthloom.operators.dedup import minhash_dedup
from synthloom.operators.dedup_index import bands_table, near_dedup_batch, near_dedup_stream


def texts(n, seed=3):
    rng = random.Random(seed)
    stems = [[rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(60)] for _ in range(8)]
    out = []
    for k in range(n):
        words = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            words[rng.randrange(60)] = f"z{rng.randint(0, 99)}"
        out.append((k, rng.choice(["", None, "one", " ".join(words), " ".join(words)])))
    return out


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(texts(180), "_ord long, response string").withColumn("b", F.lit("x")).withColumn("batch", F.lit(7))


def kept(df):
    return sorted(r._ord for r in df.select("_ord").collect())


def parts(rows):
    return [rows.filter("_ord < 50"), rows.filter("_ord between 50 and 119"), rows.filter("_ord >= 120")]


def test_batches_keep_what_one_run_keeps(spark, rows, tmp_path):
    at = str(tmp_path / "index")
    got = [kept(near_dedup_batch(b, at, k)) for k, b in enumerate(parts(rows))]
    assert sum(got, []) == kept(minhash_dedup(rows))
    assert 0 < len(got[1]) < 70
    before = {r.o: r.n for r in spark.table(bands_table(spark, at, "bigint")).groupBy("o").agg(F.count("*").alias("n")).collect()}
    assert kept(near_dedup_batch(parts(rows)[1], at, 1)) == got[1]  # tried again after a later one was done
    assert {r.o: r.n for r in spark.table(bands_table(spark, at, "bigint")).groupBy("o").agg(F.count("*").alias("n")).collect()} == before
    spark.sql(f"DROP TABLE {bands_table(spark, at, 'bigint')}")  # a new session knows the files only
    assert kept(near_dedup_batch(parts(rows)[2], at, 2)) == got[2]
    assert near_dedup_batch(rows.limit(0), at, 3).count() == 0


def test_the_index_is_not_shuffled(spark, rows, tmp_path):
    at = str(tmp_path / "index")
    near_dedup_batch(parts(rows)[0], at, 0)
    table = spark.table(bands_table(spark, at, "bigint")).filter("batch < 1").select("o", "b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = table.join(rows.select(F.col("_ord").alias("b")).distinct(), "b", "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[: plan.index("FileScan parquet spark_catalog")]
    assert "Bucketed: true" in plan
    assert "Exchange" not in scan.split("SortMergeJoin")[-1].split("\n:- ")[-1]


def test_stream(spark, rows, tmp_path):
    for k, b in enumerate(parts(rows)):
        b.coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    near_dedup_stream(stream, str(tmp_path / "index"), out, str(tmp_path / "check")).awaitTermination()
    got = kept(spark.read.option("recursiveFileLookup", True).parquet(out))
    assert got == kept(minhash_dedup(rows))
