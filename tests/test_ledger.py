import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from synthloom.operators import generate
from synthloom.operators.ledger import compacted, read, replied
from synthloom.operators.prompts import message
from synthloom.providers.base import Options


def maker(folder, die_after=None, fails=()):
    """A provider that leaves a file for each call it is asked, and ends its worker after so many."""

    class Counting:
        def complete(self, messages, options):
            text = messages[-1]["content"]
            if die_after is not None and len(os.listdir(folder)) >= die_after:
                os._exit(1)
            open(f"{folder}/{text}-{uuid.uuid4().hex}", "w").close()
            if text in fails:
                raise RuntimeError("down")
            return f"reply to {text}"

        def models(self):
            return []

    return Counting


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls"), str(tmp_path / "ledger")


def asked(spark, ids):
    rows = spark.createDataFrame([(i, None if t is None else f"t{t}") for i, t in ids], "id int, t string")
    return rows.withColumn("_messages", F.when(F.col("t").isNotNull(), F.array(message("user", F.col("t")))))


def called(folder):
    return sorted(x.split("-")[0] for x in os.listdir(folder))


def test_each_question_is_paid_for_once(spark, folders):
    calls, ledger = folders
    first = replied(asked(spark, [(1, 1), (2, 2), (3, 1), (4, None)]), maker(calls), Options(), ledger).collect()
    assert {r.id: (r._reply and r._reply.raw) for r in first} == {1: "reply to t1", 2: "reply to t2", 3: "reply to t1", 4: None}
    assert called(calls) == ["t1", "t2"]
    again = replied(asked(spark, [(1, 1), (5, 5)]), maker(calls), Options(), ledger).collect()
    assert {r.id: (r._reply.raw, r._reply.kept) for r in again} == {1: ("reply to t1", True), 5: ("reply to t5", False)}
    assert called(calls) == ["t1", "t2", "t5"]
    # other options are another question
    replied(asked(spark, [(1, 1)]), maker(calls), Options(temperature=0.5), ledger).count()
    assert called(calls) == ["t1", "t1", "t2", "t5"]
    assert replied(asked(spark, [(1, 1)]).limit(0), maker(calls), Options(), ledger).count() == 0


def test_failed_calls_are_not_kept(spark, folders):
    calls, ledger = folders
    out = replied(asked(spark, [(1, 1), (2, 2)]), maker(calls, fails=("t2",)), Options(), ledger).collect()
    assert {r.id: (r._reply.raw, r._reply.error) for r in out} == {1: ("reply to t1", None), 2: (None, "down")}
    out = replied(asked(spark, [(1, 1), (2, 2)]), maker(calls), Options(), ledger).collect()
    assert {r._reply.raw for r in out} == {"reply to t1", "reply to t2"} and called(calls) == ["t1", "t2", "t2"]


def test_a_killed_run_makes_only_the_missing_calls(spark, folders):
    calls, ledger = folders
    rows = asked(spark, [(i, i) for i in range(60)])
    with pytest.raises(Exception):
        replied(rows, maker(calls, die_after=30), Options(), ledger, workers=1, chunk=5).count()
    kept = {r.raw.removeprefix("reply to ") for r in read(spark, ledger).collect()}
    before = called(calls)
    assert 0 < len(kept) < 60 and kept <= set(before)
    out = replied(rows, maker(calls), Options(), ledger, workers=1, chunk=5).collect()
    assert {r.id: r._reply.raw for r in out} == {i: f"reply to t{i}" for i in range(60)}
    now = called(calls)
    assert all(now.count(k) == 1 for k in kept) and len(now) == len(before) + 60 - len(kept)


RETRY = """
import os, sys, uuid
from pyspark.sql import SparkSession, functions as F
from synthloom.operators.ledger import replied
from synthloom.operators.prompts import message
from synthloom.providers.base import Options

calls, ledger, mark = sys.argv[1:]

class Dying:
    def complete(self, messages, options):
        if len(os.listdir(calls)) >= 30 and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        open(f"{calls}/{messages[-1]['content']}-{uuid.uuid4().hex}", "w").close()
        return "ok"

spark = SparkSession.builder.master("local[1,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.checkpoint.dir", mark + "-scratch").getOrCreate()
rows = spark.range(60).select("id", F.array(message("user", F.concat(F.lit("t"), F.col("id").cast("string")))).alias("_messages"))
print("replies", replied(rows, Dying, Options(), ledger, workers=1, chunk=8).filter("_reply.raw = 'ok'").count())
"""


def test_a_task_that_is_tried_again_calls_for_the_rest_only(folders, tmp_path):
    calls, ledger = folders
    (tmp_path / "retry.py").write_text(RETRY)
    env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, str(tmp_path / "retry.py"), calls, ledger, str(tmp_path / "died")], env=env, capture_output=True, text=True, timeout=200)
    assert "replies 60" in done.stdout, done.stderr[-2000:]
    # the first attempt kept three chunks of eight and lost six calls of the fourth
    assert os.path.exists(tmp_path / "died") and len(called(calls)) == 66 and len(set(called(calls))) == 60


def test_compaction_keeps_every_reply(spark, folders):
    calls, ledger = folders
    replied(asked(spark, [(i, i) for i in range(40)]), maker(calls), Options(), ledger, chunk=2)
    files = [f for f in os.listdir(ledger) if f.endswith(".parquet")]
    assert len(files) == 20 or len(files) > 16
    assert compacted(spark, ledger, 2) == 40
    assert len([f for f in os.listdir(ledger) if f.endswith(".parquet")]) <= 2 and read(spark, ledger).count() == 40
    replied(asked(spark, [(i, i) for i in range(40)]), maker(calls), Options(), ledger)
    assert len(called(calls)) == 40
    assert compacted(spark, ledger + "-none") == 0


def test_generation_through_a_ledger(spark, folders, sf):
    from synthloom.queries import symbols

    _, ledger = folders
    s = symbols(spark, sf)
    make = generate.maker("offline")
    plain = {r.doc_id: r.response for r in generate.generate(s, make).collect()}
    assert {r.doc_id: r.response for r in generate.generate(s, make, ledger=ledger).collect()} == plain
    n = read(spark, ledger).count()
    assert {r.doc_id: r.response for r in generate.generate(s, make, ledger=ledger).collect()} == plain
    assert read(spark, ledger).count() == n
    rows = generate.generate(s, make)
    score = generate.maker("offline-judge")
    assert sorted(r.doc_id for r in generate.judge(rows, score, ledger=ledger).collect()) == sorted(r.doc_id for r in generate.judge(rows, score).collect())
