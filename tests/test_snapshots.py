import csv
import json
import random
from dataclasses import replace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from synthloom.operators import sync
from synthloom.plans import datasets
from synthloom.providers.base import Offline
from synthloom.sources import files, snapshots

ODD = ' a "quoted",\n line \\ with é '


def symbols_of(spark, bodies):
    rows = [((f"N.{n}", b, "method"), k) for k, (n, b) in enumerate(bodies.items())]
    kind = "symbol struct<fully_qualified_name:string,body_text:string,kind:string>, _ord long"
    return spark.createDataFrame(rows, kind).withColumn("body", F.col("symbol.body_text")).withColumn("symbol", F.col("symbol").withField("signature_text", F.lit("s")))


def write(spark, out, bodies, format):
    s = symbols_of(spark, bodies)
    rows = s.select(F.lit(None).cast("int").alias("_slot"), F.col("_ord").alias("_at"), *(c.alias(f"_{n}") for n, c in sync.facts("t").items()), "body", F.lit("old").alias("made"))
    dealt = datasets.content(rows, format).repartitionByRange(4, "_at").sortWithinPartitions("_at")
    return snapshots.write_version(dealt, out, format, ["body", "made"])


def bring_up(spark, out, bodies, **how):
    s = symbols_of(spark, bodies)
    facts = sync.facts("t")
    make = lambda ids: s.select(facts["id"].alias("_id"), "body", F.lit("new").alias("made")).join(ids.select(F.col("id").alias("_id")), "_id", "left_semi")
    return datasets.synchronise(spark, out, sync.current_rows(s, "t"), make, **how)


def held(spark, out):
    now = snapshots.current(out)
    rows = snapshots.records(spark, out, now, snapshots.manifest(spark, out, now)).orderBy("_row_offset").collect()
    assert [r._row_offset for r in rows] == list(range(now.rows))
    if now.format == "parquet":
        return {r._symbol_fqn[2:]: (r.body, r.made) for r in rows}
    if now.format == "csv":
        return {r._symbol_fqn[2:]: tuple(next(csv.reader([r.value], strict=True)) if "\n" not in r.value else next(csv.reader(iter(r.value.splitlines(True))))) for r in rows}
    return {r._symbol_fqn[2:]: (json.loads(r.value)["body"], json.loads(r.value)["made"]) for r in rows}


@pytest.mark.parametrize("format", snapshots.FORMATS)
def test_one_stale_row_rewrites_one_file(spark, tmp_path, format):
    out = str(tmp_path / "out")
    bodies = {f"m{k:03d}": f"return {k};{ODD}" for k in range(200)}
    first = write(spark, out, bodies, format)
    assert len(first.files) == 4 and first.rows == 200 and held(spark, out) == {n: (b, "old") for n, b in bodies.items()}
    changed = {n: b for n, b in bodies.items() if n != "m007"} | {"m120": "changed", "z": "added"}
    planned = bring_up(spark, out, changed, orphans="keep")
    assert (planned.n_new, planned.n_stale, planned.n_unchanged, planned.n_orphan) == (1, 1, 198, 1)
    second = snapshots.current(out)
    names = {f[1] for f in second.files}
    assert len({f[1] for f in first.files} - names) == 1  # of the four files, that of m120
    assert held(spark, out) == {n: (b, "old") for n, b in bodies.items()} | {"m120": ("changed", "new"), "z": ("added", "new")}
    assert {p.name for p in (tmp_path / "out" / "data").iterdir() if not p.name.startswith(".")} == names
    assert bring_up(spark, out, changed, orphans="archive").n_orphan == 1
    assert set(held(spark, out)) == set(changed)
    (gone,) = (spark.read.parquet if format == "parquet" else lambda p: spark.read.text(p, wholetext=True))(f"{out}/_archive/*").collect()
    assert "return 7;" in gone[0]
    before = snapshots.current(out)
    assert bring_up(spark, out, changed).estimated_calls == 0 and snapshots.current(out) == before  # nothing to do, nothing written


@pytest.mark.parametrize("format", snapshots.FORMATS)
def test_generated_datasets_of_any_format_are_synchronised(spark, tmp_path, format):
    out = str(tmp_path / "out")
    full = lambda bodies: symbols_of(spark, bodies).drop("body").withColumns({c: F.lit("x") for c in ("kind", "name", "namespace", "file_path")}).withColumn("complexity", F.lit(1)).withColumn(
        "symbol", F.struct("symbol.*", *(F.lit("x").alias(c) for c in ("xml_doc_comment", "containing_type", "namespace", "file_path")), F.lit(1).alias("complexity"))
    )
    datasets.generate_dataset(spark, full({"a": "1", "b": ODD, "c": "3"}), out, Offline, format=format)
    planned = datasets.sync_dataset(spark, full({"a": "1", "b": ODD, "c": "33", "d": "4"}), out, Offline)
    assert (planned.n_new, planned.n_stale, planned.n_unchanged) == (1, 1, 2)
    assert sorted(r.symbol_fqn for r in files.read_manifest(spark, out).collect()) == ["N.a", "N.b", "N.c", "N.d"]
    with pytest.raises(FileExistsError):
        datasets.generate_dataset(spark, full({"a": "1"}), out, Offline)


def test_a_sync_that_dies_leaves_the_last_version(spark, tmp_path):
    out = str(tmp_path / "out")
    bodies = {f"m{k}": str(k) for k in range(40)}
    first = write(spark, out, bodies, "jsonl")
    s = symbols_of(spark, bodies | {"m3": "x", "m30": "y"})
    rows = s.filter("body in ('x', 'y')").select(F.lit(0).alias("_slot"), F.col("_ord").alias("_at"), *(c.alias(f"_{n}") for n, c in sync.facts("t").items()), F.lit("{}").alias("value"))
    broken = rows.repartition(4, "_at").withColumn("value", F.when(F.col("_at") == 30, F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="killed"):  # after other tasks have written their files
        snapshots.write_version(broken, out, "jsonl", ["body", "made"], first, [0])
    assert snapshots.current(out) == first and set(held(spark, out)) == set(bodies)
    snapshots.publish(out, replace(first, version=2))  # another writer was faster
    with pytest.raises(Exception, match="no longer at version 1"):
        snapshots.write_version(rows, out, "jsonl", ["body", "made"], first, [0])
    with pytest.raises(RuntimeError, match="another writer"):
        snapshots.publish(out, replace(first, version=2))
    assert set(held(spark, out)) == set(bodies)
    assert snapshots.vacuum(out) >= 2  # what the dead writers left
    assert set(held(spark, out)) == set(bodies)


def test_names_that_repeat_raise_before_a_call(spark, tmp_path):
    class Never(Offline):
        def complete(self, messages, options):
            raise AssertionError("asked")

    twice = symbols_of(spark, {"a": "1"}).unionByName(symbols_of(spark, {"a": "2"}))
    with pytest.raises(Exception, match="occurs 2 times"):
        datasets.generate_dataset(spark, twice, str(tmp_path / "out"), Never)
    assert snapshots.current(str(tmp_path / "out")) is None


def test_older_datasets_are_adopted_or_refused(spark, tmp_path):
    out = str(tmp_path / "out")
    bodies = {"a": "1", "b": "2", "c": "3"}
    rows = sync.current_rows(symbols_of(spark, bodies), "t").withColumn("row_offset", F.col("symbol_fqn").substr(3, 1).cast("binary").cast("string"))
    rows = rows.withColumn("row_offset", (F.ascii("row_offset") - 97).cast("long"))
    files.write_manifest(rows, out)
    (tmp_path / "out" / "data").mkdir()
    lines = tmp_path / "out" / "data" / "part-0.csv"
    lines.write_text("body,made\n1,old\n2,old\n3,old\n")
    with pytest.raises(ValueError, match="generate it again"):
        bring_up(spark, out, bodies | {"b": "22"})
    assert lines.read_text().count("old") == 3 and snapshots.current(out) is None
    lines.write_text("".join(json.dumps({"body": b, "made": "old"}) + "\n" for b in bodies.values()))
    bring_up(spark, out, bodies | {"b": "22"})
    assert held(spark, out) == {"a": ("1", "old"), "b": ("22", "new"), "c": ("3", "old")}
    assert [p.read_text().count("old") for p in (tmp_path / "out" / "_archive").rglob("part-0.csv")] == [3]


def test_records_are_written_in_slices(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(snapshots, "HELD", 2, raising=False)
    texts = ["a", "é" * 3, "", "dd", "e"]
    facts = {f"_{c}": [c] * 5 for c in snapshots.FACTS}
    batch = pa.RecordBatch.from_pydict({**facts, "value": texts})
    file = snapshots._File({"path": str(tmp_path), "format": "jsonl"}, 0, 0, batch.schema)
    real, sizes = file.out, []

    class Out:
        def write(self, data):
            sizes.append(data.count(b"\n"))
            return real.write(data)

        def close(self):
            real.close()

    file.out = Out()
    file.add(batch)
    _, name, rows, size = file.closed()
    assert (tmp_path / snapshots.DATA / name).read_text() == "".join(x + "\n" for x in texts)
    assert sizes == [2, 2, 1] and rows == 5 and size == 15


def shuffled(spark):
    """Bytes that the session's tasks have written to shuffles so far."""
    hosts = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(hosts.apply(k).totalShuffleWrite() for k in range(hosts.size()))


@pytest.mark.parametrize("format", snapshots.FORMATS)
def test_texts_that_stay_are_not_shuffled(spark, tmp_path, format):
    out = str(tmp_path / "out")
    bodies = {f"m{k:03d}": random.Random(k).randbytes(5000).hex() for k in range(120)}
    write(spark, out, bodies, format)
    before = shuffled(spark)
    # each of the four files is rewritten
    changed = bodies | {f"m{k:03d}": "changed" for k in (3, 40, 70, 110)}
    bring_up(spark, out, changed)
    assert held(spark, out) == {n: (b, "new" if b == "changed" else "old") for n, b in changed.items()}
    # held() sorts all rows by their numbers, which writes each text once
    assert shuffled(spark) - before < 1.5 * sum(map(len, bodies.values()))


def test_rows_of_parquet_files_are_read_by_their_numbers(tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "HELD", 3)
    (tmp_path / snapshots.DATA).mkdir()
    for name, a in (("one", 0), ("two", 100)):
        table = pa.table({"body": [None if k == 4 else str(a + k) for k in range(20)], "n": pa.array(range(20), pa.int64())})
        pq.write_table(table, tmp_path / snapshots.DATA / name, row_group_size=7)
    schema = pa.schema([("_name", pa.string()), ("_pos", pa.int64()), ("body", pa.string()), ("n", pa.int64())])
    places = [("one", 0), ("one", 4), ("one", 5), ("one", 19), (None, None), ("two", 6), ("two", 7), ("two", 8), (None, None), ("one", 2)]
    batch = pa.RecordBatch.from_pylist([{"_name": n, "_pos": p, "body": None if n else "own", "n": None if n else -1} for n, p in places], schema)
    got = [r for b in snapshots.with_content(str(tmp_path), "parquet", iter([batch, batch.slice(0, 0), batch.slice(9, 1)])) for r in b.to_pylist()]
    text = {"one": lambda p: None if p == 4 else str(p), "two": lambda p: str(100 + p), None: lambda p: "own"}
    assert [(r["_name"], r["_pos"], r["body"], r["n"]) for r in got] == [(n, p, text[n](p), -1 if n is None else p) for n, p in [*places, places[9]]]
