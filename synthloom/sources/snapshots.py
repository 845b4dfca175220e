"""Datasets whose data and manifest are published together, version by version, and rewritten file by file.

A version is one line of JSON, `_manifest/versions/<n>.json`: the format, the columns, the source, and the data files with
their rows. The newest one counts. Each data file `data/rows-<slot>-...` has a manifest file beside it in `_manifest/rows`,
which holds for each row its id, hashes, and the place of the row in the file: its number, and its first byte and length.

Spark tasks write both kinds of file and send their names as commit messages; the commit makes the next version from the
last one, less the files that were rewritten. A job that dies before leaves the last version as it was, and two writers that
start from one version can't both publish. Files are reached by pyarrow, so paths must be shared folders or stores it knows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from synthloom.schema import MANIFEST_ROW
from synthloom.tables import small

#: A file is closed beyond so many bytes, which is what one changed row makes a sync write again.
FILE_BYTES = 64 << 20
#: Records that are Python objects at one time; Spark's batches hold 10,000.
HELD = 256
#: Bytes and rows of a row group of a Parquet file.
GROUP_BYTES, GROUP_ROWS = 16 << 20, 10_000
FORMATS = ("jsonl", "csv", "parquet")
DATA, ROWS, VERSIONS = "data", "_manifest/rows", "_manifest/versions"
FACTS = [f.name for f in MANIFEST_ROW.fields if f.name != "row_offset"]
PLACE = "_slot int, _name string, _pos long, _start long, _length long"
#: Names of the files of this module; no other file is ever deleted.
OWN = re.compile(r"rows-\d{10}-\d{4}-[0-9a-f]{12}")


@dataclass(frozen=True)
class Snapshot:
    """One version. files: [slot, name, rows, bytes], in the order of their rows."""

    version: int
    format: str
    columns: list[str] = field(default_factory=list)
    files: list[list] = field(default_factory=list)
    source: dict = field(default_factory=dict)
    generated_at: str = ""
    format_version: int = 2

    @property
    def rows(self) -> int:
        return sum(f[2] for f in self.files)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return pafs.LocalFileSystem(), os.path.abspath(path)


def _listed(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return [f for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.is_file]


def current(path: str) -> Snapshot | None:
    """The newest published version; None if there is none."""
    fs, at = opened(path)
    names = sorted(f.path for f in _listed(fs, f"{at}/{VERSIONS}") if f.base_name.endswith(".json") and not f.base_name.startswith("."))
    if not names:
        return None
    with fs.open_input_stream(names[-1]) as f:
        return Snapshot(**json.loads(f.read()))


def publish(path: str, snapshot: Snapshot) -> None:
    """Make a version the newest. It appears whole or not at all, and never in the place of another one."""
    fs, at = opened(path)
    fs.create_dir(f"{at}/{VERSIONS}")
    final, draft = f"{at}/{VERSIONS}/{snapshot.version:08d}.json", f"{at}/{VERSIONS}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(json.dumps(asdict(snapshot)).encode())
    try:
        if isinstance(fs, pafs.LocalFileSystem):
            os.link(draft, final)
        elif fs.get_file_info(final).type != pafs.FileType.NotFound:
            raise FileExistsError(final)
        else:
            fs.move(draft, final)
    except FileExistsError:
        raise RuntimeError(f"version {snapshot.version} of {path} was published by another writer") from None
    finally:
        if fs.get_file_info(draft).type != pafs.FileType.NotFound:
            fs.delete_file(draft)


def vacuum(path: str) -> int:
    """Delete older versions, and files that the newest one doesn't name (of replaced data, and of writes that failed)."""
    fs, at = opened(path)
    now = current(path)
    if now is None:
        return 0
    stems = {f[1].rsplit(".", 1)[0] for f in now.files}
    gone = [f.path for folder in (DATA, ROWS) for f in _listed(fs, f"{at}/{folder}") if OWN.match(f.base_name) and f.base_name.rsplit(".", 1)[0] not in stems]
    gone += [f.path for f in _listed(fs, f"{at}/{VERSIONS}") if f.base_name != f"{now.version:08d}.json"]
    for name in gone:
        fs.delete_file(name)
    return len(gone)


class SnapshotSource(DataSource):
    """df.write.format("synthloom").mode("append"): rows (_slot, _at, the manifest's columns with an underscore before, content).

    Content is `value`, a record's text, for jsonl and csv, and the columns themselves for Parquet. Rows that have a place in
    the last version (`_name` and what PLACE has beside it) stay: the task that writes them reads their content there. Options:
    path, format, version (that is gone on from, 0 for none), next (slot of this write's first new file), columns, source,
    replaced (slots).
    """

    @classmethod
    def name(cls) -> str:
        return "synthloom"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SnapshotWriter({k.lower(): v for k, v in self.options.items()})


@dataclass
class Written(WriterCommitMessage):
    files: list[list]


class SnapshotWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Write this task's rows to files of their slots; rows without one go to new files, numbered by the task."""
        from pyspark import TaskContext

        first = int(self.options["next"]) + TaskContext.get().partitionId()
        files, out = [], None
        for batch in with_content(self.options["path"], self.options["format"], iterator):
            slots = batch.column("_slot").fill_null(-1).to_numpy()
            a = 0
            while a < batch.num_rows:
                b = a + int((slots[a:] != slots[a]).argmax() or batch.num_rows - a)
                slot = int(slots[a]) if slots[a] >= 0 else first
                if out is None or out.slot != slot or out.bytes >= FILE_BYTES:
                    if out is not None:
                        files.append(out.closed())
                    out = _File(self.options, slot, sum(f[0] == slot for f in files), batch.schema)
                out.add(batch.slice(a, b - a))
                a = b
        if out is not None:
            files.append(out.closed())
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Publish the version that has these files in the place of the replaced ones."""
        o = self.options
        old = current(o["path"])
        version = int(o["version"])
        if (old.version if old else 0) != version:
            raise RuntimeError(f"{o['path']} is no longer at version {version}")
        gone = set(json.loads(o.get("replaced", "[]")))
        kept = [f for f in old.files if f[0] not in gone] if old else []
        files = sorted(kept + [f for m in messages if m for f in m.files], key=lambda f: (f[0], f[1]))
        made = Snapshot(version + 1, o["format"], json.loads(o.get("columns", "[]")), files, json.loads(o.get("source", "{}")), datetime.now(UTC).isoformat())
        publish(o["path"], made)

    def abort(self, messages: list[Written | None]) -> None:
        """Files of a failed write are in no version; the next vacuum deletes them."""


class _File:
    """A data file and its manifest rows, being written."""

    def __init__(self, options: dict[str, str], slot: int, part: int, schema: pa.Schema):
        self.fs, at = opened(options["path"])
        self.format, self.slot, self.rows, self.bytes = options["format"], slot, 0, 0
        stem = f"rows-{slot:010d}-{part:04d}-{uuid.uuid4().hex[:12]}"
        self.name = f"{stem}.{self.format}"
        for folder in (DATA, ROWS):
            self.fs.create_dir(f"{at}/{folder}")
        self.out = self.fs.open_output_stream(f"{at}/{DATA}/{self.name}")
        self.content = [n for n in schema.names if not n.startswith("_")]
        self.table = pq.ParquetWriter(self.out, pa.schema([schema.field(n) for n in self.content])) if self.format == "parquet" else None
        self.side = pq.ParquetWriter(f"{at}/{ROWS}/{stem}.parquet", self._schema(), filesystem=self.fs)
        self.waiting, self.waiting_bytes, self.waiting_rows = [], 0, 0
        if self.format == "csv":
            self.out.write((header := ",".join(_quoted(c) for c in json.loads(options["columns"])).encode() + b"\n"))
            self.bytes = len(header)

    @staticmethod
    def _schema() -> pa.Schema:
        return pa.schema([*((n, pa.string()) for n in FACTS), ("_slot", pa.int32()), ("_name", pa.string()), ("_pos", pa.int64()), ("_start", pa.int64()), ("_length", pa.int64())])

    def add(self, batch: pa.RecordBatch) -> None:
        n = batch.num_rows
        starts = lengths = [None] * n
        data = None
        if self.table is not None:
            data = batch.select(self.content)
            self.bytes += batch.nbytes
        else:
            starts, lengths = [], []
            for at in range(0, n, HELD):
                records = [v.encode() for v in batch.column("value").slice(at, HELD).to_pylist()]
                for r in records:
                    starts.append(self.bytes)
                    lengths.append(len(r))
                    self.bytes += len(r) + 1
                self.out.write(b"\n".join(records) + b"\n")
        facts = [batch.column(f"_{c}").cast(pa.string()) for c in FACTS]
        place = [pa.array([self.slot] * n, pa.int32()), pa.array([self.name] * n), pa.array(range(self.rows, self.rows + n), pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())]
        self.waiting.append((data, pa.RecordBatch.from_arrays([*facts, *place], schema=self._schema())))
        self.waiting_bytes += batch.nbytes
        self.waiting_rows += n
        self.rows += n
        if self.waiting_bytes >= GROUP_BYTES or self.waiting_rows >= GROUP_ROWS:
            self._flush()

    def _flush(self) -> None:
        """Write what waits as one row group, of the manifest's rows and of the data if it is Parquet."""
        if self.waiting:
            if self.table is not None:
                self.table.write_table(pa.Table.from_batches([data for data, _ in self.waiting]))
            self.side.write_table(pa.Table.from_batches([side for _, side in self.waiting]))
        self.waiting, self.waiting_bytes, self.waiting_rows = [], 0, 0

    def closed(self) -> list:
        self._flush()
        for x in (self.table, self.side, self.out):
            if x is not None:
                x.close()
        return [self.slot, self.name, self.rows, self.bytes]


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\n\r') else text


def write_version(rows: DataFrame, path: str, format: str, columns: list[str], old: Snapshot | None = None, replaced: list[int] | None = None, source: dict | None = None) -> Snapshot:
    """Publish rows, laid out as SnapshotSource says, as the next version; files that nothing names any more are deleted after."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {', '.join(FORMATS)}")
    rows.sparkSession.dataSource.register(SnapshotSource)
    options = {
        "path": _absolute(path),
        "format": format,
        "version": str(old.version if old else 0),
        "next": str(max((f[0] for f in old.files), default=-1) + 1 if old else 0),
        "columns": json.dumps(columns),
        "source": json.dumps(source or {}),
        "replaced": json.dumps(replaced or []),
    }
    rows.write.format("synthloom").mode("append").options(**options).save()
    vacuum(path)
    return current(path)


def _absolute(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else os.path.abspath(path)


def _paths(path: str, folder: str, names: list[str]) -> list[str]:
    return [f"{_absolute(path)}/{folder}/{n}" for n in names]


def manifest(spark: SparkSession, path: str, snapshot: Snapshot) -> DataFrame:
    """The manifest's rows with the place of each; row_offset counts rows through the files in the snapshot's order."""
    schema = T.StructType([f for f in MANIFEST_ROW.fields if f.name != "row_offset"] + spark.createDataFrame([], PLACE).schema.fields)
    if not snapshot.files:
        return spark.createDataFrame([], schema).withColumn("row_offset", F.lit(None).cast("long"))
    stems = [f[1].rsplit(".", 1)[0] + ".parquet" for f in snapshot.files]
    rows = spark.read.schema(schema).parquet(*_paths(path, ROWS, stems))
    before, starts = 0, []
    for _, name, n, _ in snapshot.files:
        starts.append((name, before))
        before += n
    base = spark.createDataFrame(starts, "_name string, _base long")
    return rows.join(small(base, 128, len(starts)), "_name").withColumn("row_offset", F.col("_base") + F.col("_pos")).drop("_base")


def _spans(names: list[str | None]) -> Iterator[tuple[int, int]]:
    """First and past the last row of each run of equal names."""
    a = 0
    for b in range(1, len(names) + 1):
        if b == len(names) or names[b] != names[a]:
            yield a, b
            a = b


class _Texts:
    """Records of a data file of JSON lines or CSV, by their first bytes and lengths."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def read(self, places: pa.RecordBatch) -> list[pa.RecordBatch]:
        values = []
        for start, length in zip(places.column("_start").to_pylist(), places.column("_length").to_pylist(), strict=True):
            self.file.seek(start)
            values.append(self.file.read(length).decode())
        return [pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string())})]


class _Rows:
    """Rows of a Parquet data file by their numbers, which ascend; row groups that none of them lies in aren't read."""

    def __init__(self, file: pa.NativeFile):
        self.file = pq.ParquetFile(file)
        self.ends = np.cumsum([self.file.metadata.row_group(k).num_rows for k in range(self.file.num_row_groups)])
        self.group, self.at, self.batch = -1, 0, None

    def read(self, places: pa.RecordBatch) -> list[pa.RecordBatch]:
        wanted, out = places.column("_pos").to_numpy(), []
        while len(wanted):
            group = int(np.searchsorted(self.ends, wanted[0], "right"))
            if group != self.group or wanted[0] < self.at:
                self.batches = self.file.iter_batches(HELD, row_groups=[group])
                self.group, self.at, self.batch = group, int(self.ends[group - 1]) if group else 0, next(self.batches)
            while wanted[0] >= self.at + self.batch.num_rows:
                self.at, self.batch = self.at + self.batch.num_rows, next(self.batches)
            n = int(np.searchsorted(wanted, self.at + self.batch.num_rows))
            out.append(self.batch.take(pa.array(wanted[:n] - self.at)))
            wanted = wanted[n:]
        return out


def with_content(path: str, format: str, batches: Iterator[pa.RecordBatch], columns: pa.Schema | None = None) -> Iterator[pa.RecordBatch]:
    """Batches whose rows with a place have the content that is found there. columns: those of the content, where rows have
    none of their own. Rows of one file should be side by side, in its order: it is then opened once and read through once."""
    fs, at = opened(path)
    name, file, reader = None, None, None
    for whole in batches:
        if "_name" not in whole.schema.names:
            yield whole
            continue
        own = [n for n in whole.schema.names if not n.startswith("_")] if columns is None else []
        schema = pa.schema([whole.schema.field(n) for n in own]) if columns is None else columns
        for k in range(0, whole.num_rows, HELD):
            batch = whole.slice(k, HELD)
            found, names = [], batch.column("_name").to_pylist()
            for a, b in _spans(names):
                if names[a] is None:
                    found.append(batch.slice(a, b - a).select(own))
                    continue
                if names[a] != name:
                    if file is not None:
                        file.close()
                    name, file = names[a], fs.open_input_file(f"{at}/{DATA}/{names[a]}")
                    reader = _Rows(file) if format == "parquet" else _Texts(file)
                found += [r.select(schema.names).cast(schema) for r in reader.read(batch.slice(a, b - a))]
            content = pa.Table.from_batches(found, schema).combine_chunks()
            rest = [n for n in batch.schema.names if n not in own]
            fields = [*(batch.schema.field(n) for n in rest), *schema]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *(c.chunk(0) for c in content.columns)], schema=pa.schema(fields))
    if file is not None:
        file.close()


def records(spark: SparkSession, path: str, snapshot: Snapshot, wanted: DataFrame) -> DataFrame:
    """wanted (rows of manifest(), other columns carried), each column with an underscore before it, and the rows' content:
    `value`, or the columns of a Parquet dataset.

    Places are dealt by file and the content is read where it lies, so it isn't shuffled, and a file that no wanted row lies
    in isn't opened."""
    wanted = wanted.toDF(*(c if c.startswith("_") else f"_{c}" for c in wanted.columns))
    base, format = _absolute(path), snapshot.format
    content = T.StructType([T.StructField(c, T.StringType()) for c in (snapshot.columns if format == "parquet" else ["value"])])
    if format == "parquet" and snapshot.files:
        content = spark.read.parquet(*_paths(path, DATA, [snapshot.files[0][1]])).schema
    columns = to_arrow_schema(content)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return with_content(base, format, batches, columns)

    near = wanted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_name").sortWithinPartitions("_name", "_pos")
    return near.mapInArrow(read, T.StructType([*wanted.schema.fields, *content.fields]))
