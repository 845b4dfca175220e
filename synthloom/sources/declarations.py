"""C# sources as a table: `spark.read.format("synthloom-csharp").load(folder)`.

A Python data source with a row for each visible declaration. Files are dealt to partitions by their bytes; filters on kind,
namespace, path and complexity go into the reader, which leaves out whole files by their path before it opens them, looks
through no namespace that the filters exclude, and works out complexity for the kinds that are asked for only. Files are
reached by pyarrow, so folders must be shared ones or stores it knows.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from synthloom.operators.filters import DEFAULT_KINDS, GENERATED_ENDINGS
from synthloom.schema import SYMBOL
from synthloom.sources.csharp import head_of, place_of, symbols_in
from synthloom.sources.snapshots import opened

#: Bytes of a partition, and what opening one more file counts for.
PARTITION_BYTES, OPEN_BYTES = 32 << 20, 1 << 20
#: Rows go to Spark in batches of about so many bytes of bodies.
BATCH_BYTES = 8 << 20
#: least_complexity of what is not a method, which no least complexity holds back.
NO_BOUND = (1 << 31) - 1

SCHEMA = T.StructType([*SYMBOL.fields, T.StructField("least_complexity", T.IntegerType()), T.StructField("place", T.IntegerType())])
#: Columns that no row has null.
ALWAYS = {"fully_qualified_name", "body_text", "namespace", "file_path", "complexity", "kind", "least_complexity", "place"}
_ARROW = pa.schema([(f.name, pa.int32() if f.dataType == T.IntegerType() else pa.string()) for f in SCHEMA.fields])


def test_of(f: Filter) -> tuple[str, Callable[[object], bool]] | None:
    """The column a filter is on and the test it makes of a value that isn't null; None if the reader leaves it to Spark."""
    if isinstance(f, Not):
        inner = test_of(f.child)
        return None if inner is None else (inner[0], lambda x: not inner[1](x))
    if isinstance(f, IsNotNull):
        test = lambda x: True
    elif isinstance(f, In):
        some = set(f.value)
        if None in some:
            return None
        test = some.__contains__
    elif isinstance(f, (EqualTo, StringStartsWith, StringEndsWith, StringContains, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
        v = f.value
        if v is None:
            return None
        test = {
            EqualTo: lambda x: x == v,
            StringStartsWith: lambda x: x.startswith(v),
            StringEndsWith: lambda x: x.endswith(v),
            StringContains: lambda x: v in x,
            GreaterThan: lambda x: x > v,
            GreaterThanOrEqual: lambda x: x >= v,
            LessThan: lambda x: x < v,
            LessThanOrEqual: lambda x: x <= v,
        }[type(f)]
    else:
        return None
    return (f.attribute[0], test) if len(f.attribute) == 1 and f.attribute[0] in ALWAYS else None


@dataclass
class Files(InputPartition):
    """Some files of one partition: their paths below the folder, and their bytes."""

    files: list[tuple[str, int]] = field(default_factory=list)
    bytes: int = 0


class DeclarationSource(DataSource):
    """Options: path, pathGlobFilter (of file names, *.cs), partitionBytes, includeGenerated (false)."""

    @classmethod
    def name(cls) -> str:
        return "synthloom-csharp"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if schema != SCHEMA:
            raise ValueError("the columns of synthloom-csharp are fixed; select those that are wanted")
        return DeclarationReader({k.lower(): v for k, v in self.options.items()})


class DeclarationReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.glob = options.get("pathglobfilter", "*.cs")
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.generated = options.get("includegenerated", "false").lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keep the filters that test_of knows, which hold for every row that is read; the others stay with Spark."""
        for f in filters:
            if test_of(f) is None:
                yield f
            else:
                self.filters.append(f)

    def _test(self, *columns: str) -> Callable[[object], bool]:
        tests = [t for c, t in map(test_of, self.filters) if c in columns]
        return lambda x: all(t(x) for t in tests)

    def partitions(self) -> Sequence[InputPartition]:
        """Files whose path passes, in order of their paths, in runs of about partition_bytes."""
        fs, root = opened(self.path)
        wanted = self._test("file_path")
        found = []
        for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            below = f.path[len(root.rstrip("/")) + 1 :]
            hidden = any(part.startswith((".", "_")) for part in below.split("/"))
            generated = not self.generated and below.lower().endswith(GENERATED_ENDINGS)
            if f.is_file and not hidden and not generated and fnmatch.fnmatchcase(f.base_name, self.glob) and wanted(below):
                found.append((below, f.size))
        runs = [Files()]
        for below, size in sorted(found):
            if runs[-1].files and runs[-1].bytes + size + OPEN_BYTES > self.partition_bytes:
                runs.append(Files())
            runs[-1].files.append((below, size))
            runs[-1].bytes += size + OPEN_BYTES
        return runs

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.path)
        rest = [(c, t) for c, t in map(test_of, self.filters) if c not in ("file_path", "kind")]
        space, kind = self._test("namespace"), self._test("kind")
        rows, held = [], 0
        for below, _ in partition.files:
            with fs.open_input_stream(f"{root.rstrip('/')}/{below}") as f:
                code = f.read().decode("utf-8-sig", "replace")
            if not self.generated and "<auto-generated" in head_of(code).lower():
                continue
            for s in symbols_in(code, below, kind, space):
                s |= {"least_complexity": s["complexity"] if s["kind"] == "method" else NO_BOUND, "place": s.pop("_at")}
                if all(t(s[c]) for c, t in rest):
                    rows.append(s)
                    held += len(s["body_text"])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def read_declarations(
    spark: SparkSession,
    path: str,
    kinds: Sequence[str] = DEFAULT_KINDS,
    min_complexity: int = 0,
    exclude_namespaces: Sequence[str] = (),
    include_generated: bool = False,
    glob: str = "*.cs",
) -> DataFrame:
    """The declarations below a folder, flat, with _ord as read_symbols has it; its filters are written so that all of them go
    into the reader. Switches filter pushdown for Python data sources on in the session. Projects are not resolved."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DeclarationSource)
    df = spark.read.format(DeclarationSource.name()).option("pathGlobFilter", glob).option("includeGenerated", include_generated).load(path)
    kept = F.col("kind").isin([k.lower() for k in kinds])
    if min_complexity > 0:
        kept &= F.col("least_complexity") >= min_complexity
    for x in exclude_namespaces:
        kept &= (F.col("namespace") != x) & ~F.col("namespace").startswith(x + ".")
    return df.filter(kept).withColumn("_ord", place_of("file_path", "place")).drop("least_complexity", "place")
