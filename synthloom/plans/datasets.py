"""Datasets on disk with a manifest: made, synchronised with their sources, seeded, converted and reported."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from synthloom.functions.text import trim_ws
from synthloom.operators import export, generate, sync
from synthloom.operators.export import output_fields
from synthloom.sources import files, snapshots
from synthloom.tables import small, written

ARCHIVE = "_archive"


def _keyed(symbols: DataFrame, dataset_type: str) -> DataFrame:
    """symbols with the manifest's columns, each named with an underscore so that it isn't written with the data."""
    facts = sync.facts(dataset_type)
    return symbols.withColumns({f"_{name}": column for name, column in facts.items()})


def content(rows: DataFrame, format: str, columns: Sequence[str] | None = None) -> DataFrame:
    """rows with their content as it is written: columns beginning with an underscore, and `value` or the output columns.

    With the columns of a dataset that exists, exactly those, null where rows have none."""
    out = output_fields(rows)
    names = list(columns) if columns is not None else out.columns
    have = {c.lower(): c for c in out.columns}
    facts = [c for c in rows.columns if c.startswith("_")]
    kept = rows.select(*facts, *((F.col(have[n.lower()]) if n.lower() in have else F.lit(None).cast("string")).alias(n) for n in names))
    if format == "parquet":
        return kept
    if format == "csv":
        cells = F.struct(*(export.as_text(f) for f in kept.schema.fields if f.name not in facts))
        return kept.select(*facts, F.to_csv(cells, files.CSV).alias("value"))
    # rows that exist hold the fields they have; a JSON line names its own
    return rows.select(*facts, F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("value"))


def generate_dataset(
    spark: SparkSession, symbols: DataFrame, out: str, make: generate.Maker | None, dataset_type: str = "explanation", format: str = "jsonl", source: Mapping | None = None, **options
) -> DataFrame:
    """Make a row of each symbol and publish them with a manifest of the rows that were made; returns the manifest.

    Without a maker, a dry run, the symbols themselves are written. Model replies are kept in a table before anything else
    is done, so no call is made twice; names that occur twice, which no sync could tell apart, raise before the first call.
    """
    format = format.lower()
    if format not in snapshots.FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {', '.join(snapshots.FORMATS)}")
    if snapshots.current(out) is not None or files.manifest_head(spark, out) is not None:
        raise FileExistsError(f"{out} has a manifest")
    keyed = _keyed(symbols, dataset_type)
    if make is not None:
        sync.diff(None, sync.current_rows(symbols, dataset_type)).agg(F.count("new_sha")).first()
    made = keyed if make is None else generate.generate(keyed, make, dataset_type, **options)
    rows = written(made.withColumns({"_slot": F.lit(None).cast("int"), "_at": F.col("_ord")}).select(*PLACED, *output_fields(made).columns), "made")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = content(rows, format).repartitionByRange(n, "_at", "_id").sortWithinPartitions("_at", "_id")
    done = snapshots.write_version(ordered, out, format, output_fields(rows).columns, source=dict(source or {}))
    return files.manifest_columns(snapshots.manifest(spark, out, done))


PLACED = ("_slot", "_at", *(f"_{c}" for c in snapshots.FACTS))
SPOT = ("_name", "_pos", "_start", "_length")


def synchronise(
    spark: SparkSession,
    out: str,
    now: DataFrame,
    make_rows: Callable[[DataFrame], DataFrame],
    orphans: str = "drop",
    dry_run: bool = False,
    source: Mapping | None = None,
) -> Row:
    """Bring a dataset up to `now`, the manifest columns of what it should hold; returns the plan's counts.

    make_rows gets the ids that are new or stale, with their hashes, and returns (_id, output columns) for those it could
    make. Files without a stale row that was remade, or an orphan that goes, are left as they are, whatever their format.
    Nothing is written before the rows are made, and nothing is deleted before the new version is published.
    """
    if orphans not in sync.ORPHANS:
        raise ValueError(f"unknown orphan policy {orphans!r}; known: {', '.join(sync.ORPHANS)}")
    old = snapshots.current(out) or _adopted(spark, out, dry_run)
    if old is None:
        raise ValueError(f"{out} was written before versions were kept, and can't be read row by row; generate it again")
    now = written(now.select(*snapshots.FACTS), "current")
    manifest = snapshots.manifest(spark, out, old)
    status = written(sync.diff(manifest.select("id", "body_sha"), now), "diff")
    planned = sync.plan(status).first()
    if dry_run:
        return planned
    asked = status.filter(F.col("status").isin("new", "stale"))
    facts = now.join(asked.select("id"), "id").join(manifest.select("id", "_slot", F.col("row_offset").alias("_at")), "id", "left")
    facts = facts.select("_slot", "_at", *(F.col(c).alias(f"_{c}") for c in snapshots.FACTS))
    made = make_rows(asked.select("id", "status", F.col("new_sha").alias("body_sha"))).join(facts, "_id")
    columns = old.columns or output_fields(made).columns
    fresh = written(content(made, old.format, columns), "fresh", "zstd")
    placed = written(manifest.join(status.select("id", "status"), "id").join(fresh.select(F.col("_id").alias("id"), F.lit(True).alias("remade")), "id", "left"), "placed")
    goes = (F.col("status") == "orphan") & F.lit(orphans != "keep")
    changed = goes | ((F.col("status") == "stale") & F.col("remade"))
    touched = [r._slot for r in placed.filter(changed).select("_slot").distinct().collect()]  # at most the snapshot's files
    if not touched and fresh.isEmpty():
        return planned
    again = placed.join(small(spark.createDataFrame([(s,) for s in touched], "_slot int"), 16, len(touched)), "_slot", "left_semi")
    body = [c for c in fresh.columns if not c.startswith("_")]
    rows = fresh.select(*PLACED, *body)
    if old.files:
        # rows that stay are dealt by their places; the task that writes a file reads them where they lie
        stay = again.filter(~goes & F.col("remade").isNull()).withColumns({f"_{c}": F.col(c) for c in snapshots.FACTS} | {"_at": F.col("row_offset")})
        rows = stay.select(*PLACED, *SPOT).unionByName(rows, allowMissingColumns=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a file is rewritten by one task; new rows are dealt to all of them
    task = F.coalesce(F.col("_slot"), -1 - F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int"))
    dealt = rows.repartition(n, task).sortWithinPartitions("_slot", "_at", "_id")
    if orphans == "archive" and planned.n_orphan:
        _archive(snapshots.records(spark, out, old, placed.filter("status = 'orphan'")).select(*body), out, old.format)
    snapshots.write_version(dealt, out, old.format, columns, old, touched, dict(source or {}))
    return planned


def _archive(rows: DataFrame, out: str, format: str) -> None:
    at = f"{out}/{ARCHIVE}/{datetime.now(UTC):%Y%m%d-%H%M%S-%f}"
    if format == "parquet":
        rows.write.parquet(at)
    else:
        rows.select("value").write.text(at)


def _adopted(spark: SparkSession, out: str, dry_run: bool) -> snapshots.Snapshot | None:
    """Version 1 of a dataset without one: empty, or with the rows of JSON lines that an older manifest lists.

    Each of its rows must be found in the lines, else nothing is done; the older files move to the archive.
    """
    manifest = files.read_manifest(spark, out)
    if manifest is None or manifest.isEmpty():
        first = snapshots.Snapshot(0, "jsonl")
        return first if dry_run else _published(spark, out, first)
    found = written(files.existing_rows(spark, f"{out}/{snapshots.DATA}", manifest), "existing")
    if found.count() != manifest.count():
        return None
    rows = found.join(manifest.drop("row_offset"), "id").select(F.lit(None).cast("int").alias("_slot"), F.col("row_offset").alias("_at"), *(F.col(c).alias(f"_{c}") for c in snapshots.FACTS), "value")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = snapshots.write_version(rows.repartitionByRange(n, "_at").sortWithinPartitions("_at"), out, "jsonl", [])
    _moved_to_archive(out)
    return done


def _published(spark: SparkSession, out: str, first: snapshots.Snapshot) -> snapshots.Snapshot:
    """An empty first version; files of rows that no manifest ties to symbols move to the archive."""
    done = replace(first, version=1, generated_at=datetime.now(UTC).isoformat())
    snapshots.publish(out, done)
    _moved_to_archive(out)
    return done


def _moved_to_archive(out: str) -> None:
    fs, at = snapshots.opened(out)
    now = {f[1] for f in snapshots.current(out).files}
    loose = [f for f in snapshots._listed(fs, f"{at}/{snapshots.DATA}") if f.base_name not in now and not f.base_name.startswith((".", "_"))]
    if loose:
        folder = f"{at}/{ARCHIVE}/before-{datetime.now(UTC):%Y%m%d-%H%M%S-%f}"
        fs.create_dir(folder)
        for f in loose:
            fs.move(f.path, f"{folder}/{f.base_name}")


def sync_dataset(
    spark: SparkSession,
    symbols: DataFrame,
    out: str,
    make: generate.Maker,
    dataset_type: str = "explanation",
    orphans: str = "drop",
    dry_run: bool = False,
    source: Mapping | None = None,
    **options,
) -> Row:
    """Bring a dataset of any format up to its sources; returns the plan's counts.

    New and changed symbols are made again, unchanged rows stay as they are, a stale row that can't be remade keeps its old
    content and hash, and rows whose symbol is gone are dropped, kept, or put in the archive.
    """

    def make_rows(ids: DataFrame) -> DataFrame:
        wanted = _keyed(symbols, dataset_type).join(ids.select(F.col("id").alias("_id")), "_id", "left_semi")
        made = generate.generate(wanted, make, dataset_type, **options)
        return made.select("_id", *output_fields(made).columns)

    return synchronise(spark, out, sync.current_rows(symbols, dataset_type), make_rows, orphans, dry_run, source)


def migrate_dataset(spark: SparkSession, out: str, source: Mapping | None = None) -> int:
    """Seed an empty manifest for a dataset without one; returns the non-blank lines of its *.jsonl files. They can't be tied
    to symbols: the next sync makes all rows anew and archives those in the data folder."""
    if snapshots.current(out) is not None or files.manifest_head(spark, out) is not None:
        raise FileExistsError(f"{out} has a manifest")
    fs, at = snapshots.opened(out)
    found = [f.path for folder in (at, f"{at}/{snapshots.DATA}") for f in snapshots._listed(fs, folder) if f.base_name.endswith(".jsonl")]
    scheme = out.split("://")[0] + "://" if "://" in out else ""
    n = spark.read.text([f"{scheme}{p}" for p in found]).filter(trim_ws(F.col("value")) != "").count() if found else 0
    snapshots.publish(out, snapshots.Snapshot(1, "jsonl", source=dict(source or {}), generated_at=datetime.now(UTC).isoformat()))
    return n


def merge_regenerated(ours: DataFrame, theirs: DataFrame, symbols: DataFrame, make: generate.Maker, dataset_type: str = "explanation", **options) -> DataFrame:
    """sync.merge() under "regenerate", carried out: rows that both sides have and that differ are made anew.

    A row that was made holds its symbol's present hash, `generated_at` of now where there is such a column, and merged
    "regenerated"; one whose symbol is gone, or whose call fails, keeps our content and says "conflict". Only the rows that
    differ are asked for. Ids must be unique on either side; names of symbols that occur twice raise before the first call.
    """
    rows = written(sync.merge(ours, theirs, "regenerate"), "merged")
    wanted = _keyed(symbols, dataset_type).join(rows.filter("merged = 'regenerate'").select(F.col("id").alias("_id")), "_id", "left_semi")
    sync.diff(None, sync.current_rows(wanted, dataset_type)).agg(F.count("new_sha")).first()
    made = generate.generate(wanted, make, dataset_type, **options)
    fresh = {"body_sha": F.col("_body_sha"), **{c: F.col(c) for c in output_fields(made).columns}, "generated_at": F.lit(datetime.now(UTC).isoformat())}
    new = [c for c in rows.columns if c in fresh]
    made = written(made.select(F.col("_id").alias("id"), F.lit(True).alias("_made"), *(fresh[c].alias(f"_new_{c}") for c in new)), "remade")
    done = F.when(F.col("_made"), "regenerated").when(F.col("merged") == "regenerate", "conflict").otherwise(F.col("merged"))
    kept = {c: F.when(F.col("_made"), F.col(f"_new_{c}").cast(rows.schema[c].dataType)).otherwise(F.col(c)) if c in new else F.col(c) for c in rows.columns}
    return rows.join(made, "id", "left").select(*(c.alias(name) for name, c in {**kept, "merged": done}.items()))


FIELDS = (
    *("instruction", "question", "input", "context", "code", "original_code", "output", "response", "answer", "completion"),
    *("fixed_code", "refactored_code", "explanation", "chosen", "rejected"),
)
FORMATS: dict[str, Callable[[DataFrame], DataFrame] | None] = {
    "jsonl": None,
    "alpaca": lambda df: export.to_alpaca(df, "source_file"),
    "sharegpt": lambda df: export.to_sharegpt(df, "source_file"),
    "preference": lambda df: export.to_preference(df, "source_file"),
    "preference-sharegpt": lambda df: export.to_preference_sharegpt(df, "source_file"),
}


def export_dataset(spark: SparkSession, path: str, out: str, format: str = "jsonl") -> None:
    """Convert the JSON lines right below a folder (or one file), each file to its own folder source_file=<name> of out."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {', '.join(FORMATS)}")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("source_file"))
    lines = lines.withColumn("source_file", F.regexp_replace("source_file", r"\.jsonl?$", ""))
    rows = files.json_rows(lines, None, "source_file")
    convert = FORMATS[format]
    if convert is None:
        rows.select("source_file", F.to_json("row").alias("value")).write.partitionBy("source_file").text(out)
    else:
        convert(files.variant_columns(rows, *FIELDS, keep=("source_file",))).write.option("ignoreNullFields", False).partitionBy("source_file").json(out)


def inspect_report(symbols: DataFrame, path: str, out: str) -> dict:
    """Write the counts of a solution's symbols as a line of JSON, and all symbols by name as JSON lines; returns the counts."""
    kept = written(symbols, "inspected")
    counts = export.inspection(kept).first().asDict()
    report = {"solution": path, "files": counts["n_files"], "by_kind": {r.kind: r.n for r in export.kinds(kept).collect()}, "avg_complexity": round(counts["avg_complexity"], 1)}
    spark = symbols.sparkSession
    spark.createDataFrame([(json.dumps(report, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary")
    kept.select("symbol.*").orderBy("fully_qualified_name").write.mode("overwrite").json(f"{out}/symbols")
    return report
