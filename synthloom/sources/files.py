"""Readers and writers of datasets and manifests."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import UTC, datetime
from decimal import Decimal

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthloom.functions.text import trim_ws
from synthloom.operators.export import output_fields, stringified
from synthloom.schema import MANIFEST, MANIFEST_ROW
from synthloom.sources import snapshots
from synthloom.tables import small


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of JSON lines. With a schema, that of its columns; without, one column `row`, a variant that keeps each
    value's kind. Blank lines and lines that aren't JSON objects are skipped; of a key that repeats the last value counts."""
    return json_rows(spark.read.text(path), schema)


def json_rows(lines: DataFrame, schema: T.StructType | None = None, *keep: str) -> DataFrame:
    """read_jsonl() on lines in a column `value`, with the columns `keep` of them."""
    lines = lines.filter(trim_ws(F.col("value")).startswith("{"))
    parsed = F.try_parse_json("value")
    # a repeated key is what else makes a JSON object unreadable as a variant
    objects = lines.withColumn("value", F.when(parsed.isNull(), last_wins(F.when(parsed.isNull(), F.col("value")))).otherwise(F.col("value")))
    objects = objects.select(*keep, F.try_parse_json("value").alias("row"), "value").filter("row is not null")
    if schema is None:
        return objects.select(*keep, "row")
    return objects.select(*keep, F.from_json("value", schema).alias("r")).select(*keep, "r.*")


def last_wins(value: Column) -> Column:
    """A JSON object's text with one value for each key, the last one; null if it is no JSON."""

    @F.pandas_udf("string")
    def again(batch: pd.Series) -> pd.Series:
        return pd.Series([_reread(x) for x in batch], dtype=object)

    return again(value)


def _reread(value: str | None) -> str | None:
    try:
        return None if value is None else json.dumps(json.loads(value, parse_float=Decimal), ensure_ascii=False, allow_nan=False, default=float)
    except ValueError:
        return None


def variant_columns(rows: DataFrame, *names: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns of strings from `row` variants: null where the value is of another kind."""

    def text(name: str) -> Column:
        v = F.try_variant_get("row", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).alias(name)

    return rows.select(*keep, *(text(n) for n in names))


FORMATS = ("jsonl", "csv", "parquet")
CSV = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_dataset(df: DataFrame, path: str, format: str = "jsonl", write_metadata: bool = True, as_strings: bool = False, mode: str = "errorifexists") -> DataFrame:
    """Write the output fields of df; returns what was selected. Tasks write their own parts and commit together."""
    format = format.lower()
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {', '.join(FORMATS)}")
    out = output_fields(df, write_metadata)
    writer = (stringified(out) if format == "csv" or as_strings else out).write.mode(mode)
    if format == "jsonl":
        writer.option("ignoreNullFields", False).json(path)
    elif format == "csv":
        writer.csv(path, header=True, **CSV)
    else:
        writer.parquet(path)
    return out


def manifest_path(directory: str) -> str:
    return f"{directory.rstrip('/')}/_manifest"


def write_manifest(rows: DataFrame, directory: str, source: dict | None = None) -> None:
    """The manifest as a table of its rows, and its head (version, time, source) as a line of JSON beside it."""
    rows.select(*(F.col(f.name).cast(f.dataType) for f in MANIFEST_ROW.fields)).write.mode("overwrite").parquet(f"{manifest_path(directory)}/rows")
    head = {"format_version": 1, "generated_at": datetime.now(UTC).isoformat(), "source": source}
    rows.sparkSession.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{manifest_path(directory)}/head")


def manifest_head(spark: SparkSession, directory: str) -> dict | None:
    """Version, time and source of the manifest; None if there is none."""
    now = snapshots.current(directory)
    if now is not None:
        return {"format_version": now.format_version, "generated_at": now.generated_at, "source": now.source}
    try:
        head = spark.read.text(f"{manifest_path(directory)}/head").first()
    except AnalysisException as e:
        return _absent(e)
    return json.loads(head[0]) if head else None


def read_manifest(spark: SparkSession, directory: str) -> DataFrame | None:
    """The manifest's rows, of the newest version where versions are kept; None if there is none."""
    now = snapshots.current(directory)
    if now is not None:
        return manifest_columns(snapshots.manifest(spark, directory, now))
    try:
        return spark.read.schema(MANIFEST_ROW).parquet(f"{manifest_path(directory)}/rows")
    except AnalysisException as e:
        return _absent(e)


def manifest_columns(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in MANIFEST_ROW.fields))


def _absent(e: AnalysisException) -> None:
    """None for a path that isn't there; any other error goes on."""
    if e.getCondition() != "PATH_NOT_FOUND":
        raise e


def read_manifest_document(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a manifest that is one JSON document."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("rows").alias("r")).select("r.*")


def lines_with_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(row_offset, value) of every line, counted from 0 through the files in order of their names.

    Lines are numbered in their files by Spark's own input order and offset by the files before; a row a file is what the
    global window reads.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    counts = lines.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("f", "b")) - F.col("n")).drop("n")
    local = F.row_number().over(Window.partitionBy("f", "b").orderBy("i")) - 1
    return lines.withColumn("k", local).join(small(before, 200), ["f", "b"]).select((F.col("before") + F.col("k")).alias("row_offset"), "value")


def existing_rows(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(id, row_offset, value) of the lines a manifest lists; blank and broken ones are left out."""
    lines = lines_with_offsets(spark, path).filter(trim_ws(F.col("value")).startswith("{"))
    broken = F.try_parse_json("value").isNull()
    lines = lines.withColumn("value", F.when(broken, last_wins(F.when(broken, F.col("value")))).otherwise(F.col("value"))).filter("value is not null")
    return manifest.select("id", "row_offset").join(lines, "row_offset").select("id", "row_offset", "value")
