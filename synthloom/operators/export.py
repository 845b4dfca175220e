"""Conversion to training formats, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthloom.functions.text import first_text
from synthloom.schema import CORE_FIELDS


def _text(df: DataFrame, name: str) -> Column:
    """The column if there is one and it holds strings (or JSON that is a string), else null."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.col(name)
    if isinstance(kind, T.VariantType):
        return F.when(F.schema_of_variant(F.col(name)) == "STRING", F.col(name).cast("string"))
    return F.lit(None).cast("string")


def _turns(df: DataFrame) -> tuple[Column, Column, Column]:
    """Instruction, input and output of a row of any dataset type."""

    def explained(code: str) -> Column:
        text, why = _text(df, code), first_text(_text(df, "explanation"))
        return F.when(F.coalesce(text, F.lit("")) != "", F.when(why != "", F.concat(text, F.lit("\n\n"), why)).otherwise(text))

    instruction = first_text(_text(df, "instruction"), _text(df, "question"))
    given = first_text(*(_text(df, c) for c in ("input", "context", "code", "original_code")))
    output = first_text(*(_text(df, c) for c in ("output", "response", "answer", "completion")), explained("fixed_code"), explained("refactored_code"))
    return instruction, given, output


def to_alpaca(df: DataFrame, *keep: str) -> DataFrame:
    instruction, given, output = _turns(df)
    return df.select(*keep, instruction.alias("instruction"), given.alias("input"), output.alias("output"))


def to_sharegpt(df: DataFrame, *keep: str) -> DataFrame:
    """One column, conversations: a human turn, with the input below the instruction, and the model's."""
    instruction, given, output = _turns(df)
    human = F.when(given == "", instruction).otherwise(F.concat(instruction, F.lit("\n\n"), given))

    def turn(who: str, said: Column) -> Column:
        return F.struct(F.lit(who).alias("from"), said.alias("value"))

    return df.select(*keep, F.array(turn("human", human), turn("gpt", output)).alias("conversations"))


def to_preference(df: DataFrame, *keep: str) -> DataFrame:
    """prompt, chosen and rejected as texts; the prompt is the instruction with the input below it."""
    instruction, given, _ = _turns(df)
    asked = F.when(given == "", instruction).otherwise(F.concat(instruction, F.lit("\n\n"), given))
    return df.select(*keep, asked.alias("prompt"), first_text(_text(df, "chosen")).alias("chosen"), first_text(_text(df, "rejected")).alias("rejected"))


def to_preference_sharegpt(df: DataFrame, *keep: str) -> DataFrame:
    """conversations, a human turn; chosen and rejected, a model's turn each."""
    flat = to_preference(df, *keep)

    def turn(who: str, said: str) -> Column:
        return F.struct(F.lit(who).alias("from"), F.col(said).alias("value"))

    return flat.select(*keep, F.array(turn("human", "prompt")).alias("conversations"), turn("gpt", "chosen").alias("chosen"), turn("gpt", "rejected").alias("rejected"))


def output_fields(df: DataFrame, write_metadata: bool = True) -> DataFrame:
    """Columns that are written: none that begins with an underscore; without metadata, core fields only."""
    core = {c.lower() for c in CORE_FIELDS}
    return df.select(*(c for c in df.columns if not c.startswith("_") and (write_metadata or c.lower() in core)))


def as_text(f: T.StructField) -> Column:
    """A column as a string, one that is none as JSON text."""
    c = F.col(f.name)
    if isinstance(f.dataType, T.StringType):
        return c
    if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(c).alias(f.name)
    return c.cast("string").alias(f.name)


def stringified(df: DataFrame) -> DataFrame:
    """Every column as a string, those that are none as JSON text."""
    return df.select(*(as_text(f) for f in df.schema.fields))


def inspection(symbols: DataFrame, method: str = "method") -> DataFrame:
    """One row: symbols, methods, their mean complexity (0 without any) and files, case aside."""
    methods = F.col("kind") == method
    return symbols.agg(
        F.count(F.lit(1)).alias("n_symbols"),
        F.count_if(methods).alias("n_methods"),
        F.coalesce(F.avg(F.when(methods, F.col("complexity"))), F.lit(0.0)).alias("avg_complexity"),
        F.count_distinct(F.lower("file_path")).alias("n_files"),
    )


def kinds(symbols: DataFrame) -> DataFrame:
    """Symbols by kind, the most frequent first."""
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")
