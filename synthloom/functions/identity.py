"""Content-addressed identity of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prompt_version(dataset_type: Column) -> Column:
    return F.concat(dataset_type, F.lit("@1"))


def row_id(fqn: Column, dataset_type: Column, version: Column) -> Column:
    """16 hex digits that name a row: symbol, dataset type and prompt version."""
    return F.substring(F.sha2(F.concat_ws("\n", fqn, dataset_type, version), 256), 1, 16)


def body_sha(body: Column) -> Column:
    return F.sha2(body, 256)
