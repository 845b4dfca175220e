"""Schemas of the rows that pass between steps."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TEXT, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()
SYMBOL = struct(
    fully_qualified_name=TEXT, signature_text=TEXT, body_text=TEXT, xml_doc_comment=TEXT, containing_type=TEXT, namespace=TEXT, file_path=TEXT, complexity=INT, kind=TEXT
)
MESSAGE = struct(role=TEXT, content=TEXT)
MANIFEST_ROW = struct(id=TEXT, symbol_fqn=TEXT, symbol_kind=TEXT, dataset_type=TEXT, body_sha=TEXT, prompt_version=TEXT, row_offset=LONG)
MANIFEST = struct(format_version=INT, generated_at=TEXT, source=struct(solution_path=TEXT, solution_sha=TEXT, commit=TEXT), rows=T.ArrayType(MANIFEST_ROW))
KINDS = ("method", "property", "constructor", "class", "struct", "record", "record-struct", "interface", "enum")

# The columns a writer keeps when metadata is off, compared without regard to case.
CORE_FIELDS = (
    "instruction", "input", "output",
    "prompt", "completion", "response",
    "question", "answer", "context",
    "code", "buggy_code", "fixed_code",
    "original_code", "refactored_code",
    "explanation",
)
