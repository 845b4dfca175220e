"""A corpus pipeline: quality rules, near duplicates, personal data, source mix, packing.

run() writes each stage's rows as Parquet in the shared scratch folder and reads them again as the next one's documents.

All stages take texts whole, whatever their length, carry columns of any names along, and give an empty table for one. Nulls:
a null text has no words, so the first stage rejects it; later stages, on their own, keep null texts (the mix takes none of
them) and null ids, sources and other columns. Rows that repeat each other are judged alike, are copies of which one stays
after the second stage, and are told apart by their place in the mix. Ties: of near duplicates with equal least ids and
texts any one stays; equal keys of the mix and equal lengths in packing are taken in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from synthloom.llm.common import table, written
from synthloom.llm.jaccard import one_of_each
from synthloom.llm.mixing import mixed_documents
from synthloom.llm.packing import pack
from synthloom.llm.pii import sanitised
from synthloom.llm.quality import kept_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects; null and blank texts are rejected."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id (null before others), of each group whose 5-word shingles link it at a similarity of 0.8
    or more; texts without a word all stay."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked and the terms that give it away generalised or removed; n_chars follows the
    text, null texts stay null."""
    return sanitised(docs, n_chars_col="n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; null texts are taken never, a null source is a source of its own."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences of 4096 tokens; a null text would be one end token."""
    return pack(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", source_mix),
    ("packing", packing),
]

#: Packing, and so the rows of run(), can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
