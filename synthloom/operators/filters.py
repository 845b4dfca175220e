"""Predicates on symbols, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks a test project and a generated file.
TEST_SUFFIXES = (".Tests", ".Test", ".UnitTests", ".IntegrationTests", ".AcceptanceTests")
TEST_FRAMEWORKS = ("xunit.core", "xunit", "Microsoft.NET.Test.Sdk", "MSTest.TestFramework", "nunit.framework")
GENERATED_ENDINGS = (".g.cs", ".designer.cs", ".g.i.cs")
DEFAULT_KINDS = ("method", "property", "class", "interface")


def kind_in(kind: Column, kinds: Sequence[str] = DEFAULT_KINDS) -> Column:
    return F.lower(kind).isin([k.lower() for k in kinds])


def complex_enough(kind: Column, complexity: Column, least: int, method: str = "method") -> Column:
    """Only methods are held to a least complexity."""
    return F.lit(True) if least <= 0 else ~((kind == method) & (complexity < least))


def namespace_kept(namespace: Column, excluded: Sequence[str]) -> Column:
    """Not an excluded namespace nor below one; null is kept."""
    out = F.lit(True)
    for prefix in excluded:
        out &= ~F.coalesce((namespace == prefix) | namespace.startswith(prefix + "."), F.lit(False))
    return out


def is_test_project(name: Column, references: Column) -> Column:
    """By the project's name or the assemblies it refers to, in any case."""
    by_name = F.lit(False)
    for suffix in TEST_SUFFIXES:
        by_name |= F.endswith(F.lower(name), F.lit(suffix.lower()))

    def framework(reference: Column) -> Column:
        held = F.lit(False)
        for x in TEST_FRAMEWORKS:
            held |= F.contains(F.lower(reference), F.lit(x.lower()))
        return held

    return F.coalesce(by_name, F.lit(False)) | F.coalesce(F.exists(references, framework), F.lit(False))


def is_generated(path: Column, head: Column) -> Column:
    """By the file's name, or an auto-generated mark in what precedes its first declaration."""
    out = F.contains(F.coalesce(head, F.lit("")), F.lit("<auto-generated"))
    for ending in GENERATED_ENDINGS:
        out |= F.endswith(F.lower(path), F.lit(ending))
    return out


def symbols_kept(df: DataFrame, kinds: Sequence[str] = DEFAULT_KINDS, min_complexity: int = 0, exclude_namespaces: Sequence[str] = (), method: str = "method") -> DataFrame:
    """Rows whose flat kind, complexity and namespace pass."""
    return df.filter(kind_in(F.col("kind"), kinds) & complex_enough(F.col("kind"), F.col("complexity"), min_complexity, method) & namespace_kept(F.col("namespace"), exclude_namespaces))
