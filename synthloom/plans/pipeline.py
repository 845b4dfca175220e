"""Pipelines declared as YAML: named steps over DataFrames, joined by depends_on, with one sink for all leaves."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from graphlib import CycleError, TopologicalSorter

import yaml
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from synthloom.operators import dedup, generate, sample
from synthloom.operators.context import enriched
from synthloom.operators.prompts import prompt
from synthloom.sources.csharp import read_symbols
from synthloom.sources.files import write_dataset
from synthloom.sources.references import read_references
from synthloom.tables import written

Step = Callable[[SparkSession, DataFrame | None, Mapping], DataFrame]


@dataclass(frozen=True)
class StepConfig:
    name: str
    type: str
    depends_on: tuple[str, ...] = ()
    config: Mapping = field(default_factory=dict)


@dataclass(frozen=True)
class PipelineConfig:
    name: str
    steps: tuple[StepConfig, ...]
    solution: Mapping = field(default_factory=dict)
    output: Mapping = field(default_factory=dict)


def load(text: str, environ: Mapping[str, str] | None = None) -> PipelineConfig:
    """A configuration from YAML. ${NAME} stands for a variable of the environment; a variable whose name is the path of a
    value, with __ between keys and places (OUTPUT__DIR, STEPS__0__CONFIG__MAX_ROWS), overrides it. Keys are in snake_case or
    PascalCase."""
    environ = os.environ if environ is None else environ
    raw = _snake_keys(yaml.safe_load(re.sub(r"\$\{(\w+)\}", lambda m: environ.get(m[1], m[0]), text)) or {})
    for name, value in environ.items():
        keys = [snake(x) for x in name.split("__")]
        if len(keys) > 1 and keys[0] in ("name", "solution", "output", "steps"):
            _put(raw, keys, value)
    steps = tuple(StepConfig(s["name"], ALIASES.get(s["type"], s["type"]), tuple(dict.fromkeys(s.get("depends_on") or ())), s.get("config") or {}) for s in raw.get("steps") or ())
    return PipelineConfig(raw.get("name", "pipeline"), steps, raw.get("solution") or {}, raw.get("output") or {})


def snake(key: str) -> str:
    """DependsOn, dependsOn or DEPENDS_ON as depends_on."""
    return (key if key.isupper() else re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key)).lower()


def _snake_keys(value: object) -> object:
    if isinstance(value, dict):
        return {snake(str(k)): _snake_keys(v) for k, v in value.items()}
    return [_snake_keys(v) for v in value] if isinstance(value, list) else value


def _put(raw: object, keys: Sequence[str], value: str) -> None:
    """Set what the keys lead to, as YAML reads the value; places in lists must exist."""
    for k in keys[:-1]:
        if isinstance(raw, list):
            if not k.isdigit() or int(k) >= len(raw):
                return
            raw = raw[int(k)]
        elif isinstance(raw, dict):
            if raw.get(k) is None:
                raw[k] = {}
            raw = raw[k]
        else:
            return
    if isinstance(raw, dict):
        raw[keys[-1]] = yaml.safe_load(value)


def _symbols(spark: SparkSession, _: DataFrame | None, c: Mapping) -> DataFrame:
    known = {"kinds": "symbol_kinds", **{k: k for k in ("min_complexity", "exclude_namespaces", "include_generated", "include_tests", "max_body_lines")}}
    path = c.get("solution_path") or c["path"]
    found = read_symbols(spark, path, **{k: c[v] for k, v in known.items() if c.get(v) is not None})
    if not c.get("include_context"):
        return found
    refs = read_references(spark, path, bool(c.get("include_generated")), bool(c.get("include_tests")))
    return enriched(found, refs, **{k: int(c[k]) for k in ("max_depth", "max_callees", "max_interfaces") if c.get(k) is not None})


def _sample(_: SparkSession, df: DataFrame | None, c: Mapping) -> DataFrame:
    return sample.sample(df, int(c.get("max_rows", 0)), c.get("strategy", "complexity_weighted"), int(c.get("seed", 42)))


def _generate(_: SparkSession, df: DataFrame | None, c: Mapping) -> DataFrame:
    keys = ("dataset_type", "model", "temperature", "max_tokens", "workers", "system_prompt", "drop_on_error", "ledger")
    return generate.generate(df, generate.maker(c["provider"], c.get("settings")), **{k: c[k] for k in keys if k in c})


def _judge(_: SparkSession, df: DataFrame | None, c: Mapping) -> DataFrame:
    keys = ("min_score", "rubric", "model", "temperature", "workers", "input_col", "output_col", "ledger")
    return generate.judge(df, generate.maker(c["provider"], c.get("settings")), system_prompt=c.get("prompt"), **{k: c[k] for k in keys if k in c})


def _dedup(_: SparkSession, df: DataFrame | None, c: Mapping) -> DataFrame:
    return dedup.minhash_dedup(df, **{k: c[k] for k in ("field", "threshold", "num_hashes", "shingle_size", "seed") if k in c})


STEPS: dict[str, Step] = {"SymbolExtractor": _symbols, "StratifiedSampler": _sample, "LlmStep": _generate, "LlmJudge": _judge, "MinHashDeduplicator": _dedup}


# Names that stand for these steps in other tools' files.
ALIASES = {"RoslynSymbolExtractor": "SymbolExtractor"}


def register_step(name: str, step: Step) -> None:
    STEPS[name] = step


def checked(config: PipelineConfig) -> list[StepConfig]:
    """The steps in an order that respects depends_on. Names, dependencies, types, dataset types and cycles are checked before anything runs."""
    by = {}
    for s in config.steps:
        if s.name in by:
            raise ValueError(f"two steps are named {s.name!r}")
        by[s.name] = s
        if s.type not in STEPS:
            raise ValueError(f"unknown step type {s.type!r}; known: {', '.join(STEPS)}")
        if "dataset_type" in s.config:
            prompt(s.config["dataset_type"])
    for s in config.steps:
        for d in s.depends_on:
            if d not in by:
                raise KeyError(f"step {s.name!r} depends on {d!r}, which there is none of")
    try:
        return [by[n] for n in TopologicalSorter({s.name: s.depends_on for s in config.steps}).static_order()]
    except CycleError as e:
        raise ValueError(f"the steps form a cycle: {' -> '.join(e.args[1])}") from e


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@dataclass
class Built:
    """The lazy plan: every step's frame, their union at the leaves, and the row counts that a run fills in."""

    frames: dict[str, DataFrame]
    leaves: DataFrame
    rows: dict[str, Observation]


def build(spark: SparkSession, config: PipelineConfig, max_rows: int | None = None) -> Built:
    """Compose the steps. A step that calls a model and has several consumers is kept, so no call is made twice."""
    order = checked(config)
    consumers = {s.name: sum(s.name in x.depends_on for x in order) for s in order}
    frames: dict[str, DataFrame] = {}
    rows: dict[str, Observation] = {}
    for s in order:
        given = union([frames[d] for d in s.depends_on]) if s.depends_on else None
        c = {**config.solution, **s.config} if s.type == "SymbolExtractor" else dict(s.config)
        if max_rows is not None and s.type == "StratifiedSampler":
            c["max_rows"] = max_rows
        rows[s.name] = Observation(s.name)
        df = STEPS[s.type](spark, given, c).observe(rows[s.name], F.count(F.lit(1)).alias("rows"))
        if consumers[s.name] > 1 and s.type in ("LlmStep", "LlmJudge"):
            df = written(df, s.name)  # a lost executor must not pay for the calls again
        frames[s.name] = df
    return Built(frames, union([frames[n] for n, k in consumers.items() if not k]), rows)


def run(spark: SparkSession, config: PipelineConfig, out_dir: str | None = None, max_rows: int | None = None) -> dict[str, int]:
    """Write what the leaves give; returns the rows that each step gave."""
    built = build(spark, config, max_rows)
    o = config.output
    write_dataset(built.leaves, out_dir or o["dir"], o.get("format", "jsonl"), o.get("write_metadata", True))
    return {name: seen.get["rows"] for name, seen in built.rows.items()}


TEMPLATES = {
    name: f"""name: {{name}}
solution:
  path: ./src
  min_complexity: 3
steps:
  - name: symbols
    type: SymbolExtractor
  - name: sampled
    type: StratifiedSampler
    depends_on: [symbols]
    config: {{{{max_rows: {rows}, strategy: complexity_weighted}}}}
  - name: generated
    type: LlmStep
    depends_on: [sampled]
    config: {{{{dataset_type: {kind}, provider: {provider}, workers: 4}}}}
output:
  dir: ./training-data
  format: jsonl
"""
    for name, kind, rows, provider in (
        *((f"{prefix}{name}", kind, rows, "openai") for prefix in ("", "dotnet-") for name, kind, rows in (("mixed", "explanation", 50000), ("explanation", "explanation", 10000), ("unit-test", "unit-test", 10000))),
        ("custom", "explanation", 1000, "offline"),
    )
}
