"""Command line: inspect, generate, run, init, models, export, sync, migrate."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from synthloom.operators import export, generate, sample
from synthloom.operators.sync import ORPHANS
from synthloom.plans import datasets, pipeline
from synthloom.providers.base import provider
from synthloom.session import session
from synthloom.sources.csharp import read_symbols


def comma_list(text: str) -> list[str]:
    """The parts between commas, trimmed, without empty ones."""
    return [x for part in text.split(",") if (x := part.strip())]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="synthloom")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *positional: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for x in positional:
            v.add_argument(x)
        return v

    def of_symbols(v: argparse.ArgumentParser, min_complexity: int) -> None:
        v.add_argument("--min-complexity", type=int, default=min_complexity)
        v.add_argument("--exclude-namespaces", type=comma_list, default=[])
        v.add_argument("--include-tests", action="store_true")
        v.add_argument("--include-generated", action="store_true")

    v = verb("inspect", "path")
    of_symbols(v, 3)
    v.add_argument("--report")
    for name in ("generate", "sync"):
        v = verb(name, "path", "out")
        of_symbols(v, 0)
        v.add_argument("--dataset-type", default="explanation")
        v.add_argument("--provider", default="offline")
        v.add_argument("--model")
        v.add_argument("--workers", type=int, default=4)
        v.add_argument("--ledger", help="folder of replies that later runs need not pay for again")
        v.add_argument("--dry-run", action="store_true")
        if name == "generate":
            v.add_argument("--max-rows", type=int, default=0)
            v.add_argument("--seed", type=int, default=42)
            v.add_argument("--format", default="jsonl")
        else:
            v.add_argument("--orphans", choices=ORPHANS, default="drop")
    verb("migrate", "path", "out")
    v = verb("run", "yaml")
    v.add_argument("--out-dir")
    v.add_argument("--max-rows", type=int)
    v = verbs.add_parser("init")
    v.add_argument("template", choices=sorted(pipeline.TEMPLATES))
    v.add_argument("--name", default="my-dataset")
    v = verb("models", "provider")
    v.add_argument("--filter", default="")
    v = verb("export", "path", "out")
    v.add_argument("--format", default="jsonl", choices=tuple(datasets.FORMATS))
    return p


def _symbols(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return read_symbols(
        spark, a.path, min_complexity=a.min_complexity, exclude_namespaces=a.exclude_namespaces, include_tests=a.include_tests, include_generated=a.include_generated
    )


def main(args: Sequence[str] | None = None) -> int:
    """0: done; 1: failed; 2: wrong usage, or a manifest that is there already; 130: interrupted."""
    try:
        a = _parser().parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        if a.verb == "init":
            print(pipeline.TEMPLATES[a.template].format(name=a.name))
        elif a.verb == "models":
            print(*(m for m in provider(a.provider).models() if a.filter.lower() in m.lower()), sep="\n")
        elif a.verb == "inspect":
            found = _symbols(session(), a)
            export.inspection(found).show(truncate=False)
            export.kinds(found).show(truncate=False)
            if a.report:
                datasets.inspect_report(found, a.path, a.report)
        elif a.verb == "run":
            print(pipeline.run(session(), pipeline.load(Path(a.yaml).read_text()), a.out_dir, a.max_rows))
        elif a.verb == "export":
            datasets.export_dataset(session(), a.path, a.out, a.format)
        elif a.verb == "migrate":
            n = datasets.migrate_dataset(session(), a.out, {"solution_path": a.path})
            print(f"{n} rows can't be tied to symbols; the next sync makes all rows anew")
        elif a.verb == "sync":
            spark, make = session(), generate.maker(a.provider)
            source = {"solution_path": a.path}
            done = datasets.sync_dataset(spark, _symbols(spark, a), a.out, make, a.dataset_type, a.orphans, a.dry_run, source, model=a.model, workers=a.workers, ledger=a.ledger)
            print(*(f"{k}: {v}" for k, v in done.asDict().items()), sep="\n")
        else:
            spark, make = session(), generate.maker(a.provider)
            symbols = sample.sample(_symbols(spark, a), a.max_rows, seed=a.seed)
            source, options = {"solution_path": a.path}, {} if a.dry_run else {"model": a.model, "workers": a.workers, "ledger": a.ledger}
            rows = datasets.generate_dataset(spark, symbols, a.out, None if a.dry_run else make, a.dataset_type, a.format, source, **options)
            print(f"{rows.count()} rows")
    except KeyboardInterrupt:
        print("synthloom: interrupted", file=sys.stderr)
        return 130
    except FileExistsError as e:
        print(f"synthloom: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        print(f"synthloom: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
