"""Prompts by dataset type: messages and prepared columns as expressions of the symbol, and how replies are read."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthloom.functions.replies import string_keys
from synthloom.functions.text import midpoint_prefix, strip_backticks, strip_fences, trim_ws

JSON_ONLY = "Answer with one JSON object and nothing else."


@dataclass(frozen=True)
class Prompt:
    """One dataset type. `ask` gives the user message, `prepared` columns known before the reply, `fields` columns read from it."""

    name: str
    system: str
    ask: Callable[[Column], Column]
    prepared: Callable[[Column], Mapping[str, Column]]
    fields: tuple[str, ...]
    read: Callable[[Column], Mapping[str, Column]]
    kinds: tuple[str, ...]

    def messages(self, symbol: Column) -> Column:
        return F.array(message("system", F.lit(self.system)), message("user", self.ask(symbol)))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _code(text: Column) -> Column:
    return F.concat(F.lit("\n```csharp\n"), F.coalesce(text, F.lit("")), F.lit("\n```"))


def _whole(name: str, clean: Callable[[Column], Column] = trim_ws) -> Callable[[Column], Mapping[str, Column]]:
    return lambda reply: {name: clean(reply)}


def _object(*keys: str) -> Callable[[Column], Mapping[str, Column]]:
    def read(reply: Column) -> Mapping[str, Column]:
        found = string_keys(reply, *keys)
        return {k: found[k] for k in keys}

    return read


def _explain(s: Column) -> Column:
    return F.concat(F.lit("Explain what the "), s["kind"], F.lit(" `"), s["fully_qualified_name"], F.lit("` does."))


def _complete(s: Column) -> Column:
    return midpoint_prefix(F.coalesce(s["body_text"], F.lit("")))


def _mend(s: Column) -> Column:
    return F.lit("Find and fix the bug in this code.")


def _test(s: Column) -> Column:
    return F.concat(F.lit("Write unit tests for `"), s["fully_qualified_name"], F.lit("`."))


def _document(s: Column) -> Column:
    return F.lit("Write an XML documentation comment for this declaration.")


def _refactor(s: Column) -> Column:
    return F.concat(F.lit("Refactor this code of complexity "), s["complexity"].cast("string"), F.lit(" so that it is easier to read."))


METHODS = ("method", "constructor")
TYPES = ("class", "struct", "record", "record-struct", "interface")
PROMPTS = {
    p.name: p
    for p in (
        Prompt(
            "explanation",
            "You explain C# code to developers, precisely and briefly.",
            lambda s: F.concat(_explain(s), _code(s["body_text"])),
            lambda s: {"instruction": _explain(s), "context": s["body_text"]},
            ("response",),
            _whole("response"),
            (*METHODS, "property", *TYPES, "enum"),
        ),
        Prompt(
            "completion",
            "You complete C# code. Answer with the missing code only.",
            lambda s: F.concat(F.lit("Continue this code:\n"), _complete(s)),
            lambda s: {"prompt": _complete(s)},
            ("completion",),
            _whole("completion", strip_backticks),
            (*METHODS, "property"),
        ),
        Prompt(
            "bug-fix",
            f"You write examples of realistic bugs and their fixes. {JSON_ONLY} Keys: buggy_code, fixed_code, explanation.",
            lambda s: F.concat(F.lit("Introduce one realistic bug in this code, then fix it."), _code(s["body_text"])),
            lambda s: {"instruction": _mend(s)},
            ("buggy_code", "fixed_code", "explanation"),
            _object("buggy_code", "fixed_code", "explanation"),
            METHODS,
        ),
        Prompt(
            "unit-test",
            "You write unit tests in C#.",
            lambda s: F.concat(_test(s), F.lit("\nSignature: "), s["signature_text"], _code(s["body_text"])),
            lambda s: {"instruction": _test(s), "context": s["signature_text"]},
            ("response",),
            _whole("response", strip_fences),
            METHODS,
        ),
        Prompt(
            "docstring",
            "You write documentation comments for C# declarations.",
            lambda s: F.concat(_document(s), _code(s["signature_text"])),
            lambda s: {"instruction": _document(s), "code": s["signature_text"]},
            ("response",),
            _whole("response"),
            (*METHODS, "property", *TYPES, "enum"),
        ),
        Prompt(
            "refactor",
            f"You refactor C# code without changing what it does. {JSON_ONLY} Keys: refactored_code, explanation.",
            lambda s: F.concat(_refactor(s), _code(s["body_text"])),
            lambda s: {"instruction": _refactor(s), "original_code": s["body_text"]},
            ("refactored_code", "explanation"),
            _object("refactored_code", "explanation"),
            (*METHODS, "class", "struct", "record", "record-struct"),
        ),
        Prompt(
            "architecture-qa",
            f"You ask and answer questions on the design of C# systems. {JSON_ONLY} Keys: question, answer.",
            lambda s: F.concat(F.lit("Ask and answer one question on the design of this part of namespace "), F.coalesce(s["namespace"], F.lit("")), F.lit("."), _code(s["body_text"])),
            lambda s: {},
            ("question", "answer"),
            _object("question", "answer"),
            (*TYPES, "enum"),
        ),
    )
}
ALIASES = {"bugfix": "bug-fix", "unittest": "unit-test", "architectureqa": "architecture-qa"}


def prompt(dataset_type: str) -> Prompt:
    """The prompt of a dataset type, by its name or an alias, in any case."""
    name = dataset_type.lower()
    name = ALIASES.get(name, name)
    if name not in PROMPTS:
        raise ValueError(f"unknown dataset type {dataset_type!r}; known: {', '.join(PROMPTS)}")
    return PROMPTS[name]


def with_system(messages: Column, system: str | None) -> Column:
    """Messages under another system message; earlier ones are dropped, the rest keep their order."""
    if not system:
        return messages
    return F.concat(F.array(message("system", F.lit(system))), F.filter(messages, lambda m: m["role"] != "system"))


def rendered(df: DataFrame, dataset_type: str, system: str | None = None) -> DataFrame:
    """Rows that have a symbol, with _messages and the prepared columns of the type."""
    p = prompt(dataset_type)
    some = df.filter(F.col("symbol").isNotNull())
    return some.withColumns({"_messages": with_system(p.messages(F.col("symbol")), system), **p.prepared(F.col("symbol"))})


def fan_out(df: DataFrame, dataset_types: Sequence[str] | None = None, max_rows: int = 0, order: str = "_ord") -> DataFrame:
    """Each row once for every type that accepts its symbol's kind, with dataset_type.

    Of max_rows, every type has an equal quota, the first ones one more for the remainder; what a type can't fill is left.
    Rows of least order come first. A type's rows are cut by range before they are ranked, see stratified_sample().
    """
    names = [prompt(x).name for x in dataset_types or PROMPTS]
    kind = F.lower(F.col("symbol.kind"))
    fits = F.array(*(F.when(kind.isin(list(PROMPTS[n].kinds)), F.lit(n)) for n in names))
    out = df.withColumn("dataset_type", F.explode(F.filter(fits, lambda x: x.isNotNull())))
    if max_rows <= 0:
        return out
    base, extra = divmod(max_rows, len(names))
    # top-k per type: each is a bounded merge of partitions' own first rows
    parts = [out.filter(F.col("dataset_type") == n).orderBy(order).limit(base + (i < extra)) for i, n in enumerate(names)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
