"""What C# declarations refer to: base types, calls and creations, one file a row.

The helper marks names only; what a name stands for is found by joins in `operators/context.py`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from synthloom.sources.csharp import quieted, source_files, symbols_in

TYPES = ("class", "struct", "record", "record-struct", "interface", "enum")
_USING = re.compile(r"^[ \t]*(?:global\s+)?using\s+(?:(\w+)\s*=\s*)?([\w.]+)\s*;", re.M)
_GENERIC = r"<(?:[^<>;{}()]|<(?:[^<>;{}()]|<[^<>;{}()]*>)*>)*>"
_NEW = re.compile(rf"\bnew\s+([A-Za-z_][\w.]*)\s*({_GENERIC})?\s*(?=[({{])")
_CALL = re.compile(rf"(?<![\w.])((?:\w+\s*[?!]?\.\s*)*)([A-Za-z_]\w*)\s*(?:{_GENERIC})?\(")
# words before a bracket that call nothing
_WORDS = frozenset(("if while for foreach switch catch using lock return nameof typeof sizeof default new await checked unchecked when fixed and or not is in base this").split())
_OPEN_SPOT = re.compile(r"\bnew\s+$")


def arity(generics: str | None) -> int:
    """How many arguments a generic list has; those of inner lists don't count."""
    depth = n = 0
    for c in generics or "":
        depth += (c == "<") - (c == ">")
        n += c == "," and depth == 1
    return n + 1 if generics else 0


def key_of(name: str) -> str:
    """A dotted name with each generic list as its number of arguments: A.B<T,U>.C is A.B`2.C."""
    return re.sub(_GENERIC, lambda m: f"`{arity(m[0])}", name)


def bases_of(header: str) -> list[str]:
    """The base list of a type's header, as written."""
    header = re.sub(r"\bwhere\b.*", "", header, flags=re.S)
    header = re.sub(_GENERIC, lambda m: m[0].replace(",", "\0"), header)
    while (bare := re.sub(r"\([^()]*\)", "", header)) != header:
        header = bare
    _, colon, rest = header.partition(":")
    return ["".join(x.replace("\0", ",").split()) for x in rest.split(",") if x.strip()] if colon else []


def _declared(variable: str, *texts: str) -> str | None:
    """The type that a parameter, local, field or property is declared with, in the first text that declares it."""
    v = re.escape(variable)
    for text in texts:
        if m := re.search(rf"\bvar\s+{v}\s*=\s*new\s+([A-Za-z_][\w.]*(?:\s*{_GENERIC})?)", text):
            return "".join(m[1].split())
        for m in re.finditer(rf"(?<![\w.])([A-Za-z_][\w.]*(?:\s*{_GENERIC})?)\??\s+{v}\s*(?:[,)=;{{]|\bin\b)", text):
            if m[1] not in ("return", "var", "new", "await", "throw", "out", "ref", "in", "is", "as", "case", "else"):
                return "".join(m[1].split())
    return None


def references_in(code: str, path: str) -> list[dict]:
    """Rows of one file. Each declaration gives a row of role `declares`, and one for each name it refers to: `base`, `new`,
    or `call` (name: the type that is asked for `member`; null: the own type; "base": its parents)."""
    quiet = quieted(code)
    directives = [(m[1], m[2]) for m in _USING.finditer(quiet)]
    spaces = sorted({space for alias, space in directives if not alias})
    aliases = {alias: space for alias, space in directives if alias}
    declared = symbols_in(code, path)
    types = [(s["_at"], s["_at"] + len(s["body_text"])) for s in declared if s["kind"] in TYPES]
    out: list[dict] = []
    for s in declared:
        at, end = s["_at"], s["_at"] + len(s["body_text"])
        is_type = s["kind"] in TYPES
        outer = ".".join(x for x in (s["namespace"], s["containing_type"]) if x)
        head = {
            "_ord": f"{path}#{at:010d}",
            "fqn": s["fully_qualified_name"],
            "key": key_of(s["fully_qualified_name"]),
            "kind": s["kind"],
            "owner": key_of(s["fully_qualified_name"] if is_type else outer),
            "namespace": s["namespace"],
            "usings": spaces,
        }
        header = quiet[at : at + len(s["signature_text"])]
        words = set(re.findall(r"\b(?:virtual|abstract|override)\b", header))

        def row(role: str, place: int, name: str | None = None, member: str | None = None, written: str | None = None) -> None:
            bare, n = None, 0
            if name is not None:
                bare, n = re.sub(_GENERIC, "", name), arity(g[0] if (g := re.search(_GENERIC + "$", name)) else None)
                first, dot, rest = bare.partition(".")
                bare = aliases.get(first, first) + dot + rest
            out.append({**head, "role": role, "place": place, "name": bare, "arity": n, "member": member, "written": written, "open": bool(words), "overrides": "override" in words})

        row("declares", -1)
        if is_type:
            for n, base in enumerate(bases_of(header)):
                row("base", n, base, written=base)
            continue
        inside = [quiet[a:b] for a, b in types if a < at < b][::-1]
        body = quiet[at + len(header) : end]
        for m in _NEW.finditer(body):
            name = m[1] + "".join((m[2] or "").split())
            row("new", m.start(), name, written=name)
        for m in _CALL.finditer(body):
            via = re.sub(r"[\s?!]", "", m[1]).rstrip(".")
            if m[2] in _WORDS or _OPEN_SPOT.search(body[: m.start()]):
                continue
            via = via.removeprefix("this.")
            if via in ("", "this"):
                row("call", m.start(), None, m[2], m[2])
            elif via == "base":
                row("call", m.start(), "base", m[2], f"base.{m[2]}")
            else:
                known = None if "." in via else _declared(via, header + body, *inside)
                row("call", m.start(), known or via, m[2], f"{via}.{m[2]}")
    return out


SCHEMA = (
    "_ord string, fqn string, key string, kind string, owner string, namespace string, usings array<string>, role string, place int,"
    " name string, arity int, member string, written string, open boolean, overrides boolean"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(",")]


def references(files: DataFrame) -> DataFrame:
    """The rows of references_in for each of files' (file_path, value)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, code in zip(batch.file_path, batch.value, strict=True):
                yield pd.DataFrame(references_in(code or "", path), columns=_COLUMNS)

    return files.select("file_path", "value").mapInPandas(parse, SCHEMA)


def read_references(spark: SparkSession, path: str, include_generated: bool = False, include_tests: bool = False) -> DataFrame:
    """The references of a .sln, a .csproj or a folder, from the same files as read_symbols."""
    return references(source_files(spark, path, include_generated, include_tests))
