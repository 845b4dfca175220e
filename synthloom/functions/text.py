"""Column expressions on texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts tokens of the near-duplicate filter.
SEPARATORS = r"[ \t\r\n.,;:(){}\[\]\"'`]+"
MARKER = "// ... truncated"


def trim_ws(c: Column) -> Column:
    """Without white space of any kind at either end (trim() takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_fences(c: Column) -> Column:
    """Without a Markdown code fence around it: the first line, if it opens one and ends, and a closing fence."""
    t = trim_ws(c)
    inner = F.when(F.locate("\n", t) > 1, F.substr(t, F.locate("\n", t) + 1)).otherwise(t)
    closed = F.when(F.endswith(inner, F.lit("```")), F.substr(inner, F.lit(1), F.length(inner) - 3)).otherwise(inner)
    return F.when(F.startswith(t, F.lit("```")), trim_ws(closed)).otherwise(t)


def strip_backticks(c: Column) -> Column:
    return F.btrim(trim_ws(c), F.lit("`"))


def tokens(c: Column) -> Column:
    """Lower-case tokens; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), SEPARATORS), lambda x: x != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once and only if the result is asked for: inside a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(c: Column, k: int) -> Column:
    """k-token shingles: all tokens joined if they are fewer, none for a blank text, one empty one for separators only."""

    def of(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(k)), " "))
        return F.when(F.size(t) < k, F.array(F.array_join(t, " "))).otherwise(many)

    return F.when(trim_ws(F.coalesce(c, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(let(tokens(c), of))


def truncate_lines(c: Column, n: int, marker: str = MARKER) -> Column:
    """The first n lines and a marker line, if there are more; n of 0 or less keeps all."""
    if n <= 0:
        return c
    lines = F.split(c, "\n")
    return F.when(F.size(lines) > n, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n" + marker))).otherwise(c)


def midpoint_prefix(c: Column) -> Column:
    """A text up to the first newline at or after its middle; to the middle itself if there is none, or only at its end."""
    middle = F.floor(F.length(c) / 2).cast("int")
    after = F.instr(F.substr(c, middle + 1), F.lit("\n")) + middle
    usable = (after > middle) & (after < F.length(c))
    return F.when(F.length(c) == 0, c).when(usable, F.substr(c, F.lit(1), after - 1)).otherwise(F.substr(c, F.lit(1), middle))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def md5_int(c: Column) -> Column:
    """The first 32 bits of a string's MD5 as a number: the same in any engine."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def uniform(seed: int, key: Column) -> Column:
    """A number above 0 and below 1 from seed and key, on any cluster and in any order."""
    return (md5_int(F.concat(F.lit(f"{seed}:"), key.cast("string"))) + 1) / F.lit(4294967297.0)
