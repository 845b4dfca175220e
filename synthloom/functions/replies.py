"""Parsing of model replies, strictly, in Arrow batches: engines' own JSON functions accept more than JSON."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _refuse(_: str) -> None:
    raise ValueError("not a JSON number")


def unfenced(text: str) -> str:
    text = text.strip()
    if text.startswith("```"):
        if (at := text.find("\n")) > 0:
            text = text[at + 1 :]
        text = text.removesuffix("```")
    return text.strip()


def parsed_object(reply: str | None) -> dict | None:
    """A reply that is one JSON object, in a code fence or not."""
    if reply is None:
        return None
    try:
        value = json.loads(unfenced(reply), parse_constant=_refuse)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def string_keys(reply: Column, *keys: str) -> Column:
    """A struct of the keys' values, null unless the reply is a JSON object that has a string under each."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])

    @F.pandas_udf(schema)
    def parse(replies: pd.Series) -> pd.DataFrame:
        rows = [parsed_object(x) for x in replies]
        good = [r if r is not None and all(isinstance(r.get(k), str) for k in keys) else None for r in rows]
        return pd.DataFrame({k: [r[k] if r else None for r in good] for k in keys}, dtype=object)

    out = parse(reply)
    return F.when(out[keys[0]].isNotNull(), out)


def score_of(reply: str | None) -> tuple[float | None, str | None]:
    """(score, reason): a finite number or a string that reads as one; a reason that isn't a string is empty."""
    found = parsed_object(reply)
    score = found.get("score") if found else None
    if isinstance(score, str):
        try:
            score = float(score)
        except ValueError:
            return None, None
    if not isinstance(score, (int, float)) or isinstance(score, bool) or not math.isfinite(score):
        return None, None
    reason = found.get("reason")
    return float(score), reason if isinstance(reason, str) else ""


def judged(reply: Column) -> Column:
    """A struct (score float, reason string) of a judge's reply; null fields if it can't be read."""

    @F.pandas_udf("score float, reason string")
    def parse(replies: pd.Series) -> pd.DataFrame:
        rows = [score_of(x) for x in replies]
        return pd.DataFrame({"score": pd.array([s for s, _ in rows], dtype="Float32"), "reason": pd.Series([r for _, r in rows], dtype=object)})

    return parse(reply)
