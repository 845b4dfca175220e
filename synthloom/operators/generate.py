"""Model generation and model-as-judge filtering, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthloom.functions.replies import judged, score_of
from synthloom.operators.ledger import replied
from synthloom.operators.prompts import message, prompt, rendered
from synthloom.providers.base import Options, Provider, provider

Maker = Callable[[], Provider]


def maker(name: str, settings: Mapping | None = None) -> Maker:
    """A provider to be made once in each worker; the name is looked up at once, so a wrong one fails at planning."""
    provider(name, **(settings or {}))

    def made() -> Provider:
        return provider(name, **(settings or {}))

    made.label = f"{name.lower()} {(settings or {}).get('base_url', '')}".strip()  # what a ledger tells providers apart by
    return made


#: Rows that are Python objects at one time; Spark's batches hold 10,000.
HELD = 256


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = HELD) -> Iterator[list[dict]]:
    """Rows of Arrow batches as dicts, some at a time, so that texts are held twice for a slice only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pylist()


def completed(messages: Column, make: Maker, options: Options, workers: int = 4) -> Column:
    """A struct (raw, error) of each conversation's reply. Calls of a slice overlap on `workers` threads; a failed call is a row's error, not the task's."""
    reply = pa.struct([("raw", pa.string()), ("error", pa.string())])

    @F.arrow_udf("raw string, error string")
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        with ThreadPoolExecutor(max(1, workers)) as pool:
            for batch in batches:
                tables = [pa.RecordBatch.from_arrays([batch], ["m"])]
                parts = [pa.array(list(pool.map(lambda r: asked(model, r["m"], options), rows)), reply) for rows in in_slices(tables)]
                yield pa.concat_arrays(parts) if parts else pa.array([], reply)

    return call.asNondeterministic()(messages)


def asked(model: Provider, turns: list[dict] | None, options: Options) -> dict[str, str | None]:
    try:
        return {"raw": model.complete(turns, options), "error": None}
    except Exception as e:
        return {"raw": None, "error": str(e)}


def answered(df: DataFrame, messages: Column, make: Maker, options: Options, workers: int, ledger: str | None) -> DataFrame:
    """df with `_reply`: lazily from completed(), or at once and through the ledger of replies in that folder."""
    if ledger is None:
        return df.withColumn("_reply", completed(messages, make, options, workers))
    return replied(df.withColumn("_asked", messages).drop("_messages"), make, options, ledger, workers, messages="_asked", keep=False)


def generate(
    df: DataFrame,
    make: Maker,
    dataset_type: str = "explanation",
    model: str | None = None,
    temperature: float | None = 0.7,
    max_tokens: int | None = None,
    workers: int = 4,
    system_prompt: str | None = None,
    drop_on_error: bool = True,
    ledger: str | None = None,
    keep_reply: bool = False,
) -> DataFrame:
    """Rows with the prepared and the parsed columns of their dataset type; parsed ones win.

    Rows without a symbol go. Where a call fails or its reply can't be read, the row goes, or keeps `error` (and
    `response_raw`) if drop_on_error is off. The call is made once a row: it is the only expression that isn't deterministic,
    so persist or write the result before using it twice. With a ledger, a folder that all tasks share, calls are made at
    once, each different one once, and those that an earlier run or attempt made are not made again (see ledger.py); keep_reply
    adds `reply_kept`, whether the ledger held a row's reply before.
    """
    p = prompt(dataset_type)
    replies = answered(rendered(df, dataset_type, system_prompt), F.col("_messages"), make, Options(model, temperature, max_tokens), workers, ledger)
    read = p.read(F.col("_reply.raw"))
    out = replies.withColumns(dict(read))
    unread = F.col("_reply.raw").isNull() | F.col(p.fields[0]).isNull()
    if drop_on_error:
        out = out.filter(~unread)
    else:
        out = out.withColumn("error", F.when(F.col("_reply.error").isNotNull(), F.col("_reply.error")).when(unread, F.lit("response did not parse")))
        out = out.withColumn("response_raw", F.when(F.col("_reply.error").isNull() & unread, F.col("_reply.raw")))
    if keep_reply:
        out = out.withColumn("reply_kept", F.col("_reply.kept") if ledger else F.lit(False))
    return out.drop("_messages", "_reply")


RUBRICS = {
    "default": "Rate how good and complete the output is as an answer to the input, from 1 to 5.",
    "code_quality": "Rate the code in the output for correctness, clarity and idiom, from 1 to 5.",
}
JUDGE_FORM = 'Answer with one JSON object: {"score": <number>, "reason": "<one sentence>"}.'


def judge(
    df: DataFrame,
    make: Maker,
    min_score: float = 3.0,
    rubric: str = "default",
    system_prompt: str | None = None,
    input_col: str = "instruction",
    output_col: str = "response",
    model: str | None = None,
    temperature: float | None = 0.0,
    workers: int = 2,
    ledger: str | None = None,
) -> DataFrame:
    """Rows with judge_score and judge_reason, of which those scored at least min_score stay.

    Rows with an empty output go before the call; those whose call fails or whose score can't be read go after it.
    """
    text = F.coalesce(F.col(output_col), F.lit(""))
    ask = F.concat(F.lit("Input:\n"), F.coalesce(F.col(input_col), F.lit("")), F.lit("\n\nOutput:\n"), text)
    system = system_prompt or f"{RUBRICS.get(rubric, RUBRICS['default'])} {JUDGE_FORM}"
    turns = F.array(message("system", F.lit(system)), message("user", ask))
    scored = answered(df.filter(text != ""), turns, make, Options(model, temperature, None), workers, ledger)
    scored = scored.withColumn("_judged", judged(F.col("_reply.raw")))
    kept = scored.filter(F.col("_judged.score") >= F.lit(min_score).cast("float"))
    return kept.withColumn("judge_score", F.col("_judged.score")).withColumn("judge_reason", F.col("_judged.reason")).drop("_reply", "_judged")


#: The margin of a pair that needs no judge.
BUG_FIX_MARGIN = 4.0


def preference_pairs(df: DataFrame, make: Maker, judge_of: Maker, min_chosen: float = 3.0, dataset_type: str = "explanation") -> DataFrame:
    """Rows with chosen, rejected and margin: two replies to one prompt, the better scored first; ties and weak winners go.

    A bug-fix reply holds both sides, the fixed code and the buggy one: these are the pair, and neither a second reply nor a
    judge is asked for.
    """
    if prompt(dataset_type).name == "bug-fix":
        made = generate(df, make, dataset_type).filter("fixed_code != buggy_code")
        return made.withColumns({"chosen": F.col("fixed_code"), "rejected": F.col("buggy_code"), "chosen_score": F.lit(5.0), "margin": F.lit(BUG_FIX_MARGIN)})
    p = rendered(df, dataset_type)
    system = {"role": "system", "content": f"{RUBRICS['default']} {JUDGE_FORM}"}
    once_more = {"role": "user", "content": "Answer once more, differently."}
    answers = pa.struct([("a", pa.string()), ("b", pa.string()), ("sa", pa.float32()), ("sb", pa.float32())])

    @F.arrow_udf("a string, b string, sa float, sb float")
    def both_scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Two replies to each conversation and their scores in one worker; a text is in it once."""
        model, judge = make(), judge_of()

        def one(row: dict) -> dict:
            turns = row["m"]
            if turns is None:
                return dict.fromkeys(("a", "b", "sa", "sb"))
            a, b = (asked(model, t, Options(temperature=x))["raw"] for t, x in ((turns, 0.7), ([*turns, once_more], 1.0)))
            scores = [None, None]
            if a is not None and b is not None:
                for k, x in enumerate((a, b)):
                    ask = {"role": "user", "content": f"Input:\n{turns[-1]['content']}\n\nOutput:\n{x}"}
                    scores[k] = score_of(asked(judge, [system, ask], Options(temperature=0.0))["raw"])[0]
            return {"a": a, "b": b, "sa": scores[0], "sb": scores[1]}

        with ThreadPoolExecutor(4) as pool:
            for batch in batches:
                parts = [pa.array(list(pool.map(one, rows)), answers) for rows in in_slices([pa.RecordBatch.from_arrays([batch], ["m"])])]
                yield pa.concat_arrays(parts) if parts else pa.array([], answers)

    twice = p.withColumn("_both", both_scored.asNondeterministic()(F.col("_messages")))
    both = twice.withColumns({f"_{c}": F.col(f"_both.{c}") for c in ("a", "b", "sa", "sb")}).filter("_sa is not null and _sb is not null and _sa != _sb")
    first = F.col("_sa") > F.col("_sb")
    out = both.withColumn("chosen", F.when(first, F.col("_a")).otherwise(F.col("_b"))).withColumn("rejected", F.when(first, F.col("_b")).otherwise(F.col("_a")))
    out = out.withColumn("chosen_score", F.greatest("_sa", "_sb")).withColumn("margin", F.abs(F.col("_sa") - F.col("_sb")))
    return out.filter(F.col("chosen_score") >= min_chosen).drop("_messages", "_both", "_a", "_b", "_sa", "_sb")


def token_costs(df: DataFrame, text_col: str, price_per_1k: float, group: str | None = None) -> DataFrame:
    """Rows, mean, 10th and 90th percentile of tokens (4 characters each, rounded up), total tokens and price."""
    n = F.ceil(F.length(F.coalesce(F.col(text_col), F.lit(""))) / 4)
    by = df.groupBy(group) if group else df.groupBy()
    found = by.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(n).alias("mean_tokens"),
        F.percentile(n, 0.1).alias("p10_tokens"),
        F.percentile(n, 0.9).alias("p90_tokens"),
        F.sum(n).alias("total_tokens"),
    )
    return found.withColumn("price", F.col("total_tokens") * F.lit(price_per_1k / 1000))
