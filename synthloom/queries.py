"""The registered queries on the test tables, each with the SQL that gives the same rows.

documents stands in for a table of symbols: the text is the body, the language the kind, the source the namespace; where a
rule holds for methods only, `en` is the method kind.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthloom.functions import identity, text
from synthloom.functions.replies import string_keys
from synthloom.operators import context, dedup, dedup_index, export, filters, generate, prompts, sample, sync
from synthloom.plans import datasets, pipeline
from synthloom.providers.base import Offline, OfflineJudge
from synthloom.sources import snapshots
from synthloom.sources.declarations import read_declarations
from synthloom.sources.files import CSV
from synthloom.tables import scratch, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """documents as symbols: `symbol`, its flat columns, _ord and doc_id. kinds renames languages."""
    d = table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    fqn = F.concat("source", F.lit("."), name)
    kind = F.col("lang")
    if kinds:
        kind = F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), kind)
    columns = {
        "fully_qualified_name": fqn,
        "signature_text": F.concat("lang", F.lit(" "), fqn),
        "body_text": F.col("text"),
        "xml_doc_comment": F.lit(None).cast("string"),
        "containing_type": F.col("source"),
        "namespace": F.col("source"),
        "file_path": F.concat("source", F.lit("/"), name, F.lit(".cs")),
        "complexity": (F.floor(F.col("n_chars") / 500) + 1).cast("int"),
        "kind": kind,
    }
    s = d.select("doc_id", F.struct(*(c.alias(n) for n, c in columns.items())).alias("symbol"))
    return s.select("doc_id", F.col("doc_id").alias("_ord"), "symbol", "symbol.kind", name.alias("name"), "symbol.namespace", "symbol.file_path", "symbol.complexity")


S = """s AS (
  SELECT doc_id, source || '.' || doc_id AS fqn, lang || ' ' || source || '.' || doc_id AS sig, text AS body, lang AS kind, source AS namespace,
         source || '/' || doc_id || '.cs' AS file_path, (n_chars // 500 + 1)::INT AS complexity
  FROM documents
)"""


@query(
    "inspect_summary",
    f"""WITH {S} SELECT count(*)::BIGINT AS n_symbols, count(*) FILTER (kind = 'en')::BIGINT AS n_methods,
  round(coalesce(avg(complexity) FILTER (kind = 'en'), 0), 6) AS avg_complexity, count(DISTINCT lower(file_path))::BIGINT AS n_files FROM s""",
)
def inspect_summary(spark: SparkSession, d: str) -> DataFrame:
    return export.inspection(symbols(spark, d), "en").withColumn("avg_complexity", F.round("avg_complexity", 6))


@query("inspect_kinds", f"WITH {S} SELECT kind, count(*)::BIGINT AS n FROM s GROUP BY kind")
def inspect_kinds(spark: SparkSession, d: str) -> DataFrame:
    return export.kinds(symbols(spark, d))


@query("flatten_symbol", f"WITH {S} SELECT doc_id, kind, doc_id::VARCHAR AS name, namespace, file_path, complexity FROM s")
def flatten_symbol(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).select("doc_id", "symbol.kind", "name", "symbol.namespace", "symbol.file_path", "symbol.complexity")


@query(
    "symbol_filter",
    f"""WITH {S} SELECT doc_id, kind, complexity FROM s
WHERE kind IN ('en', 'de', 'fr') AND NOT (kind = 'en' AND complexity < 3) AND NOT (namespace = 'src1' OR starts_with(namespace, 'src1.'))""",
)
def symbol_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.symbols_kept(symbols(spark, d), ("EN", "de", "fr"), 3, ("src1",), "en").select("doc_id", "kind", "complexity")


@query(
    "project_and_file_filter",
    f"""WITH {S} SELECT doc_id, namespace IN ('src3') OR list_contains(['ref' || (doc_id % 3)], 'ref1') AS test, ends_with(lower(file_path), '7.cs') AS generated
FROM (SELECT doc_id, namespace, file_path FROM s)""",
)
def project_and_file_filter(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("namespace") == "src3", F.lit("App.UNITTESTS")).otherwise(F.col("namespace"))
    refs = F.array(F.when(F.col("doc_id") % 3 == 1, F.lit("/lib/XUnit.core.dll")).otherwise(F.lit("/lib/app.dll")))
    path = F.regexp_replace("file_path", r"7\.cs$", "7.Designer.cs")
    return symbols(spark, d).select("doc_id", filters.is_test_project(name, refs).alias("test"), filters.is_generated(path, F.lit("")).alias("generated"))


@query(
    "truncate_body",
    f"""WITH {S} SELECT doc_id, CASE WHEN len(string_split(body, chr(10))) > 3 THEN array_to_string(string_split(body, chr(10))[1:3], chr(10)) || chr(10) || '{text.MARKER}' ELSE body END AS body FROM s""",
)
def truncate_body(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).select("doc_id", text.truncate_lines(F.col("symbol.body_text"), 3).alias("body"))


@query(
    "row_identity",
    f"""WITH {S} SELECT doc_id, substr(sha256(fqn || chr(10) || 'explanation' || chr(10) || 'explanation@1'), 1, 16) AS row_id, sha256(body) AS body_sha, 'explanation@1' AS prompt_version FROM s""",
)
def row_identity(spark: SparkSession, d: str) -> DataFrame:
    s, kind = F.col("symbol"), F.lit("explanation")
    version = identity.prompt_version(kind)
    return symbols(spark, d).select("doc_id", identity.row_id(s["fully_qualified_name"], kind, version).alias("row_id"), identity.body_sha(s["body_text"]).alias("body_sha"), version.alias("prompt_version"))


U = "(('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE"


@query("uniform_sample", f"WITH {S} SELECT doc_id FROM s ORDER BY {U}, doc_id LIMIT 100")
def uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.uniform_sample(symbols(spark, d), 100).select("doc_id")


@query("weighted_sample", f"WITH {S} SELECT doc_id, complexity FROM s ORDER BY -(ln({U}) / greatest(complexity, 1)::DOUBLE), doc_id LIMIT 100")
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.weighted_sample(symbols(spark, d), 100).select("doc_id", "complexity")


@query("weighted_sample_lineitem", """SELECT l_orderkey, l_linenumber FROM lineitem
ORDER BY -(ln((('0x' || substr(md5('7:' || (l_orderkey * 10 + l_linenumber)), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE) / greatest(l_quantity::BIGINT, 1)::DOUBLE), l_orderkey * 10 + l_linenumber LIMIT 1000""")
def weighted_sample_lineitem(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("w"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_ord"))
    return sample.weighted_sample(rows, 1000, "w", seed=7).select("l_orderkey", "l_linenumber")


@query("stratified_sample", f"WITH {S} SELECT doc_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {U}, doc_id) AS r FROM s) WHERE r <= 20")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.stratified_sample(symbols(spark, d), 20, "kind").select("doc_id", "kind")


def _prompt(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = prompts.prompt(name)
        df = prompts.rendered(symbols(spark, d), name)
        return df.select("doc_id", *p.prepared(F.col("symbol")), F.col("_messages")[0]["content"].alias("system"), F.col("_messages")[1]["content"].alias("user"))

    return run


def _code(x: str) -> str:
    return f"chr(10) || '```csharp' || chr(10) || {x} || chr(10) || '```'"


_EXPLAIN = "'Explain what the ' || kind || ' `' || fqn || '` does.'"
_HALF = "(length(body) // 2)"
_AFTER = f"(instr(substr(body, {_HALF} + 1), chr(10)) + {_HALF})"
_PREFIX = f"CASE WHEN length(body) = 0 THEN body WHEN {_AFTER} > {_HALF} AND {_AFTER} < length(body) THEN substr(body, 1, {_AFTER} - 1) ELSE substr(body, 1, {_HALF}) END"
_TEST = "'Write unit tests for `' || fqn || '`.'"
_REFACTOR = "'Refactor this code of complexity ' || complexity || ' so that it is easier to read.'"
_DOCUMENT = "'Write an XML documentation comment for this declaration.'"
_ASKED = {
    "explanation": ({"instruction": _EXPLAIN, "context": "body"}, f"{_EXPLAIN} || {_code('body')}"),
    "completion": ({"prompt": _PREFIX}, f"'Continue this code:' || chr(10) || {_PREFIX}"),
    "bug-fix": ({"instruction": "'Find and fix the bug in this code.'"}, f"'Introduce one realistic bug in this code, then fix it.' || {_code('body')}"),
    "unit-test": ({"instruction": _TEST, "context": "sig"}, f"{_TEST} || chr(10) || 'Signature: ' || sig || {_code('body')}"),
    "docstring": ({"instruction": _DOCUMENT, "code": "sig"}, f"{_DOCUMENT} || {_code('sig')}"),
    "refactor": ({"instruction": _REFACTOR, "original_code": "body"}, f"{_REFACTOR} || {_code('body')}"),
    "architecture-qa": ({}, f"'Ask and answer one question on the design of this part of namespace ' || namespace || '.' || {_code('body')}"),
}
for _name, (_prepared, _user) in _ASKED.items():
    _columns = "".join(f"{sql} AS {name}, " for name, sql in _prepared.items())
    _system = prompts.PROMPTS[_name].system.replace("'", "''")
    query(f"prompt_{_name.replace('-', '_')}", f"WITH {S} SELECT doc_id, {_columns}'{_system}' AS system, {_user} AS \"user\" FROM s")(_prompt(_name))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conversations as arrays of messages in order."""
    m = F.struct("turn", "role", F.col("text").alias("content"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def _said(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


@query("conversation_messages", "SELECT conv_id, count(*)::BIGINT AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS said FROM conversations GROUP BY conv_id")
def conversation_messages(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", F.size("messages").cast("long").alias("n"), _said(F.col("messages")).alias("said"))


@query(
    "system_override",
    """SELECT conv_id, 'system: Be brief.' || coalesce(chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) FILTER (role <> 'system'), '') AS said FROM conversations GROUP BY conv_id""",
)
def system_override(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", _said(prompts.with_system(F.col("messages"), "Be brief.")).alias("said"))


G = f"g AS (SELECT doc_id, {_EXPLAIN} AS instruction, 'reply:' || substr(sha256({_ASKED['explanation'][1]}), 1, 8) AS response FROM s)"


@query("llm_generate", f"WITH {S}, {G} SELECT * FROM g")
def llm_generate(spark: SparkSession, d: str) -> DataFrame:
    return generate.generate(symbols(spark, d), Offline).select("doc_id", "instruction", "response")


@query("llm_error_rows", f"WITH {S} SELECT doc_id, 'response did not parse' AS error, 'reply:' || substr(sha256({_ASKED['bug-fix'][1]}), 1, 8) AS response_raw FROM s")
def llm_error_rows(spark: SparkSession, d: str) -> DataFrame:
    return generate.generate(symbols(spark, d), Offline, "bug-fix", drop_on_error=False).select("doc_id", "error", "response_raw")


_SCORED = "CASE n // 5 % 4 WHEN 0 THEN 1 + n % 5 WHEN 1 THEN 1 + n % 5 WHEN 2 THEN 1.5 + n % 5 END"


@query(
    "judge_filter",
    f"""WITH {S}, {G}, n AS (SELECT doc_id, ('0x' || substr(md5('Input:' || chr(10) || instruction || chr(10) || chr(10) || 'Output:' || chr(10) || response), 1, 8))::BIGINT AS n FROM g)
SELECT doc_id, ({_SCORED})::DOUBLE AS judge_score, CASE WHEN n // 5 % 4 = 0 THEN 'offline' ELSE '' END AS judge_reason FROM n WHERE ({_SCORED}) >= 3""",
)
def judge_filter(spark: SparkSession, d: str) -> DataFrame:
    made = generate.generate(symbols(spark, d), Offline)
    return generate.judge(made, OfflineJudge, 3.0).select("doc_id", F.col("judge_score").cast("double").alias("judge_score"), "judge_reason")


_AGAIN = "'reply:' || substr(sha256('Answer once more, differently.'), 1, 8)"


@query(
    "preference_pairs",
    f"""WITH {S}, u AS (SELECT doc_id, {_ASKED['explanation'][1]} AS u FROM s), r AS (SELECT doc_id, u, 'reply:' || substr(sha256(u), 1, 8) AS a, {_AGAIN} AS b FROM u),
n AS (SELECT doc_id, a, b, ('0x' || substr(md5('Input:' || chr(10) || u || chr(10) || chr(10) || 'Output:' || chr(10) || a), 1, 8))::BIGINT AS na,
             ('0x' || substr(md5('Input:' || chr(10) || u || chr(10) || chr(10) || 'Output:' || chr(10) || b), 1, 8))::BIGINT AS nb FROM r),
z AS (SELECT doc_id, a, b, ({_SCORED.replace('n ', 'na ')})::DOUBLE AS sa, ({_SCORED.replace('n ', 'nb ')})::DOUBLE AS sb FROM n)
SELECT doc_id, CASE WHEN sa > sb THEN a ELSE b END AS chosen, CASE WHEN sa > sb THEN b ELSE a END AS rejected, abs(sa - sb) AS margin
FROM z WHERE sa <> sb AND greatest(sa, sb) >= 3""",
)
def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    return generate.preference_pairs(symbols(spark, d), Offline, OfflineJudge).select("doc_id", "chosen", "rejected", F.col("margin").cast("double").alias("margin"))


_QUOTED = """'"' || replace(replace(replace(replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"'"""
_REPLY = f"""CASE doc_id % 4 WHEN 0 THEN '```json' || chr(10) || '{{"question": "q' || doc_id || '", "answer": ' || {_QUOTED} || '}}' || chr(10) || '```'
  WHEN 1 THEN ' {{"question": ' || {_QUOTED} || ', "answer": ' || n_chars || '}} ' WHEN 2 THEN '{{"question": "' || lang || '", "answer": ' || {_QUOTED} || ', "more": null}}'
  ELSE '{{"question": "x", "answer": ' || {_QUOTED} || '}} trailing' END"""


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Texts as a model would send them in JSON: between fences, with a number, with a null, and with words after the end."""
    quoted = F.coalesce("text", F.lit(""))
    for plain, escaped in (("\\", r"\\"), ('"', r"\""), ("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t")):
        quoted = F.replace(quoted, F.lit(plain), F.lit(escaped))
    quoted = F.concat(F.lit('"'), quoted, F.lit('"'))
    k = F.col("doc_id") % 4
    fenced = F.concat(F.lit('```json\n{"question": "q'), "doc_id", F.lit('", "answer": '), quoted, F.lit("}\n```"))
    number = F.concat(F.lit(' {"question": '), quoted, F.lit(', "answer": '), "n_chars", F.lit("} "))
    more = F.concat(F.lit('{"question": "'), "lang", F.lit('", "answer": '), quoted, F.lit(', "more": null}'))
    trailing = F.concat(F.lit('{"question": "x", "answer": '), quoted, F.lit("} trailing"))
    return table(spark, d, "documents").select("doc_id", F.when(k == 0, fenced).when(k == 1, number).when(k == 2, more).otherwise(trailing).alias("reply"))


@query("strip_fences", f"""WITH r AS (SELECT doc_id, {_REPLY} AS reply FROM documents) SELECT doc_id, trim(CASE WHEN doc_id % 4 = 0 THEN regexp_replace(regexp_replace(reply, '^```json\\n', ''), '```$', '') ELSE reply END, ' ' || chr(10)) AS body FROM r""")
def strip_fences(spark: SparkSession, d: str) -> DataFrame:
    return replies(spark, d).select("doc_id", text.strip_fences(F.col("reply")).alias("body"))


@query("parse_json_keys", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'q' || doc_id WHEN 2 THEN lang END AS question, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') END AS answer FROM documents")
def parse_json_keys(spark: SparkSession, d: str) -> DataFrame:
    found = string_keys(F.col("reply"), "question", "answer")
    return replies(spark, d).select("doc_id", found.alias("f")).select("doc_id", "f.question", "f.answer")


_TOKENS = "list_filter(string_split_regex(lower(text), '[ \\t\\r\\n.,;:(){}\\[\\]\"''`]+'), lambda x: x <> '')"
_SHINGLES = """CASE WHEN regexp_matches(text, '^\\s*$') THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
  ELSE list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) END"""
TOKENISED = f"t AS (SELECT doc_id, text, {_TOKENS} AS t FROM documents), g AS (SELECT doc_id, t, {_SHINGLES} AS g FROM t)"


@query("shingle_counts", f"WITH {TOKENISED} SELECT doc_id, len(t)::BIGINT AS n_tokens, len(g)::BIGINT AS n_shingles, len(list_distinct(g))::BIGINT AS n_distinct FROM g")
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"), text.shingles(F.col("text"), 3).alias("g"))
    return g.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size("g").cast("long").alias("n_shingles"), F.size(F.array_distinct("g")).cast("long").alias("n_distinct"))


_A, _B = dedup.permutations(128, 42)
SIGNED = f"""{TOKENISED}, h AS (
  SELECT DISTINCT doc_id, ('0x' || substr(md5(x), 1, 8))::BIGINT % 2147483647 AS h FROM (SELECT doc_id, unnest(g) AS x FROM g)
), p AS (SELECT unnest({_A}) AS a, unnest({_B}) AS b, unnest(range(1, 129)) AS k), m AS (
  SELECT doc_id, k, min((a::HUGEINT * h + b) % 2147483647)::BIGINT AS v FROM h, p GROUP BY doc_id, k
), sig AS (
  SELECT d.doc_id, coalesce(list(v ORDER BY k) FILTER (v IS NOT NULL), list_transform(range(128), lambda x: 4294967295)) AS sig FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id
)"""


@query("minhash_signature", f"WITH {SIGNED} SELECT doc_id, md5(array_to_string(sig, ',')) AS sig FROM sig")
def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    sig = dedup.signature(F.col("text"))
    return table(spark, d, "documents").select("doc_id", sig.alias("s")).select("doc_id", F.md5(F.array_join(F.col("s").cast("array<string>"), ",")).alias("sig"))


@query(
    "minhash_dedup",
    f"""WITH RECURSIVE {SIGNED}, slots AS (SELECT doc_id, unnest(range(128)) AS k, unnest(sig) AS v FROM sig), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM slots a JOIN slots b ON a.k = b.k AND a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 109
), earlier AS (SELECT b AS n, list(a) AS a FROM pairs GROUP BY b), o AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, coalesce(a, []) AS a FROM documents LEFT JOIN earlier ON n = doc_id
), walk AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS kept
  UNION ALL
  SELECT o.i, CASE WHEN list_has_any(walk.kept, o.a) THEN walk.kept ELSE list_append(walk.kept, o.doc_id) END FROM walk JOIN o ON o.i = walk.i + 1
)
SELECT unnest(kept) AS doc_id FROM walk WHERE i = (SELECT count(*) FROM documents)""",
)
def minhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("_ord"), "text")
    return dedup.minhash_dedup(docs, "text").select("doc_id")


@query("minhash_dedup_batches", SQL["minhash_dedup"])
def minhash_dedup_batches(spark: SparkSession, d: str) -> DataFrame:
    """Three batches of documents one after another, each against the index of what the ones before kept."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("_ord"), "text")
    at = f"{scratch(spark)}/index-{uuid.uuid4().hex}"
    cuts = docs.agg(F.expr("percentile(_ord, array(1 / 3D, 2 / 3D))").alias("c")).first().c
    batches = [docs.filter(F.col("_ord") < cuts[0]), docs.filter((F.col("_ord") >= cuts[0]) & (F.col("_ord") < cuts[1])), docs.filter(F.col("_ord") >= cuts[1])]
    kept = [written(dedup_index.near_dedup_batch(b, at, n, "text").select("doc_id"), "batch") for n, b in enumerate(batches)]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query(
    "dedup_pairs",
    f"""WITH {SIGNED}, slots AS (SELECT doc_id, unnest(range(128)) AS k, unnest(sig) AS v FROM sig)
SELECT b.doc_id AS late, a.doc_id AS early, count(*)::BIGINT AS equal FROM slots a JOIN slots b ON a.k = b.k AND a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 109""",
)
def dedup_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("_ord"), "text")
    return dedup.dedup_pairs(docs, "text")


@query(
    "cosine_dedup",
    """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_max(list_transform(embedding, lambda x: abs(x))) > 0), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.4
), earlier AS (SELECT b AS n, list(a) AS a FROM pairs GROUP BY b), o AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, coalesce(a, []) AS a FROM embeddings LEFT JOIN earlier ON n = vec_id
), walk AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS kept
  UNION ALL
  SELECT o.i, CASE WHEN list_has_any(walk.kept, o.a) THEN walk.kept ELSE list_append(walk.kept, o.vec_id) END FROM walk JOIN o ON o.i = walk.i + 1
)
SELECT unnest(kept) AS vec_id FROM walk WHERE i = (SELECT count(*) FROM embeddings)""",
)
def cosine_dedup(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("_ord"), "embedding")
    # the vectors of the test tables are far apart: a threshold above 0.52 would remove none
    return dedup.cosine_dedup(vectors, "embedding", 0.4).select("vec_id")


@query("exact_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(coalesce(text, ''))")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("_ord"), "text"), "text").select("doc_id")


def _before(spark: SparkSession, d: str) -> DataFrame:
    """What a dataset of documents held before: one in 5 was not there, one in 7 had another body; and some that are gone."""
    known = sync.facts("explanation")
    was = F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(known["body_sha"])
    s = symbols(spark, d).filter(known["symbol_fqn"].isNotNull() & (F.col("doc_id") % 5 != 0))
    body = F.coalesce("symbol.body_text", F.lit("")).alias("body")
    had = s.select(*(c.alias(n) for n, c in (known | {"body_sha": was, "row_offset": F.col("doc_id").cast("long")}).items()), body)
    key = F.col("s_suppkey")
    gone = {"id": F.concat(F.lit("gone"), key.cast("string")), "body_sha": F.lit("gone"), "row_offset": (key + 100_000_000).cast("long")}
    return had.unionByName(table(spark, d, "supplier").select(*(c.alias(n) for n, c in gone.items())), allowMissingColumns=True)


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of a dataset as of before."""
    return _before(spark, d).select("id", "body_sha", "row_offset")


ID = "substr(sha256(fqn || chr(10) || 'explanation' || chr(10) || 'explanation@1'), 1, 16)"
SYNC = f"""{S}, cur AS (SELECT {ID} AS id, sha256(body) AS sha, doc_id FROM s), man AS (
  SELECT id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha END AS sha, doc_id AS pos FROM cur WHERE doc_id % 5 <> 0
  UNION ALL SELECT 'gone' || s_suppkey, 'gone', s_suppkey + 100000000 FROM supplier
), diff AS (
  SELECT coalesce(man.id, cur.id) AS id, man.sha AS old_sha, cur.sha AS new_sha, man.pos,
         CASE WHEN man.id IS NULL THEN 'new' WHEN cur.id IS NULL THEN 'orphan' WHEN man.sha = cur.sha THEN 'unchanged' ELSE 'stale' END AS status
  FROM man FULL JOIN cur ON man.id = cur.id
)"""


@query("manifest_diff", f"WITH {SYNC} SELECT id, status, old_sha, new_sha FROM diff")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return sync.diff(manifest(spark, d), sync.current_rows(symbols(spark, d), "explanation"))


@query(
    "manifest_diff_orders",
    """SELECT coalesce(a.k, b.k) AS id, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'orphan' WHEN a.h = b.h THEN 'unchanged' ELSE 'stale' END AS status
FROM (SELECT o_orderkey::VARCHAR AS k, md5(o_orderstatus || (o_orderkey % 11 = 0)) AS h FROM orders WHERE o_orderkey % 4 <> 0) a
FULL JOIN (SELECT o_orderkey::VARCHAR AS k, md5(o_orderstatus || false) AS h FROM orders WHERE o_orderkey % 9 <> 0) b ON a.k = b.k""",
)
def manifest_diff_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")

    def rows(flag: Column) -> Column:
        return F.md5(F.concat("o_orderstatus", flag.cast("string"))).alias("body_sha")

    old = o.filter("k % 4 <> 0").select(F.col("k").cast("string").alias("id"), rows(F.col("k") % 11 == 0))
    now = o.filter("k % 9 <> 0").select(F.col("k").cast("string").alias("id"), rows(F.lit(False)))
    return sync.diff(old, now).select("id", "status")


@query("sync_plan", f"""WITH {SYNC} SELECT count(*) FILTER (status = 'new')::BIGINT AS n_new, count(*) FILTER (status = 'stale')::BIGINT AS n_stale, count(*) FILTER (status = 'unchanged')::BIGINT AS n_unchanged,
  count(*) FILTER (status = 'orphan')::BIGINT AS n_orphan, count(*) FILTER (status IN ('new', 'stale'))::BIGINT AS estimated_calls FROM diff""")
def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    return sync.plan(sync.diff(manifest(spark, d), sync.current_rows(symbols(spark, d), "explanation")))


def _sync(orphans: str, archived: bool = False) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        old = manifest(spark, d).select("id", "row_offset", F.concat(F.lit("old "), "id").alias("response"))

        def make(ids: DataFrame) -> DataFrame:
            # one id in 16 can't be made
            return ids.filter(~F.col("id").startswith("f")).select("id", "body_sha", F.concat(F.lit("new "), "id").alias("response"))

        rows, gone = sync.apply(old, manifest(spark, d).select("id", "body_sha"), sync.current_rows(symbols(spark, d), "explanation"), make, orphans)
        return gone.select("id", "response") if archived else rows.select("id", "body_sha", "response", "row_offset")

    return run


for _policy in sync.ORPHANS:
    query(
        f"sync_apply_{_policy}",
        f"""WITH {SYNC}, kept AS (
  SELECT id, pos, CASE WHEN status = 'stale' AND id NOT LIKE 'f%' THEN new_sha ELSE old_sha END AS body_sha, CASE WHEN status = 'stale' AND id NOT LIKE 'f%' THEN 'new ' ELSE 'old ' END || id AS response
  FROM diff WHERE status IN ('stale', 'unchanged'{", 'orphan'" if _policy == "keep" else ""})
  UNION ALL SELECT id, NULL, new_sha, 'new ' || id FROM diff WHERE status = 'new' AND id NOT LIKE 'f%'
)
SELECT id, body_sha, response, (row_number() OVER (ORDER BY pos NULLS LAST, id) - 1)::BIGINT AS row_offset FROM kept""",
    )(_sync(_policy))
def _synced(format: str) -> Query:
    """A dataset of an older state of documents, written and then brought up to the present by rewriting files."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        at = f"{scratch(spark)}/dataset-{uuid.uuid4().hex}"
        s = symbols(spark, d)
        now = sync.current_rows(s, "explanation")
        told = s.select(sync.facts("explanation")["id"].alias("id"), F.coalesce("symbol.body_text", F.lit("")).alias("body"))
        facts = [F.lit(None).cast("int").alias("_slot"), F.col("row_offset").alias("_at"), *(F.coalesce(c, F.lit("gone")).alias(f"_{c}") for c in snapshots.FACTS)]
        rows = _before(spark, d).select(*facts, F.concat(F.lit("old "), "id").alias("response"), F.coalesce("body", F.lit(' a "quoted",\n line ')).alias("body"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = datasets.content(rows, format).repartitionByRange(n, "_at").sortWithinPartitions("_at")
        snapshots.write_version(ordered, at, format, ["response", "body"])

        def make(ids: DataFrame) -> DataFrame:
            # one id in 16 can't be made
            return ids.filter(~F.col("id").startswith("f")).join(told, "id").select(F.col("id").alias("_id"), F.concat(F.lit("new "), "id").alias("response"), "body")

        datasets.synchronise(spark, at, now, make)
        kept = snapshots.current(at)
        held = snapshots.records(spark, at, kept, snapshots.manifest(spark, at, kept))
        if format != "parquet":
            parsed = F.from_json("value", "response string, body string") if format == "jsonl" else F.from_csv("value", "response string, body string", CSV)
            held = held.select("_id", "_body_sha", parsed.alias("r")).select("_id", "_body_sha", "r.*")
        return held.select(F.col("_id").alias("id"), F.col("_body_sha").alias("body_sha"), "response", F.sha2(F.coalesce("body", F.lit("")), 256).alias("body_now"))

    return run


for _format in snapshots.FORMATS:
    query(
        f"sync_files_{_format}",
        f"""WITH {SYNC} SELECT d.id, CASE WHEN status = 'unchanged' OR d.id LIKE 'f%' THEN old_sha ELSE new_sha END AS body_sha,
  CASE WHEN status = 'unchanged' OR d.id LIKE 'f%' THEN 'old ' ELSE 'new ' END || d.id AS response, new_sha AS body_now
FROM diff d WHERE status IN ('unchanged', 'stale') OR status = 'new' AND d.id NOT LIKE 'f%'""",
    )(_synced(_format))
query("sync_archived", f"WITH {SYNC} SELECT id, 'old ' || id AS response FROM diff WHERE status = 'orphan'")(_sync("archive", True))


def _merge(policy: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size")

        def side(keep: Column, change: Column, at: Column) -> DataFrame:
            return p.filter(keep).select(F.col("k").cast("string").alias("id"), F.md5(F.concat(F.col("k").cast("string"), change.cast("string"))).alias("body_sha"), at.alias("generated_at"))

        ours = side(F.col("k") % 3 != 0, F.col("k") % 2 == 0, F.col("p_size"))
        theirs = side(F.col("k") % 5 != 0, F.lit(False), F.lit(25))
        return sync.merge(ours, theirs, policy).select("id", "body_sha", "generated_at", "merged")

    return run


for _policy, _wins in (("ours", "false"), ("theirs", "true"), ("newer", "b.at > a.at")):
    query(
        f"dataset_merge_{_policy}",
        f"""WITH a AS (SELECT p_partkey::VARCHAR AS id, md5(p_partkey || (p_partkey % 2 = 0)::VARCHAR) AS sha, p_size AS at FROM part WHERE p_partkey % 3 <> 0),
b AS (SELECT p_partkey::VARCHAR AS id, md5(p_partkey || 'false') AS sha, 25 AS at FROM part WHERE p_partkey % 5 <> 0),
j AS (SELECT coalesce(a.id, b.id) AS id, a.sha AS asha, b.sha AS bsha, a.at AS aat, b.at AS bat, a.id IS NULL OR (b.id IS NOT NULL AND a.sha <> b.sha AND ({_wins})) AS use_b,
  CASE WHEN a.id IS NULL THEN 'theirs' WHEN b.id IS NULL THEN 'ours' WHEN a.sha = b.sha THEN 'same' ELSE 'conflict' END AS merged FROM a FULL JOIN b ON a.id = b.id)
SELECT id, CASE WHEN use_b THEN bsha ELSE asha END AS body_sha, CASE WHEN use_b THEN bat ELSE aat END AS generated_at, merged FROM j""",
    )(_merge(_policy))


def exported(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all dataset types at once, by doc_id: what a row lacks is null or empty."""
    k = F.col("doc_id") % 6

    def where(test: Column, value: Column) -> Column:
        return F.when(test, value)

    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        where(k.isin(0, 1, 2, 3), F.concat(F.lit("do "), F.col("doc_id").cast("string"))).alias("instruction"),
        where(k == 4, t).alias("question"),
        where(k == 4, F.lit("because")).alias("answer"),
        where(k == 0, t).alias("context"),
        where(k == 0, F.col("lang")).alias("response"),
        where(k == 1, F.lit("")).alias("input"),
        where(k == 1, t).alias("code"),
        where(k.isin(1, 2), F.concat(F.lit("fixed "), "source")).alias("fixed_code"),
        where(k == 3, F.lit("better")).alias("refactored_code"),
        where(k == 3, t).alias("original_code"),
        where(k.isin(2, 3), F.lit("why")).alias("explanation"),
        where(k == 5, t).alias("completion"),
    )


EXPORTED = """e AS (SELECT doc_id, doc_id % 6 AS k, 'do ' || doc_id AS i, text AS t, lang, source FROM documents), x AS (
  SELECT doc_id, CASE WHEN k <= 3 THEN i WHEN k = 4 THEN t ELSE '' END AS instruction, CASE WHEN k IN (0, 1, 3) THEN t ELSE '' END AS input,
         CASE k WHEN 0 THEN lang WHEN 1 THEN 'fixed ' || source WHEN 2 THEN 'fixed ' || source || chr(10) || chr(10) || 'why' WHEN 3 THEN 'better' || chr(10) || chr(10) || 'why' WHEN 4 THEN 'because' ELSE t END AS output
  FROM e)"""


@query("export_alpaca", f"WITH {EXPORTED} SELECT * FROM x")
def export_alpaca(spark: SparkSession, d: str) -> DataFrame:
    return export.to_alpaca(exported(spark, d), "doc_id")


@query("export_sharegpt", f"WITH {EXPORTED} SELECT doc_id, 'human' AS first, CASE WHEN input = '' THEN instruction ELSE instruction || chr(10) || chr(10) || input END AS human, 'gpt' AS second, output AS gpt FROM x")
def export_sharegpt(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("conversations")
    return export.to_sharegpt(exported(spark, d), "doc_id").select("doc_id", c[0]["from"].alias("first"), c[0]["value"].alias("human"), c[1]["from"].alias("second"), c[1]["value"].alias("gpt"))


@query("write_fields_core_only", f"WITH {S} SELECT {_EXPLAIN} AS instruction, body AS context FROM s")
def write_fields_core_only(spark: SparkSession, d: str) -> DataFrame:
    df = prompts.rendered(symbols(spark, d), "explanation").select("doc_id", "_ord", "_messages", "instruction", "context", "kind")
    return export.output_fields(df, write_metadata=False)


@query("dag_fanout_fanin", f"""WITH {S} SELECT doc_id, 'a' AS branch, complexity AS left_only, NULL::VARCHAR AS right_only FROM s UNION ALL SELECT doc_id, 'b', NULL, namespace FROM s""")
def dag_fanout_fanin(spark: SparkSession, d: str) -> DataFrame:
    def source(s: SparkSession, _: DataFrame | None, c: Mapping) -> DataFrame:
        return symbols(s, c["dir"]).select("doc_id", "complexity", "namespace")

    def branch(_: SparkSession, df: DataFrame | None, c: Mapping) -> DataFrame:
        return df.select("doc_id", F.lit(c["name"]).alias("branch"), F.col(c["take"]).alias(c["to"]))

    pipeline.register_step("_Source", source)
    pipeline.register_step("_Branch", branch)
    config = pipeline.PipelineConfig(
        "diamond",
        (
            pipeline.StepConfig("src", "_Source", (), {"dir": d}),
            pipeline.StepConfig("a", "_Branch", ("src",), {"name": "a", "take": "complexity", "to": "left_only"}),
            pipeline.StepConfig("b", "_Branch", ("src",), {"name": "b", "take": "namespace", "to": "right_only"}),
        ),
    )
    return pipeline.build(spark, config).leaves


_KINDS = {"en": "method", "de": "class", "fr": "property", "es": "interface"}
_ACCEPTS = ", ".join(f"('{n}', '{k}')" for n, p in prompts.PROMPTS.items() for k in p.kinds)
_QUOTAS = ", ".join(f"('{n}', {500 // len(prompts.PROMPTS) + (i < 500 % len(prompts.PROMPTS))})" for i, n in enumerate(prompts.PROMPTS))


@query(
    "mixed_fanout",
    f"""WITH k AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'method' WHEN 'de' THEN 'class' WHEN 'fr' THEN 'property' WHEN 'es' THEN 'interface' END AS kind FROM documents),
f AS (SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS r FROM k JOIN (VALUES {_ACCEPTS}) a(t, kind) USING (kind))
SELECT doc_id, t AS dataset_type FROM f JOIN (VALUES {_QUOTAS}) q(t, n) USING (t) WHERE r <= n""",
)
def mixed_fanout(spark: SparkSession, d: str) -> DataFrame:
    return prompts.fan_out(symbols(spark, d, _KINDS), max_rows=500).select("doc_id", "dataset_type")


@query(
    "generate_by_ledger",
    f"WITH {S}, {G} SELECT g.*, lang = 'en' OR lang = 'de' AS kept FROM g JOIN documents USING (doc_id)",
)
def generate_by_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A run over some languages, then one over all of them, which pays only for what the first one did not ask."""
    at = f"{scratch(spark)}/ledger-{uuid.uuid4().hex}"
    s, make = symbols(spark, d), generate.maker("offline")
    generate.generate(s.filter(F.col("kind").isin("en", "de")), make, ledger=at)
    return generate.generate(s, make, ledger=at, keep_reply=True).select("doc_id", "instruction", "response", F.col("reply_kept").alias("kept"))


_PARENTS = """SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"""


@query(
    "context_ancestors",
    f"""WITH RECURSIVE p AS MATERIALIZED ({_PARENTS}), a AS (SELECT child, parent AS ancestor, 1 AS depth FROM p UNION ALL SELECT a.child, p.parent, depth + 1 FROM a JOIN p ON p.child = a.ancestor WHERE depth < 5)
SELECT child, ancestor, min(depth)::INT AS depth FROM a WHERE child != ancestor GROUP BY child, ancestor""",
)
def context_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Orders, customers, suppliers, nations and regions stand in for types: a region has a fifth of all heirs."""
    links = [("orders", "o", "o_orderkey", "c", "o_custkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")]
    parents = [table(spark, d, t).select(F.concat(F.lit(a), k).alias("child"), F.concat(F.lit(b), of).alias("parent")) for t, a, k, b, of in links]
    return context.ancestors(pipeline.union(parents))


@query(
    "context_resolution",
    """WITH w AS (SELECT doc_id, lang, source, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents), f AS (SELECT lang, source, w[1] AS first FROM w WHERE len(w) > 0),
decl AS (SELECT key, min(kind) AS kind FROM (SELECT source || '.' || first AS key, lang AS kind FROM f UNION ALL SELECT first, lang FROM f WHERE lang = 'fr') GROUP BY key),
asked AS (SELECT DISTINCT source, unnest(w) AS word FROM w), scope AS (SELECT *, 0 AS rank, source || '.' || word AS key FROM asked
  UNION ALL SELECT *, 1, word FROM asked UNION ALL SELECT asked.*, 1, u || '.' || word FROM asked, (VALUES ('src1'), ('src2'), ('src3')) v(u)),
hits AS (SELECT DISTINCT source, word, rank, key, kind FROM scope JOIN decl USING (key)),
near AS (SELECT source, word, min(key) AS target, min(kind) AS target_kind FROM (SELECT *, min(rank) OVER (PARTITION BY source, word) AS best FROM hits) WHERE rank = best GROUP BY source, word HAVING count(*) = 1)
SELECT source, word, target, target_kind FROM asked LEFT JOIN near USING (source, word)""",
)
def context_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Each source declares the first words of its documents; every word of its documents is looked for there, then among the
    French ones, which all see, and in three sources that all use."""
    docs = table(spark, d, "documents")
    first = docs.select("source", F.regexp_extract("text", "[A-Za-z]+", 0).alias("first"), F.col("lang").alias("kind")).filter("first != ''")
    declared = first.select(F.concat("source", F.lit("."), "first").alias("key"), "kind").unionByName(first.filter("kind = 'fr'").select(F.col("first").alias("key"), "kind"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    asked = docs.select("source", F.explode(words).alias("name")).distinct()
    used = F.array(*(F.lit(x) for x in ("src1", "src2", "src3")))
    asked = asked.select(F.concat_ws(":", "source", "name").alias("id"), "source", "name", context.scopes(F.col("source"), F.lit(None).cast("string"), used).alias("scopes"))
    found = context.resolved(written(asked, "asked"), declared.filter("key is not null"))
    return found.select(F.split("id", ":")[0].alias("source"), F.col("name").alias("word"), "target", "target_kind")


@query(
    "token_cost_estimate",
    """SELECT lang, count(*)::BIGINT AS n_rows, round(avg(n), 6) AS mean_tokens, round(quantile_cont(n, 0.1), 6) AS p10_tokens, round(quantile_cont(n, 0.9), 6) AS p90_tokens, sum(n)::BIGINT AS total_tokens, round(sum(n) * (0.0025 / 1000)::DOUBLE, 6) AS price
FROM (SELECT lang, ceil(length(text) / 4)::BIGINT AS n FROM documents) GROUP BY lang""",
)
def token_cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    found = generate.token_costs(table(spark, d, "documents"), "text", 0.0025, "lang")
    return found.select("lang", "n_rows", *(F.round(c, 6).alias(c) for c in ("mean_tokens", "p10_tokens", "p90_tokens")), "total_tokens", F.round("price", 6).alias("price"))


@query("stream_incremental_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_incremental_dedup(spark: SparkSession, d: str) -> DataFrame:
    from synthloom.streaming.incremental import exact_stream_dedup, run_batches

    at = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    firsts = exact_stream_dedup(stream.select("user_id", "event_type"), ["user_id", "event_type"])
    run_batches(firsts, lambda x: x, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_windowed_sample",
    """SELECT day + INTERVAL 1 DAY AS window_end, event_type, event_id FROM (
  SELECT date_trunc('day', ts) AS day, event_type, event_id, row_number() OVER (PARTITION BY date_trunc('day', ts), event_type
    ORDER BY -(ln((('0x' || substr(md5('42:' || event_id), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE) / greatest(coalesce(value, 1), 1)), event_id) AS r
  FROM events WHERE ts IS NOT NULL) WHERE r <= 20 AND day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_windowed_sample(spark: SparkSession, d: str) -> DataFrame:
    from synthloom.streaming.stateful import merged, windowed_reservoirs

    at = f"{scratch(spark)}/sample-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    found = windowed_reservoirs(stream, 20, "ts", "1 day", "1 hour", "event_type", "value", order="event_id")
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return merged(spark.read.schema(found.schema).parquet(f"{at}/out"), 20, schema).select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "event_id")


@query(
    "source_pushdown",
    """WITH d AS (SELECT doc_id, source, lang, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g')) AS w FROM documents),
c AS (SELECT *, (1 + (length(w) - length(replace(w, 'E ', ''))) // 2)::INT AS complexity FROM d)
SELECT 'doc' || doc_id AS type_name, source || '.' || lang AS namespace, complexity, md5('public int Run() { return ' || replace(w, 'E ', 'E && ') || '; }') AS body_md5
FROM c WHERE complexity >= 20 AND source <> 'src1' AND NOT (source = 'src2' AND lang = 'de')""",
)
def source_pushdown(spark: SparkSession, d: str) -> DataFrame:
    """All documents written as C# files, 64 types a file, and the methods of some namespaces and a least complexity read back."""
    # what is kept is found in runs, in half of the time that dropping every other character takes
    words = F.upper(F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z ]+"), F.lit(0)), ""))
    body = F.concat(F.lit("public int Run() { return "), F.replace(words, F.lit("E "), F.lit("E && ")), F.lit("; }"))
    code = F.concat(F.lit("namespace "), "source", F.lit(" { namespace "), "lang", F.lit(" { public class doc"), "doc_id", F.lit(" { "), body, F.lit(" } } }"))
    at = f"{scratch(spark)}/sources-{uuid.uuid4().hex}"
    table(spark, d, "documents").select(code.alias("value")).write.option("maxRecordsPerFile", 64).text(at)
    found = read_declarations(spark, at, ("method",), 20, ("src1", "src2.de"), glob="*.txt")
    return found.select(F.col("containing_type").alias("type_name"), "namespace", "complexity", F.md5("body_text").alias("body_md5"))
