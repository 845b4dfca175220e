import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from synthloom.functions import text
from synthloom.functions.replies import parsed_object, score_of
from synthloom.operators import dedup, export, filters, generate, prompts, sample, sync
from synthloom.providers.base import Offline, OfflineJudge, Options


def values(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


# near duplicates


def kept(spark, texts, partitions=1, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "_ord long, response string").repartition(partitions)
    return sorted(values(dedup.minhash_dedup(df, **how), "_ord"))


def test_dedup_of_copies_and_rewordings(spark):
    rng = random.Random(8)
    base = [f"{rng.choice('bcdfg')}{i}" for i in range(120)]
    one, other = " ".join(base), " ".join(reversed(base))
    changed = " ".join(["first", *base[1:]])  # 118 of 122 three-word shingles in common
    half = " ".join(base[:60] + [f"z{i}" for i in range(60)])
    texts = [other, one, half, one.upper(), changed, other.replace(" ", ", "), "b1 c2", "b1", ""]
    assert kept(spark, texts) == [0, 1, 2, 6, 7, 8]
    assert kept(spark, texts, threshold=1.0) == [0, 1, 2, 4, 6, 7, 8]
    assert kept(spark, []) == []


def test_symbols_are_deduplicated_by_their_place(spark, tmp_path):
    from synthloom.sources.csharp import read_symbols

    body = " ".join(f"total += table[{i}] * {i};" for i in range(60))
    for name in "BAC":
        (tmp_path / f"{name}.cs").write_text(f"namespace N {{ public class {name} {{ public int Sum() {{ {body} return total; }} public int Own{name}() {{ return {ord(name)} + {name}; }} }} }}")
    symbols = read_symbols(spark, str(tmp_path), ("method",)).withColumn("body", F.col("symbol.body_text"))
    stay = dedup.minhash_dedup(symbols, "body")
    assert sorted(values(stay, "name")) == ["N.A.OwnA", "N.A.Sum", "N.B.OwnB", "N.C.OwnC"] and values(stay.filter("name LIKE '%Sum'"), "file_path") == ["A.cs"]
    made = generate.generate(sample.sample(stay, 2), Offline)
    assert made.count() == 2


def test_pairs_and_first_come(spark):
    texts = [" ".join(f"w{j}" for j in range(i, i + 40)) for i in range(0, 12, 2)] + ["x y z"]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "_ord string, response string")
    pairs = {(r.late, r.early): r.equal for r in dedup.dedup_pairs(df, threshold=0.7, num_hashes=64, shingle_size=2).collect()}
    assert pairs and all(a > b and n >= 45 for (a, b), n in pairs.items())
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("d", "b"), ("z", "y")], "late string, early string")
    assert sorted(values(dedup.first_come(edges), "o")) == ["b", "d", "z"]


def test_preference_pairs_take_one_worker(spark, monkeypatch):
    monkeypatch.setattr(generate, "HELD", 3, raising=False)
    symbols = spark.range(40).selectExpr("id AS _ord", """named_struct('fully_qualified_name', concat('A.', id), 'signature_text', 'void M()', 'body_text', concat('return ', id), 'xml_doc_comment',
        CAST(NULL AS STRING), 'containing_type', 'A', 'namespace', 'N', 'file_path', 'a.cs', 'complexity', 1, 'kind', 'method') AS symbol""")
    pairs = generate.preference_pairs(symbols, Offline, OfflineJudge)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    rows = pairs.collect()
    assert 5 < len(rows) < 40 and all(r.margin > 0 and r.chosen_score >= 3 and r.chosen != r.rejected for r in rows)


def test_small_groups_share_a_call(spark, monkeypatch):
    monkeypatch.setattr(dedup, "GROUPED", 50)
    rng = random.Random(11)
    rows = [(i, rng.randrange(40)) for i in range(400)] + [(1000 + i, 99) for i in range(120)]

    def pairs(group, starts):
        o = group.column("o").to_numpy()
        assert starts[-1] == len(o)
        found = [(o[i], o[j], len(starts) - 1) for x, y in dedup.pairs_in(starts) for i, j in zip(x, y)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))], ["i", "j", "groups"])

    got = dedup.in_groups(spark.createDataFrame(rows, "o long, b long"), ["b"], pairs, "i long, j long, groups long").collect()
    assert sorted(sorted((r.i, r.j)) for r in got) == sorted([a, b] for a, x in rows for b, y in rows if x == y and a < b)
    assert max(r.groups for r in got) > 1
    signed = spark.createDataFrame([(i, [i // 3, 1, 2]) for i in range(9)], "o long, _sig array<long>")
    plan = dedup.matches(signed.selectExpr("o", "_sig[0] AS b"), signed, 3)
    assert plan.count() == 9
    assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()


def test_dedup_of_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 8)
    rng = random.Random(3)
    texts = []
    for i in range(90):
        words = [f"w{j}" for j in range(50)]
        for _ in range(rng.randrange(12)):
            words[rng.randrange(50)] = f"v{rng.randrange(40)}"
        texts.append(" ".join(words))
    assert kept(spark, texts, threshold=0.6, num_hashes=64, shingle_size=2) == brute(texts, 0.6, 64, 2)


def test_cosine_dedup(spark):
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(120)]
    vectors += [[x + rng.gauss(0, 0.15) for x in v] for v in vectors[:60]] + [[0.0] * 16, None]
    stay = []
    for i, v in enumerate(vectors):
        def cosine(a, b):
            return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

        if not v or not any(v) or not any(vectors[j] and any(vectors[j]) and cosine(v, vectors[j]) >= 0.97 for j in stay):
            stay.append(i)
    df = spark.createDataFrame(list(enumerate(vectors)), "_ord int, embedding array<double>")
    assert sorted(values(dedup.cosine_dedup(df, threshold=0.97), "_ord")) == stay and 120 < len(stay) < 180


def test_dedup_of_blank_texts(spark):
    assert kept(spark, ["", "  ", None]) == [0]
    assert kept(spark, ["...", ""]) == [0, 1]


def brute(texts, threshold, n, k, seed=42):
    a, b = dedup.permutations(n, seed)

    def sig(t):
        h = {int(__import__("hashlib").md5(s.encode()).hexdigest()[:8], 16) % dedup.PRIME for s in dedup.shingle_strings(t, k)}
        return [min((x * v + y) % dedup.PRIME for v in h) if h else 0xFFFFFFFF for x, y in zip(a, b)]

    stay = []
    for i, s in enumerate(map(sig, texts)):
        if not any(sum(x == y for x, y in zip(s, o)) >= dedup.required(threshold, n) for _, o in stay):
            stay.append((i, s))
    return [i for i, _ in stay]


def test_dedup_is_greedy_and_the_same_in_any_partitioning(spark):
    words = [f"w{i}" for i in range(60)]
    # a chain: each text is near the next one, the ends are not near each other
    texts = [" ".join(words[i : i + 40]) for i in range(0, 20, 1)] + [" ".join(words[:40])] + ["x y z"]
    how = {"threshold": 0.7, "num_hashes": 64, "shingle_size": 2}
    want = brute(texts, 0.7, 64, 2)
    assert 1 < len(want) < len(texts)
    assert kept(spark, texts, 1, **how) == want
    assert kept(spark, texts, 7, **how) == want


def test_exact_dedup(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "_ord long, t string")
    assert sorted(values(dedup.exact_dedup(df, "t"), "_ord")) == [1, 2, 4]


# samples


def test_samples(spark):
    df = spark.range(60).select(F.col("id").alias("_ord"), F.when(F.col("id") % 4 == 0, 9).when(F.col("id") % 4 == 1, -3).otherwise(None).alias("complexity"))
    assert sample.sample(df, -1).count() == 60 and sample.sample(df, 61).count() == 60
    for strategy in sample.STRATEGIES:
        drawn = values(sample.sample(df, 17, strategy, 9), "_ord")
        assert len(set(drawn)) == 17 and drawn == sorted(drawn) == values(sample.sample(df.repartition(5), 17, strategy, 9), "_ord")
        assert drawn != values(sample.sample(df, 17, strategy, 10), "_ord")
    with pytest.raises(ValueError, match="unknown sampling"):
        sample.sample(df, 1, "best")


def test_samples_draw_by_weight(spark):
    # one of two rows is drawn first with the share of its weight; the rest follow the same rule
    df = spark.range(40).select(F.col("id").alias("_ord"), F.when(F.col("id") < 10, 4).otherwise(1).alias("complexity"))
    heavy = [sum(x == 4 for x in values(sample.weighted_sample(df, 8, seed=s), "complexity")) for s in range(12)]
    rng = random.Random(0)
    simulated = []
    for _ in range(4000):
        left, drawn = [4] * 10 + [1] * 30, 0
        for _ in range(8):
            at = rng.choices(range(len(left)), left)[0]
            drawn += left.pop(at) == 4
        simulated.append(drawn)
    want = sum(simulated) / len(simulated)
    assert abs(sum(heavy) / len(heavy) - want) < 1.2
    assert sum(x == 9 for x in values(sample.weighted_sample(spark.range(120).select(F.col("id").alias("_ord"), F.when(F.col("id") < 90, 1).otherwise(9).alias("complexity")), 30), "complexity")) > 15


def test_stratified_sample_takes_all_of_small_strata(spark):
    df = spark.range(1000).select(F.col("id").alias("_ord"), F.when(F.col("id") < 3, "rare").otherwise("often").alias("s"))
    assert dict(values(sample.stratified_sample(df, 10, "s").groupBy("s").count(), "s", "count")) == {"rare": 3, "often": 10}


# replies, generation, judge


def test_score_cases():
    assert score_of('{"score":4,"reason":"good"}') == (4.0, "good")
    assert score_of('```json\n{"score":"3.5"}\n```') == (3.5, "")
    for bad in ("not json", '{"score":true}', '{"score":null}', '{"score":[1]}', "{}", '{"score":4} x', '{"score":"NaN"}', '{"score":NaN}', None, "[1]"):
        assert score_of(bad) == (None, None)


def test_parsed_object_needs_json():
    assert parsed_object("{'a': 1}") is None
    assert parsed_object('{"a": 1}') == {"a": 1}


def symbol_rows(spark, *bodies):
    rows = [(i, ("N.C.M", "void M()", b, None, "C", "N", "f.cs", 3, "method")) for i, b in enumerate(bodies)]
    rows.append((len(rows), None))
    from synthloom.schema import SYMBOL

    return spark.createDataFrame(rows, f"_ord long, symbol {SYMBOL.simpleString()}")


class Failing(Offline):
    def complete(self, messages, options):
        raise RuntimeError("no answer")


class Fixing(Offline):
    def complete(self, messages, options):
        return '```json\n{"buggy_code": "a", "fixed_code": "b", "explanation": "c", "more": 1}\n```'


def test_generate_cases(spark):
    df = symbol_rows(spark, "x", "y")
    made = generate.generate(df, Offline)
    assert made.count() == 2 and "response" in made.columns and "_messages" not in made.columns
    assert generate.generate(df, Failing).count() == 0
    assert values(generate.generate(df, Failing, drop_on_error=False), "error") == ["no answer"] * 2
    assert values(generate.generate(df, Fixing, "BugFix"), "buggy_code", "fixed_code", "explanation") == [("a", "b", "c")] * 2
    with pytest.raises(ValueError, match="unknown dataset type"):
        generate.generate(df, Offline, "poem")
    with pytest.raises(ValueError, match="unknown provider"):
        generate.maker("nobody")


def test_bug_fixes_are_pairs_by_themselves(spark):
    class Never(OfflineJudge):
        def complete(self, messages, options):
            raise AssertionError("a judge was asked")

    pairs = generate.preference_pairs(symbol_rows(spark, "x"), Fixing, Never, dataset_type="bug-fix")
    assert values(pairs, "chosen", "rejected", "margin") == [("b", "a", generate.BUG_FIX_MARGIN)]


def test_judge_drops_empty_outputs_before_the_call(spark):
    class Strict(OfflineJudge):
        def complete(self, messages, options):
            return '{"score": %d, "reason": "r"}' % (4 if "good" in messages[-1]["content"] else 2)

    df = spark.createDataFrame([("i", "good"), ("i", "bad"), ("i", ""), ("i", None)], "instruction string, response string")
    assert values(generate.judge(df, Strict), "response", "judge_score", "judge_reason") == [("good", 4.0, "r")]


def test_offline_judge_answers_in_every_shape():
    shapes = {OfflineJudge().complete([{"role": "user", "content": str(i)}], Options())[:5] for i in range(50)}
    assert len(shapes) >= 3


# texts and filters


def test_text_functions(spark):
    df = spark.createDataFrame([("ab\ncd\nef",), ("abcd",), ("",), ("abc\n",), (None,)], "t string")
    assert values(df, text.midpoint_prefix(F.col("t"))) == ["ab\ncd", "ab", "", "ab", None]
    assert values(df, text.truncate_lines(F.col("t"), 2))[0] == f"ab\ncd\n{text.MARKER}"
    fenced = spark.createDataFrame([("```json\n{}\n```",), ("```x```",), (" a ",), (" a\t",)], "t string")
    assert values(fenced, text.strip_fences(F.col("t"))) == ["{}", "```x", "a", "a"]
    assert values(spark.createDataFrame([("` x` ",)], "t string"), text.strip_backticks(F.col("t"))) == [" x"]


def test_namespace_filter(spark):
    df = spark.createDataFrame([("A",), ("A.B",), ("AB",), (None,)], "n string")
    assert values(df.filter(filters.namespace_kept(F.col("n"), ["A"])), "n") == ["AB", None]


def test_system_override(spark):
    m = F.array(*(prompts.message(r, F.lit(c)) for r, c in (("system", "old"), ("user", "u"), ("system", "older"), ("assistant", "a"))))
    got = spark.range(1).select(prompts.with_system(m, "new").alias("m")).first().m
    assert [(x.role, x.content) for x in got] == [("system", "new"), ("user", "u"), ("assistant", "a")]


# synchronisation and export


def test_diff_cases(spark):
    now = spark.createDataFrame([("n", "1"), ("u", "1"), ("s", "2")], "id string, body_sha string")
    old = spark.createDataFrame([("u", "1"), ("s", "1"), ("o", "1")], "id string, body_sha string")
    assert dict(values(sync.diff(old, now), "id", "status")) == {"n": "new", "u": "unchanged", "s": "stale", "o": "orphan"}
    assert set(values(sync.diff(None, now), "status")) == {"new"}
    assert sync.diff(old.limit(0), now.limit(0)).count() == 0
    assert sync.plan(sync.diff(old, now)).first().estimated_calls == 2
    for a, b in ((old.union(old), now), (old, now.union(now)), (None, now.union(now))):
        with pytest.raises(Exception, match="occurs 2 times"):
            sync.diff(a, b).collect()
    theirs = now.withColumn("body_sha", F.lit("9"))
    assert set(values(sync.merge(now, theirs, "regenerate"), "merged", "body_sha")) == {("regenerate", "1"), ("regenerate", "2")}


def test_second_sync_makes_nothing(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, body_sha string")
    asked = []

    def make(ids):
        asked.append(ids.count())
        return ids.select("id", "body_sha", F.lit("r").alias("response"))

    none = spark.createDataFrame([], "id string, row_offset int, response string")
    rows, _ = sync.apply(none, None, now, make)
    again, _ = sync.apply(rows.select("id", "row_offset", "response"), rows.select("id", "body_sha"), now, make)
    assert asked == [2, 0]
    assert sorted(values(again, "id", "row_offset", "response", "body_sha")) == [("a", 0, "r", "1"), ("b", 1, "r", "2")]


def test_export_skips_values_that_are_no_strings(spark):
    df = spark.createDataFrame([('{"instruction": "", "question": "q", "output": 5, "answer": "a"}',)], "j string").select(F.parse_json("j").alias("row"))
    from synthloom.sources.files import variant_columns

    rows = variant_columns(df, "instruction", "question", "output", "answer")
    assert values(export.to_alpaca(rows), "instruction", "input", "output") == [("q", "", "a")]


def test_fan_out_respects_kinds_and_quota(spark):
    df = symbol_rows(spark, *map(str, range(20))).filter("symbol is not null")
    got = dict(values(prompts.fan_out(df, max_rows=15).groupBy("dataset_type").count(), "dataset_type", "count"))
    assert got == {n: 3 if i == 0 else 2 for i, n in enumerate(prompts.PROMPTS) if n != "architecture-qa"}


def test_partition_invariance_of_uniform(spark):
    u = [sorted(values(spark.range(50).repartition(n), text.uniform(1, F.col("id")))) for n in (1, 5)]
    assert u[0] == u[1] and all(0 < x < 1 for x in u[0])
    assert len(set(itertools.chain(*u))) == 50


def test_generated_files_are_known_by_all_that_precedes_the_code(spark, tmp_path):
    from synthloom.sources.csharp import read_symbols

    body = "namespace N { class %s { int M() { return 1; } } }"
    licence = "// a long licence line\r\n" * 200
    (tmp_path / "A.cs").write_text(licence + "#nullable enable\n/* * <Auto-Generated/> */\n" + body % "Made")
    (tmp_path / "B.cs").write_text('namespace N { class Own { string M() { return "<auto-generated>"; } } }')
    (tmp_path / "C.cs").write_text("/* not closed <auto-generated\n" + licence)
    (tmp_path / "D.cs").write_text(licence + body % "Plain")
    paths = {r.file_path.rsplit("/", 1)[-1] for r in read_symbols(spark, str(tmp_path)).select("file_path").collect()}
    assert paths == {"B.cs", "D.cs"}


def test_cosine_clusters_make_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(3, 24))
    vectors = [centres[0] + 0.02 * rng.normal(size=24) for _ in range(600)] + [centres[k % 3] + 0.35 * rng.normal(size=24) for k in range(120)] + list(rng.normal(size=(150, 24)))
    order = rng.permutation(len(vectors))
    df = spark.createDataFrame([(k, [float(x) for x in vectors[i]]) for k, i in enumerate(order)] + [(9000, None), (9001, [0.0] * 24)], "_ord long, embedding array<double>")
    made = {}
    real = dedup.written

    def counted(rows, name):
        out = real(rows, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(dedup, "written", counted)
    got = {r._ord for r in dedup.cosine_dedup(df, threshold=0.9).collect()}
    unit = [vectors[i] / np.linalg.norm(vectors[i]) for i in order]
    stay = []
    for k, v in enumerate(unit):
        if all(v @ unit[s] < 0.9 for s in stay):
            stay.append(k)
    assert got == {*stay, 9000, 9001} and 150 < len(stay) < 330
    assert made["edges"] < 3 * len(unit)  # all pairs of the cluster would be 180,000
    with pytest.raises(ValueError, match="can't be compared"):
        dedup.cosine_dedup(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "_ord long, embedding array<double>"))


def test_cosine_of_low_thresholds_makes_no_copies(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = [*rng.normal(size=(1800, 16)), *(rng.normal(size=16) * 0.05 + np.ones(16) for _ in range(300))]
    order = rng.permutation(len(vectors))
    df = spark.createDataFrame([(f"k{k:05}", [float(x) for x in vectors[i]]) for k, i in enumerate(order)] + [("z", None)], "_ord string, embedding array<double>")
    made = []
    real = dedup.written
    monkeypatch.setattr(dedup, "written", lambda rows, name: made.append((out := real(rows, name)).count()) or out)
    monkeypatch.setattr(dedup, "STEP", 50)
    got = sorted(values(dedup.cosine_dedup(df, threshold=0.4), "_ord"))
    unit = [vectors[i] / np.linalg.norm(vectors[i]) for i in order]
    stay = []
    for k, v in enumerate(unit):
        if all(v @ unit[s] < 0.4 for s in stay):
            stay.append(k)
    assert got == [*(f"k{k:05}" for k in stay), "z"] and len(stay) > 50  # several steps
    assert max(made) <= len(vectors)  # more than 60 copies of each vector before


def test_many_rows_are_picked_by_a_bound(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("id AS _ord", "CAST(id % 7 AS INT) AS complexity", "CAST(id % 3 AS INT) AS tied")
    for k in (1, 4_000, 19_999, 20_000, 30_000):
        want = [sorted(r._ord for r in f(df, k).select("_ord").collect()) for f in (sample.uniform_sample, sample.weighted_sample)]
        monkeypatch.setattr(sample, "MERGED", 50)
        assert [[r._ord for r in f(df, k).select("_ord").collect()] for f in (sample.uniform_sample, sample.weighted_sample)] == want
        monkeypatch.undo()
    monkeypatch.setattr(sample, "MERGED", 50)
    low, high, before = sample._bounds(df.select(F.col("tied").cast("double").alias("_sample_key")), 10_000)
    assert (low, high, before) == (1.0, 1.0, 6_667)
    assert sample._least(df, F.col("tied"), 10_000, F.col("_ord")).groupBy("tied").count().filter("tied = 1").first()[1] == 3_333
