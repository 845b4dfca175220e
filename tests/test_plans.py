import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthloom import cli
from synthloom.plans import datasets
from synthloom.plans import pipeline as p
from synthloom.providers.base import Offline, Options, ProviderError, provider
from synthloom.providers.http import SERVICES, Http, delay, error_text, model_not_found
from synthloom.sources import csharp, files
from synthloom.streaming.incremental import dedup_against_kept, run_batches


def config(*steps):
    return p.PipelineConfig("t", tuple(p.StepConfig(n, t, tuple(d), c) for n, t, d, c in steps))


@pytest.fixture(autouse=True)
def steps():
    p.register_step("_rows", lambda s, df, c: s.createDataFrame([(i,) for i in c["ids"]], "id int"))
    p.register_step("_tag", lambda s, df, c: df.withColumn(c["name"], F.lit(1)))
    p.register_step("_fail", lambda s, df, c: df.select(F.raise_error(F.lit("broken")).cast("int").alias("id")))


def test_topologies(spark):
    linear = p.build(spark, config(("a", "_rows", (), {"ids": [1]}), ("b", "_tag", "a", {"name": "x"}), ("c", "_tag", "b", {"name": "y"})))
    assert [tuple(r) for r in linear.leaves.collect()] == [(1, 1, 1)]
    assert linear.rows["a"].get["rows"] == 1
    diamond = p.build(spark, config(("a", "_rows", (), {"ids": [1, 2]}), ("b", "_tag", "a", {"name": "x"}), ("c", "_tag", "a", {"name": "y"}), ("d", "_tag", "bc", {"name": "z"})))
    assert sorted(r.id for r in diamond.leaves.collect()) == [1, 1, 2, 2]
    fan_out = p.build(spark, config(("a", "_rows", (), {"ids": [1, 2]}), ("b", "_tag", "a", {"name": "x"}), ("c", "_tag", "a", {"name": "y"})))
    assert fan_out.leaves.count() == 4
    assert p.build(spark, config(("a", "_rows", (), {"ids": []}))).leaves.count() == 0


def test_wrong_plans():
    with pytest.raises(ValueError, match="cycle"):
        p.checked(config(("a", "_tag", "b", {}), ("b", "_tag", "a", {})))
    with pytest.raises(KeyError):
        p.checked(config(("a", "_tag", "z", {})))
    with pytest.raises(ValueError, match="two steps"):
        p.checked(config(("a", "_rows", (), {}), ("a", "_rows", (), {})))
    with pytest.raises(ValueError, match="unknown step type"):
        p.checked(config(("a", "Nothing", (), {})))


def test_failing_step_surfaces(spark):
    built = p.build(spark, config(("a", "_rows", (), {"ids": [1]}), ("b", "_fail", "a", {})))
    with pytest.raises(Exception, match="broken"):
        built.leaves.collect()


CODE = """
namespace App.Core {
    /// <summary>Adds.</summary>
    public class Calc<T> : Base {
        public Calc(int x) : base(x) { }
        /// <summary>Sum.</summary>
        public int Add(int a, int b) { if (a > 0 && b > 0) { return a + b; } return 0; }
        private void Hidden() { }
        public string Name { get; set; }
        internal static string Say() => "if (x) { }";
    }
    internal enum Colour { Red }
}
"""


def test_symbols(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "Calc.cs").write_text(CODE)
    (tmp_path / "src" / "Calc.g.cs").write_text(CODE)
    got = {r.symbol.fully_qualified_name: r for r in csharp.read_symbols(spark, str(tmp_path), ("method", "class", "property", "constructor", "enum")).collect()}
    assert set(got) == {"App.Core.Calc<T>", "App.Core.Calc<T>.Calc", "App.Core.Calc<T>.Add", "App.Core.Calc<T>.Name", "App.Core.Calc<T>.Say", "App.Core.Colour"}
    add = got["App.Core.Calc<T>.Add"]
    assert (add.kind, add.complexity, add.namespace, add.symbol.xml_doc_comment) == ("method", 3, "App.Core", "<summary>Sum.</summary>")
    assert got["App.Core.Calc<T>.Say"].complexity == 1


def test_interface_members_need_no_modifier(spark, tmp_path):
    (tmp_path / "I.cs").write_text(
        """namespace N; public interface IStore<T> where T : class {
    int Count(int from, T? to);
    string Name { get; }
    private void Own() { }
    protected internal void Shared();
    bool Empty() { if (Count(0, null) > 0) { return false; } int Local(int x) { return x; } return true; }
    public class Inner { int hidden; public int Seen() => 1; void Not() { } }
    T Last();
}
class Plain { int Field() { return 1; } }"""
    )
    got = {r.symbol.fully_qualified_name: r.kind for r in csharp.read_symbols(spark, str(tmp_path)).collect()}
    members = {"Count": "method", "Name": "property", "Shared": "method", "Empty": "method", "Inner": "class", "Inner.Seen": "method", "Last": "method"}
    assert got == {"N.IStore<T>": "interface", "N.Plain": "class", **{f"N.IStore<T>.{k}": v for k, v in members.items()}}


def solution(root):
    """A solution of two projects, one for tests by what it refers to, and a project and a file beside them."""
    for folder, reference, name in (("App", "Newtonsoft.Json", "A"), ("App/Checks", "XUnit.Core", "B"), ("Other", "x", "C")):
        (root / folder).mkdir(parents=True, exist_ok=True)
        (root / folder / f"{folder.split('/')[-1]}.csproj").write_text(f'<Project><ItemGroup><PackageReference Include="{reference}" /></ItemGroup></Project>')
        (root / folder / f"{name}.cs").write_text(f"namespace N {{ public class {name} {{ }} }}")
    (root / "Loose.cs").write_text("namespace N { public class Loose { } }")
    line = 'Project("{1}") = "%s", "%s", "{2}"\nEndProject\n'
    (root / "All.sln").write_text(line % ("App", ".\\App\\App.csproj") + line % ("Checks", "Other\\..\\App\\Checks\\Checks.csproj"))


def test_solutions_and_projects(spark, tmp_path):
    solution(tmp_path)

    def names(path, **how):
        return {r.symbol.fully_qualified_name: r.file_path for r in csharp.read_symbols(spark, str(path), **how).collect()}

    assert names(tmp_path / "All.sln") == names(tmp_path) == {"N.A": "App/A.cs"}
    assert names(tmp_path / "All.sln", include_tests=True) == {"N.A": "App/A.cs", "N.B": "App/Checks/B.cs"}
    assert names(tmp_path / "Other" / "Other.csproj") == {"N.C": "C.cs"}
    (tmp_path / "All.sln").unlink()
    assert set(names(tmp_path)) == {"N.A", "N.C"}


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("int? n = null; string? s = o?.Name; n ??= 4; return n;", 1),
        ('// if (a && b)\nvar s = "for (;;) || ??"; /* while (x) { } */ return s;', 1),
        ('items.Where(i => i > 0 && i < 9).Select(i => i % 2 == 0 ? "even" : "odd")', 3),
        ("var r = shape switch { Circle c when c.R > 0 => c.R switch { > 9 => 1, _ => 2 }, Square q => Fit(q, x => x + 1), _ => 4 };", 6),
        ("foreach (var a in xs) { if (a == null) continue; try { Go(a); } catch (E) when (a.Ok || a.Late) { while (a.Next()) { } } }", 6),
        ("switch (k) { case > 3 when k < 9: A(); break; case 1: case 2: B(); break; default: break; }", 4),
        ("Func<int, Func<int, int>> f = a => b => a > b ? a : b; return f(1)(2) == 2 || f(2)(1) == 2;", 3),
    ],
)
def test_complexity(body, want):
    assert csharp.complexity(body) == want


def test_dataset_follows_its_sources(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()

    def sources(**bodies):
        (src / "A.cs").write_text("namespace N { public class A { %s } }" % " ".join(f"public int {n}() {{ {b} }}" for n, b in bodies.items()))
        return csharp.read_symbols(spark, str(src), ("method",))

    def held():
        manifest = {r.symbol_fqn: r for r in files.read_manifest(spark, out).collect()}
        lines = {r.row_offset: json.loads(r.value) for r in files.lines_with_offsets(spark, f"{out}/data").collect()}
        assert sorted(lines) == sorted(r.row_offset for r in manifest.values())
        return {name: lines[r.row_offset] for name, r in manifest.items()}

    class Picky(Offline):
        def complete(self, messages, options):
            if "refused" in messages[-1]["content"]:
                raise RuntimeError("no")
            return super().complete(messages, options)

    symbols = sources(One="return 1;", Two="return 2;", Three="refused();", Four="return 4;")
    datasets.generate_dataset(spark, symbols, out, Picky)
    first = held()
    assert set(first) == {"N.A.One", "N.A.Two", "N.A.Four"} and all(first[n]["symbol"]["fully_qualified_name"] == n for n in first)
    symbols = sources(One="return 1;", Two="return 22;", Three="return 3;", Five="return 5;")
    planned = datasets.sync_dataset(spark, symbols, out, Picky, dry_run=True)
    assert (planned.n_new, planned.n_stale, planned.n_unchanged, planned.n_orphan) == (2, 1, 1, 1) and held() == first
    datasets.sync_dataset(spark, symbols, out, Picky, orphans="keep")
    second = held()
    assert set(second) == {"N.A.One", "N.A.Two", "N.A.Three", "N.A.Four", "N.A.Five"}
    assert second["N.A.One"] == first["N.A.One"] and second["N.A.Four"] == first["N.A.Four"] and second["N.A.Two"] != first["N.A.Two"]
    datasets.sync_dataset(spark, symbols, out, Picky, orphans="archive")
    assert set(held()) == {"N.A.One", "N.A.Two", "N.A.Three", "N.A.Five"}
    (gone,) = spark.read.option("recursiveFileLookup", True).text(f"{out}/_archive").collect()
    assert json.loads(gone.value)["symbol"]["fully_qualified_name"] == "N.A.Four"

    class Never(Offline):
        def complete(self, messages, options):
            raise AssertionError("asked again")

    assert datasets.sync_dataset(spark, symbols, out, Never).estimated_calls == 0
    with pytest.raises(Exception, match="occurs 2 times"):
        datasets.sync_dataset(spark, symbols.unionByName(symbols), out, Never)


def test_command_line_of_datasets(spark, tmp_path):
    solution(tmp_path / "s")
    at, out = str(tmp_path / "s"), str(tmp_path / "out")
    assert cli.main(["generate", at, out, "--dry-run"]) == 0
    assert spark.read.json(f"{out}/data").first().kind == "class"
    assert cli.main(["sync", at, out, "--dry-run", "--exclude-namespaces", "X, Y,"]) == 0
    assert cli.main(["migrate", at, out]) == 2  # it has a manifest
    old = tmp_path / "old"
    old.mkdir()
    (old / "rows.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert datasets.migrate_dataset(spark, str(old)) == 2 and files.read_manifest(spark, str(old)).count() == 0
    assert cli.main(["sync", at, str(old)]) == 0 and files.read_manifest(spark, str(old)).count() == 1
    assert cli.main(["inspect", at, "--report", str(tmp_path / "report")]) == 0
    report = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "report" / "summary"), wholetext=True).collect()))
    assert report["by_kind"] == {"class": 1} and spark.read.json(str(tmp_path / "report" / "symbols")).first().fully_qualified_name == "N.A"


def test_exports_keep_files_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"instruction": "i", "chosen": "c", "rejected": "r", "output": "o"}\n')
    (tmp_path / "in" / "b.jsonl").write_text('{"question": "q", "question": "later", "answer": "a"}\n{"question": "q2"}\n')
    for form in datasets.FORMATS:
        datasets.export_dataset(spark, str(tmp_path / "in"), str(tmp_path / form), form)
        got = {r.source_file: r.n for r in spark.read.json(str(tmp_path / form)).groupBy("source_file").agg(F.count("*").alias("n")).collect()}
        assert got == {"a": 1, "b": 2}, form
    pair = spark.read.json(str(tmp_path / "preference")).filter("source_file = 'a'").first()
    assert (pair.prompt, pair.chosen, pair.rejected) == ("i", "c", "r")
    assert {r.instruction for r in spark.read.json(str(tmp_path / "alpaca")).collect()} == {"i", "later", "q2"}


def test_environment_overrides_configurations():
    text = "Name: x\nsteps:\n- {name: a, type: RoslynSymbolExtractor}\n- {name: b, type: StratifiedSampler, DependsOn: [a], Config: {MaxRows: 3}}\noutput: {dir: here}"
    c = p.load(text, {"STEPS__1__CONFIG__MAX_ROWS": "7", "Output__Dir": "there", "STEPS__9__NAME": "none", "PATH": "x"})
    assert (c.name, c.steps[0].type, c.steps[1].depends_on, c.steps[1].config, c.output) == ("x", "SymbolExtractor", ("a",), {"max_rows": 7}, {"dir": "there"})


def test_yaml_run_and_export(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "Calc.cs").write_text(CODE)
    yaml = p.TEMPLATES["custom"].format(name="mine").replace("./src", "${SRC}").replace("min_complexity: 3", "min_complexity: 0")
    c = p.load(yaml, {"SRC": str(tmp_path / "src")})
    assert c.steps[1].config["max_rows"] == 1000 and c.steps[1].depends_on == ("symbols",)
    counts = p.run(spark, c, str(tmp_path / "out"), max_rows=2)
    assert counts["sampled"] == counts["generated"] == 2
    rows = files.read_jsonl(spark, str(tmp_path / "out"))
    assert rows.count() == 2
    assert cli.main(["export", str(tmp_path / "out"), str(tmp_path / "alpaca"), "--format", "alpaca"]) == 0
    got = spark.read.json(str(tmp_path / "alpaca")).collect()
    assert all(g.instruction and g.output.startswith("reply:") for g in got)
    assert cli.main(["export", "x"]) == 2
    assert cli.main(["run", str(tmp_path / "none.yaml")]) == 1


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": "x", "n": 1}\n\nbroken\n[1]\n{"a": "y"}\n{"a": "v", "n": 1.50, "a": "w"}\n{"a": 1')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 3
    assert [r.a for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), T.StructType().add("a", "string")).collect()] == ["x", "y", "w"]
    df = spark.createDataFrame([(1, "a,\"b\"\nc", None, (1, "x"))], "_ord int, instruction string, response string, symbol struct<k:int,v:string>")
    files.write_dataset(df, str(tmp_path / "csv"), "CSV")
    got = spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, quote='"', escape='"').first()
    assert (got.instruction, got.symbol) == ("a,\"b\"\nc", '{"k":1,"v":"x"}')
    files.write_dataset(df, str(tmp_path / "json"), write_metadata=False)
    assert json.loads(spark.read.text(str(tmp_path / "json")).first().value) == {"instruction": 'a,"b"\nc', "response": None}
    files.write_dataset(df, str(tmp_path / "parquet"), "parquet")
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1
    with pytest.raises(ValueError, match="unknown format"):
        files.write_dataset(df, "x", "xml")


def test_manifest_round_trip_and_offsets(spark, tmp_path):
    assert files.read_manifest(spark, str(tmp_path)) is None
    rows = spark.createDataFrame([("i", "f", "method", "explanation", "s", "explanation@1", 2)], "id string, symbol_fqn string, symbol_kind string, dataset_type string, body_sha string, prompt_version string, row_offset long")
    files.write_manifest(rows, str(tmp_path))
    back = files.read_manifest(spark, str(tmp_path))
    assert back.collect() == rows.collect()
    (tmp_path / "d.jsonl").write_text('{"n":0}\n\n{"n":2}\n')
    assert [(r.id, r.value) for r in files.existing_rows(spark, str(tmp_path / "d.jsonl"), back).collect()] == [("i", '{"n":2}')]


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "_ord long, t string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("_ord long, t string").parquet(str(source))
    run_batches(stream, lambda x: x.filter("t = 'a'"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "_ord long, t string")
    kept = str(tmp_path / "kept")
    assert sorted(r._ord for r in dedup_against_kept(spark, first, "t", kept, 0).collect()) == [1, 2]
    more = spark.createDataFrame([(4, "b"), (5, "c")], "_ord long, t string")
    assert [r._ord for r in dedup_against_kept(spark, more, "t", kept, 1).collect()] == [5]


# providers


class Service(http.server.BaseHTTPRequestHandler):
    answers: list = []
    seen: list = []

    def do_POST(self):
        self.seen.append((self.path, dict(self.headers), json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or "null")))
        code, body, headers = self.answers.pop(0)
        self.send_response(code)
        for k, v in headers.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    do_GET = do_POST

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.seen, Service.answers = [], []
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


TURNS = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]


def test_chat_service(service):
    Service.answers = [(500, {}, {"Retry-After": "0"}), (200, {"choices": [{"message": {"content": "hi"}}]}, {})]
    assert provider("OpenAI", base=service, key="k").complete(TURNS, Options("m", 0.5, 9)) == "hi"
    path, headers, body = Service.seen[-1]
    assert (path, headers["Authorization"], body) == ("/chat/completions", "Bearer k", {"messages": TURNS, "model": "m", "temperature": 0.5, "max_tokens": 9})


def test_other_services(service):
    Service.answers = [(200, {"content": [{"text": "c"}]}, {}), (200, {"candidates": [{"content": {"parts": [{"text": "g"}]}}]}, {}), (200, {"choices": [{"message": {"content": "z"}}]}, {})]
    assert Http(SERVICES["anthropic"], service, "k").complete(TURNS, Options("m")) == "c"
    assert Service.seen[-1][2] == {"messages": TURNS[1:], "max_tokens": 4096, "system": "s", "model": "m"}
    assert provider("google", base=service, key="k").complete(TURNS, Options("m", max_tokens=5)) == "g"
    assert [c["role"] for c in Service.seen[-1][2]["contents"]] == ["user", "model"] and Service.seen[-1][2]["generationConfig"] == {"maxOutputTokens": 5}
    assert provider("azure", base=service, key="k", deployment="d").complete(TURNS, Options("m")) == "z"
    assert "/deployments/d/" in Service.seen[-1][0] and "model" not in Service.seen[-1][2]


def test_failures(service):
    Service.answers = [(404, {"error": {"message": "no such model\nmore"}}, {})]
    with pytest.raises(ProviderError, match="^HTTP 404: no such model$"):
        provider("lmstudio", base=service).complete(TURNS, Options("m"))
    Service.answers = [(200, {"choices": []}, {})]
    with pytest.raises(ProviderError, match="holds no text"):
        provider("ollama", base=service).complete(TURNS, Options("m"))
    Service.answers = [(200, {"models": [{"name": "models/b"}, {"name": "models/A"}]}, {})]
    assert provider("gemini", base=service).models() == ["A", "b"]


def test_error_text_and_delay():
    assert error_text('{"error": "x"}') == "x" and error_text('{"message": "y"}') == "y" and error_text("plain\ntext") == "plain"
    assert error_text('{"error": {"code": 7}, "message": "top"}') == "top"
    assert model_not_found(404, "Model Not Found") and not model_not_found(500, "model not found") and not model_not_found(404, None)
    assert delay("3", 0, 1) == 3 and delay(None, 2, 1) == 4 and delay("Wed, 21 Oct 2015 07:28:00 GMT", 0, 1) == 0
