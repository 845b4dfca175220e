from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from synthloom.operators.context import ancestors, context, enriched, resolved, scopes
from synthloom.plans import pipeline
from synthloom.sources import csharp
from synthloom.sources.references import arity, bases_of, key_of, read_references, references_in
from synthloom.tables import looked_up

FILES = {
    "Core/Entity.cs": """namespace Shop.Core;
public interface IEntity { int Id(); }
public interface INamed : IEntity { string Title(); }
public abstract class Entity : IEntity, IDisposable
{
    public virtual int Id() { return Hash(); }
    public static int Hash() => 3;
    public abstract void Close();
}
public class Named<T> : Entity, INamed where T : class
{
    public override int Id() => base.Id() + 1;
    public string Title() { return Format(Id()); }
    public override void Close() { }
    public string Format(int n) { return n.ToString(); }
}
""",
    "Data/Store.cs": """using Shop.Core;
using Alias = Shop.Tools.Text;
namespace Shop.Data
{
    public interface IStore<T> : INamed { void Save(T item); }
    public class Store : Named<string>, IStore<Order>
    {
        private readonly Clock _clock;
        public Store(Clock clock) { _clock = clock; }
        public void Save(Order item)
        {
            // Hidden() and "Quiet()" are no calls
            var log = new Log();
            log.Write(Format(1));
            if (_clock.Now() > 0) { this.Close(); }
            Alias.Trim("x"); item.Total(); Missing(); Entity.Hash();
            Chain().Next();
        }
        public override void Close() { base.Close(); }
        public override int Id() => 9;
    }
    public class Order { public int Total() { return 1; } }
    public class Twin { }
}
""",
    "Tools/Text.cs": """using Shop.Data;
using Shop.Other;
namespace Shop.Tools
{
    public class Text { public static string Trim(string s) { return new Log().ToString(); } }
    public class Log { public void Write(string s) { Twin t = new Twin(); var o = new Shop.Data.Order(); o.Total(); } }
    public class Clock { public int Now() { return 0; } }
    public record Mark(int X, string Y) : Base(X);
    public record Base(int X);
}
""",
    "Other/Twin.cs": """namespace Shop.Other { public class Twin { } public class Ring : Loop { } public class Loop : Ring { } }
""",
}


def brute(rows):
    """Lists by declaration, found by walking scopes and bases one by one."""
    types = {r["key"]: r for r in rows if r["role"] == "declares" and r["key"] == r["owner"]}
    methods, open_ = {}, {}
    for r in rows:
        if r["role"] == "declares" and r["key"] != r["owner"]:
            name = r["key"].rpartition(".")[2].split("`")[0]
            if r["kind"] == "method":
                methods[(r["owner"], name)] = min(methods.get((r["owner"], name), r["fqn"]), r["fqn"])
            if r["open"]:
                open_[(r["owner"], name, r["kind"])] = r["fqn"]

    def find(r):
        name = r["name"] + (f"`{r['arity']}" if r["arity"] else "")
        around = r["owner"].split(".")
        levels = [[".".join(around[:n])] for n in range(len(around), 0, -1)] + [["", *r["usings"]]]
        for level in levels:
            hit = {k for s in level if (k := f"{s}.{name}".lstrip(".")) in types}
            if hit:
                return hit.pop() if len(hit) == 1 else None
        return None

    parents, faces = defaultdict(list), defaultdict(list)
    for r in rows:
        if r["role"] == "base":
            t = find(r)
            face = types[t]["kind"] == "interface" if t else r["name"].rpartition(".")[2][:1] == "I" and r["name"].rpartition(".")[2][1:2].isupper()
            if face:
                faces[r["owner"]].append(t or r["written"])
            if types[r["owner"]]["kind"] == "interface" or not face:
                parents[r["owner"]].append(t or r["written"])

    def up(t):
        seen, level, out = {t}, [t], []
        for d in range(5):
            level = sorted({p for x in level for p in parents[x]} - seen)
            seen |= set(level)
            out += [(d + 1, p) for p in level]
        return out

    def shown(k):
        return types[k]["fqn"] if k in types else k

    result = {}
    for d in (r for r in rows if r["role"] == "declares"):
        mine = sorted((r for r in rows if r["_ord"] == d["_ord"] and r["role"] in ("call", "new")), key=lambda r: r["place"])
        called, missing = [], []
        for r in mine:
            if r["role"] == "new":
                t = find(r)
                hit = f"{types[t]['fqn']}.{t.rpartition('.')[2].split('`')[0]}" if t else None
            else:
                start = r["owner"] if r["name"] in (None, "base") else find(r)
                line = [p for _, p in up(start)] if start else []
                line = line if r["name"] == "base" or not start else [start, *line]
                hit = next((methods[(t, r["member"])] for t in line if (t, r["member"]) in methods), None)
            (called if hit else missing).append(hit or r["written"])
        missing += [r["written"] for r in rows if r["_ord"] == d["_ord"] and r["role"] == "base" and not find(r)]
        over = None
        if d["overrides"]:
            name = d["key"].rpartition(".")[2].split("`")[0]
            over = next((open_[(t, name, d["kind"])] for _, t in up(d["owner"]) if (t, name, d["kind"]) in open_), None)
        result[d["_ord"]] = (list(dict.fromkeys(called)), [shown(x) for x in faces[d["owner"]]], [shown(x) for _, x in up(d["owner"])], over, sorted(set(missing)))
    return result


@pytest.fixture(scope="module")
def solution(tmp_path_factory):
    root = tmp_path_factory.mktemp("solution")
    for path, code in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(code)
    return str(root)


@pytest.fixture(scope="module")
def found(spark, solution):
    return {r["_ord"]: r for r in context(read_references(spark, solution)).collect()}


def test_context_equals_brute_force(found):
    rows = [r for path, code in FILES.items() for r in references_in(code, path)]
    want = brute(rows)
    got = {k: (r.called_symbols, r.implemented_interfaces, r.inheritance_chain, r.overridden_member, sorted(r.unresolved_references)) for k, r in found.items()}
    assert got == want


def test_context_of_known_members(found):
    by = {r.fully_qualified_name: r for r in found.values()}
    save = by["Shop.Data.Store.Save"]
    # Shop.Tools is not used by that file, so Log and Clock are not its types; the alias names Text whole
    assert save.called_symbols == ["Shop.Core.Named<T>.Format", "Shop.Data.Store.Close", "Shop.Tools.Text.Trim", "Shop.Data.Order.Total", "Shop.Core.Entity.Hash", ]
    assert {"Log", "log.Write", "_clock.Now", "Missing", "Chain"} == set(save.unresolved_references)
    assert save.inheritance_chain == ["Shop.Core.Named<T>", "Shop.Core.Entity"]
    assert save.implemented_interfaces == ["Shop.Data.IStore<T>"]
    assert by["Shop.Data.Store.Id"].overridden_member == "Shop.Core.Named<T>.Id"
    assert by["Shop.Core.Named<T>.Id"].called_symbols == ["Shop.Core.Entity.Id"]
    assert by["Shop.Core.Entity"].implemented_interfaces == ["Shop.Core.IEntity", "IDisposable"]
    assert by["Shop.Data.IStore<T>"].inheritance_chain == ["Shop.Core.INamed", "Shop.Core.IEntity"]
    assert by["Shop.Tools.Mark"].inheritance_chain == ["Shop.Tools.Base"]
    # Twin is in two of the used namespaces
    write = by["Shop.Tools.Log.Write"]
    assert write.called_symbols == ["Shop.Data.Order.Order", "Shop.Data.Order.Total"] and write.unresolved_references == ["Twin"]
    assert by["Shop.Other.Ring"].inheritance_chain == ["Shop.Other.Loop"]


def test_enriched_symbols(spark, solution, found):
    s = csharp.read_symbols(spark, solution)
    out = enriched(s, read_references(spark, solution), max_callees=2).collect()
    assert len(out) == s.count() and {r["_ord"] for r in out} <= set(found)
    assert next(r for r in out if r["name"] == "Shop.Data.Store.Save").called_symbols == ["Shop.Core.Named<T>.Format", "Shop.Data.Store.Close"]


def test_helpers():
    assert [arity(x) for x in (None, "<T>", "<A<B,C>,D>")] == [0, 1, 2]
    assert key_of("N.A<T,U>.B<X>.C") == "N.A`2.B`1.C"
    assert bases_of("public class A<T> : B<C<int, X>, D>, E where T : F") == ["B<C<int,X>,D>", "E"]
    assert bases_of("public record R(int X) : Q(X), I") == ["Q", "I"] and bases_of("public struct S") == []


def test_ancestors(spark):
    deep = [(i, i - 1) for i in range(1, 9)]
    hub = [(100 + i, 1) for i in range(3000)]
    ring = [(50, 51), (51, 52), (52, 50), (53, 53), (None, 1), (60, None), (61, 8), (61, 7), (61, 8)]
    df = spark.createDataFrame(deep + hub + ring, "child long, parent long")
    got = {(r.child, r.ancestor): r.depth for r in ancestors(df, 5).collect()}
    parents = defaultdict(set)
    for c, p in deep + hub + ring:
        if c is not None and p is not None and c != p:
            parents[c].add(p)
    want = {}
    for c in parents:
        level = {c}
        for d in range(1, 6):
            level = {p for x in level for p in parents.get(x, ())} - {c}
            for p in level:
                want.setdefault((c, p), d)
    assert got == want
    assert ancestors(df.limit(0)).count() == 0


def test_looked_up_splits_keys_that_many_rows_share(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).alias("k"))
    rows = rows.filter("id >= 0")
    held = spark.createDataFrame([(7, "hot"), (10, "ten")], "k long, v string")
    rows = rows.withColumn("k", F.col("k").cast("long"))
    for how in ("inner", "left"):
        assert sorted(map(tuple, looked_up(rows, held, "k", how).select("id", "k", "v").collect())) == sorted(map(tuple, rows.join(held, "k", how).select("id", "k", "v").collect()))


def test_resolution_by_nearest_scope(spark):
    asked = spark.createDataFrame([(1, "X", "A.B", None, ["U", "V"]), (2, "Y", "A.B", None, ["U", "V"]), (3, "Z", "A", "A.T", []), (4, "Q", None, None, None), (1, "X", "A.B", None, [])], "id int, name string, ns string, owner string, u array<string>")
    asked = asked.select("id", "name", scopes(F.col("ns"), F.col("owner"), F.col("u")).alias("scopes"))
    declared = spark.createDataFrame([("A.X", "class"), ("U.X", "class"), ("U.Y", "class"), ("V.Y", "class"), ("A.T.Z", "enum"), ("A.Z", "class"), ("Q", "class"), ("Q", "class")], "key string, kind string")
    got = {r.id: (r.target, r.target_kind) for r in resolved(asked, declared).collect()}
    assert got == {1: ("A.X", "class"), 2: (None, None), 3: ("A.T.Z", "enum"), 4: ("Q", "class")}


def test_context_in_a_pipeline(spark, solution):
    c = pipeline.load(f"""
name: t
solution: {{path: {solution}, include_context: true, max_callees: 1}}
steps: [{{name: s, type: SymbolExtractor}}]
""")
    rows = {r["name"]: r for r in pipeline.build(spark, c).leaves.collect()}
    assert rows["Shop.Data.Store.Save"].called_symbols == ["Shop.Core.Named<T>.Format"]
    assert rows["Shop.Data.Store"].inheritance_chain == ["Shop.Core.Named<T>", "Shop.Core.Entity"]
