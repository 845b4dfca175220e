import random
import re
import time

import pytest
from pyspark.sql import functions as F

from synthloom.sources import csharp
from synthloom.sources.csharp import _without_spaces, complexity, quieted, read_symbols, symbols_in
from synthloom.sources.declarations import OPEN_BYTES, DeclarationReader, read_declarations

CODE = """// licence
using System;
public class Outside { public int Zero() { return 0; } }
namespace Shop
{
    /// <summary>A basket { }</summary>
    /// <remarks>of goods</remarks>
    [Serializable]

    [Note(new[] { 1 })]
    public class Basket
    {
        public int Count { get; }
        // } namespace Fake {
        public int Sum(int[] x) { var s = 0; foreach (var y in x) { if (y > 0 && y < 9) s += y; } return s; }
        public void Clear() { }
    }
    namespace Old { public interface IKept { int Left(); } }
}
namespace Shop.Old.Deep { public class Well { public int Depth() => 1 > 0 ? 2 : 3; } }
namespace Tools { public enum Tool { Saw } internal static class Box { public static string Open() { return "namespace Shop {"; } } }
"""
SCOPED = "namespace Shop.Flat;\n\npublic class Plain { public void Run() { while (true) { } } }\n"


def names(found):
    return {s["fully_qualified_name"] for s in found}


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "src"
    (at / "a" / "obj").mkdir(parents=True)
    (at / "a" / "Shop.cs").write_text(CODE)
    (at / "Flat.cs").write_text("﻿" + SCOPED)
    (at / "Made.g.cs").write_text("public class Made { }")
    (at / "Marked.cs").write_text("// <AUTO-generated/>\npublic class Marked { }")
    (at / "Broken.cs").write_bytes(b"public class Broken { public int N() { return '\xff'; }")
    (at / "Empty.cs").write_text("")
    (at / "notes.txt").write_text("public class Notes { }")
    (at / ".hidden.cs").write_text("public class Hidden { }")
    return at


@pytest.mark.parametrize("excluded", [(), ("Shop",), ("Shop.Old",), ("Shop.Old.Deep", "Tools"), ("Sho",), ("Shop", "Tools")])
def test_a_namespace_left_out_takes_its_declarations_and_no_others(excluded):
    def wanted(space):
        return not any(space == x or space.startswith(x + ".") for x in excluded)

    for code in (CODE, SCOPED):
        every = symbols_in(code, "x.cs")
        assert symbols_in(code, "x.cs", None, wanted) == [s for s in every if wanted(s["namespace"])]
        assert symbols_in(code, "x.cs", {"method"}.__contains__, wanted) == [s for s in every if wanted(s["namespace"]) and s["kind"] == "method"]


def test_namespaces_within_one_that_is_left_out_may_stay():
    every = symbols_in(CODE, "x.cs")
    for some in ({"Shop.Old"}, {"Shop"}, {"", "Tools"}):
        assert symbols_in(CODE, "x.cs", None, some.__contains__) == [s for s in every if s["namespace"] in some]


def test_a_file_without_namespaces_is_left_out_where_the_nameless_one_is():
    assert symbols_in("public class A { }", "x.cs", None, lambda x: x != "") == []


def test_what_is_blanked_keeps_its_length():
    quiet = quieted(CODE)
    a = quiet.index("namespace Shop")
    b = quiet.index("namespace Shop.Old.Deep")
    out = _without_spaces(quiet, [(a, b - 1, "Shop")], lambda x: x != "Shop")
    assert len(out) == len(quiet) and not out[a : b - 1].strip() and out[:a] == quiet[:a] and out[b:] == quiet[b:]


def test_documentation_is_found_past_attributes():
    basket = next(s for s in symbols_in(CODE, "x.cs") if s["fully_qualified_name"] == "Shop.Basket")
    assert basket["xml_doc_comment"] == "<summary>A basket { }</summary>\n<remarks>of goods</remarks>"
    assert [s["xml_doc_comment"] for s in symbols_in("/// first\npublic class A { }\n/// far\n\npublic class B { } public class C { }", "x.cs")] == ["first", "far", None]


def test_the_reader_gives_what_read_symbols_gives(spark, folder):
    for how in ({}, {"kinds": ("Method", "enum"), "min_complexity": 2}, {"exclude_namespaces": ("Shop", "Tools")}, {"include_generated": True}):
        want = read_symbols(spark, str(folder), **how).select("symbol.*", "_ord").collect()
        got = read_declarations(spark, str(folder), **how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want)) and want


def test_every_filter_of_read_declarations_is_pushed(spark, folder, capsys):
    read_declarations(spark, str(folder), ("method", "class"), 2, ("Shop.Old",)).explain("formatted")
    plan = capsys.readouterr().out
    for pushed in ("In(kind,[class,method])", "GreaterThanOrEqual(least_complexity,2)", "Not(EqualTo(namespace,Shop.Old))", "Not(StringStartsWith(namespace,Shop.Old.))"):
        assert pushed in plan.replace(", ", ",").replace("In(kind,[method,class])", "In(kind,[class,method])")
    assert "Filter" not in plan.replace("PushedFilters", "")


def test_filters_of_all_shapes_hold_whoever_tests_them(spark, folder):
    all_rows = read_declarations(spark, str(folder), ("method", "property", "class", "interface", "enum"))
    kept = [r.asDict() for r in all_rows.collect()]
    cases = [
        (F.col("kind") == "class", lambda r: r["kind"] == "class"),
        (F.col("kind") != "class", lambda r: r["kind"] != "class"),
        (F.col("file_path").startswith("a/"), lambda r: r["file_path"].startswith("a/")),
        (~F.col("file_path").endswith("Flat.cs"), lambda r: not r["file_path"].endswith("Flat.cs")),
        (F.col("namespace").contains("Old"), lambda r: "Old" in r["namespace"]),
        (F.col("complexity") > 1, lambda r: r["complexity"] > 1),
        ((F.col("complexity") <= 3) & (F.col("namespace") == "Shop"), lambda r: r["complexity"] <= 3 and r["namespace"] == "Shop"),
        ((F.col("complexity") < 2) | (F.col("kind") == "class"), lambda r: r["complexity"] < 2 or r["kind"] == "class"),
        (F.col("xml_doc_comment").isNotNull(), lambda r: r["xml_doc_comment"] is not None),
        (F.col("xml_doc_comment").contains("goods"), lambda r: "goods" in (r["xml_doc_comment"] or "")),
        (F.col("containing_type").isNull(), lambda r: r["containing_type"] is None),
        (F.length("body_text") > 40, lambda r: len(r["body_text"]) > 40),
    ]
    for test, same in cases:
        got = [r["fully_qualified_name"] for r in all_rows.filter(test).collect()]
        assert sorted(got) == sorted(r["fully_qualified_name"] for r in kept if same(r)), test


def test_files_are_dealt_by_their_bytes_and_left_out_by_their_paths(folder):
    size = {f: (folder / f).stat().st_size for f in ("a/Shop.cs", "Flat.cs", "Marked.cs", "Broken.cs", "Empty.cs")}
    one = DeclarationReader({"path": str(folder)}).partitions()
    assert [dict(p.files) for p in one] == [size]
    each = DeclarationReader({"path": str(folder), "partitionbytes": "1"}).partitions()
    assert sorted(p.files for p in each) == sorted([f] for f in size.items())
    two = DeclarationReader({"path": str(folder), "partitionbytes": str(2 * OPEN_BYTES + 2000)}).partitions()
    assert [len(p.files) for p in two] == [2, 2, 1] and all(p.bytes <= 2 * OPEN_BYTES + 2000 for p in two)


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    assert read_declarations(spark, str(tmp_path)).count() == 0


def test_other_columns_are_refused(spark, folder):
    read_declarations(spark, str(folder))
    with pytest.raises(Exception, match="fixed"):
        spark.read.format("synthloom-csharp").schema("kind string").load(str(folder)).count()


#: What branches are, in one pattern.
BRANCH = re.compile(r"\b(?:if|while|for|foreach|catch)\b|&&|\|\||\?\?(?!=)|(?<![?\w>\])])\?(?![?.\[])|(?<=[\w)\]])\s+\?(?![?.\[])\s|\bcase\b(?=[^:{};]*:)")


def test_code_is_passed_over_faster_than_by_patterns_tried_at_every_letter():
    body = "THE OLD MAN AND THE && SEA OF WORDS " * 20_000
    code = f"namespace A {{ public class B {{ public int Run() {{ return {body}; }} }} }}"
    plain = [re.compile(r"\bnamespace\s+([\w.]+)\s*([{;])"), csharp._TYPE, csharp._MEMBER, BRANCH]

    def least(run):
        took = []
        for _ in range(3):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    assert [s["complexity"] for s in symbols_in(code, "x.cs", {"method"}.__contains__)] == [20_001]
    assert least(lambda: symbols_in(code, "x.cs", {"method"}.__contains__)) < 0.6 * least(lambda: [p.findall(code) for p in plain])


def test_declarations_and_branches_are_those_that_whole_patterns_find():
    words = "public internal private static sealed partial readonly ref class struct record interface enum new async override xpublic publicx public_ class1 _class é A B int if while for foreach catch case xcase iff switch".split()
    marks = ["(", ")", "()", "{", "}", ";", "=>", ":", ",", "<", ">", "&&", "&", "|", "||", "|||", "?", "??", "??=", "?.", "?[", "]", "\n", "  ", ""]
    r = random.Random(7)
    seen = [0, 0, 0]
    for _ in range(4000):
        code = "".join(r.choice(words) + r.choice(marks) + r.choice((" ", "", "\n", " ")) if r.random() < 0.8 else r.choice(marks) for _ in range(r.randrange(1, 40)))
        for k, (whole, first) in enumerate(((csharp._TYPE, csharp._TYPE_FIRST), (csharp._MEMBER, csharp._MEMBER_FIRST))):
            want = [(m.span(), m.groups()) for m in whole.finditer(code)]
            assert [(m.span(), m.groups()) for m in csharp._found(whole, first, code)] == want
            seen[k] += len(want)
        want = len(BRANCH.findall(code))
        assert 1 + want + sum(csharp._arms(code[m.end() : csharp._closing(code, m.end() - 1) - 1]) for m in re.finditer(r"\bswitch\s*\{", code)) == complexity(code)
        seen[2] += want
    assert min(seen) > 200
