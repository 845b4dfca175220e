"""Symbols of C# sources: declarations found by patterns, one file a row.

Files are read and parted by Spark; the helper below only marks declarations and their bodies in one file's text. Facts
that need a compiler (types of expressions, inherited documentation) are out of scope.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthloom.operators.filters import DEFAULT_KINDS, is_generated, is_test_project, symbols_kept
from synthloom.functions.text import truncate_lines
from synthloom.schema import SYMBOL

# strings, characters and comments, which hold no code
_QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|@\"(?:[^\"]|\"\")*\"|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'", re.S)


def _words(words: str, then: str = "") -> re.Pattern:
    """Whole words, as \\b(?:...)\\b finds them. Each begins with its letter, so that the engine passes over all other letters
    at once and doesn't try the pattern at them."""
    return re.compile("|".join(rf"{w[0]}(?<!\w{w[0]}){w[1:]}\b{then}" for w in words.split()))


_NAMESPACE = re.compile(r"namespace(?<!\wnamespace)\s+([\w.]+)\s*([{;])")
_TYPE = re.compile(r"((?:\b(?:public|internal|protected|private|static|sealed|abstract|partial|readonly|ref)\s+)*)\b(class|struct|record\s+struct|record\s+class|record|interface|enum)\s+(\w+)\s*(<[^>{;]*>)?[^{;]*?([{;])")
_MEMBER = re.compile(
    r"((?:\b(?:public|internal|protected|private|static|virtual|override|abstract|async|sealed|readonly|new|extern|partial|unsafe|required)\s+)+)"
    r"(?:([\w.<>\[\],?]+(?:\s*<[^>;{}()]*>)?)\s+)?(\w+)\s*(<[^>(){;]*>)?\s*(\([^{};]*?\))?\s*(?:where[^{;]*?|:\s*(?:base|this)\s*\([^{};]*\)\s*)?(\{|=>|;)"
)
# what a type or a member can begin with
_TYPE_FIRST = _words("public internal protected private static sealed abstract partial readonly ref class struct record interface enum", r"(?=\s)")
_MEMBER_FIRST = _words("public internal protected private static virtual override abstract async sealed readonly new extern partial unsafe required", r"(?=\s)")
# in an interface, members need no modifier
_PLAIN_MEMBER = re.compile(_MEMBER.pattern.replace(r"\s+)+)", r"\s+)*)", 1))
# branches, parted so that none has to be tried at every letter; no two of these share a character that they consume
_BRANCH = _words("if while for foreach catch")
_CASE = _words("case", r"(?=[^:{};]*:)")
_ASK = re.compile(r"\?\?(?!=)|(?<![?\w>\])])\?(?![?.\[])|(?<=[\w)\]])\s+\?(?![?.\[])\s")
_ARM = _words("switch", r"\s*\{")


def _found(pattern: re.Pattern, first: re.Pattern, code: str) -> Iterator[re.Match]:
    """pattern.finditer(code) for a pattern that matches nowhere but where first does."""
    end = 0
    for start in first.finditer(code):
        if start.start() >= end and (m := pattern.match(code, start.start())):
            end = m.end()
            yield m


def quieted(code: str) -> str:
    """The code with strings and comments blanked, of the same length and lines."""
    return _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def _closing(quiet: str, at: int) -> int:
    """Past the brace that closes the one at `at`."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(quiet, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(quiet)


def _arms(inner: str) -> int:
    """The arms of a switch expression: its parts between commas that hold an arrow, brackets left to themselves."""
    depth, flat = 0, []
    for m in re.finditer(r"[(\[{]|[)\]}]|,|=>", inner):
        if m[0] in "([{":
            depth += 1
        elif m[0] in ")]}":
            depth -= 1
        elif not depth:
            flat.append(m[0])
    return sum("=>" in part for part in " ".join(flat).split(","))


def complexity(body: str) -> int:
    """1 and one for each branch: if, loops, catch, labels of case, arms of switch expressions, ?:, &&, ||, ??."""
    quiet = quieted(body)
    arms = 0
    for m in _ARM.finditer(quiet):
        arms += _arms(quiet[m.end() : _closing(quiet, m.end() - 1) - 1])
    asks = len(_ASK.findall(quiet)) if "?" in quiet else 0
    return 1 + quiet.count("&&") + quiet.count("||") + len(_BRANCH.findall(quiet)) + len(_CASE.findall(quiet)) + asks + arms


def visible(modifiers: str, in_interface: bool = False) -> bool:
    """Public, internal or protected internal; without a word on it, a member is private, and public in an interface."""
    words = set(modifiers.split())
    if in_interface and words.isdisjoint(("public", "internal", "protected", "private")):
        return True
    return "private" not in words and ("public" in words or "internal" in words)


_DOC = re.compile(r"((?:[ \t]*///[^\n]*\n)+)[ \t]*(?:\[[^\n]*\]\s*)*$")


def _doc_above(code: str, at: int) -> str | None:
    """The documentation comment above a declaration, past attributes. Only the lines that can belong to it are read."""
    start, end = at, at
    while end >= 0:
        a = code.rfind("\n", 0, end) + 1
        line = code[a:end].strip()
        if line and not line.startswith(("[", "///")):
            break
        start, end = a, a - 1
    m = _DOC.search(code, start, at)
    return "\n".join(re.sub(r"^\s*/// ?", "", x) for x in m[1].splitlines()).strip() or None if m else None


def _without_spaces(quiet: str, spaces: list[tuple], wanted: Callable[[str], bool]) -> str:
    """The code with the namespaces that aren't wanted blanked, down to those within them that are."""
    named = sorted((a, b, ".".join(n for x, y, n in spaces if x < a + 1 < y)) for a, b, _ in spaces)
    if wanted("") and all(wanted(name) for *_, name in named):
        return quiet
    parts, at, open_ = [], 0, [(len(quiet), wanted(""))]
    edges = sorted([(a, 1, b, name) for a, b, name in named] + [(b, 0, b, name) for a, b, name in named])
    for place, opens, end, name in edges:
        parts.append(quiet[at:place] if open_[-1][1] else " " * (place - at))
        at = place
        if opens:
            open_.append((end, wanted(name)))
        elif len(open_) > 1:
            open_.pop()
    parts.append(quiet[at:] if open_[-1][1] else " " * (len(quiet) - at))
    return "".join(parts)


def symbols_in(code: str, path: str, kinds: Callable[[str], bool] | None = None, wanted: Callable[[str], bool] | None = None) -> list[dict]:
    """The declarations of one file, those of some kinds and of wanted namespaces only if these are given; what lies in
    other namespaces isn't looked through."""
    quiet = quieted(code)
    spaces = [(m.start(), _closing(quiet, m.end() - 1) if m[2] == "{" else len(code), m[1]) for m in _NAMESPACE.finditer(quiet)]
    if wanted is not None:
        quiet = _without_spaces(quiet, spaces, wanted)
    types, out = [], []

    def within(at: int) -> str:
        return ".".join(name for a, b, name in spaces if a < at < b)

    def holder(at: int) -> list[tuple]:
        return [t for t in types if t[0] < at < t[1]]

    def add(kind: str, m: re.Match, name: str, body: str, signature: str) -> None:
        if kinds is not None and not kinds(kind):
            return
        inside = holder(m.start())
        outer = ".".join(t[2] for t in inside)
        space = within(m.start())
        out.append(
            {
                "fully_qualified_name": ".".join(x for x in (space, outer, name) if x),
                "signature_text": signature.strip(" ;\r\n\t"),
                "body_text": body.strip(),
                "xml_doc_comment": _doc_above(code, m.start()),
                "containing_type": outer,
                "namespace": space,
                "file_path": path,
                "complexity": complexity(body) if kind in ("method", "constructor") else 1,
                "kind": kind,
                "_at": m.start(),
            }
        )

    for m in _found(_TYPE, _TYPE_FIRST, quiet):
        end = _closing(quiet, m.end() - 1) if m[5] == "{" else m.end()
        types.append((m.start(), end, m[3] + re.sub(r"\s+", "", m[4] or ""), m[2]))
    for start, end, name, kind in types:
        m = _TYPE.match(quiet, start)
        if m and (visible(m[1]) or not holder(start) and not m[1].strip()):
            add({"record struct": "record-struct", "record class": "record"}.get(" ".join(kind.split()), kind), m, name, code[start:end], code[start : m.end() - 1])
    starts = {t[0] for t in types}

    def member(m: re.Match, inside: list[tuple]) -> int:
        """Add a member, and return where it ends."""
        if m[6] == "{":
            end = _closing(quiet, m.end() - 1)
        elif m[6] == "=>":
            end = quiet.find(";", m.end()) + 1 or len(quiet)
        else:
            end = m.end()
        own = inside[-1][2].split("<")[0]
        kind = "constructor" if m[5] and not m[2] and m[3] == own else "method" if m[5] and m[2] else "property" if m[2] and not m[5] and m[6] != ";" else None
        if kind and visible(m[1], inside[-1][3] == "interface") and m[2] not in ("class", "struct", "record", "interface", "enum", "delegate", "event"):
            add(kind, m, m[3] + re.sub(r"\s+", "", m[4] or ""), code[m.start() : end], code[m.start() : m.end() - len(m[6])])
        return end

    for m in _found(_MEMBER, _MEMBER_FIRST, quiet):
        inside = holder(m.start())
        if inside and m.start() not in starts and inside[-1][3] != "interface":
            member(m, inside)
    for start, end, *_ in (t for t in types if t[3] == "interface"):
        at = quiet.find("{", start, end) + 1
        while at and (m := _PLAIN_MEMBER.search(quiet, at, end - 1)):
            inside = holder(m.start())
            nested = [t for t in inside if t[0] > start]
            at = max(nested[0][1], m.start() + 1) if nested else max(member(m, inside), m.start() + 1)
    return sorted(out, key=lambda x: x["_at"])


#: What precedes the first token of a file: blanks, comments and directives, of any length.
LEADING = r"^\x{FEFF}?(?:\s++|//[^\r\n]*+|#[^\r\n]*+|/\*(?s:.*?)\*/)*+"


def head_of(code: str) -> str:
    """What precedes the first token of a file, as LEADING finds it."""
    return re.match(LEADING.replace(r"\x{FEFF}", "\ufeff"), code)[0]


_PROJECT_LINE = r'(?m)^\s*Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+\.csproj)"'
_REFERENCE = r'(?i)<(?:PackageReference|Reference)\s[^>]*?Include\s*=\s*"([^"]+)"'


def _bare(path: Column) -> Column:
    """A path without its scheme and authority."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)", "")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def _below(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, value) of the files below a folder, whole, without byte order marks; bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    text = F.regexp_replace(F.make_valid_utf8("value"), r"^\x{FEFF}", "")
    return files.select(_bare(F.col("_metadata.file_path")).alias("path"), text.alias("value"))


def root_of(path: str) -> str:
    """The folder that paths of symbols are relative to: a solution's or a project's own, or the folder itself."""
    path = path.rstrip("/")
    return path.rpartition("/")[0] or "." if path.lower().endswith((".sln", ".csproj")) else path


def projects(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, test) of the projects of a solution, of one project, or of a folder: those of its first solution, or
    else all projects below it."""
    wanted = _below(spark, root_of(path), "*.csproj")
    solution = None
    if path.lower().endswith(".sln"):
        solution = spark.read.text(path, wholetext=True).select(_bare(F.col("_metadata.file_path")).alias("path"), "value")
    elif path.lower().endswith(".csproj"):
        wanted = wanted.filter(F.element_at(F.split("path", "/"), -1) == path.rpartition("/")[2])
    else:
        solution = _below(spark, path, "*.sln").orderBy("path").limit(1)
    if solution is not None and not solution.isEmpty():
        named = solution.select(_folder(F.col("path")).alias("root"), F.explode(F.regexp_extract_all("value", F.lit(_PROJECT_LINE), F.lit(1))).alias("at"))
        at = F.concat("root", F.lit("/"), F.regexp_replace(F.translate("at", "\\", "/"), r"^(\./)+", ""))
        # a step up takes back the folder before it
        for _ in range(8):
            at = F.regexp_replace(at, r"/[^/]+/\.\.(?=/)", "")
        wanted = wanted.join(named.select(at.alias("path")), "path", "left_semi")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.csproj$", "")
    test = is_test_project(name, F.regexp_extract_all("value", F.lit(_REFERENCE), F.lit(1)))
    return wanted.select(_folder(F.col("path")).alias("folder"), name.alias("name"), test.alias("test"))


def _of_projects(files: DataFrame, known: DataFrame, include_tests: bool) -> DataFrame:
    """The files that lie below a project, the nearest one above a file being its own; without those of test projects."""
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    own = files.select("path", F.explode(above).alias("folder")).join(known.groupBy("folder").agg(F.max("test").alias("test")), "folder")
    own = own.groupBy("path").agg(F.max_by("test", F.length("folder")).alias("test"))
    return files.join(own if include_tests else own.filter(~F.col("test")), "path", "left_semi")


def source_files(spark: SparkSession, path: str, include_generated: bool = False, include_tests: bool = False) -> DataFrame:
    """(file_path, value) of the .cs files of a .sln, a .csproj or a folder, as read_symbols takes them."""
    root = root_of(path)
    files = _below(spark, root, "*.cs")
    known = projects(spark, path)
    if not known.isEmpty():
        files = _of_projects(files, known, include_tests)
    elif not include_tests:
        files = files.filter(~F.col("path").rlike(r"(?i)\.(?:Tests|Test|UnitTests|IntegrationTests|AcceptanceTests)/"))
    if not include_generated:
        head = F.regexp_extract("value", LEADING, 0)
        files = files.filter(~is_generated(F.col("path"), F.lower(head)))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getRawPath().rstrip("/")
    return files.select(F.substr("path", F.lit(len(whole) + 2)).alias("file_path"), "value")


def outside_of(excluded: Sequence[str]) -> Callable[[str], bool]:
    """Whether a namespace is none of these nor below one."""
    return lambda space: not any(space == x or space.startswith(x + ".") for x in excluded)


def place_of(path: str, at: str) -> Column:
    """A key that sorts declarations by file and by where they begin in it, whichever of them are kept."""
    return F.concat_ws("#", path, F.lpad(F.col(at).cast("string"), 10, "0"))


def read_symbols(
    spark: SparkSession,
    path: str,
    kinds: Sequence[str] = DEFAULT_KINDS,
    min_complexity: int = 0,
    exclude_namespaces: Sequence[str] = (),
    include_generated: bool = False,
    include_tests: bool = False,
    max_body_lines: int = 0,
) -> DataFrame:
    """Symbols of a .sln, a .csproj or a folder: `symbol`, its flat columns, and _ord by file and place.

    Paths are relative to the solution, project or folder. Where there are projects, files outside of any are left out, and
    those of test projects too unless asked for; a folder without projects gives all of its .cs files.
    """
    files = source_files(spark, path, include_generated, include_tests)
    names = [f.name for f in SYMBOL.fields]
    some = {k.lower() for k in kinds}.__contains__
    outside = outside_of(exclude_namespaces)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, code in zip(batch.file_path, batch.value, strict=True):
                yield pd.DataFrame(symbols_in(code, path, some, outside), columns=[*names, "_at"])

    flat = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SYMBOL.fields)
    found = files.mapInPandas(parse, f"{flat}, _at int")
    kept = symbols_kept(found, kinds, min_complexity, exclude_namespaces).withColumn("body_text", truncate_lines(F.col("body_text"), max_body_lines))
    return kept.select(
        F.struct(*names).alias("symbol"), "kind", F.col("fully_qualified_name").alias("name"), "namespace", "file_path", "complexity", place_of("file_path", "_at").alias("_ord")
    )
