"""Context of symbols: what they call, what their types implement and inherit, and what they override.

Names are resolved by equi-joins on whole names: a name and each scope that it may be read in make a candidate, and the nearest
scope that holds one decides. A name that its nearest scope holds twice, or that no scope holds, stays as it was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthloom.tables import looked_up, written

# Caps of the lists that go into a prompt.
MAX_CALLEES, MAX_INTERFACES, MAX_DEPTH = 20, 10, 5


def ancestors(parents: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(child, ancestor, depth): what is reached from a child over (child, parent) rows in at most `depth` steps, each once
    and at its least depth. Children of a circle reach the others in it, never themselves. Rows with a null side are left out.

    A step joins the rows found last with the parents of their ends; these are grouped by child first, so a parent with any
    number of heirs is one row that is looked up.
    """
    links = parents.filter("child is not null and parent is not null and child != parent").select("child", "parent").distinct()
    links = written(links, "links")
    above = written(links.groupBy("child").agg(F.collect_set("parent").alias("parents")).withColumnRenamed("child", "ancestor"), "above")
    found = written(links.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "ancestors")
    front, parts = found, [found]
    for step in range(2, depth + 1):
        next_ = looked_up(front.select("child", "ancestor"), above, "ancestor").select("child", F.explode("parents").alias("ancestor")).filter("child != ancestor").distinct()
        for seen in parts:
            next_ = next_.join(seen.select("child", "ancestor"), ["child", "ancestor"], "left_anti")
        front = written(next_.select("child", "ancestor", F.lit(step).alias("depth")), "ancestors")
        if front.isEmpty():
            break
        parts.append(front)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scopes(namespace: Column, owner: Column, usings: Column) -> Column:
    """Array of (rank, scope) that a name is read in, nearest first: the types around it, its namespace and those that hold
    it, the global one and the used ones together."""
    around = F.split(F.coalesce(owner, namespace, F.lit("")), r"\.")
    own = F.transform(F.sequence(F.lit(0), F.size(around) - 1), lambda i: F.struct(i.cast("int").alias("rank"), F.array_join(F.slice(around, F.lit(1), F.size(around) - i), ".").alias("scope")))
    last = F.size(around)
    used = F.transform(F.coalesce(usings, F.array().cast("array<string>")), lambda u: F.struct(last.alias("rank"), u.alias("scope")))
    return F.concat(own, F.array(F.struct(last.alias("rank"), F.lit("").alias("scope"))), used)


def resolved(asked: DataFrame, declared: DataFrame) -> DataFrame:
    """asked (id, name, scopes) with `target` and `target_kind`: the declared (key, kind) that the nearest scope with one
    holds; both null where no scope holds one, or the nearest holds several. Ids and keys that repeat count once."""
    index = declared.groupBy("key").agg(F.min("kind").alias("kind"))
    asked = asked.dropDuplicates(["id"])
    tried = asked.select("id", F.explode("scopes").alias("s"), "name").select("id", F.col("s.rank").alias("rank"), F.concat_ws(".", F.nullif(F.col("s.scope"), F.lit("")), "name").alias("key"))
    hits = looked_up(written(tried, "tried"), index, "key").groupBy("id").agg(F.collect_set(F.struct("rank", "key", "kind")).alias("hits"))
    near = F.filter("hits", lambda h: h["rank"] == F.array_min(F.transform("hits", lambda x: x["rank"])))
    one = hits.select("id", F.array_distinct(F.transform(near, lambda h: F.struct(h["key"].alias("key"), h["kind"].alias("kind")))).alias("near"))
    one = one.filter(F.size("near") == 1).select("id", F.col("near")[0]["key"].alias("target"), F.col("near")[0]["kind"].alias("target_kind"))
    return asked.select("id", "name").join(one, "id", "left")


def _listed(rows: DataFrame, name: str, most: int, by: str = "place") -> DataFrame:
    """(_ord, name): the values in order of where they first stand, each once, `most` of them."""
    first = rows.groupBy("_ord", "value").agg(F.min(by).alias("at"))
    return first.groupBy("_ord").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), 1, most).alias(name))


def context(refs: DataFrame, max_depth: int = MAX_DEPTH, max_callees: int = MAX_CALLEES, max_interfaces: int = MAX_INTERFACES) -> DataFrame:
    """A row for each declaration of refs (see sources/references.py):

    called_symbols          whole names of what its body calls or creates, in order, without repeats
    implemented_interfaces  the interfaces in the base list of its type, as declared or, if unknown, as written
    inheritance_chain       the base types of its type, nearest first, to max_depth; of an interface, those it extends
    overridden_member       the nearest inherited member that may be overridden, if it is an override
    unresolved_references   what it names that was found nowhere or in several places, as written

    Members that a type inherits are found up to max_depth. A name of a base that no file declares counts as an interface if
    it is an I and a capital. All parts of a partial type count together.
    """
    refs = written(refs, "references")
    types = ("class", "struct", "record", "record-struct", "interface", "enum")
    declares = refs.filter("role = 'declares'")
    type_rows = declares.filter(F.col("kind").isin(*types))
    shown = type_rows.groupBy("key").agg(F.min("fqn").alias("fqn"))

    # the types that names stand for, each name of a file and owner asked once
    id_ = F.sha2(F.to_json(F.struct("owner", "namespace", "usings", "name", "arity")), 256)
    named = refs.filter("role != 'declares' and name is not null and name != 'base'").withColumn("id", id_)
    full = F.when(F.col("arity") > 0, F.concat("name", F.lit("`"), F.col("arity").cast("string"))).otherwise(F.col("name"))
    asked = named.select("id", full.alias("name"), scopes(F.col("namespace"), F.col("owner"), F.col("usings")).alias("scopes"))
    target = written(resolved(asked, type_rows.select("key", "kind")).select("id", "target", "target_kind"), "targets")
    known = written(looked_up(written(named, "named"), target, "id", "left"), "known")

    # base lists of types
    looks = F.coalesce(F.col("target_kind") == "interface", F.col("name").rlike(r"(?:^|\.)I[A-Z]\w*$"))
    bases = known.filter("role = 'base'").withColumn("is_interface", looks).withColumn("value", F.coalesce("target", "written"))
    bases = written(bases.select(F.col("owner").alias("child"), F.col("value").alias("parent"), "kind", "is_interface", "place", "written", "target"), "bases")
    up = bases.filter("kind = 'interface' or kind in ('class', 'record') and not is_interface")
    chain = written(ancestors(up, max_depth), "chain")
    member_up = written(chain.select(F.col("child").alias("owner"), F.col("ancestor").alias("at"), "depth"), "above")

    # names to show for keys
    def by_type(rows: DataFrame, name: str, most: int, by: str) -> DataFrame:
        """rows (child, parent, by) as lists of whole names for each type."""
        s = rows.select("child", F.col("parent").alias("key"), by).join(shown, "key", "left").select(F.col("child").alias("_ord"), F.coalesce("fqn", "key").alias("value"), by)
        return _listed(s, name, most, by).withColumnRenamed("_ord", "owner")

    implemented = by_type(bases.filter("is_interface"), "implemented_interfaces", max_interfaces, "place")
    inherited = by_type(chain.withColumnRenamed("ancestor", "parent"), "inheritance_chain", 1 << 30, "depth")

    # members: key of the type, a dot and the bare name
    bare = F.regexp_replace("key", r"`\d+$", "")
    members = written(declares.filter(~F.col("kind").isin(*types)).select(bare.alias("member_key"), "fqn", "kind", "open"), "members")
    callable_ = members.filter("kind = 'method'").groupBy("member_key").agg(F.min("fqn").alias("callee"))
    held = chain.groupBy(F.col("child").alias("start")).agg(F.collect_list(F.struct(F.col("depth").alias("depth"), F.col("ancestor").alias("at"))).alias("ups"))

    calls = refs.filter("role = 'call' and (name is null or name = 'base')").select("_ord", "place", "member", "written", F.col("owner").alias("start"), (F.col("name").isNotNull()).alias("skip_own"))
    other = known.filter("role = 'call'").select("_ord", "place", "member", "written", F.col("target").alias("start"), F.lit(False).alias("skip_own"))
    sites = looked_up(written(calls.unionByName(other), "calls"), held, "start", "left")
    own = F.when(F.col("start").isNotNull() & ~F.col("skip_own"), F.array(F.struct(F.lit(0).alias("depth"), F.col("start").alias("at"))))
    nobody = F.array().cast("array<struct<depth:int,at:string>>")
    tries = sites.select("_ord", "place", "written", "member", F.explode_outer(F.concat(F.coalesce(own, nobody), F.coalesce("ups", nobody))).alias("t"))
    tries = written(tries.select("_ord", "place", "written", F.col("t.depth").alias("depth"), F.concat("t.at", F.lit("."), "member").alias("member_key")), "tries")
    found = looked_up(tries, callable_, "member_key", "left").groupBy("_ord", "place", "written").agg(F.min_by("callee", F.when(F.col("callee").isNotNull(), F.col("depth"))).alias("value"))

    created = known.filter("role = 'new'").select("_ord", "place", "written", F.col("target").alias("key"))
    simple = F.regexp_replace(F.element_at(F.split("key", r"\."), -1), r"`\d+$", "")
    created = looked_up(written(created, "created"), shown, "key", "left").select("_ord", "place", "written", F.concat("fqn", F.lit("."), simple).alias("value"))
    uses = written(found.unionByName(created), "uses")
    called = _listed(uses.filter("value is not null"), "called_symbols", max_callees)
    missing = uses.filter("value is null").select("_ord", "written", "place")
    missing = missing.unionByName(known.filter("role = 'base' and target is null").select("_ord", "written", "place"))
    unresolved = _listed(missing.select("_ord", F.col("written").alias("value"), "place"), "unresolved_references", 1 << 30)

    # the member that an override takes the place of
    may = members.filter("open").groupBy("member_key", "kind").agg(F.min("fqn").alias("overridden"))
    name = F.element_at(F.split(bare, r"\."), -1)
    over = declares.filter("overrides").select("_ord", "kind", "owner", name.alias("member")).join(member_up, "owner")
    over = over.withColumn("member_key", F.concat("at", F.lit("."), "member")).join(may, ["member_key", "kind"])
    over = over.groupBy("_ord").agg(F.min_by("overridden", "depth").alias("overridden_member"))

    out = written(declares.select("_ord", "fqn", "owner"), "declared")
    out = looked_up(out, implemented, "owner", "left")
    out = looked_up(written(out, "declared"), inherited, "owner", "left")
    for part in (called, over, unresolved):
        out = out.join(part, "_ord", "left")
    empty = F.array().cast("array<string>")
    lists = ("called_symbols", "implemented_interfaces", "inheritance_chain")
    return out.select("_ord", F.col("fqn").alias("fully_qualified_name"), *(F.coalesce(c, empty).alias(c) for c in lists), "overridden_member", F.coalesce("unresolved_references", empty).alias("unresolved_references"))


def enriched(symbols: DataFrame, refs: DataFrame, **limits: int) -> DataFrame:
    """symbols (see read_symbols) with the lists of context(); those it has no row for get nulls."""
    return symbols.join(context(refs, **limits).drop("fully_qualified_name"), "_ord", "left")
