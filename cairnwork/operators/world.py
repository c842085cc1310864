"""The composed world model, and the bounded questions that are asked of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions import ranks as R
from cairnwork.operators import graph as G
from cairnwork.operators import joins as J
from cairnwork.session import materialise

#: Answers list this many of each kind and count the rest.
BOUND = 12


@dataclass(frozen=True)
class World:
    """A world model as tables.

    functions: id, name, owner_type, path, subsystem, public, test, unresolved (its unresolved call sites)
    relations: kind (INVOKES, SUPPLIES_DATA, STATE_FLOW, ENCLOSES, DISPATCHES_TO), src, dst, status, weight,
        move (descend, return, state), evidence
    effects: function, category, status, label;  state: key, function, role (read, write)
    coverage: path, dimension, status;  dependencies: src, dst, declared, built, calls, verdict
    invariants: id, kind, status, scope (array of subsystems), evidence (array of functions); an invariant with
        much evidence has many rows, each with a part of it, as a state that very many functions write
    spelled: function, name, n (unresolved call sites by the name at the site)
    """

    functions: DataFrame
    relations: DataFrame
    effects: DataFrame
    state: DataFrame
    coverage: DataFrame
    dependencies: DataFrame
    invariants: DataFrame
    spelled: DataFrame


def compose(functions: DataFrame, call_sites: DataFrame, state: DataFrame, closures: DataFrame, dispatch: DataFrame) -> DataFrame:
    """The weighted relations of a world: sites of one (kind, src, dst) count as weight, and the least of them is
    the evidence.

    call_sites: site, function, callee, supplies, returns. A call that supplies data, and one that returns a
    value, is a data relation besides the invocation, the latter the other way round. `closures` (outer,
    inner) enclose; `dispatch` (declaration, implementation) is inferred. Flows through state (`state`: key,
    function, role) go from writers to the node `state:key` and from there to readers, so that a key that
    all functions touch makes as many relations as it has users, not their square.
    """
    known = functions.select(F.col("id"))
    sites = call_sites.where("callee is not null").join(known.select(F.col("id").alias("function")), "function", "left_semi")
    kinds = F.array_compact(F.array(
        F.struct(F.lit("INVOKES").alias("kind"), F.lit("descend").alias("move"), F.col("function").alias("src"), F.col("callee").alias("dst")),
        F.when(F.coalesce("supplies", F.lit(False)), F.struct(F.lit("SUPPLIES_DATA").alias("kind"), F.lit("descend").alias("move"), F.col("function").alias("src"), F.col("callee").alias("dst"))),
        F.when(F.coalesce("returns", F.lit(False)), F.struct(F.lit("SUPPLIES_DATA").alias("kind"), F.lit("return").alias("move"), F.col("callee").alias("src"), F.col("function").alias("dst"))),
    ))
    from_calls = sites.select(F.explode(kinds).alias("r"), F.col("site").cast("string").alias("evidence")).select("r.*", "evidence", F.lit("DERIVED").alias("status"))
    ends = state.where("key is not null").select("key", "function", "role").distinct()
    hub, user = F.concat(F.lit("state:"), "key"), F.col("function")
    writes = F.col("role") == "write"
    flows = ends.select(F.lit("STATE_FLOW").alias("kind"), F.lit("state").alias("move"), F.when(writes, user).otherwise(hub).alias("src"), F.when(writes, hub).otherwise(user).alias("dst"), F.col("key").alias("evidence"), F.lit("DERIVED").alias("status"))
    inner = closures.select(F.lit("ENCLOSES").alias("kind"), F.lit("descend").alias("move"), F.col("outer").alias("src"), F.col("inner").alias("dst"), F.lit("").alias("evidence"), F.lit("DERIVED").alias("status"))
    impl = dispatch.select(F.lit("DISPATCHES_TO").alias("kind"), F.lit("descend").alias("move"), F.col("declaration").alias("src"), F.col("implementation").alias("dst"), F.lit("name join").alias("evidence"), F.lit("INFERRED").alias("status"))
    rows = from_calls.unionByName(flows).unionByName(inner).unionByName(impl)
    return rows.groupBy("kind", "move", "src", "dst").agg(F.min("status").alias("status"), F.count("*").alias("weight"), F.min("evidence").alias("evidence"))


class UnknownSelector(ValueError):
    """Nothing has exactly this name; there is no guessing."""


@dataclass(frozen=True)
class Scope:
    selector: str
    functions: DataFrame  # id
    components: DataFrame  # path
    subsystems: DataFrame  # name


def strip_generics(c: Column) -> Column:
    return F.substring_index(c, "<", 1)


def resolve(world: World, selector: str, provided: DataFrame | None = None) -> Scope:
    """The functions, files and subsystems that `subsystem:`, `path:`, `fn:` (name or Owner::name), `state:` or
    `capability:` names (what `provided`, capability and subsystem, says provides it); a bare selector is a subsystem if there is one of that name, else a path."""
    kind, sep, value = selector.partition(":")
    if not sep or kind not in ("subsystem", "path", "fn", "state", "capability"):
        kind = "path" if world.functions.where(F.col("subsystem") == selector).isEmpty() else "subsystem"
        value = selector
    f = world.functions
    if kind == "subsystem":
        mine = f.where(F.col("subsystem") == value)
    elif kind == "capability":
        if provided is None:
            raise UnknownSelector(f"nothing tells what provides `{value}`")
        mine = f.join(provided.where(F.col("capability") == value).select("subsystem").distinct(), "subsystem", "left_semi")
    elif kind == "path":
        root = value.rstrip("/")
        mine = f.where((F.col("path") == root) | F.col("path").startswith(root + "/"))
    elif kind == "fn":
        owner, has_owner, name = value.rpartition("::")
        mine = f.where(F.col("id") == value) if not f.where(F.col("id") == value).isEmpty() else f.where(F.col("name") == name)
        if has_owner and not mine.isEmpty() and f.where(F.col("id") == value).isEmpty():
            mine = mine.where((F.col("owner_type") == owner) | (strip_generics(F.col("owner_type")) == owner))
    else:
        mine = f.join(world.state.where(F.col("key") == value).select(F.col("function").alias("id")).distinct(), "id", "left_semi")
    mine = materialise(mine.select("id", "path", "subsystem"))
    if mine.isEmpty():
        raise UnknownSelector(f"no {kind} `{value}`")
    return Scope(f"{kind}:{value}", mine.select("id").distinct(), mine.select("path").where("path is not null").distinct(), mine.select(F.col("subsystem").alias("name")).where("name is not null").distinct())


def inside(df: DataFrame, col: str, scope: Scope, part: str = "functions") -> DataFrame:
    members = {"functions": scope.functions.select(F.col("id").alias(col)), "components": scope.components.select(F.col("path").alias(col)), "subsystems": scope.subsystems.select(F.col("name").alias(col))}[part]
    return df.join(members, col, "left_semi")


def bounded(df: DataFrame, order: Sequence[Column], n: int = BOUND) -> DataFrame:
    """The first rows of an answer, and in each how many were left out."""
    head = df.orderBy(*order).limit(n)
    total = df.agg(F.count("*").alias("_total"))
    return head.crossJoin(F.broadcast(total)).withColumn("n_omitted", F.greatest(F.col("_total") - n, F.lit(0))).drop("_total")  # one row


def effects(world: World, scope: Scope) -> DataFrame:
    """(category, n_sites, strongest, n_functions) of the effects in scope, most sites first."""
    rows = inside(world.effects, "function", scope)
    return rows.groupBy("category").agg(F.count("*").alias("n_sites"), R.strongest(R.STRENGTH, F.col("status")).alias("strongest"), F.countDistinct("function").alias("n_functions"))


def unknowns(world: World, scope: Scope) -> DataFrame:
    """(dimension, n_ok, n_unknown, n_unsupported) of the files in scope; dimension `(calls)` counts unresolved call
    sites as unknown."""
    rows = inside(world.coverage, "path", scope, "components")
    s = F.col("status")
    tally = rows.groupBy("dimension").agg(F.count_if(~s.isin("UNKNOWN", "UNSUPPORTED")).alias("n_ok"), F.count_if(s == "UNKNOWN").alias("n_unknown"), F.count_if(s == "UNSUPPORTED").alias("n_unsupported"))
    calls = inside(world.functions.select("id", "unresolved"), "id", scope).agg(F.lit("(calls)").alias("dimension"), F.lit(0).cast("long").alias("n_ok"), F.coalesce(F.sum("unresolved"), F.lit(0)).cast("long").alias("n_unknown"), F.lit(0).cast("long").alias("n_unsupported"))
    return tally.unionByName(calls)


def upstream_steps(world: World) -> DataFrame:
    """(src, dst, why): from a function to those that depend on it. Resolved calls have no `why`; a closure leads to
    its enclosing function, an implementation to its declaration, and a function to unresolved sites that
    spell its name when no other function has it."""
    r = world.relations
    back = lambda kind, why: r.where(F.col("kind") == kind).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(why).cast("string").alias("why"))
    single = world.functions.groupBy("name").agg(F.count("*").alias("_n"), F.min("id").alias("src")).where("_n = 1").select("name", "src")
    spelled = world.spelled.join(single, "name").select("src", F.col("function").alias("dst"), F.lit("UNIQUE_NAME").alias("why"))
    return J.union_all([back("INVOKES", None), back("ENCLOSES", "ENCLOSES"), back("DISPATCHES_TO", "DISPATCHES_TO"), spelled]).distinct()


def frontier(world: World, scope: Scope) -> DataFrame:
    """(id, depth, reason, subsystem, test) of all that depends on the scope; a null reason is a resolved way."""
    reached = G.upstream(upstream_steps(world), scope.functions.select(F.col("id").alias("node")))
    return reached.join(world.functions.select(F.col("id").alias("node"), "subsystem", "test"), "node", "left").select(F.col("node").alias("id"), "depth", "reason", "subsystem", "test")


def frontier_summary(reached: DataFrame) -> DataFrame:
    """(reason, subsystem, n, min_depth, nearest, n_omitted); resolved and inferred ways are never mixed."""
    rows = reached.select(F.concat_ws("|", F.coalesce("reason", F.lit("RESOLVED")), F.coalesce("subsystem", F.lit("-"))).alias("g"), F.col("id").alias("node"), "depth")
    out = G.impact_frontier(rows, "g", BOUND)
    return out.select(F.substring_index("g", "|", 1).alias("reason"), F.expr("substring(g, instr(g, '|') + 1)").alias("subsystem"), "n_nodes", "min_depth", "nearest", "n_omitted")


def impact(world: World, scopes: Sequence[Scope]) -> DataFrame:
    """(section, item, n): what a change of the scopes reaches: components of callers, readers of state they write,
    invariants at risk."""
    seed = materialise(J.union_all([s.functions for s in scopes]).distinct())
    calls = world.relations.where("kind = 'INVOKES'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    callers = G.bfs_depth(calls, seed.select(F.col("id").alias("node")))
    comps = callers.join(world.functions.select(F.col("id").alias("node"), "path"), "node").groupBy(F.coalesce("path", F.lit("-")).alias("item")).agg(F.count("*").alias("n")).select(F.lit("component").alias("section"), "item", "n")
    written = world.state.where("role = 'write'").join(seed.select(F.col("id").alias("function")), "function", "left_semi").select("key").distinct()
    readers = world.state.where("role = 'read'").join(written, "key", "left_semi").join(seed.select(F.col("id").alias("function")), "function", "left_anti").groupBy(F.col("key").alias("item")).agg(F.countDistinct("function").alias("n")).select(F.lit("state_readers").alias("section"), "item", "n")
    subs = J.union_all([s.subsystems for s in scopes]).distinct()
    touched = world.invariants.select("id", "kind", F.explode_outer("evidence").alias("f")).join(seed.select(F.col("id").alias("f")), "f", "left_semi").select("id")
    scoped = world.invariants.where("kind = 'DEPENDENCY'").select("id", F.explode("scope").alias("name")).join(subs, "name", "left_semi").select("id")
    risk = touched.union(scoped).distinct().select(F.lit("invariant").alias("section"), F.col("id").alias("item"), F.lit(1).cast("long").alias("n"))
    return J.union_all([comps, readers, risk])


def trace(world: World, origin: Scope, destination: Scope) -> DataFrame:
    moves = world.relations.select("src", "dst", "kind", "move", "evidence", ((F.col("status") != "DERIVED") | (F.col("kind") == "ENCLOSES")).alias("inferred"))
    return G.realizable_path(moves, origin.functions.select(F.col("id").alias("node")), destination.functions.select(F.col("id").alias("node")))


def why(world: World, a: Scope, b: Scope) -> DataFrame:
    """(section, src, dst, detail): relations either way between two scopes, dependencies of their subsystems, and
    invariants over both."""
    mark = lambda df, m, col, flag: df.join(m.select(F.col(m.columns[0]).alias(col), F.lit(True).alias(flag)), col, "left")

    def between(df: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
        for side in ("src", "dst"):
            df = mark(mark(df, x, side, f"_a{side}"), y, side, f"_b{side}")
        return df.where("(_asrc and _bdst) or (_bsrc and _adst)")

    rel = between(world.relations, a.functions, b.functions).select(F.lit("relation").alias("section"), "src", "dst", F.col("kind").alias("detail"))
    dep = between(world.dependencies, a.subsystems, b.subsystems).select(F.lit("dependency").alias("section"), "src", "dst", F.col("verdict").alias("detail"))
    inv = world.invariants.where("kind = 'DEPENDENCY'").select("id", F.explode("scope").alias("name"))
    both = inv.join(a.subsystems, "name", "left_semi").select("id").distinct().join(inv.join(b.subsystems, "name", "left_semi").select("id").distinct(), "id")
    return J.union_all([rel, dep, both.select(F.lit("invariant").alias("section"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("id").alias("detail"))])


def state_model(world: World, scope: Scope) -> DataFrame:
    """(key, writers and readers inside and outside) of every state that the scope touches."""
    keys = inside(world.state, "function", scope).select("key").distinct()
    rows = world.state.join(keys, "key", "left_semi").select("key", "function", "role").distinct().join(scope.functions.select(F.col("id").alias("function"), F.lit(True).alias("_in")), "function", "left")
    count = lambda role, there: F.count_if((F.col("role") == role) & (F.col("_in").isNotNull() if there else F.col("_in").isNull()))
    return rows.groupBy("key").agg(count("write", True).alias("writers_in"), count("write", False).alias("writers_out"), count("read", True).alias("readers_in"), count("read", False).alias("readers_out"))


def invariants(world: World, scope: Scope) -> DataFrame:
    """Invariants that the scope bears on, strongest first: by evidence, or (but for state) by subsystem."""
    by_evidence = world.invariants.select("id", F.explode("evidence").alias("f")).join(scope.functions.select(F.col("id").alias("f")), "f", "left_semi").select("id")
    by_scope = world.invariants.where("kind <> 'STATE'").select("id", F.explode("scope").alias("name")).join(scope.subsystems, "name", "left_semi").select("id")
    return world.invariants.join(by_evidence.union(by_scope).distinct(), "id", "left_semi").select("id", "kind", "status").distinct().orderBy(R.rank(R.STRENGTH, F.col("status")), "id")


def dependencies(world: World, scope: Scope) -> DataFrame:
    return inside(world.dependencies, "src", scope, "subsystems").union(inside(world.dependencies, "dst", scope, "subsystems").select(*world.dependencies.columns)).distinct()


def compare(world: World, a: Scope, b: Scope) -> DataFrame:
    """(section, item, held): effect categories of one scope or both, shared callees, shared state."""

    def sides(df: DataFrame, key: str, item: str) -> DataFrame:
        both = inside(df, key, a).select(F.col(item).alias("item"), F.lit("a").alias("s")).union(inside(df, key, b).select(F.col(item).alias("item"), F.lit("b").alias("s")))
        return both.groupBy("item").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).select("item", F.when(F.col("lo") != F.col("hi"), "shared").otherwise(F.concat(F.lit("only_"), "lo")).alias("held"))

    calls = world.relations.where("kind = 'INVOKES'").select("src", "dst")
    parts = [sides(world.effects, "function", "category").select(F.lit("effect").alias("section"), "item", "held"), sides(calls, "src", "dst").where("held = 'shared'").select(F.lit("callee").alias("section"), "item", "held"), sides(world.state, "function", "key").where("held = 'shared'").select(F.lit("state").alias("section"), "item", "held")]
    return J.union_all(parts)


def boundary(world: World, scope: Scope) -> DataFrame:
    """(direction, counterpart, n, weight): relations between functions with exactly one end in scope, by the other
    end's subsystem. What passes through state is in `state_model`."""
    m = scope.functions
    r = world.relations.where("kind <> 'STATE_FLOW'").join(m.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(m.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left").where("(_s is null) <> (_d is null)")
    other = r.select(F.when(F.col("_s"), "out").otherwise("in").alias("direction"), F.when(F.col("_s"), F.col("dst")).otherwise(F.col("src")).alias("id"), "weight")
    return other.join(world.functions.select("id", "subsystem"), "id", "left").groupBy("direction", F.coalesce("subsystem", F.lit("-")).alias("counterpart")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def entry_points(world: World, scope: Scope) -> DataFrame:
    """(id, n_callers, public): functions called from outside, most callers first."""
    outer = inside(world.relations.where("kind = 'INVOKES'"), "dst", scope).join(scope.functions.select(F.col("id").alias("src")), "src", "left_anti")
    counted = outer.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n_callers"))
    return counted.join(world.functions.where("not test").select("id", "public"), "id")


def understand(world: World, scope: Scope) -> DataFrame:
    """(section, item, n): a mission's context in one bounded table: entry points, flows over the boundary, state,
    effects, invariants, unknowns, the resolved frontier, and totals; twelve items of each section."""
    entry = entry_points(world, scope).select(F.lit("entry_point").alias("section"), F.col("id").alias("item"), F.col("n_callers").alias("n"))
    flow = boundary(world, scope).select(F.concat(F.lit("flow_"), "direction").alias("section"), F.col("counterpart").alias("item"), F.col("weight").alias("n"))
    state = state_model(world, scope).select(F.lit("state").alias("section"), F.col("key").alias("item"), F.expr("writers_in + writers_out + readers_in + readers_out").alias("n"))
    eff = effects(world, scope).select(F.lit("effect").alias("section"), F.col("category").alias("item"), F.col("n_sites").alias("n"))
    inv = invariants(world, scope).select(F.lit("invariant").alias("section"), F.col("id").alias("item"), F.lit(1).cast("long").alias("n"))
    unk = unknowns(world, scope).select(F.lit("unknown").alias("section"), F.col("dimension").alias("item"), F.col("n_unknown").alias("n")).where("n > 0")
    front = frontier(world, scope).where("reason is null").groupBy(F.coalesce("subsystem", F.lit("-")).alias("item")).agg(F.count("*").alias("n")).select(F.lit("frontier").alias("section"), "item", "n")
    total = scope.functions.agg(F.lit("total").alias("section"), F.lit("functions").alias("item"), F.count("*").alias("n"))
    rows = J.union_all([x.select("section", "item", F.col("n").cast("long").alias("n")) for x in (entry, flow, state, eff, inv, unk, front, total)])
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy("section").orderBy(F.desc("n"), "item"))).where(F.col("_rn") <= BOUND).drop("_rn")


def explain(world: World, scope: Scope) -> DataFrame:
    """(id, name, path, callers, callees, effects, state) of the functions in scope, at most twelve, by id."""
    f = inside(world.functions, "id", scope).orderBy("id").limit(BOUND)
    calls = world.relations.where("kind = 'INVOKES'")
    callers = calls.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n_callers"))
    callees = calls.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n_callees"))
    eff = world.effects.groupBy(F.col("function").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("effects"))
    st = world.state.groupBy(F.col("function").alias("id")).agg(F.countDistinct("key").alias("n_states"))
    out = reduce(lambda x, y: x.join(y, "id", "left"), (callers, callees, eff, st), f)
    return out.select("id", "name", "path", F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce("n_callees", F.lit(0)).alias("n_callees"), F.coalesce("effects", F.lit("")).alias("effects"), F.coalesce("n_states", F.lit(0)).alias("n_states"))


def plan(world: World, scope: Scope) -> DataFrame:
    """(step, item): what a change of the scope must keep, test again and clear up."""
    keep = invariants(world, scope).select(F.lit("preserve").alias("step"), F.col("id").alias("item"))
    again = impact(world, [scope]).where("section <> 'invariant'").select(F.concat(F.lit("verify_"), "section").alias("step"), "item")
    clear = unknowns(world, scope).where("n_unknown > 0").select(F.lit("resolve").alias("step"), F.col("dimension").alias("item"))
    return J.union_all([keep, again, clear])


def invariant_delta(before: World, after: World, authority: Sequence[str]) -> DataFrame:
    """(section, item): what a change did to the invariants (`broken`: in conflict and was not, or new in conflict;
    `dropped`; `weakened` and `strengthened` by their standing; `new`), which subsystems have effects of the
    categories `authority` that they had not, and dependencies whose verdict is another. The change has
    regressed when anything is broken or dropped."""
    of = lambda w: w.invariants.groupBy("id").agg(F.min(R.rank(R.STRENGTH, F.col("status"))).alias("k"), F.bool_or(F.col("status") == "CONFLICT").alias("c"))
    b, a = of(before).select("id", F.col("k").alias("kb"), F.col("c").alias("cb")), of(after).select("id", F.col("k").alias("ka"), F.col("c").alias("ca"))
    both = b.join(a, "id", "full_outer")
    section = F.when(F.col("ka").isNull(), "dropped").when(F.col("ca") & ~F.coalesce("cb", F.lit(False)), "broken").when(F.col("kb").isNull(), "new").when(F.col("ka") > F.col("kb"), "weakened").when(F.col("ka") < F.col("kb"), "strengthened")
    changes = both.select(section.alias("section"), F.col("id").alias("item")).where("section is not null")
    held = lambda w: w.effects.where(F.col("category").isin(*authority)).join(w.functions.select(F.col("id").alias("function"), "subsystem"), "function").where("subsystem is not null").select(F.concat_ws(": ", "subsystem", "category").alias("item")).distinct()
    gained = held(after).join(held(before), "item", "left_anti").select(F.lit("new_authority").alias("section"), "item")
    x, y = (w.dependencies.select("src", "dst", F.col("verdict").alias(n)) for w, n in ((before, "vb"), (after, "va")))
    moved = x.join(y, ["src", "dst"], "full_outer").where("not (vb <=> va)").select(F.lit("dependency").alias("section"), F.concat(F.col("src"), F.lit("->"), F.col("dst"), F.lit(": "), F.coalesce("vb", F.lit("absent")), F.lit(" -> "), F.coalesce("va", F.lit("removed"))).alias("item"))
    return J.union_all([changes, gained, moved])


def capabilities(provided: DataFrame, consumed: DataFrame, scope: Scope) -> DataFrame:
    """(capability, n_providers, n_consumers) of capabilities that a subsystem in scope provides or consumes;
    `provided` and `consumed` have capability and subsystem."""
    sides = provided.select("capability", "subsystem", F.lit(True).alias("_p")).unionByName(consumed.select("capability", "subsystem", F.lit(False).alias("_p"))).distinct()
    mine = sides.join(scope.subsystems.select(F.col("name").alias("subsystem")), "subsystem", "left_semi").select("capability").distinct()
    return sides.join(mine, "capability", "left_semi").groupBy("capability").agg(F.count_if("_p").alias("n_providers"), F.count_if(~F.col("_p")).alias("n_consumers"))


def impact_closure(before: World, after: World, changed: DataFrame) -> DataFrame:
    """(function, rule): functions that a change of the files `changed` (path) may affect, with the first rule that
    says so: R1 defined in a changed file, before or after; R2 called by one of these; R3 caller of one that is
    gone; R4 with a call, resolved or not, spelled like one that is new."""
    at = lambda w: w.functions.join(changed.select("path"), "path", "left_semi").select("id", "name")
    b, a = materialise(at(before)), materialise(at(after))
    rule = lambda df, c, n, r: df.select(F.col(c).alias("function"), F.lit(n).alias("_k"), F.lit(r).alias("rule"))
    calls = lambda w: w.relations.where("kind = 'INVOKES'").select("src", "dst")
    callees = calls(before).join(b.select(F.col("id").alias("src")), "src", "left_semi").union(calls(after).join(a.select(F.col("id").alias("src")), "src", "left_semi"))
    removed = b.join(a, "id", "left_anti").select(F.col("id").alias("dst"))
    callers = calls(before).join(removed, "dst", "left_semi")
    added = a.join(b.select("id"), "id", "left_anti").select("name").distinct()
    named = before.spelled.join(added, "name", "left_semi").select("function").union(calls(before).join(before.functions.select(F.col("id").alias("dst"), "name"), "dst").join(added, "name", "left_semi").select("src"))
    rows = J.union_all([rule(b.select("id").union(a.select("id")), "id", 1, "R1_SEED"), rule(callees, "dst", 2, "R2_CALLEE"), rule(callers, "src", 3, "R3_CALLER_OF_REMOVED"), rule(named, "function", 4, "R4_NAME_CANDIDATE")])
    return rows.groupBy("function").agg(F.min(F.struct("_k", "rule"))["rule"].alias("rule"))


def outside_closure(before: World, after: World, closure: DataFrame) -> DataFrame:
    """The soundness check: functions whose composed behaviour differs though the closure does not hold them."""

    def behaviour(w: World) -> DataFrame:
        ends = w.relations.select(F.explode(F.array("src", "dst")).alias("function"), F.xxhash64("kind", "src", "dst", "weight").alias("h"))
        return ends.groupBy("function").agg(F.bit_xor("h").alias("h"))

    x, y = behaviour(before).withColumnRenamed("h", "hb"), behaviour(after).withColumnRenamed("h", "ha")
    return x.join(y, "function", "full_outer").where("not (hb <=> ha)").select("function").join(closure.select("function"), "function", "left_anti")
