"""The world model of the architecture tables, and the questions asked of it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.operators import constraints as C
from cairnwork.operators import world as L
from cairnwork.plans import relational as P
from cairnwork.plans import evidence_queries  # noqa: F401 (its queries are used by name)
from cairnwork.plans import store as S
from cairnwork.plans.graph_queries import arch_sql
from cairnwork.plans.registry import ORACLES, QUERIES, query
from cairnwork.session import materialise


def architecture_world(spark: SparkSession, sf_dir: str, dependencies: bool = False, until: str | None = None) -> L.World:
    """Nodes are functions, files components, crates subsystems. Calls invoke, and supply data; reads and writes
    touch the state of the node they lead to; what owns encloses, what guards dispatches. Dependencies between
    crates, and the invariants that follow, are composed only for questions that need them."""
    with ThreadPoolExecutor(1) as pool:  # the dependencies need nothing of the rest: cores that one waits for serve the other
        found = pool.submit(inheritable_thread_target(lambda: materialise(P.reconcile_three_way(spark, sf_dir)))) if dependencies else None
        return _composed(spark, sf_dir, until, lambda: found.result() if found else spark.createDataFrame([], "src string, dst string, declared boolean, built boolean, calls bigint, verdict string"))


def _composed(spark: SparkSession, sf_dir: str, until: str | None, dependencies: Callable[[], DataFrame]) -> L.World:
    nodes, edges = S.architecture(spark, sf_dir, until)
    nodes, edges = materialise(nodes), materialise(edges.where("src is not null and dst is not null"))
    sub = F.lower(F.trim("crate"))
    missing = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").where("kind = 'calls'")
    unresolved = missing.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("unresolved"))
    functions = nodes.join(unresolved, "node", "left").select(F.col("node").alias("id"), F.regexp_extract("node", ":([^#]*)", 1).alias("name"), F.col("kind").alias("owner_type"), F.col("file_path").alias("path"), sub.alias("subsystem"), (F.col("status") == "verified").alias("public"), (F.col("kind") == "gate").alias("test"), F.coalesce("unresolved", F.lit(0)).alias("unresolved"))
    functions = materialise(functions)
    known = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    calls = known.where("kind = 'calls'").select(F.col("id").alias("site"), F.col("src").alias("function"), F.col("dst").alias("callee"), F.col("evidence_ref").isNotNull().alias("supplies"), (F.col("id") % 2 == 0).alias("returns"))
    state = materialise(known.where("kind in ('reads', 'writes')").select(F.col("dst").alias("key"), F.col("src").alias("function"), F.when(F.col("kind") == "reads", "read").otherwise("write").alias("role")).distinct())
    owns = known.where("kind = 'owns' and src <> dst").select(F.col("src").alias("outer"), F.col("dst").alias("inner"))
    guards = known.where("kind = 'guards' and src <> dst").select(F.col("src").alias("declaration"), F.col("dst").alias("implementation"))
    relations = materialise(L.compose(functions, calls, state, owns, guards))
    status = F.when(F.col("evidence_ref").isNotNull(), "OBSERVED").otherwise("INFERRED")
    effects = known.where("kind in ('reads', 'writes', 'calls')").select(F.col("src").alias("function"), F.upper("kind").alias("category"), status.alias("status"), F.col("dst").alias("label"))
    stand = F.when(F.col("status") == "verified", "OBSERVED").when(F.col("status") == "planned", "UNKNOWN").when(F.col("status") == "blocked", "UNSUPPORTED").otherwise("DERIVED")
    coverage = nodes.where("file_path is not null").select(F.col("file_path").alias("path"), F.upper("kind").alias("dimension"), stand.alias("status"))
    deps = dependencies()
    invariants = deps.where("verdict = 'CONFIRMED'").select(F.concat_ws(":", F.lit("INV-DEPENDENCY"), "src", "dst").alias("id"), F.lit("DEPENDENCY").alias("kind"), F.lit("DERIVED").alias("status"), F.array("src", "dst").alias("scope"), F.array().cast("array<string>").alias("evidence"))
    writers = state.where("role = 'write'").select(F.concat_ws(":", F.lit("INV-STATE"), "key").alias("id"), F.lit("STATE").alias("kind"), F.lit("INFERRED").alias("status"), F.array().cast("array<string>").alias("scope"), F.array("function").alias("evidence"))
    spelled = missing.groupBy(F.col("src").alias("function"), F.regexp_extract("dst", ":([^#]*)", 1).alias("name")).agg(F.count("*").alias("n"))
    return L.World(functions, relations, effects, state, coverage, deps, invariants.unionByName(writers), spelled)


#: The time at which the world before a change is seen.
BEFORE = "2025-07-01"
_A, _B = "subsystem:vantor-core", "subsystem:vantor-ledger"

_W = f"""{S.ARCH}, fn as (select node id, lower(trim(crate)) subsystem, file_path, status, kind from anode), kn as (select e.* from aedge e where src in (select id from fn) and dst in (select id from fn)),
sa as (select id from fn where subsystem = 'vantor-core'), sb as (select id from fn where subsystem = 'vantor-ledger'), st as (select distinct dst k, src f, kind from kn where kind in ('reads', 'writes'))"""


@query(f"with {_W} select upper(kind) as category, count(*) as n_sites, case when bool_or(evidence_ref is not null) then 'OBSERVED' else 'INFERRED' end as strongest, count(distinct src) as n_functions from kn where kind in ('reads', 'writes', 'calls') and src in (from sa) group by 1")
def lens_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = architecture_world(spark, sf_dir)
    return L.effects(w, L.resolve(w, _A))


@query(f"with {_W} select upper(kind) as dimension, count(*) filter (status not in ('planned', 'blocked')) as n_ok, count(*) filter (status = 'planned') as n_unknown, count(*) filter (status = 'blocked') as n_unsupported from fn where file_path in (select file_path from fn where subsystem = 'vantor-core') group by 1 union all select '(calls)', 0, count(*), 0 from aedge where kind = 'calls' and src in (from sa) and dst is not null and dst not in (select id from fn)")
def lens_unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = architecture_world(spark, sf_dir)
    return L.unknowns(w, L.resolve(w, _A))


@query(f"with {_W}, t as (select distinct k from st where f in (from sa)) select k as key, count(*) filter (kind = 'writes' and f in (from sa)) as writers_in, count(*) filter (kind = 'writes' and f not in (from sa)) as writers_out, count(*) filter (kind = 'reads' and f in (from sa)) as readers_in, count(*) filter (kind = 'reads' and f not in (from sa)) as readers_out from st where k in (from t) group by 1")
def lens_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = architecture_world(spark, sf_dir)
    return L.state_model(w, L.resolve(w, _A))


def _held(q: str) -> str:
    return f"select item, case when bool_or(s = 'a') and bool_or(s = 'b') then 'shared' when bool_or(s = 'a') then 'only_a' else 'only_b' end held from ({q}) group by 1"


@query(f"""with {_W}, e as ({_held("select upper(kind) item, 'a' s from kn where kind in ('reads', 'writes', 'calls') and src in (from sa) union all select upper(kind), 'b' from kn where kind in ('reads', 'writes', 'calls') and src in (from sb)")}),
  c as ({_held("select dst item, 'a' s from kn where kind = 'calls' and src in (from sa) union all select dst, 'b' from kn where kind = 'calls' and src in (from sb)")}), t as ({_held("select k item, 'a' s from st where f in (from sa) union all select k, 'b' from st where f in (from sb)")})
  select 'effect' as section, item, held from e union all select 'callee', item, held from c where held = 'shared' union all select 'state', item, held from t where held = 'shared'""")
def lens_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = architecture_world(spark, sf_dir)
    return L.compare(w, L.resolve(w, _A), L.resolve(w, _B))


@query(f"""with {_W}, o as (select src, dst from kn where kind = 'calls' and src not in (from sa) and dst in (from sa)), g as (select dst id, count(distinct src) n from o group by 1) select g.id, g.n as n_callers, (fn.status = 'verified') as public from g join fn using (id) where fn.kind <> 'gate'""")
def lens_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = architecture_world(spark, sf_dir)
    return L.entry_points(w, L.resolve(w, _A))


@query(f"""with {_W}, f as (select * from fn where subsystem = 'vantor-core' order by id limit 12) select f.id, regexp_extract(f.id, ':([^#]*)', 1) as name, f.file_path as path, (select count(distinct src) from kn where kind = 'calls' and dst = f.id) as n_callers, (select count(distinct dst) from kn where kind = 'calls' and src = f.id) as n_callees,
  coalesce((select string_agg(distinct upper(kind), ',' order by upper(kind)) from kn where kind in ('reads', 'writes', 'calls') and src = f.id), '') as effects, (select count(distinct k) from st where st.f = f.id) as n_states from f""")
def lens_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = architecture_world(spark, sf_dir)
    return L.explain(w, L.resolve(w, _A))


_REL = """rel as (select distinct kind, move, src, dst from (select 'INVOKES' as kind, 'descend' as move, src, dst from kn where kind = 'calls' union all select 'SUPPLIES_DATA', 'descend', src, dst from kn where kind = 'calls' and evidence_ref is not null
  union all select 'SUPPLIES_DATA', 'return', dst, src from kn where kind = 'calls' and id % 2 = 0 union all select 'ENCLOSES', 'descend', src, dst from kn where kind = 'owns' and src <> dst union all select 'DISPATCHES_TO', 'descend', src, dst from kn where kind = 'guards' and src <> dst))"""
_DEPS = ORACLES["reconcile_three_way"]
_INV = f"""dep as ({_DEPS}), inv as (select 'INV-DEPENDENCY:' || src || ':' || dst as id, 'DEPENDENCY' as kind, 'DERIVED' as status, src, dst, null::varchar as f from dep where verdict = 'CONFIRMED' union all select 'INV-STATE:' || k, 'STATE', 'INFERRED', null, null, f from st where kind = 'writes')"""
_BORNE = "select distinct id, kind, status from inv where f in (from sa) or (kind = 'DEPENDENCY' and (src = 'vantor-core' or dst = 'vantor-core'))"


def _affected(seeds: str) -> str:
    """What a change of the seeds reaches, as SQL."""
    return f"""seed as ({seeds}), up(node, depth) using key (node) as (select distinct id, 0 from seed union select kn.src, min(up.depth) + 1 from up join kn on kn.kind = 'calls' and kn.dst = up.node where kn.src not in (select node from recurring.up) group by kn.src),
  hit as (select 'component' as section, coalesce(fn.file_path, '-') as item, count(*) as n from up join fn on fn.id = up.node where depth > 0 group by 2
    union all select 'state_readers', k, count(distinct f) from st where kind = 'reads' and f not in (from seed) and k in (select k from st where kind = 'writes' and f in (from seed)) group by 2)"""


_UNKNOWN = "select dimension from (select upper(kind) as dimension, count(*) filter (status = 'planned') n from fn where file_path in (select file_path from fn where subsystem = 'vantor-core') group by 1 union all select '(calls)', count(*) from aedge where kind = 'calls' and src in (from sa) and dst is not null and dst not in (select id from fn)) where n > 0"


_UNDERSTAND = f"""with recursive {_W}, {_INV}, raw as (select 'INVOKES' as kind, src, dst from kn where kind = 'calls' union all select 'SUPPLIES_DATA', src, dst from kn where kind = 'calls' and evidence_ref is not null union all select 'SUPPLIES_DATA', dst, src from kn where kind = 'calls' and id % 2 = 0
  union all select 'ENCLOSES', src, dst from kn where kind = 'owns' and src <> dst union all select 'DISPATCHES_TO', src, dst from kn where kind = 'guards' and src <> dst),
  flow as (select case when src in (from sa) then 'flow_out' else 'flow_in' end as section, case when src in (from sa) then dst else src end as id from raw where (src in (from sa)) <> (dst in (from sa))),
  nm as (select id, regexp_extract(id, ':([^#]*)', 1) as name from fn), one as (select name, min(id) id from nm group by 1 having count(*) = 1),
  stp as (select distinct dst src, src dst, case kind when 'INVOKES' then 0 when 'ENCLOSES' then 1 else 2 end w from raw where kind in ('INVOKES', 'ENCLOSES', 'DISPATCHES_TO')
    union select one.id, e.src, 3 from aedge e join one on one.name = regexp_extract(e.dst, ':([^#]*)', 1) where e.kind = 'calls' and e.src is not null and e.dst is not null and e.dst not in (select id from fn)),
  r(node, depth, k) using key (node) as (select distinct id, 0, 0 from sa union select s.dst, min(r.depth) + 1, min(case when r.k > 0 then r.k else s.w end) from r join stp s on s.src = r.node where s.dst not in (select node from recurring.r) group by s.dst),
  whole as (select 'entry_point' as section, id as item, n_callers::bigint as n from ({ORACLES["lens_entry_points"]}) union all select section, coalesce(fn.subsystem, '-'), count(*) from flow left join fn using (id) group by 1, 2
    union all select 'state', key, writers_in + writers_out + readers_in + readers_out from ({ORACLES["lens_state"]}) union all select 'effect', category, n_sites from ({ORACLES["lens_effects"]})
    union all select 'invariant', id, 1 from ({_BORNE}) union all select 'unknown', dimension, n_unknown from ({ORACLES["lens_unknowns"]}) where n_unknown > 0
    union all select 'frontier', coalesce(subsystem, '-'), count(*) from r left join fn on fn.id = r.node where depth > 0 and k = 0 group by 2 union all select 'total', 'functions', count(*) from sa)
  select section, item, n::bigint as n from whole qualify row_number() over (partition by section order by n desc, item) <= 12"""
_HYPOTHESIS = f"""with {_W}, c as (select coalesce(bool_and(status = 'verified'), false) and count(*) > 0 as ok from fn where file_path in (select file_path from fn where subsystem = 'vantor-core')),
  f as (select 'effect' as h, count(*) n, 'VALIDATED' as yes, 'FALSIFIED' as no from kn where kind = 'writes' and src in (from sa) union all select 'never', count(*), 'FALSIFIED', 'VALIDATED' from kn where kind = 'writes' and src in (from sa)
    union all select 'writes-only', count(*), 'FALSIFIED', 'VALIDATED' from kn where kind = 'writes' and src in (from sa) and dst not in (from sa) union all select 'never-invokes', count(*), 'FALSIFIED', 'VALIDATED' from kn where kind = 'calls' and src in (from sa) and dst in (from sb))
  select h as hypothesis, case when f.n > 0 then yes when c.ok then no else 'STILL_HYPOTHESIZED' end as outcome from f, c"""
_RULES = f"""with {_W}, un as (select src id, regexp_extract(dst, ':([^#]*)', 1) as name from aedge where kind = 'calls' and src is not null and dst is not null and dst not in (select id from fn)),
  ef as (select distinct fn.id, fn.subsystem s, upper(kn.kind) c from kn join fn on fn.id = kn.src where kn.kind in ('reads', 'writes', 'calls')),
  facts as (select 'core-writes-nothing' as rule, id as fact, 2 v from ef where s = 'vantor-core' and c = 'WRITES' group by 2 union all select 'core-writes-nothing', id, 1 from fn where subsystem = 'vantor-core' and id in (select id from un)
    union all select distinct 'cli-calls-no-vault', src, 2 from kn join fn on fn.id = kn.src where kn.kind = 'calls' and fn.subsystem = 'vantor-cli' and dst = 'vantor-vault' union all select distinct 'cli-calls-no-vault', un.id, 1 from un join fn using (id) where fn.subsystem = 'vantor-cli' and un.name = 'vantor-vault'
    union all select 'cli-calls-no-vault', id, 1 from fn where subsystem = 'vantor-cli' and id in (select id from un)
    union all select 'mail-effects', id, 2 from ef where s = 'vantor-mail' and c not in ('READS', 'CALLS') group by 2 union all select 'bench-is-pure', id, 2 from ef where s = 'vantor-bench' group by 2),
  num as (select *, row_number() over (partition by rule, v order by fact) rn from facts)
  select r.rule, case coalesce(max(v), 0) when 2 then 'VIOLATED' when 1 then 'UNKNOWN' else 'SATISFIED' end as verdict, count(fact) as n_facts, count(*) filter (v = 2) as n_violations, count(*) filter (v = 1) as n_unknown, coalesce(string_agg(case when v = 2 and rn <= 12 then fact end, ',' order by fact), '') as counterexamples
  from (values ('core-writes-nothing'), ('cli-calls-no-vault'), ('mail-effects'), ('bench-is-pure')) r(rule) left join num using (rule) group by 1"""


def _named(name: str, sql: str | None = None):  # noqa: ANN202
    def decorate(f):  # noqa: ANN001, ANN202
        f.__name__ = name
        return query(sql)(f)

    return decorate




@_named("lens_dependencies", f"select distinct * from ({_DEPS}) where src = 'vantor-core' or dst = 'vantor-core'")
def lens_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = architecture_world(spark, sf_dir, True)
    return L.dependencies(w, L.resolve(w, _A))


@_named("lens_why", f"""with {_W}, {_REL}, {_INV} select 'relation' as section, src, dst, kind as detail from rel where (src in (from sa) and dst in (from sb)) or (src in (from sb) and dst in (from sa))
  union all select 'dependency', src, dst, verdict from dep where (src = 'vantor-core' and dst = 'vantor-ledger') or (src = 'vantor-ledger' and dst = 'vantor-core')
  union all select distinct 'invariant', null, null, id from inv where kind = 'DEPENDENCY' and 'vantor-core' in (src, dst) and 'vantor-ledger' in (src, dst)""")
def lens_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = architecture_world(spark, sf_dir, True)
    return L.why(w, L.resolve(w, _A), L.resolve(w, _B))


@_named("lens_frontier", f"""with recursive {_W}, {_REL}, nm as (select id, regexp_extract(id, ':([^#]*)', 1) as name from fn), one as (select name, min(id) id from nm group by 1 having count(*) = 1),
  s as (select distinct dst src, src dst, case kind when 'INVOKES' then 0 when 'ENCLOSES' then 1 else 2 end w from rel where kind in ('INVOKES', 'ENCLOSES', 'DISPATCHES_TO')
    union select one.id, e.src, 3 from aedge e join one on one.name = regexp_extract(e.dst, ':([^#]*)', 1) where e.kind = 'calls' and e.src is not null and e.dst is not null and e.dst not in (select id from fn)),
  r(node, depth, k) using key (node) as (select distinct id, 0, 0 from sa union select s.dst, min(r.depth) + 1, min(case when r.k > 0 then r.k else s.w end) from r join s on s.src = r.node where s.dst not in (select node from recurring.r) group by s.dst),
  z as (select case k when 1 then 'ENCLOSES' when 2 then 'DISPATCHES_TO' when 3 then 'UNIQUE_NAME' else 'RESOLVED' end as reason, coalesce(subsystem, '-') as subsystem, node, depth from r left join fn on fn.id = r.node where depth > 0),
  y as (select *, row_number() over (partition by reason, subsystem order by depth, node) rn from z)
  select reason, subsystem, count(*) as n_nodes, min(depth)::int as min_depth, string_agg(case when rn <= 12 then node end, ',' order by rn) as nearest, greatest(count(*) - 12, 0) as n_omitted from y group by 1, 2""")
def lens_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = architecture_world(spark, sf_dir)
    return L.frontier_summary(L.frontier(w, L.resolve(w, _A)))


@_named("lens_impact", f"with recursive {_W}, {_INV}, {_affected('select id from sa union select id from sb')} select section, item, n from hit union all select distinct 'invariant', id, 1 from inv where f in (from seed) or src in ('vantor-core', 'vantor-ledger') or dst in ('vantor-core', 'vantor-ledger')")
def lens_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = architecture_world(spark, sf_dir, True)
    return L.impact(w, [L.resolve(w, _A), L.resolve(w, _B)])


@_named("lens_trace")
def lens_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = architecture_world(spark, sf_dir)
    return L.trace(w, L.resolve(w, _A), L.resolve(w, "subsystem:vantor-vault"))


@_named("lens_invariants", f"with {_W}, {_INV} {_BORNE}")
def lens_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = architecture_world(spark, sf_dir, True)
    return L.invariants(w, L.resolve(w, _A))


@_named("lens_understand", _UNDERSTAND)
def lens_understand(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = architecture_world(spark, sf_dir, True)
    return L.understand(w, L.resolve(w, _A))


@_named("lens_plan", f"with recursive {_W}, {_INV}, {_affected('select id from sa')} select 'preserve' as step, id as item from ({_BORNE}) union all select 'verify_' || section, item from hit union all select 'resolve', dimension from ({_UNKNOWN})")
def lens_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = architecture_world(spark, sf_dir, True)
    return L.plan(w, L.resolve(w, _A))


@_named("lens_hypothesis", _HYPOTHESIS)
def lens_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the core write to a store? Does it never? Does it write to its own nodes alone? Does it never call the
    ledger?"""
    w = architecture_world(spark, sf_dir)
    scope = L.resolve(w, _A)
    found = L.inside(w.effects.where("category = 'WRITES'"), "function", scope)
    covered = L.inside(w.coverage, "path", scope, "components").select((F.col("status") == "OBSERVED").alias("observed"))
    own = scope.functions.select(F.col("id").alias("key"))
    elsewhere = L.inside(w.state.where("role = 'write'"), "function", scope).join(own, "key", "left_anti")
    calls = L.inside(L.inside(w.relations.where("kind = 'INVOKES'"), "src", scope), "dst", L.resolve(w, _B))
    asked = (("effect", found, False), ("never", found, True), ("writes-only", elsewhere, True), ("never-invokes", calls, True))
    rows = [(name, C.hypothesis_outcome(df, covered, refutes)) for name, df, refutes in asked]
    return spark.createDataFrame(rows, "hypothesis string, outcome string")


def _then_and_now(table: str, columns: str) -> str:
    """A table of the world, before and after, as SQL."""
    return f"select 'b' as w, {columns} from {table}_b union all select 'a', {columns} from {table}_a"


_TWO = f"""{arch_sql("_b", BEFORE)}, {arch_sql("_a")}, tn as ({_then_and_now("anode", "node, crate, file_path, status")}), te as ({_then_and_now("aedge", "id, src, dst, kind, evidence_ref")}),
  known as (select e.* from te e where exists (select 1 from tn where tn.w = e.w and tn.node = e.src) and exists (select 1 from tn where tn.w = e.w and tn.node = e.dst))"""


@_named("lens_verify", f"""with {_TWO}, i as (select distinct w, 'INV-STATE:' || dst as id from known where kind = 'writes'), h as (select distinct k.w, lower(trim(n.crate)) || ': ' || upper(k.kind) as item from known k join tn n on n.w = k.w and n.node = k.src where k.kind in ('reads', 'writes', 'calls') and n.crate is not null)
  select 'new' as section, id as item from i where w = 'a' and id not in (select id from i where w = 'b') union all select 'dropped', id from i where w = 'b' and id not in (select id from i where w = 'a')
  union all select 'new_authority', item from h where w = 'a' and item like '%: WRITES' and item not in (select item from h where w = 'b')""")
def lens_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the changes since BEFORE did to the invariants of state, and to which crates write."""
    return L.invariant_delta(architecture_world(spark, sf_dir, until=BEFORE), architecture_world(spark, sf_dir), ["WRITES"])


@_named("lens_impact_closure", f"""with {_TWO}, path as (select distinct file_path p from tn where w = 'a' and lower(trim(crate)) = 'vantor-core' and file_path is not null), seed as (select w, node from tn where file_path in (from path)),
  nm as (select w, node, regexp_extract(node, ':([^#]*)', 1) as name from tn), fresh as (select regexp_extract(node, ':([^#]*)', 1) as name from seed where w = 'a' and node not in (select node from seed where w = 'b')),
  calls as (select distinct w, src, dst from known where kind = 'calls'),
  hits as (select node as function, 1 k from seed union all select c.dst, 2 from calls c join seed s on s.w = c.w and s.node = c.src
    union all select src, 3 from calls where w = 'b' and dst in (select node from seed where w = 'b') and dst not in (select node from seed where w = 'a')
    union all select c.src, 4 from calls c where c.w = 'b' and regexp_extract(c.dst, ':([^#]*)', 1) in (from fresh)
    union all select e.src, 4 from te e where e.w = 'b' and e.kind = 'calls' and e.src is not null and e.dst is not null and e.dst not in (select node from tn where w = 'b') and regexp_extract(e.dst, ':([^#]*)', 1) in (from fresh))
  select function, case min(k) when 1 then 'R1_SEED' when 2 then 'R2_CALLEE' when 3 then 'R3_CALLER_OF_REMOVED' else 'R4_NAME_CANDIDATE' end as rule from hits group by 1""")
def lens_impact_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the changes of the files of one crate since BEFORE may affect."""
    before, after = architecture_world(spark, sf_dir, until=BEFORE), architecture_world(spark, sf_dir)
    return L.impact_closure(before, after, L.resolve(after, _A).components)


@_named("lens_capabilities", f"with {S.CAP_SQL}, {_W}, p as (select distinct cap_key c, target_crate s from cap where target_crate is not null), u as (select distinct p.c, x.subsystem s from kn join fn x on x.id = kn.src join fn y on y.id = kn.dst join p on p.s = y.subsystem where kn.kind = 'calls' and x.subsystem is not null and x.subsystem <> y.subsystem), b as (select c, s, true as p from p union all select c, s, false from u) select c as capability, count(*) filter (p) as n_providers, count(*) filter (not p) as n_consumers from b where c in (select c from b where s = 'vantor-core') group by 1")
def lens_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities that a crate provides, or consumes by calling into the crates that provide them. Calls are folded
    to pairs of crates before they meet the capabilities."""
    w = architecture_world(spark, sf_dir)
    provided = S.capabilities(spark, sf_dir, "target_crate").where("target_crate is not null").select(F.col("cap_key").alias("capability"), F.col("target_crate").alias("subsystem"))
    sub = w.functions.where("subsystem is not null").select("id", "subsystem")
    pairs = w.relations.where("kind = 'INVOKES'").join(sub.select(F.col("id").alias("src"), F.col("subsystem").alias("user")), "src").join(sub.select(F.col("id").alias("dst"), "subsystem"), "dst").where("user <> subsystem").select("user", "subsystem").distinct()
    consumed = provided.join(pairs, "subsystem").select("capability", F.col("user").alias("subsystem"))
    return L.capabilities(provided, consumed, L.resolve(w, _A))


@_named("lens_unanswerable", ORACLES["understanding_gaps"].join(("select * from (", ") where gap = 'edge without evidence'")))
def lens_unanswerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap that owns a question which cannot be answered; no row where the name owns none."""
    return QUERIES["understanding_gaps"](spark, sf_dir).where("gap = 'edge without evidence'")


@_named("census_rules", _RULES)
def census_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over observed effects and calls of subsystems."""
    w = architecture_world(spark, sf_dir)
    sub = w.functions.select(F.col("id").alias("function"), F.col("subsystem").alias("scope"))
    effects = w.effects.join(sub, "function").select("function", "scope", "category")
    calls = w.relations.where("kind = 'INVOKES'").select(F.col("src").alias("function"), F.col("dst").alias("callee"), F.lit(None).cast("string").alias("spelled")).unionByName(w.spelled.select("function", F.lit(None).cast("string").alias("callee"), F.col("name").alias("spelled"))).join(sub, "function")
    coverage = w.functions.select(F.col("id").alias("function"), F.col("subsystem").alias("scope"), (F.col("unresolved") == 0).alias("observed"))
    rules = [C.parse_rule(n, t) for n, t in (("core-writes-nothing", "forall f: function in vantor-core forbid effect WRITES"), ("cli-calls-no-vault", "forall f: function in vantor-cli forbid call to vantor-vault"), ("mail-effects", "forall f: function in vantor-mail observed effect within READS, CALLS"), ("bench-is-pure", "forall f: function in vantor-bench observed effect within none"))]
    return C.evaluate(rules, w.functions.select(F.col("id").alias("name"), F.col("owner_type").alias("kind"), F.create_map(F.lit("path"), F.col("path")).alias("attributes")), effects=effects, calls=calls, coverage=coverage)


@_named("lens_by_capability", f"with {S.CAP_SQL}, {_W}, c as (select target_crate t from cap where target_crate in (select subsystem from fn) order by cap_key limit 1), sc as (select id from fn where subsystem = (select t from c)) select upper(kind) as category, count(*) as n_sites, case when bool_or(evidence_ref is not null) then 'OBSERVED' else 'INFERRED' end as strongest, count(distinct src) as n_functions from kn where kind in ('reads', 'writes', 'calls') and src in (from sc) group by 1")
def lens_by_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of what provides a capability, here the first that anything provides."""
    w = architecture_world(spark, sf_dir)
    provided = S.capabilities(spark, sf_dir, "target_crate").where("target_crate is not null").select(F.col("cap_key").alias("capability"), F.col("target_crate").alias("subsystem"))
    there = provided.join(w.functions.select("subsystem").distinct(), "subsystem", "left_semi").agg(F.min("capability").alias("c")).first()["c"]
    return L.effects(w, L.resolve(w, f"capability:{there}", provided))
