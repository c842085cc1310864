"""Joins, aggregates, ranked rows and set operations over the stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions import ranks as R
from cairnwork.operators import graph as G
from cairnwork.operators import joins as J
from cairnwork.operators import windows as X
from cairnwork.operators.versions import latest_version
from cairnwork.plans import store as S
from cairnwork.plans.registry import query
from cairnwork.session import broadcast_if_small, materialise, table

_PROGRESS_SQL = "case {} when 'verified' then 0 when 'implemented_unverified' then 1 when 'unimplemented' then 2 when 'blocked' then 3 when 'excluded' then 4 else 5 end"


# ---- joins

@query(f"with {S.LINK_SQL}, {S.SRC_SQL} select s.donor, count(*) as n_links from lnk l join src s on s.id = l.source_id group by 1")
def links_by_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner join, folded to sources first: a source's links are counted before they meet its donor."""
    per = S.links(spark, sf_dir).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("k"))
    return per.join(S.sources(spark, sf_dir, "donor"), "id").groupBy("donor").agg(F.sum("k").alias("n_links"))


@query(f"with {S.LINK_SQL}, {S.SRC_SQL}, {S.CAP_SQL} select s.donor, c.domain, count(*) as n_links, count(*) filter (s.moves_money = 1 and coalesce(c.moves_money, 0) = 0) as n_money_disagrees from src s join lnk l on l.source_id = s.id join cap c on c.id = l.canonical_id group by all")
def donor_domain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables through a bridge."""
    s = S.sources(spark, sf_dir, "donor", "moves_money", "canonical_id").select(F.col("id").alias("source_id"), "donor", F.col("moves_money").alias("sm"))
    c = S.capabilities(spark, sf_dir, "id", "domain", "moves_money").select(F.col("id").alias("canonical_id"), "domain", F.col("moves_money").alias("cm"))
    rows = S.links(spark, sf_dir).join(s, "source_id").join(c, "canonical_id")
    return rows.groupBy("donor", "domain").agg(F.count("*").alias("n_links"), F.count_if((F.col("sm") == 1) & (F.coalesce("cm", F.lit(0)) == 0)).alias("n_money_disagrees"))


@query(f"with {S.CAP_SQL}, {S.OVR_SQL} select c.cap_key, case when o.at_us is null then c.status else o.o_status end as status, coalesce(o.o_blocker, c.blocker) as blocker, (o.at_us is not null) as overridden from cap c left join ovr o using (cap_key)")
def override_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join with the override that holds last; a withdrawal leaves no status."""
    rows = S.capabilities(spark, sf_dir, "status", "blocker").join(S.overrides(spark, sf_dir), "cap_key", "left")
    return rows.select("cap_key", F.when(F.col("at_us").isNull(), F.col("status")).otherwise(F.col("o_status")).alias("status"), F.coalesce("o_blocker", "blocker").alias("blocker"), F.col("at_us").isNotNull().alias("overridden"))


@query(f"with {S.ARCH} select id, 'from' as side, src as node from aedge where src is not null and not exists (select 1 from anode where node = src) union all select id, 'to', dst from aedge where dst is not null and not exists (select 1 from anode where node = dst)")
def orphan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti joins of both ends of an edge."""
    nodes, edges = S.architecture(spark, sf_dir)
    ends = edges.select("id", F.explode(F.array(F.struct(F.lit("from").alias("side"), F.col("src").alias("node")), F.struct(F.lit("to").alias("side"), F.col("dst").alias("node")))).alias("_e")).select("id", "_e.side", "_e.node")
    return ends.where("node is not null").join(nodes.select("node"), "node", "left_anti").select("id", "side", "node")


@query(f"with {S.CAP_SQL}, {S.SRC_SQL} select cap_key from cap c where c.status = 'verified' and not exists (select 1 from src s where s.canonical_id = c.id and s.surface in ('api', 'cli'))")
def verified_without_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join whose other side is filtered first."""
    shown = S.sources(spark, sf_dir, "surface", "canonical_id").where(F.col("surface").isin("api", "cli")).select(F.col("canonical_id").alias("id"))
    return S.capabilities(spark, sf_dir, "id", "status").where("status = 'verified'").join(shown, "id", "left_anti").select("cap_key")


@query(f"with {S.CAP_SQL}, {S.ARCH} select cap_key, target_crate from cap where target_crate is not null and not exists (select 1 from anode where node = concat('crate:', target_crate, '#0'))")
def crates_without_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join on a computed key."""
    nodes, _ = S.architecture(spark, sf_dir)
    return S.capabilities(spark, sf_dir, "target_crate").where("target_crate is not null").withColumn("node", F.concat(F.lit("crate:"), "target_crate", F.lit("#0"))).join(nodes.select("node"), "node", "left_anti").select("cap_key", "target_crate")


@query(f"with {S.CAP_SQL}, {S.LINK_SQL} select cap_key from cap where id in (select canonical_id from lnk)")
def linked_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join."""
    return S.capabilities(spark, sf_dir, "id").join(S.links(spark, sf_dir).select(F.col("canonical_id").alias("id")), "id", "left_semi").select("cap_key")


@query(f"with {S.CAP_SQL}, {S.SRC_SQL} select c.cap_key, (select s.id from src s where s.canonical_id = c.id order by (s.surface is not distinct from 'api') desc, s.id limit 1) as source_id from cap c")
def best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source of each capability: of surface api before others, then the least id."""
    ranked = X.first_per_key(S.sources(spark, sf_dir, "surface", "canonical_id").where("canonical_id is not null"), ["canonical_id"], [F.when(F.col("surface") == "api", 0).otherwise(1), F.col("id")], ["id"])
    c = S.capabilities(spark, sf_dir, "id").select("cap_key", F.col("id").alias("canonical_id"))
    return c.join(ranked, "canonical_id", "left").select("cap_key", F.col("id").alias("source_id"))


@query(f"with {S.OPP_SQL}, {S.SCORE_SQL}, b as (select opportunity_id, max(evolution_score) s from sco group by 1) select opp_id, b.s as best_score, (b.s is null) as unscored from opp left join b on b.opportunity_id = opp_id order by unscored, best_score desc, opp_id limit 30")
def scored_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join whose missing side sorts last; the head of the queue."""
    best = S.scores(spark, sf_dir, "opportunity_id", "evolution_score").groupBy(F.col("opportunity_id").alias("opp_id")).agg(F.max("evolution_score").alias("best_score"))
    rows = S.opportunities(spark, sf_dir, "category").join(best, "opp_id", "left").select("opp_id", "best_score", F.col("best_score").isNull().alias("unscored"))
    return rows.orderBy("unscored", F.desc("best_score"), "opp_id").limit(30)


_ROOTS_SQL = "roots as (select split_part(path, '/', 1) || '/' || split_part(path, '/', 2) root, min(donor) who from fil where path is not null and length(path) - length(replace(path, '/', '')) >= 2 group by 1 having count(*) >= 8 union all select split_part(path, '/', 1), 'top:' || split_part(path, '/', 1) from fil where path is not null group by all)"


def _roots(fil: DataFrame) -> DataFrame:
    deep = fil.where("path is not null and size(split(path, '/')) >= 3").groupBy(F.substring_index("path", "/", 2).alias("root")).agg(F.count("*").alias("k"), F.min("donor").alias("who")).where("k >= 8").select("root", "who")
    return deep.unionByName(fil.where("path is not null").select(F.substring_index("path", "/", 1).alias("root")).distinct().withColumn("who", F.concat(F.lit("top:"), "root")))


@query(f"with {S.FILE_SQL}, {_ROOTS_SQL}, r as (select root, min(who) who from roots group by 1) select file_id, (select who from r where fil.path = r.root or starts_with(fil.path, r.root || '/') order by length(r.root) desc limit 1) as who from fil")
def prefix_owner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of the longest directory above each file."""
    fil = materialise(S.files(spark, sf_dir, "donor", "path").select("file_id", "path", "donor"))
    return J.longest_prefix_owner(fil.select("file_id", "path"), "path", _roots(fil), "root", "who").select("file_id", "who")


@query(f"with {S.SRC_SQL}, {S.CAP_SQL}, u as (select canonical_name, min(cap_key) cap_key from cap where canonical_name is not null group by 1 having count(*) = 1) select s.id, u.cap_key from src s left join u on u.canonical_name = s.canonical_name")
def unique_name_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.unique_name_join(S.sources(spark, sf_dir, "canonical_name").select("id", "canonical_name"), S.capabilities(spark, sf_dir, "id", "canonical_name").select("canonical_name", "cap_key"), "canonical_name", "cap_key").select("id", "cap_key")


@query(f"with {S.ARCH}, a as (select dst k, src a, bool_or(kind = 'writes') w, bool_or(kind = 'reads') r from aedge where kind in ('writes', 'reads') and src is not null and dst is not null group by all) select k as state, count(*) filter (w) as n_writers, count(*) filter (r) as n_readers, count(*) filter (w) * count(*) filter (r) - count(*) filter (w and r) as n_flows from a group by 1")
def state_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = S.architecture(spark, sf_dir)[1].where("kind in ('writes', 'reads') and src is not null and dst is not null")
    rows = edges.select(F.col("dst").alias("state"), F.col("src").alias("actor"), F.when(F.col("kind") == "writes", "write").otherwise("read").alias("role"))
    return J.producer_consumer(rows, "state", "actor", "role")


def _crate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind) between the crates of an edge's ends."""
    nodes, edges = S.architecture(spark, sf_dir)
    crate = nodes.where("crate is not null").select("node", F.lower(F.trim("crate")).alias("crate"))
    both = edges.join(crate.select(F.col("node").alias("src"), F.col("crate").alias("a")), "src").join(crate.select(F.col("node").alias("dst"), F.col("crate").alias("b")), "dst").where("a <> b")
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind")


_CRATE_SQL = f"{S.ARCH}, ce as (select lower(trim(x.crate)) src, lower(trim(y.crate)) dst, e.kind from aedge e join anode x on x.node = e.src join anode y on y.node = e.dst where lower(trim(x.crate)) <> lower(trim(y.crate)))"


@query(f"""with recursive {_CRATE_SQL}, d as (select distinct src, dst from ce where kind = 'depends_on'), b as (select distinct src, dst from ce where kind = 'owns'), k as (select src, dst, count(*) n from ce where kind = 'calls' group by all),
  t(src, dst) as (select src, dst from b union select t.src, b.dst from t join b on b.src = t.dst), m as (select distinct lower(trim(crate)) node from anode where kind = 'crate' and crate is not null),
  p as (select src, dst from d union select src, dst from b union select src, dst from k)
  select p.src, p.dst, (d.src is not null) as declared, (b.src is not null) as built, coalesce(k.n, 0) as calls, case when d.src is not null and b.src is not null and k.n > 0 then 'CONFIRMED' when d.src is not null and b.src is not null then 'DECLARED_AND_BUILT_NO_RESOLVED_CALL'
    when d.src is not null and not (p.src in (from m) and p.dst in (from m)) then 'DECLARED_NOT_CENSUSABLE' when d.src is not null then 'DECLARED_NOT_BUILT' when b.src is not null then 'UNDECLARED' when t.src is not null then 'TRANSITIVE_VIA_REEXPORT' else 'CALL_WITHOUT_DEPENDENCY' end as verdict
  from p left join d on d.src = p.src and d.dst = p.dst left join b on b.src = p.src and b.dst = p.dst left join k on k.src = p.src and k.dst = p.dst left join t on t.src = p.src and t.dst = p.dst""")
def reconcile_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crate dependencies: declared, built and called."""
    edges = materialise(_crate_edges(spark, sf_dir))
    of = lambda k: edges.where(F.col("kind") == k).select("src", "dst").distinct()
    called = edges.where("kind = 'calls'").groupBy("src", "dst").agg(F.count("*").alias("calls"))
    members = S.architecture(spark, sf_dir)[0].where("kind = 'crate' and crate is not null").select(F.lower(F.trim("crate")).alias("node"))
    return J.reconcile_three_way(of("depends_on"), of("owns"), called, members, G.transitive_closure(of("owns"))[0])


@query(f"""with {S.ARCH}, {S.CAP_SQL}, mem as (select distinct lower(trim(crate)) entity, node member from anode where crate is not null), dec as (select distinct a.target_crate src, 'vantor-' || a.domain dst from cap a where a.target_crate is not null and a.domain is not null and a.target_crate <> 'vantor-' || a.domain),
  obs as (select distinct x.entity src, y.entity dst from aedge e join mem x on x.member = e.src join mem y on y.member = e.dst where x.entity <> y.entity)
  select coalesce(dec.src, obs.src) as src, coalesce(dec.dst, obs.dst) as dst, case when dec.src is not null and obs.src is not null then 'agreed' when dec.src is not null and (dec.src not in (select entity from mem) or dec.dst not in (select entity from mem)) then 'not_censusable' when dec.src is not null then 'declared_not_observed' else 'observed_not_declared' end as verdict
  from dec full join obs on dec.src = obs.src and dec.dst = obs.dst""")
def declared_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains that crates serve, against edges observed between the crates' nodes."""
    nodes, edges = S.architecture(spark, sf_dir)
    membership = nodes.where("crate is not null").select(F.lower(F.trim("crate")).alias("entity"), F.col("node").alias("member"))
    said = S.capabilities(spark, sf_dir, "domain", "target_crate").where("target_crate is not null and domain is not null").select(F.col("target_crate").alias("src"), F.concat(F.lit("vantor-"), "domain").alias("dst")).where("src <> dst")
    return J.declared_against_observed(said, edges.where("src is not null and dst is not null"), membership)


_TOK = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"


@query(f"""with {S.SRC_SQL}, {S.CAP_SQL}, a as (select distinct canonical_name a from src where canonical_name is not null), b as (select distinct cap_key b from cap), x as (select a, unnest({_TOK.format("a")}) w from a), y as (select b, unnest({_TOK.format("b")}) w from b),
  s as (select a, b, count(*) shared from x join y using (w) where length(w) >= 4 group by all having count(*) >= 2) select a as canonical_name, b as cap_key, shared from s qualify row_number() over (partition by a order by shared desc, b) = 1""")
def token_overlap_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source name the capability key with most words in common, two at least."""
    return J.best_token_overlap(S.sources(spark, sf_dir, "canonical_name"), "canonical_name", S.capabilities(spark, sf_dir, "canonical_name"), "cap_key", least=4, least_shared=2)


@query(f"""with {S.ARCH}, k as (select distinct lower(crate) crate from anode where crate is not null), w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]+')) w from documents) select doc_id, w as crate, count(*) as n from w join k on k.crate = w.w group by all""")
def crate_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document names each crate."""
    nodes, _ = S.architecture(spark, sf_dir)
    crates = broadcast_if_small(nodes.where("crate is not null").select(F.lower("crate").alias("crate")).distinct())
    return J.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", crates, "crate")


@query(f"""with {S.FILE_SQL}, {S.ARCH}, r as (select id, regexp_replace(evidence_ref, ':[0-9]+$', '') ref from aedge where evidence_ref is not null), p as (select distinct path from fil where path is not null), u as (select regexp_extract(path, '[^/]*$') b, min(path) only_ from p group by 1 having count(*) = 1)
  select id, coalesce(p.path, u.only_) as resolved, case when p.path is not null then 'exact' when u.only_ is not null then 'unique name' end as how from r left join p on p.path = r.ref left join u on u.b = regexp_extract(r.ref, '[^/]*$')""")
def evidence_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the evidence of an edge lies: the path itself, else the only file of that name."""
    refs = S.architecture(spark, sf_dir)[1].where("evidence_ref is not null").select("id", F.regexp_replace("evidence_ref", ":[0-9]+$", "").alias("ref"))
    return J.resolve_references(refs, "ref", S.files(spark, sf_dir, "path"), "path").select("id", "resolved", "how")


@query(f"with {S.SRC_SQL}, {S.LINK_SQL} select s.id, s.canonical_id, l.canonical_id as linked_id from src s left join lnk l on l.source_id = s.id where s.canonical_id is not null and (l.canonical_id is null or l.canonical_id <> s.canonical_id)")
def link_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join kept where the bridge lacks the key or disagrees with it."""
    l = S.links(spark, sf_dir).select(F.col("source_id").alias("id"), F.col("canonical_id").alias("linked_id"))  # noqa: E741
    return S.sources(spark, sf_dir, "canonical_id").where("canonical_id is not null").join(l, "id", "left").where("linked_id is null or linked_id <> canonical_id").select("id", "canonical_id", "linked_id")


@query(f"""with {S.CAP_SQL}, rep as ({S.CAP_SQL[8:-1].replace("canonical_capability", "canonical_capability_replica")}), top as (select coalesce(max(id), 0) t from cap), add_ as (select cap_key, status, row_number() over (order by cap_key) rn from rep where cap_key not in (select cap_key from cap))
  select id, cap_key, status from cap union all select t + rn, cap_key, status from add_, top""")
def precedence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary list, and what only the replica has, numbered after it."""
    first = S.capabilities(spark, sf_dir, "id", "status").select("id", "cap_key", "status")
    second = live_replica(spark, sf_dir)
    return J.precedence_union(first, second, "cap_key", "id")


def live_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnwork.plans.capability import live_capabilities

    return live_capabilities(table(spark, sf_dir, "canonical_capability_replica")).select(F.lit(0).cast("long").alias("id"), "cap_key", "status")


@query(f"""with {S.CAP_SQL}, {S.SRC_SQL}, {S.FILE_SQL}, m as (select 'cap:' || cap_key id, 'capability' family, target_module as k from cap union all select 'src:' || id, 'source', module from src union all select 'fil:' || file_id, 'file', split_part(path, '/', 2) from fil), h as (select k, min(id) hub from m where k is not null group by 1 having count(distinct family) > 1)
  select distinct k as module, id as member, hub from m join h using (k)""")
def unified_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities, sources and files of one module, tied to one hub."""
    cap = S.capabilities(spark, sf_dir, "id", "target_module").select(F.concat(F.lit("cap:"), "cap_key").alias("id"), F.lit("capability").alias("family"), F.col("target_module").alias("module"))
    src = S.sources(spark, sf_dir, "module").select(F.concat(F.lit("src:"), F.col("id").cast("string")).alias("id"), F.lit("source").alias("family"), "module")
    fil = S.files(spark, sf_dir, "path").select(F.concat(F.lit("fil:"), F.col("file_id").cast("string")).alias("id"), F.lit("file").alias("family"), F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.when(F.col("path").isNotNull(), F.lit(""))).alias("module"))
    return J.unify_families(J.union_all([cap, src, fil]), "id", "family", "module")


@query(f"with {S.CAP_SQL}, {S.OVR_SQL}, k as (select cap_key from cap union select cap_key from ovr) select k.cap_key, case when o.at_us is null then 'MISSING' when o.o_status = 'verified' then 'CURRENT' else 'OTHER' end as state from k left join ovr o using (cap_key)")
def override_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required and observed keys with the state of the latest record."""
    return J.dimension_status(S.capabilities(spark, sf_dir, "id").select("cap_key"), S.overrides(spark, sf_dir), "cap_key", "at_us", F.coalesce(F.col("o_status") == "verified", F.lit(False)))


@query(f"with {_CRATE_SQL}, c as (select node, kind from anode) select e.id, e.kind from aedge e join c x on x.node = e.src join c y on y.node = e.dst where (x.kind, y.kind) in (('store', 'service'), ('store', 'gate'), ('crate', 'gate'))")
def forbidden_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between classes of nodes that must not have one."""
    nodes, edges = S.architecture(spark, sf_dir)
    rules = spark.createDataFrame([("store", "service"), ("store", "gate"), ("crate", "gate")], "src_class string, dst_class string")
    return J.forbidden_edges(edges, nodes.select("node", F.col("kind").alias("class")), rules).select("id", "kind")


@query(f"""with {S.SRC_SQL}, m as (select s.id, case when s.module = 'bank_feed' then 'module' when s.donor = 'dapple-warren' then 'donor' when s.surface is not null then 'surface' end via, case when s.module = 'bank_feed' then 'treasury' when s.donor = 'dapple-warren' then 'core' when s.surface is not null then 'surface-' || s.surface end target from src s) select id, target, via from m""")
def rule_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that matches a source: by module, by donor, by surface."""
    src = S.sources(spark, sf_dir, "donor", "module", "surface").select("id", "module", "donor", "surface")
    rules = spark.createDataFrame([("module", "bank_feed", 0, "treasury"), ("donor", "dapple-warren", 1, "core")] + [("surface", s, 2, f"surface-{s}") for s in ("governance", "automation", "cli", "worker", "model", "ui", "api")], "kind string, value string, rank int, target string")
    return J.first_matching_rule(src, [("module", F.col("module")), ("donor", F.col("donor")), ("surface", F.col("surface"))], F.broadcast(rules)).select("id", "target", "via")


# ---- aggregates

@query(f"with {S.SRC_SQL} select surface, count(*) as n_rows, count(distinct donor) as n_donors, count(*) filter (moves_money = 1) as n_money, max(id) as last_id, coalesce(sum(requires_approval), 0)::bigint as n_approval, count(*) filter (target_crate is null) as n_no_crate from src group by 1")
def conditional_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.count_if(F.col(c) == 1)
    return S.sources(spark, sf_dir, "donor", "surface", "moves_money", "requires_approval", "target_crate").groupBy("surface").agg(F.count("*").alias("n_rows"), F.countDistinct("donor").alias("n_donors"), one("moves_money").alias("n_money"), F.max("id").alias("last_id"), F.coalesce(F.sum("requires_approval"), F.lit(0)).alias("n_approval"), F.count_if(F.col("target_crate").isNull()).alias("n_no_crate"))


@query("select o_orderstatus, o_orderpriority, count(*) as n_rows, count(*) filter (o_totalprice > 200000) as n_large from orders group by all")
def census_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n_rows"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"))


@query("with o as (select l_orderkey, count(*) filter (l_linestatus = 'O') n_open, count(*) n from lineitem group by 1), q as (select l_orderkey, n from o where n_open = 0) select n as n_lines, count(*) as n_orders from q group by 1")
def fully_closed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAVING, and an aggregate over groups."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.count("*").alias("n_lines"))
    return per.where("n_open = 0").groupBy("n_lines").agg(F.count("*").alias("n_orders"))


@query(f"with {_CRATE_SQL} select src, dst, kind, count(*) as weight from ce group by all")
def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crate_edges(spark, sf_dir).groupBy("src", "dst", "kind").agg(F.count("*").alias("weight"))


@query(f"with {_CRATE_SQL}, f as (select case when src = 'vantor-ledger' then 'out' else 'in' end direction, case when src = 'vantor-ledger' then dst else src end counterpart from ce where src = 'vantor-ledger' or dst = 'vantor-ledger'), g as (select direction, counterpart, count(*) weight from f group by all) select direction, counterpart, weight from g qualify row_number() over (partition by direction order by weight desc, counterpart) <= 12")
def boundary_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve heaviest flows over one crate's boundary, each way."""
    edges = _crate_edges(spark, sf_dir).where("src = 'vantor-ledger' or dst = 'vantor-ledger'")
    out = F.col("src") == "vantor-ledger"
    flows = edges.groupBy(F.when(out, "out").otherwise("in").alias("direction"), F.when(out, F.col("dst")).otherwise(F.col("src")).alias("counterpart")).agg(F.count("*").alias("weight"))
    return flows.withColumn("_rn", F.row_number().over(W.partitionBy("direction").orderBy(F.desc("weight"), "counterpart"))).where("_rn <= 12").drop("_rn")


@query(f"with {S.CAP_SQL} select side_effect_class, arg_min(status, {_PROGRESS_SQL.format('status')}) filter (status is not null) as best_status, arg_max(status, {_PROGRESS_SQL.format('status')}) filter (status is not null and status in ('verified','implemented_unverified','unimplemented','blocked','excluded')) as worst_status, count(*) as n_rows, count(distinct domain) as n_domains from cap group by 1")
def strongest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = S.capabilities(spark, sf_dir, "domain", "side_effect_class", "status")
    known = F.when(F.col("status").isin(*R.PROGRESS), F.col("status"))
    return cap.groupBy("side_effect_class").agg(R.strongest(R.PROGRESS, F.col("status")).alias("best_status"), F.max(F.when(known.isNotNull(), F.struct(R.rank(R.PROGRESS, known).alias("r"), known.alias("s"))))["s"].alias("worst_status"), F.count("*").alias("n_rows"), F.countDistinct("domain").alias("n_domains"))


@query(f"with {S.FILE_SQL} select kind, count(*) filter (read_status = 'reviewed') as n_ok, count(*) filter (read_status in ('unread_pending', 'classified_not_read')) as n_unknown, count(*) filter (read_status = 'blocked') as n_unsupported from fil group by 1")
def coverage_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("read_status")
    return S.files(spark, sf_dir, "kind", "read_status").groupBy("kind").agg(F.count_if(s == "reviewed").alias("n_ok"), F.count_if(s.isin("unread_pending", "classified_not_read")).alias("n_unknown"), F.count_if(s == "blocked").alias("n_unsupported"))


@query(f"with {S.CAP_SQL} select domain, round(count(*) filter (status = 'verified') * 100.0 / nullif(count(*) filter (status <> 'excluded'), 0), 1) as percent, case when count(*) filter (status = 'verified') * 2 >= count(*) then 'high' when count(*) filter (status = 'verified') * 5 >= count(*) then 'middle' else 'low' end as band, round(avg(coalesce(donor_count, 0)), 6) as mean_donors from cap group by 1")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio (none where nothing counts), band, and a mean in which nulls are 0."""
    v, all_ = F.count_if(F.col("status") == "verified"), F.count_if(F.col("status") != "excluded")
    band = F.when(v * 2 >= F.count("*"), "high").when(v * 5 >= F.count("*"), "middle").otherwise("low")
    return S.capabilities(spark, sf_dir, "domain", "donor_count", "status").groupBy("domain").agg(F.round(F.try_divide(v * 100.0, all_), 1).alias("percent"), band.alias("band"), F.round(F.avg(F.coalesce("donor_count", F.lit(0))), 6).alias("mean_donors"))


@query(f"with {S.SRC_SQL} select canonical_id, bool_and(coalesce(moves_money, 0) = 1) as all_money, bool_or(coalesce(moves_money, 0) = 1) as any_money, max(coalesce(requires_approval, 0)) as approval, min(canonical_name) as name, string_agg(distinct target_crate, ',' order by target_crate) as crates, count(distinct donor) as n_donors from src where canonical_id is not null group by 1")
def collapsed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates collapsed: flags folded by and / or, the first name, the set of crates."""
    m = F.coalesce("moves_money", F.lit(0)) == 1
    return S.sources(spark, sf_dir, "donor", "canonical_name", "moves_money", "requires_approval", "canonical_id", "target_crate").where("canonical_id is not null").groupBy("canonical_id").agg(F.bool_and(m).alias("all_money"), F.bool_or(m).alias("any_money"), F.max(F.coalesce("requires_approval", F.lit(0))).alias("approval"), F.min("canonical_name").alias("name"), F.nullif(F.array_join(F.array_sort(F.collect_set("target_crate")), ","), F.lit("")).alias("crates"), F.countDistinct("donor").alias("n_donors"))


@query(f"with {S.SRC_SQL}, g as (select donor, module, count(*) n from src where module is not null group by all) select donor, module, n as n_rows from g qualify row_number() over (partition by donor order by n desc, module) = 1")
def main_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argmax with a tie-break."""
    g = S.sources(spark, sf_dir, "donor", "module").where("module is not null").groupBy("donor", "module").agg(F.count("*").alias("n_rows"))
    return X.first_per_key(g, ["donor"], [-F.col("n_rows"), F.col("module")], ["module", "n_rows"])


@query("select l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as low, round(sum(l_extendedprice * (1 + l_tax)), 2) as high, round(sqrt(avg(power(l_extendedprice * l_discount, 2))), 4) as rms_discount from lineitem group by 1")
def interval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of interval ends, and a root mean square."""
    low, high = F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice") * (1 + F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(low), 2).alias("low"), F.round(F.sum(high), 2).alias("high"), F.round(F.sqrt(F.avg(F.pow(F.col("l_extendedprice") * F.col("l_discount"), 2))), 4).alias("rms_discount"))


@query(f"with {S.FILE_SQL}, h as (select donor, kind, count(*)::double n from fil where donor is not null and kind is not null group by all), t as (select kind, sum(n) n from h group by 1), a as (select donor, sum(n) n from h group by 1), z as (select sum(n) n from h) select h.donor, round(sum(abs(ln((h.n / a.n) / (t.n / z.n)))), 6) as novelty from h join t using (kind) join a using (donor), z group by 1")
def donor_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unusual a donor's mix of kinds is: summed absolute log ratios of shares."""
    h = S.files(spark, sf_dir, "donor", "kind").where("donor is not null and kind is not null").groupBy("donor", "kind").agg(F.count("*").alias("n"))
    part = h.withColumns({"a": F.sum("n").over(W.partitionBy("donor"))})
    kinds = h.groupBy("kind").agg(F.sum("n").alias("t"))
    kinds = kinds.withColumn("z", F.sum("t").over(W.partitionBy()))  # one row for each kind
    return part.join(kinds, "kind").groupBy("donor").agg(F.round(F.sum(F.abs(F.log((F.col("n") / F.col("a")) / (F.col("t") / F.col("z"))))), 6).alias("novelty"))


@query(f"with {S.SRC_SQL}, i as (select count(distinct id) n from source_capability), d as (select count(*) n from (select id from source_capability qualify row_number() over (partition by id order by synced_at desc) = 1 and deleted_at is not null)), o as (select coalesce(sum(k), 0)::bigint n from (select surface, count(*) k from src group by 1)) select i.n as n_in, d.n as n_deleted, o.n as n_out, (i.n = d.n + o.n) as closed from i, d, o")
def accounting_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in, taken from the table itself, against records deleted and records reported by surface."""
    raw = table(spark, sf_dir, "source_capability").where("id is not null")
    came = raw.agg(F.countDistinct("id").alias("n_in"))
    gone = latest_version(raw, ["id"], "synced_at", ["deleted_at"]).agg(F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted"))
    out = S.sources(spark, sf_dir, "surface").groupBy("surface").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_out"))
    one = came.join(F.broadcast(gone)).join(F.broadcast(out))  # one row each
    return one.withColumn("closed", F.col("n_in") == F.col("n_deleted") + F.col("n_out"))


@query(f"with {S.CAP_SQL}, {S.SRC_SQL}, d as (select canonical_id, count(distinct donor) n from src group by 1) select c.cap_key, c.donor_count as stated, coalesce(d.n, 0) as counted from cap c left join d on d.canonical_id = c.id where c.donor_count is distinct from coalesce(d.n, 0)")
def donor_count_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pre-aggregated count against the rows it was made of."""
    d = S.sources(spark, sf_dir, "donor", "canonical_id").groupBy(F.col("canonical_id").alias("id")).agg(F.countDistinct("donor").alias("counted"))
    rows = S.capabilities(spark, sf_dir, "id", "donor_count").join(d, "id", "left").select("cap_key", F.col("donor_count").alias("stated"), F.coalesce("counted", F.lit(0)).alias("counted"))
    return rows.where(~F.col("stated").eqNullSafe(F.col("counted")))


@query("select key, count(*) as n_rows, count(distinct id) as n_ids from canonical_capability where key is not null group by 1 having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "canonical_capability").where("key is not null").groupBy("key").agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids")).where("n_rows > 1")


@query(f"""with {S.CAP_SQL}, rep as ({S.CAP_SQL[8:-1].replace("canonical_capability", "canonical_capability_replica")}), u as (select cap_key, status, blocker, domain, {_PROGRESS_SQL.format('status')} r, 0 p from cap union all select cap_key, status, blocker, domain, {_PROGRESS_SQL.format('status')}, 1 from rep)
  select cap_key, first(status order by r, p) as status, first(blocker order by r, p) filter (blocker is not null) as blocker, first(domain order by r, p) filter (domain is not null) as domain from u group by 1""")
def strongest_with_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest status of a key over both copies; attributes it lacks are filled from the weaker row."""
    from cairnwork.functions.text import normal_form

    def copy(name: str, place: int) -> DataFrame:
        t = table(spark, sf_dir, name).select(normal_form(F.col("key")).alias("cap_key"), normal_form(F.col("status")).alias("status"), normal_form(F.col("blocker")).alias("blocker"), "domain", "deleted_at", "synced_at")
        return latest_version(t, ["cap_key"], "synced_at", ["status", "blocker", "domain", "deleted_at"]).where("deleted_at is null").drop("deleted_at").withColumn("_p", F.lit(place))

    rows = copy("canonical_capability", 0).unionByName(copy("canonical_capability_replica", 1)).withColumn("_r", F.struct(R.rank(R.PROGRESS, F.col("status")).alias("r"), "_p"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("_r", c)))[c].alias(c)
    return rows.groupBy("cap_key").agg(F.min(F.struct("_r", "status"))["status"].alias("status"), first("blocker"), first("domain"))


@query(f"with {S.SCORE_SQL} select opportunity_id, round((coalesce(avg(learning_value), 0) + coalesce(avg(optionality), 0) + coalesce(avg(adaptability), 0)) / 3, 6) as composite, round(abs(max(evolution_score) - avg(evolution_score)), 2) as gap, case when max(evolution_score) > avg(evolution_score) then 'above' else 'level' end as direction from sco where opportunity_id is not null group by 1")
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0))
    top, avg = F.max("evolution_score"), F.avg("evolution_score")
    return S.scores(spark, sf_dir, "opportunity_id", "learning_value", "optionality", "adaptability", "evolution_score").where("opportunity_id is not null").groupBy("opportunity_id").agg(F.round((mean("learning_value") + mean("optionality") + mean("adaptability")) / 3, 6).alias("composite"), F.round(F.abs(top - avg), 2).alias("gap"), F.when(top > avg, "above").otherwise("level").alias("direction"))


@query(f"with {S.OPP_SQL} select opp_id, impact * reach * leverage as ev, round(try_cast(impact * reach * leverage * confidence as double) / nullif(effort, 0), 2) as priority from opp where impact is not null and reach is not null and leverage is not null")
def opportunity_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived scores; a missing or zero divisor gives none."""
    ev = F.col("impact") * F.col("reach") * F.col("leverage")
    return S.opportunities(spark, sf_dir, "impact", "reach", "leverage", "effort", "confidence", "ev", "priority").where("impact is not null and reach is not null and leverage is not null").select("opp_id", ev.alias("ev"), F.round(F.try_divide((ev * F.col("confidence")).cast("double"), F.col("effort")), 2).alias("priority"))


_ROW_MD5 = "md5(concat_ws('|', coalesce(c_custkey::varchar, '~'), coalesce(c_name, '~'), coalesce(c_nationkey::varchar, '~'), coalesce(round(c_acctbal * 100)::bigint::varchar, '~'), coalesce(c_mktsegment, '~')))"


@query(f"select count(*) as n_rows, bit_xor(('0x' || substr(m, 1, 15))::bigint) as xor_low, bit_xor(('0x' || substr(m, 17, 15))::bigint) as xor_high, sum(('0x' || substr(m, 1, 8))::bigint)::bigint as total from (select {_ROW_MD5} m from customer)")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint over all columns that no order of rows changes: 120 bits of the rows' digests as an exclusive or,
    and a sum, which rows that occur twice do not leave as it was."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("~"))
    row = F.concat_ws("|", text(F.col("c_custkey")), text(F.col("c_name")), text(F.col("c_nationkey")), text(F.round(F.col("c_acctbal") * 100).cast("bigint")), text(F.col("c_mktsegment")))
    part = lambda a, n: F.conv(F.substring(F.col("m"), a, n), 16, 10).cast("bigint")
    digests = table(spark, sf_dir, "customer").select(F.md5(row).alias("m"))
    return digests.agg(F.count("*").alias("n_rows"), F.bit_xor(part(1, 15)).alias("xor_low"), F.bit_xor(part(17, 15)).alias("xor_high"), F.sum(part(1, 8)).alias("total"))


# ---- ranked and running rows

@query("select l_partkey, l_suppkey, price from (select l_partkey, l_suppkey, round(l_extendedprice / l_quantity, 6) price, row_number() over (partition by l_partkey order by round(l_extendedprice / l_quantity, 6), l_suppkey) rn from lineitem) where rn = 1")
def top1_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest offer of each part."""
    rows = table(spark, sf_dir, "lineitem").withColumn("price", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 6))
    return X.first_per_key(rows, ["l_partkey"], [F.col("price"), F.col("l_suppkey")], ["l_suppkey", "price"])


@query("with m as (select o_orderkey, o_orderpriority, ((o_orderkey + 7)::hugeint * 2654435761) % 4294967296 mix from orders) select o_orderkey, o_orderpriority from m qualify row_number() over (partition by o_orderpriority order by mix, o_orderkey) <= 25")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 orders of each priority."""
    return X.stratified_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", F.col("o_orderkey"), 25, 7)


@query("with c as (select user_id, event_id, value, lag(event_id) over w as link from events window w as (partition by user_id order by ts, event_id)), k as (select *, case when event_id % 97 = 0 then -1 else link end as claimed from c) select user_id, event_id, claimed as link from k where claimed is distinct from link")
def chain_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that do not name the event before them; a few claims are made wrong."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("seq", F.struct("ts", "event_id")).withColumn("link", F.lag("event_id").over(w))
    rows = rows.withColumn("link", F.when(F.col("event_id") % 97 == 0, F.lit(-1)).otherwise(F.col("link")))
    return X.chain_breaks(rows, "user_id", "seq", "link", "event_id").select("user_id", "event_id", "link")


@query("with r as (select l_orderkey, l_linenumber, l_linenumber * 10 - 10 - case when l_quantity > 45 then 1 else 0 end s, l_linenumber * 10 e from lineitem), g as (select *, s - coalesce(max(e) over (partition by l_orderkey order by s, e rows between unbounded preceding and 1 preceding), 0) gap from r) select l_orderkey, l_linenumber, case when gap > 0 then 'hole' else 'overlap' end as defect, abs(gap) as size from g where gap <> 0")
def tiling_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes and overlaps of the ranges that an order's lines make."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 10 - 10 - F.when(F.col("l_quantity") > 45, 1).otherwise(0)).alias("s"), (F.col("l_linenumber") * 10).alias("e"))
    return X.tiling_defects(li, "l_orderkey", "s", "e").select("l_orderkey", "l_linenumber", "defect", "size")


@query("with g as (select c_mktsegment, c_nationkey, count(*) n from customer group by all) select c_mktsegment, c_nationkey, n as n_rows, round(n / sum(n) over (partition by c_mktsegment), 9) as share from g")
def group_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.shares(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_mktsegment"]).withColumn("share", F.round("share", 9))


@query("with t as (select o_custkey, o_orderkey, o_totalprice, sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) total from orders) select o_custkey, count(*) as n_orders, count(*) filter (total <= 1000000) as n_admitted from t group by 1")
def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders admitted in sequence until a customer's budget is spent."""
    q = X.admit_within_budget(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 1000000)
    return q.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.count_if("admitted").alias("n_admitted"))


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and type, by aggregation."""
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return best.select("user_id", "event_type", F.col("m.event_id").alias("event_id"), F.col("m.value").alias("value"))


@query("with s as (select user_id, event_id, event_type after_, lag(event_type) over (partition by user_id order by ts, event_id) before_ from events) select before_ as before, after_ as after, count(*) as n_rows from s where before_ is not null and before_ <> after_ group by all")
def adjacent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one type of event follows another."""
    moved = X.adjacent_changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return moved.groupBy("before", "after").agg(F.count("*").alias("n_rows"))


# ---- sort, limit and sets

@query("select p_partkey, p_retailprice, p_size from part order by (p_type = 'ECONOMY') desc, p_retailprice * 2 - p_size desc, p_partkey limit 25")
def next_queue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order by a condition and by arithmetic; the head of the queue."""
    return table(spark, sf_dir, "part").orderBy((F.col("p_type") == "ECONOMY").desc(), (F.col("p_retailprice") * 2 - F.col("p_size")).desc(), "p_partkey").limit(25).select("p_partkey", "p_retailprice", "p_size")


@query("select nation, count(*) as n_rows from (select c_nationkey nation, c_name who from customer union select s_nationkey, s_name from supplier) group by 1")
def accounted_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNION without duplicates, then counted."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("who")).union(s.select("s_nationkey", "s_name")).distinct().groupBy("nation").agg(F.count("*").alias("n_rows"))


@query("select c_custkey from customer where c_acctbal < 0 intersect select o_custkey from orders where o_orderpriority = '1-URGENT'")
def both_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey").intersect(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")))


@query("select 'gone' as side, c_custkey from (select c_custkey from customer except select o_custkey from orders where o_orderpriority = '1-URGENT') union all select 'come', o_custkey from (select o_custkey from orders except select c_custkey from customer where c_acctbal > 0)")
def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences both ways."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    gone = c.select("c_custkey").subtract(o.where("o_orderpriority = '1-URGENT'").select("o_custkey")).select(F.lit("gone").alias("side"), "c_custkey")
    return gone.unionByName(o.select(F.col("o_custkey").alias("c_custkey")).subtract(c.where("c_acctbal > 0").select("c_custkey")).select(F.lit("come").alias("side"), "c_custkey"))


@query(f"with {S.SRC_SQL}, {S.LINK_SQL}, u as (select canonical_id c, id s from src where canonical_id is not null union all select canonical_id, source_id from lnk where canonical_id > 0 and source_id > 0) select c as canonical_id, count(*) as n_paths, count(distinct s) as n_sources from u group by 1")
def two_join_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNION ALL of two ways from capability to source, counted with and without duplicates."""
    a = S.sources(spark, sf_dir, "canonical_id").where("canonical_id is not null").select("canonical_id", F.col("id").alias("s"))
    b = S.links(spark, sf_dir).where("canonical_id > 0 and source_id > 0").select("canonical_id", F.col("source_id").alias("s"))
    return a.unionByName(b).groupBy("canonical_id").agg(F.count("*").alias("n_paths"), F.countDistinct("s").alias("n_sources"))
