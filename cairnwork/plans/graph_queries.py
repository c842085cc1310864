"""Graph operators on the sales hierarchy, on a small cyclic graph, and on the architecture graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.functions.text import normal_form
from cairnwork.operators import evidence as E
from cairnwork.operators import graph as G
from cairnwork.operators.versions import latest_version
from cairnwork.plans.registry import query, sql_normal_form
from cairnwork.session import materialise, table


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind): region, nation, customer and order as one containment graph."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    parts = [
        t("nation").select(name("region", "n_regionkey").alias("src"), name("nation", "n_nationkey").alias("dst"), F.lit("nation").alias("kind")),
        t("customer").select(name("nation", "c_nationkey").alias("src"), name("customer", "c_custkey").alias("dst"), F.lit("customer").alias("kind")),
        t("orders").select(name("customer", "o_custkey").alias("src"), name("order", "o_orderkey").alias("dst"), F.lit("order").alias("kind")),
    ]
    return reduce(DataFrame.unionByName, parts)


_HIERARCHY = """e(src, dst) as (select 'region:' || n_regionkey, 'nation:' || n_nationkey from nation union all select 'nation:' || c_nationkey, 'customer:' || c_custkey from customer
  union all select 'customer:' || o_custkey, 'order:' || o_orderkey from orders)"""


@query(f"""with recursive {_HIERARCHY}, r(node, depth) as (select 'region:1', 0 union all select e.dst, r.depth + 1 from r join e on e.src = r.node),
  k as (select split_part(node, ':', 1) kind, node, depth, row_number() over (partition by split_part(node, ':', 1) order by depth, node) rn from r where depth > 0)
  select kind, count(*) as n_nodes, min(depth) as min_depth, string_agg(case when rn <= 12 then node end, ',' order by rn) as nearest, greatest(count(*) - 12, 0) as n_omitted from k group by 1""")
def region_impact_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that depends on region 1: by kind how much, how near, and the nearest twelve."""
    reached = G.bfs_depth(hierarchy(spark, sf_dir), spark.createDataFrame([("region:1",)], "node string"))
    return G.impact_frontier(reached.withColumn("kind", F.substring_index("node", ":", 1)), "kind")


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph over the nations."""
    n = F.col("n_nationkey").cast("long")
    nation = table(spark, sf_dir, "nation")
    return nation.select(n.alias("src"), ((n * 7 + 3) % 25).alias("dst")).union(nation.select(n.alias("src"), ((n * 5 + 1) % 25).alias("dst")))


_RING = "e(src, dst) as (select n_nationkey::bigint, (n_nationkey::bigint * 7 + 3) % 25 from nation union select n_nationkey::bigint, (n_nationkey::bigint * 5 + 1) % 25 from nation)"
_REACH = f"{_RING}, c(src, dst) as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src)"


@query(f"with recursive {_REACH} select src, dst from c")
def closure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.transitive_closure(ring(spark, sf_dir))[0]


@query(f"with recursive {_RING}, c(label, node) as (select 'seed' || (n_nationkey % 3), n_nationkey::bigint from nation where n_nationkey in (3, 7, 11) union select c.label, e.dst from c join e on c.node = e.src where not (c.label = 'seed1' and e.dst % 2 = 0)) select node, label from c")
def origin_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels spread from three seeds; one label may not enter even nodes."""
    roots = table(spark, sf_dir, "nation").where("n_nationkey in (3, 7, 11)").select(F.col("n_nationkey").cast("long").alias("node"), F.concat(F.lit("seed"), (F.col("n_nationkey") % 3).cast("string")).alias("label"))
    return G.labelled_reach(ring(spark, sf_dir), roots, (F.col("label") == "seed1") & (F.col("dst") % 2 == 0))[0]


@query(f"with recursive {_REACH} select n.node, greatest(n.node, coalesce(max(a.dst), n.node)) as component from (select distinct src node from e union select dst from e) n left join c a on a.src = n.node and exists (select 1 from c b where b.src = a.dst and b.dst = n.node) group by 1")
def scc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.strong_components(ring(spark, sf_dir))


@query(f"with recursive {_REACH}, l as (select n.node, greatest(n.node, coalesce(max(a.dst), n.node)) as component from (select distinct src node from e union select dst from e) n left join c a on a.src = n.node and exists (select 1 from c b where b.src = a.dst and b.dst = n.node) group by 1) select l.node, l.component, s.n_nodes from l join (select component, count(*) n_nodes from l group by 1) s using (component) where s.n_nodes > 1 or exists (select 1 from e where e.src = l.node and e.dst = l.node)")
def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cyclic_nodes(ring(spark, sf_dir))


@query(f"with recursive {_REACH}, s as (select n_nationkey::bigint node, (n_nationkey * 11 + 4) % 17 strength from nation) select s.node, least(s.strength, coalesce((select min(t.strength) from c join s t on t.node = c.dst where c.src = s.node), s.strength))::int as effective from s")
def weakest_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least strength among a node and all that it rests on."""
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), ((F.col("n_nationkey") * 11 + 4) % 17).alias("strength"))
    return G.weakest_link(nodes, ring(spark, sf_dir))[0].select("node", F.col("effective").cast("int").alias("effective"))


@query("""with recursive lines as (select p_brand parent, p_type || '/' || (p_size % 5) item, count(*)::double q from part group by all
    union all select p_type || '/' || (p_size % 5), 'unit' || (p_size % 3), count(*)::double from part group by all),
  x(root, item, quantity) as (select distinct p_brand, p_brand, 1.0::double from part union all select x.root, l.item, x.quantity * l.q from x join lines l on l.parent = x.item)
  select root, item, sum(quantity) as quantity from x where root <> item group by all""")
def bom_explosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of a three-level bill of material, multiplied down and summed."""
    part = table(spark, sf_dir, "part")
    kind = F.concat("p_type", F.lit("/"), (F.col("p_size") % 5).cast("string"))
    lines = part.groupBy(F.col("p_brand").alias("parent"), kind.alias("item")).agg(F.count("*").alias("quantity")).union(part.groupBy(kind, F.concat(F.lit("unit"), (F.col("p_size") % 3).cast("string"))).agg(F.count("*")))
    return G.explode_quantities(lines, part.select(F.col("p_brand").alias("node")).distinct())[0]


def architecture(spark: SparkSession, sf_dir: str, until: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the architecture, of versions that count (`until`: that counted at that time): nodes not
    deleted; edges src, dst, kind."""
    n, e = table(spark, sf_dir, "architecture_node"), table(spark, sf_dir, "architecture_edge")
    if until is not None:
        n, e = (t.where(F.col("synced_at") <= F.lit(until).cast("timestamp_ntz")) for t in (n, e))
    fields = ["kind", "crate", "module_path", "file_path", "status", "deleted_at"]
    nodes = latest_version(n.select(normal_form(F.col("id")).alias("node"), "synced_at", *fields), ["node"], "synced_at", fields).where("deleted_at is null").drop("deleted_at")
    rows = latest_version(e.select("id", "synced_at", normal_form(F.col("from_node")).alias("src"), normal_form(F.col("to_node")).alias("dst"), "kind", "evidence_ref"), ["id"], "synced_at", ["src", "dst", "kind", "evidence_ref"])
    return nodes, rows


_NF = sql_normal_form


def arch_sql(mark: str = "", until: str | None = None) -> str:
    """The architecture as SQL, tables anode and aedge with a mark after their names."""
    then = f" where synced_at <= timestamp '{until}'" if until else ""
    return f"""anode{mark} as (select node, kind, crate, module_path, file_path, status from (select *, {_NF("id")} node from architecture_node{then} qualify row_number() over (partition by {_NF("id")} order by synced_at desc) = 1) where deleted_at is null and node is not null),
aedge{mark} as (select id, {_NF("from_node")} src, {_NF("to_node")} dst, kind, evidence_ref from (select * from architecture_edge{then} qualify row_number() over (partition by id order by synced_at desc) = 1))"""


ARCH_SQL = arch_sql()


@query(f"""with recursive {ARCH_SQL}, s as (select distinct dst as src, src as dst from aedge where src is not null and dst is not null and kind in ('calls', 'depends_on')),
  r(node, depth) using key (node) as (select distinct node, 0 from anode where crate = 'vantor-core' union select s.dst, min(r.depth) + 1 from r join s on s.src = r.node where s.dst not in (select node from recurring.r) group by s.dst)
  select node, depth::int as depth from r where depth > 0""")
def architecture_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that calls or depends on the nodes of one crate, however far away."""
    return G.bfs_depth(*dependent_steps(spark, sf_dir))


def dependent_steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(src, dst) from each node to what calls or depends on it, and the nodes of one crate."""
    nodes, edges = architecture(spark, sf_dir)
    back = edges.where("kind in ('calls', 'depends_on')").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return back, nodes.where("crate = 'vantor-core'").select("node")


@query(f"""with recursive {ARCH_SQL}, s as (select distinct dst as src, src as dst, case kind when 'calls' then 0 when 'owns' then 1 else 2 end w from aedge where src is not null and dst is not null and kind in ('calls', 'owns', 'guards')),
  r(node, depth, k) using key (node) as (select distinct node, 0, 0 from anode where crate = 'vantor-core'
    union select s.dst, min(r.depth) + 1, min(case when r.k > 0 then r.k else s.w end) from r join s on s.src = r.node where s.dst not in (select node from recurring.r) group by s.dst)
  select node, depth::int as depth, case k when 1 then 'ENCLOSES' when 2 then 'DISPATCHES_TO' end as reason from r where depth > 0""")
def architecture_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dependents over resolved and inferred steps, with the first inferred step of the way."""
    return G.upstream(*upstream_steps(spark, sf_dir))


def upstream_steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(src, dst, why) from each node to what rests on it, and the nodes of one crate."""
    nodes, edges = architecture(spark, sf_dir)
    why = F.when(F.col("kind") == "owns", "ENCLOSES").when(F.col("kind") == "guards", "DISPATCHES_TO")
    steps = edges.where("kind in ('calls', 'owns', 'guards')").select(F.col("dst").alias("src"), F.col("src").alias("dst"), why.alias("why"))
    return steps, nodes.where("crate = 'vantor-core'").select("node")


def trace_moves(edges: DataFrame) -> DataFrame:
    """Moves of a trace: calls and ownership descend, reads return a value, writes flow through state."""
    move = F.when(F.col("kind").isin("calls", "owns"), "descend").when(F.col("kind") == "reads", "return").when(F.col("kind") == "writes", "state")
    return edges.withColumn("move", move).where("move is not null").select("src", "dst", "kind", "move", F.coalesce("evidence_ref", F.lit("")).alias("evidence"), (F.col("kind") == "owns").alias("inferred"))


@query()
def architecture_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest realizable path from the nodes of one crate to those of another."""
    nodes, edges = architecture(spark, sf_dir)
    crate = lambda c: nodes.where(F.col("crate") == c).select("node")
    return G.realizable_path(trace_moves(edges), crate("vantor-billing"), crate("vantor-vault"))


@query(f"""with {ARCH_SQL} select 'node' as element, kind, count(*) as n_rows from anode group by all union all select 'edge', kind, count(*) from aedge group by all""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = architecture(spark, sf_dir)
    return nodes.groupBy(F.lit("node").alias("element"), "kind").agg(F.count("*").alias("n_rows")).unionByName(edges.groupBy(F.lit("edge").alias("element"), "kind").agg(F.count("*").alias("n_rows")))


@query(f"""with {ARCH_SQL}, hub as (select dst from aedge where dst is not null group by 1 order by count(*) desc, dst limit 1)
  select dst as node, 'out' as direction, kind from aedge where src = (select dst from hub) and dst is not null group by all union select src, 'in', kind from aedge where dst = (select dst from hub) and src is not null group by all""")
def hub_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes next to the most referred node."""
    edges = materialise(architecture(spark, sf_dir)[1].where("src is not null and dst is not null"))
    hub = edges.groupBy("dst").count().orderBy(F.desc("count"), "dst").first()
    return G.neighbours(edges, hub["dst"] if hub else "")


def rests_on(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges src, dst): what calls, depends on or owns what, between nodes that are there."""
    nodes, edges = architecture(spark, sf_dir)
    nodes = materialise(nodes)
    known = nodes.select("node")
    edges = edges.where("kind in ('calls', 'depends_on', 'owns')").select("src", "dst").distinct()
    edges = edges.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, materialise(edges)


_RESTS = f"""{ARCH_SQL}, e as (select distinct src, dst from aedge where kind in ('calls', 'depends_on', 'owns') and src in (select node from anode) and dst in (select node from anode)), c(src, dst) as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src)"""
_PARTS = f"{_RESTS}, l as (select n.node, greatest(n.node, coalesce(max(a.dst), n.node)) as component from (select src node from e union select dst from e) n left join (select a.* from c a join c b on b.src = a.dst and b.dst = a.src) a on a.src = n.node group by 1)"


@query(f"with recursive {_PARTS} select node, component from l")
def architecture_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components of the whole architecture."""
    return G.strong_components(rests_on(spark, sf_dir)[1])


@query(f"with recursive {_PARTS} select node, component, n_nodes from (select *, count(*) over (partition by component) n_nodes from l) where n_nodes > 1 or node in (select src from e where src = dst)")
def architecture_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cyclic_nodes(rests_on(spark, sf_dir)[1])


_STRENGTH = "case status when 'verified' then 3 when 'implemented' then 2 when 'planned' then 1 else 0 end"


@query(f"with recursive {_RESTS}, s as (select node, {_STRENGTH} k from anode) select s.node, least(s.k, coalesce(w.k, s.k))::int as effective from s left join (select c.src node, min(t.k) k from c join s t on t.node = c.dst group by 1) w using (node)")
def architecture_weakest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least standing among a node and all that it rests on, directly or not."""
    nodes, edges = rests_on(spark, sf_dir)
    return G.weakest_link(nodes.select("node", F.expr(_STRENGTH).alias("strength")), edges)[0]


@query(f"with recursive {ARCH_SQL}, e as (select distinct dst as src, src as dst, kind from aedge where src is not null and dst is not null and kind in ('calls', 'depends_on')), c(label, node) as (select distinct crate, node from anode where crate is not null union select c.label, e.dst from c join e on c.node = e.src where not (e.kind = 'depends_on' and c.label like '%-cli')) select node, label from c")
def architecture_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which crates stand behind a node: labels of crates spread to what calls or depends on their nodes; the label of
    a command line does not go over dependencies."""
    nodes, edges = architecture(spark, sf_dir)
    back = edges.where("kind in ('calls', 'depends_on')").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind").where("src is not null and dst is not null").distinct()
    roots = nodes.where("crate is not null").select("node", F.col("crate").alias("label"))
    return G.labelled_reach(back, roots, (F.col("kind") == "depends_on") & F.col("label").endswith("-cli"))[0]


@query(f"""with recursive {_RESTS}, bad as (select src node from c where src = dst union select c.src from c where c.dst in (select src from c where src = dst)),
  w(node, wave) as (select node, 1 from anode where node not in (select src from e) union select e.src, w.wave + 1 from w join e on e.dst = w.node where e.src not in (select node from bad))
  select a.node, max(w.wave)::int as wave from anode a left join w using (node) group by 1""")
def architecture_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which wave each node can be done; null on and behind cycles."""
    nodes, edges = rests_on(spark, sf_dir)
    return E.waves(nodes, edges)
