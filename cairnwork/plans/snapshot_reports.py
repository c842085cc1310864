"""Reports on single records, on links between the stores, and over a snapshot of the stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.plans import store as S
from cairnwork.plans.registry import query
from cairnwork.plans.reports import money, n
from cairnwork.plans.sqlapi import read_only_sql, register_views
from cairnwork.session import broadcast_if_small

#: Rows that a list of a report shows.
LIMIT = 50
_KEY = "(select min(cap_key) from cap)"


def _first_capability(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The record asked for by its key, here the least key."""
    rows = S.capabilities(spark, sf_dir, *columns)
    return rows.orderBy("cap_key").limit(1)


@query(f"with {S.CAP_SQL} select cap_key, canonical_name, domain, target_crate, status, blocker from cap where cap_key = {_KEY}")
def capability_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_capability(spark, sf_dir, "canonical_name", "domain", "target_crate", "status", "blocker").select("cap_key", "canonical_name", "domain", "target_crate", "status", "blocker")


@query(f"with {S.ARCH} select src as actor, count(distinct dst) as n_subjects, min(dst) as first_subject from aedge where kind = 'guards' and src is not null and dst is not null group by 1")
def authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who guards what, by actor."""
    edges = S.architecture(spark, sf_dir)[1].where("kind = 'guards' and src is not null and dst is not null")
    return edges.groupBy(F.col("src").alias("actor")).agg(F.countDistinct("dst").alias("n_subjects"), F.min("dst").alias("first_subject")).orderBy("actor")


@query(f"with {S.ARCH} select dst as flow, count(distinct src) filter (kind = 'writes') as n_writers, count(distinct src) filter (kind = 'reads') as n_readers from aedge where kind in ('reads', 'writes') and src is not null and dst is not null group by 1")
def data_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through what data flows, and how many write and read it."""
    edges = S.architecture(spark, sf_dir)[1].where("kind in ('reads', 'writes') and src is not null and dst is not null")
    side = lambda k: F.countDistinct(F.when(F.col("kind") == k, F.col("src")))
    return edges.groupBy(F.col("dst").alias("flow")).agg(side("writes").alias("n_writers"), side("reads").alias("n_readers")).orderBy("flow")


def _crate_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = S.architecture(spark, sf_dir)[0]
    return nodes.where("crate is not null and kind = 'crate'").select(F.lower(F.trim("crate")).alias("target_crate"), "node", F.col("status").alias("node_status"))


_LINKED = "select c.cap_key, a.node, a.status as node_status from cap c join anode a on lower(trim(a.crate)) = c.target_crate and a.kind = 'crate'"


@query(f"with {S.CAP_SQL}, {S.ARCH} {_LINKED} where contains(c.cap_key, 'ledger') order by c.cap_key, a.node limit 200")
def capability_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Architecture nodes of the crates of the capabilities whose key has a fragment."""
    caps = S.capabilities(spark, sf_dir, "target_crate").where(F.col("cap_key").contains("ledger"))
    return caps.join(_crate_nodes(spark, sf_dir), "target_crate").orderBy("cap_key", "node").limit(200).select("cap_key", "node", "node_status")


@query(f"with {S.OVR_SQL} select cap_key, at_us, o_status, o_blocker, set_by from ovr")
def status_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The override that holds last for each key."""
    return S.overrides(spark, sf_dir).select("cap_key", "at_us", "o_status", "o_blocker", "set_by").orderBy("cap_key")


_DOMAINS = "select coalesce(domain, '<none>') as domain, count(*) as n_capabilities, count(*) filter (moves_money = 1) as n_money, count(*) filter (status = 'verified') as n_verified, coalesce(sum(donor_count), 0)::bigint as n_donor_links from cap group by 1"


@query(f"with {S.CAP_SQL} {_DOMAINS}")
def snapshot_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.capabilities(spark, sf_dir, "domain", "moves_money", "status", "donor_count")
    return rows.groupBy(F.coalesce("domain", F.lit("<none>")).alias("domain")).agg(F.count("*").alias("n_capabilities"), F.count_if(money()).alias("n_money"), F.count_if(F.col("status") == "verified").alias("n_verified"), F.coalesce(F.sum("donor_count"), F.lit(0)).alias("n_donor_links")).orderBy(F.desc("n_capabilities"), "domain")


@query(f"with {S.CAP_SQL}, d as ({_DOMAINS}) select *, (select count(*) from d)::bigint as n_domains from d order by n_capabilities desc, domain limit 10")
def snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest domains, and how many there are."""
    domains = snapshot_domains(spark, sf_dir)
    total = domains.agg(F.count("*").alias("n_domains"))
    return domains.orderBy(F.desc("n_capabilities"), "domain").limit(10).join(F.broadcast(total))  # one row


_NEXT = "select c.cap_key, coalesce(o.o_status, c.status) as status, c.moves_money, c.donor_count from cap c left join ovr o using (cap_key) where coalesce(o.o_status, c.status) = 'unimplemented'"


def _unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.capabilities(spark, sf_dir, "status", "moves_money", "donor_count").join(S.overrides(spark, sf_dir).select("cap_key", "o_status"), "cap_key", "left")
    return rows.select("cap_key", F.coalesce("o_status", "status").alias("status"), "moves_money", "donor_count").where("status = 'unimplemented'")


@query(f"with {S.CAP_SQL}, {S.OVR_SQL} {_NEXT} order by c.donor_count desc nulls last, c.cap_key limit {LIMIT}")
def snapshot_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still unimplemented after overrides, most donors first."""
    return _unverified(spark, sf_dir).orderBy(F.desc_nulls_last("donor_count"), "cap_key").limit(LIMIT)


@query(f"with {S.CAP_SQL}, {S.OVR_SQL} {_NEXT} and c.moves_money = 1 order by c.donor_count desc nulls last, c.cap_key limit {LIMIT}")
def snapshot_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unverified(spark, sf_dir).where(money()).orderBy(F.desc_nulls_last("donor_count"), "cap_key").limit(LIMIT)


@query(f"with {S.CAP_SQL} select cap_key, canonical_name, target_crate, moves_money, status, donor_count from cap where domain = 'ledger' order by moves_money desc nulls last, donor_count desc nulls last, cap_key limit {LIMIT}")
def snapshot_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.capabilities(spark, sf_dir, "canonical_name", "domain", "target_crate", "moves_money", "status", "donor_count").where("domain = 'ledger'")
    return rows.orderBy(F.desc_nulls_last("moves_money"), F.desc_nulls_last("donor_count"), "cap_key").limit(LIMIT).select("cap_key", "canonical_name", "target_crate", "moves_money", "status", "donor_count")


@query(f"with {S.CAP_SQL}, {S.SRC_SQL}, {S.LINK_SQL}, one as (select * from cap where cap_key = (select min(cap_key) from cap join lnk on canonical_id = cap.id join src on src.id = lnk.source_id)) select one.cap_key, s.donor, s.id as source_id, s.module, s.canonical_name from one join lnk on lnk.canonical_id = one.id join src s on s.id = lnk.source_id group by all order by donor, source_id limit {LIMIT}")
def snapshot_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capability (the first with sources) and the sources that its provenance names."""
    links = S.links(spark, sf_dir).join(S.sources(spark, sf_dir, "donor", "module", "canonical_name").withColumnRenamed("id", "source_id"), "source_id")
    found = S.capabilities(spark, sf_dir, "id").join(links, F.col("id") == F.col("canonical_id"))
    first = found.agg(F.min("cap_key").alias("cap_key"))
    return found.join(F.broadcast(first), "cap_key").select("cap_key", "donor", "source_id", "module", "canonical_name").distinct().orderBy("donor", "source_id").limit(LIMIT)


_CENSUS = ("donor", "classification", "read_status")


@query(f"with {S.FILE_SQL} select 'total' as section, '' as label, count(*) as n_rows, coalesce(sum(size_bytes), 0)::bigint as n_bytes from fil " + "".join(f"union all select '{c}', coalesce({c}, '<none>'), count(*), coalesce(sum(size_bytes), 0)::bigint from fil group by all " for c in _CENSUS))
def snapshot_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file census in total, by donor, by class and by status: one pass, each file counted in each section."""
    label = [F.struct(F.lit("total").alias("section"), F.lit("").alias("label")), *(F.struct(F.lit(c).alias("section"), F.coalesce(c, F.lit("<none>")).alias("label")) for c in _CENSUS)]
    rows = S.files(spark, sf_dir, *_CENSUS, "size_bytes").select("size_bytes", F.explode(F.array(*label)).alias("s"))
    return rows.groupBy(F.col("s.section").alias("section"), F.col("s.label").alias("label")).agg(n(), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))


@query(f"with {S.CAP_SQL}, {S.ARCH}, l as ({_LINKED}) select 'link' as section, cap_key, node as item from l where cap_key like '%ledger%' union all select 'gap', cap_key, coalesce(target_crate, '<none>') from cap where cap_key like '%ledger%' and cap_key not in (select cap_key from l)")
def snapshot_arch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Architecture links of capabilities, and the target crates for which there is no node."""
    caps = S.capabilities(spark, sf_dir, "target_crate").where(F.col("cap_key").contains("ledger"))
    both = caps.join(broadcast_if_small(_crate_nodes(spark, sf_dir)), "target_crate", "left")
    return both.select(F.when(F.col("node").isNull(), "gap").otherwise("link").alias("section"), "cap_key", F.coalesce("node", "target_crate", F.lit("<none>")).alias("item"))


@query(f"with {S.OPP_SQL} select opp_id, title, status from opp where status in ('discovered', 'planned') and opp_id is not null order by opp_id limit {LIMIT}")
def snapshot_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities that nobody has taken up yet."""
    return S.opportunities(spark, sf_dir, "title", "status").where("status in ('discovered', 'planned')").orderBy("opp_id").limit(LIMIT).select("opp_id", "title", "status")


#: Which tables a named store of the snapshot holds.
STORES = {"core": ("canonical_capability",), "census": ("donor_file_census",), "architecture": ("architecture_node", "architecture_edge"), "provenance": ("provenance", "source_capability")}
_STORE_SQL = "select donor, count(*) as n_files from donor_file_census where kind = 'source' group by donor having count(*) > 2"


def store_sql(spark: SparkSession, sf_dir: str, store: str, statement: str) -> DataFrame:
    """A reading statement over one named store; an unknown name is refused."""
    if store not in STORES:
        raise KeyError(f"unknown store {store}; known: {', '.join(sorted(STORES))}")
    register_views(spark, sf_dir, list(STORES[store]))
    return read_only_sql(spark, statement)


@query(_STORE_SQL)
def snapshot_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_sql(spark, sf_dir, "census", _STORE_SQL)


@query(f"""with {S.ARCH}, f as (select node, coalesce(file_path, '<none>') component, coalesce(lower(trim(crate)), '<none>') subsystem, case status when 'verified' then 3 when 'implemented' then 2 when 'planned' then 1 else 0 end k from anode),
  e as (select src node, count(*) filter (kind = 'calls') calls, count(*) filter (kind = 'reads') reads, count(*) filter (kind = 'writes') writes from aedge where src is not null group by 1),
  x as (select f.*, coalesce(calls, 0) calls, coalesce(reads, 0) reads, coalesce(writes, 0) writes from f left join e using (node))
  select 'component' as level, subsystem || '|' || component as name, 1::bigint as n_components, count(*) as n_functions, sum(calls)::bigint as n_calls, sum(reads)::bigint as n_reads, sum(writes)::bigint as n_writes, min(k)::int as weakest from x group by component, subsystem
  union all select 'subsystem', subsystem, count(distinct component), count(*), sum(calls)::bigint, sum(reads)::bigint, sum(writes)::bigint, min(k)::int from x group by subsystem""")
def architecture_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions rolled up to components, and components to subsystems: each stage reads the one below it alone."""
    nodes, edges = S.architecture(spark, sf_dir)
    per = edges.where("src is not null").groupBy(F.col("src").alias("node")).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("calls", "reads", "writes")))
    known = F.expr("case status when 'verified' then 3 when 'implemented' then 2 when 'planned' then 1 else 0 end")
    functions = nodes.select("node", F.coalesce("file_path", F.lit("<none>")).alias("component"), F.coalesce(F.lower(F.trim("crate")), F.lit("<none>")).alias("subsystem"), known.alias("k")).join(per, "node", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    components = functions.groupBy("component", "subsystem").agg(F.count("*").alias("n_functions"), *(total(c) for c in ("calls", "reads", "writes")), F.min("k").alias("k"))
    subsystems = components.groupBy("subsystem").agg(F.count("*").alias("n_components"), F.sum("n_functions").alias("n_functions"), *(total(c) for c in ("calls", "reads", "writes")), F.min("k").alias("k"))
    shape = lambda df, level, name, parts: df.select(F.lit(level).alias("level"), name.alias("name"), parts.cast("long").alias("n_components"), "n_functions", F.col("calls").alias("n_calls"), F.col("reads").alias("n_reads"), F.col("writes").alias("n_writes"), F.col("k").cast("int").alias("weakest"))
    return reduce(DataFrame.unionByName, (shape(components, "component", F.concat_ws("|", "subsystem", "component"), F.lit(1)), shape(subsystems, "subsystem", F.col("subsystem"), F.col("n_components"))))
