"""Ownership, exceptions, allocation and sinks as queries."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.operators import evidence as E
from cairnwork.operators import graph as G
from cairnwork.operators import joins as J
from cairnwork.operators import ownership as O
from cairnwork.plans import store as S
from cairnwork.plans.registry import query
from cairnwork.session import materialise, table, use_checkpoint_dir
from cairnwork.sources import catalogue as T
from cairnwork.sources import records

_DIR = "regexp_replace(path, '/[^/]*$', '')"


def _held(spark: SparkSession, sf_dir: str, classification: str) -> DataFrame:
    """(task, path): donors with the directories of their files of a class."""
    return S.files(spark, sf_dir, "donor", "path", "classification").where(F.col("classification") == classification).select(F.col("donor").alias("task"), F.regexp_replace("path", "/[^/]*$", "").alias("path"))


def _held_sql(name: str, classification: str) -> str:
    return f"{name} as (select distinct donor task, {_DIR} path from fil where classification = '{classification}' and donor is not null and path is not null)"


_RELATED = "(a.path = b.path or starts_with(a.path, b.path || '/') or starts_with(b.path, a.path || '/'))"


@query(f"with {S.FILE_SQL}, {_held_sql('o', 'mapped')}, {_held_sql('f', 'excluded')} select task, coalesce(n, 0)::bigint as n_hits from (select distinct task from o) left join (select a.task, count(*) n from o a join f b on {_RELATED} and a.task <> b.task group by 1) using (task)")
def forbidden_path_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors that own directories which others exclude."""
    return O.forbidden_paths(_held(spark, sf_dir, "mapped"), _held(spark, sf_dir, "excluded"))


@query(f"""with {S.SRC_SQL}, t as (select donor as task, bool_or(coalesce(requires_approval, 0) = 1 and coalesce(moves_money, 0) = 1) shared from src where donor is not null group by 1),
  al as (select distinct a.donor task, b.donor other from (select donor, min(target_crate) c from src group by 1) a join (select distinct donor, target_crate c from src) b on a.c = b.c where a.donor <> b.donor),
  mu as (select x.task, x.other from al x join al y on y.task = x.other and y.other = x.task)
  select a.task, count(*) filter (b.task is not null and not exists (select 1 from mu where mu.task = a.task and mu.other = b.task)) as n_conflicts from t a left join t b on a.task <> b.task and (a.shared or b.shared) group by 1""")
def shared_file_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors that need shared files, against donors with whom they share no main crate."""
    src = S.sources(spark, sf_dir, "donor", "target_crate", "requires_approval", "moves_money").where("donor is not null")
    one = lambda c: F.coalesce(c, F.lit(0)) == 1
    tasks = src.select(F.col("donor").alias("task"), (one("requires_approval") & one("moves_money")).alias("shared"))
    main = src.groupBy(F.col("donor").alias("task")).agg(F.min("target_crate").alias("c"))
    allows = main.join(src.select(F.col("donor").alias("other"), F.col("target_crate").alias("c")).distinct(), "c").where("task <> other").select("task", "other")
    return O.shared_file_conflicts(tasks, allows)


_TODAY = "2026-06-01"


@query(f"""with {S.ARCH}, c as (select lower(trim(crate)) unit, count(*) n from anode where crate is not null group by 1), k as (select node, lower(trim(crate)) unit from anode where crate is not null),
  i as (select y.unit, count(*) n from aedge e join k x on x.node = e.src join k y on y.node = e.dst where x.unit <> y.unit and e.kind in ('calls', 'depends_on') group by 1),
  s as (select c.unit, case when i.n is null then 'ISLAND' else 'LIVE' end status, c.n::varchar fp from c left join i using (unit)),
  x as (select unit, max({{'e': e, 'f': f}}) v from (select lower(trim(crate)) unit, max(created_at) + interval 365 day e, count(*)::varchar f from architecture_node where crate is not null and kind = 'crate' group by crate) group by 1),
  z as (select s.*, case when x.v is null then null when status <> 'ISLAND' then 'STALE_LIVE' when x.v.f is distinct from fp then 'STALE_FINGERPRINT' when x.v.e > timestamp '{_TODAY}' then 'GRANTED' else 'EXPIRED' end ex from s left join x using (unit))
  select unit, case when status <> 'ISLAND' then status when ex = 'GRANTED' then 'EXCEPTED' else 'BLOCKED' end as final_status, ex as exception from z""")
def island_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crates that nothing of another crate calls, and the exceptions granted when their crate nodes were made."""
    nodes, edges = S.architecture(spark, sf_dir)
    at = materialise(nodes.where("crate is not null").select("node", F.lower(F.trim("crate")).alias("unit")))
    used = edges.where("kind in ('calls', 'depends_on')").join(at.select(F.col("node").alias("src"), F.col("unit").alias("_a")), "src").join(at.select(F.col("node").alias("dst"), "unit"), "dst").where("_a <> unit").select("unit").distinct().withColumn("_used", F.lit(True))
    scan = at.groupBy("unit").agg(F.count("*").cast("string").alias("fingerprint")).join(used, "unit", "left").withColumn("status", F.when(F.col("_used"), "LIVE").otherwise("ISLAND"))
    raw = table(spark, sf_dir, "architecture_node").where("crate is not null and kind = 'crate'").groupBy("crate").agg(F.max("created_at").alias("c"), F.count("*").cast("string").alias("fingerprint"))
    granted = raw.select(F.lower(F.trim("crate")).alias("unit"), "fingerprint", (F.col("c") + F.expr("interval 365 days")).alias("expires"))
    return O.apply_exceptions(scan, granted, F.lit(_TODAY).cast("timestamp_ntz"))


@query(f"with {S.FILE_SQL}, {S.ARCH}, r as (select distinct rtrim(file_path, '/') r from anode where file_path is not null), p as (select distinct path from fil where path is not null) select path from p where not exists (select 1 from r where path = r or starts_with(path, r || '/') or starts_with(r, path || '/'))")
def unowned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census paths that no node's file covers."""
    files = S.files(spark, sf_dir, "path").select("path").where("path is not null").distinct()
    return J.unowned_paths(files, "path", S.architecture(spark, sf_dir)[0], "file_path")


@query(f"""with {S.CAP_SQL}, {S.SRC_SQL}, m as (select c.cap_key, s.target_crate t, min(case when s.surface = 'api' then 1 when s.surface = 'cli' then 2 else 3 end) r from cap c join src s on s.canonical_id = c.id where s.target_crate is not null group by all),
  l as (select cap_key, list(t order by r, t) l from m group by 1) select cap_key, l[1] as main, coalesce(array_to_string(l[2:], ','), '') as others from cap left join l using (cap_key)""")
def crate_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crate of each capability by the surfaces of its sources, and further ones in order; null: not to be told."""
    cap = S.capabilities(spark, sf_dir, "id")
    rank = F.when(F.col("surface") == "api", 1).when(F.col("surface") == "cli", 2).otherwise(3)
    src = S.sources(spark, sf_dir, "canonical_id", "target_crate", "surface").where("target_crate is not null").select(F.col("canonical_id").alias("_c"), rank.alias("rank"), F.col("target_crate").alias("target"))
    found = J.ordered_allocation(cap, "cap_key", cap.join(src, F.col("id") == F.col("_c")).select("cap_key", "rank", "target"))
    return found.withColumn("others", F.coalesce("others", F.lit("")))


@query(f"with {S.CAP_SQL}, h as (select d.k as domain, d.n least, count(cap.cap_key) n from (values ('ledger', 20), ('audit', 60), ('search', 1), ('nowhere', 2)) d(k, n) left join cap on cap.domain = d.k group by all) select domain, n, least from h where n < least")
def domain_minimums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains with fewer capabilities than they must have."""
    least = spark.createDataFrame([("ledger", 20), ("audit", 60), ("search", 1), ("nowhere", 2)], "domain string, least int")
    return E.minimum_counts(S.capabilities(spark, sf_dir, "domain"), "domain", least)


@query(f"with {S.CAP_SQL}, u as (select {S.nf('canonical_key')} cap_key, case {S.nf('status')} when 'verified' then true when 'blocked' then false end ok from canonical_status_override), e as (select cap_key, bool_or(ok) a, bool_and(ok) b from u where ok is not null group by 1) select cap_key, case when a is null then 'OPEN' when b then 'DISCHARGED' else 'REFUTED' end as state from cap left join e using (cap_key)")
def capability_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each capability was ever shown to work, and never not to."""
    said = table(spark, sf_dir, "canonical_status_override").select(S.normal_form(F.col("canonical_key")).alias("cap_key"), S.normal_form(F.col("status")).alias("s"))
    proof = said.select("cap_key", F.when(F.col("s") == "verified", True).when(F.col("s") == "blocked", False).alias("ok")).where("ok is not null and cap_key is not null")
    return E.obligation_states(S.capabilities(spark, sf_dir, "id"), proof, "cap_key", "ok")


@query(f"with k as (select {S.nf('id')} node, synced_at, kind, coalesce(status, '') status from architecture_node), f as (select node, min({{'a': synced_at, 'b': kind, 'c': status}}) v from k where node is not null group by 1) select node, v.b as kind, v.c as status from f")
def first_seen_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as they were first written."""
    rows = table(spark, sf_dir, "architecture_node").select(S.normal_form(F.col("id")).alias("node"), "synced_at", "kind", F.coalesce("status", F.lit("")).alias("status"))
    return G.first_writer_nodes(rows, "node", ["synced_at"]).select("node", "kind", "status")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{use_checkpoint_dir(spark)}/{name}-{uuid4().hex}"


@query("select c_custkey, case when c_nationkey < 10 then 'kept' else c_mktsegment end as segment from customer")
def sink_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of known keys stay as they are; the others are appended."""
    path, rows = _scratch(spark, "ignore"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"))
    rows.where("c_nationkey < 10").select("c_custkey", F.lit("kept").alias("segment")).write.parquet(path)
    T.insert_or_ignore(rows.select("c_custkey", "segment"), path, ["c_custkey"])
    return spark.read.parquet(path)


@query("select c_custkey, case when c_nationkey < 10 then c_mktsegment else 'old' end as segment from customer")
def sink_insert_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of known keys are replaced."""
    path, rows = _scratch(spark, "replace"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"))
    rows.select("c_custkey", F.lit("old").alias("segment")).write.parquet(path)
    T.insert_or_replace(rows.where("c_nationkey < 10").select("c_custkey", "segment"), path, ["c_custkey"], "segment")
    return spark.read.parquet(path)


@query("select count(*) filter (c_nationkey >= 20) as added, count(*) filter (c_nationkey between 5 and 19) as updated, count(*) filter (c_nationkey < 5) as deleted, (select count(*) from customer where c_nationkey >= 5) as n_rows from customer")
def sink_full_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made equal to another, and what that took."""
    path, rows = _scratch(spark, "sync"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"))
    rows.where("c_nationkey < 20").withColumn("segment", F.lit("old")).write.parquet(path)
    told = T.full_sync(rows.where("c_nationkey >= 5"), path, ["c_custkey"])
    again = T.write_once(rows.where("c_nationkey >= 5"), path)
    assert again == "identical"
    return spark.read.parquet(path).agg(*(F.lit(told[k]).cast("long").alias(k) for k in ("added", "updated", "deleted")), F.count("*").alias("n_rows"))


@query("select s_suppkey, s_name, s_nationkey from supplier")
def sink_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines in a total order, and read again with a schema."""
    path = _scratch(spark, "lines")
    T.write_json_lines(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, ["s_suppkey"], 4)
    found, _ = records.read_json_lines(spark, path, "s_suppkey bigint, s_name string, s_nationkey int")
    return found.select("s_suppkey", "s_name", "s_nationkey")


@query("select c_custkey as id, 2::bigint as n_rows, 'first,second' as lanes from customer where c_nationkey between 5 and 9")
def shard_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that two shards of one version both hold."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.lit(1).alias("version"))
    return T.merge_shards([("first", rows.where("c_nationkey < 10")), ("second", rows.where("c_nationkey >= 5"))], "id", "version")[1]
