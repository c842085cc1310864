"""Evidence ladders, candidates, waves and measured motions over the stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.operators import evidence as E
from cairnwork.operators import measured as M
from cairnwork.plans import graph_queries as GQ
from cairnwork.plans import store as S
from cairnwork.plans.registry import query
from cairnwork.session import materialise, table
from cairnwork.sources.inventory import artifact_class, language

_X = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '.\\.([^.]+)$', 1))"
_LANG = f"case {_X} when 'rs' then 'rust' when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'py' then 'python' when 'go' then 'go' when 'java' then 'java' when 'rb' then 'ruby' when 'sql' then 'sql' when 'md' then 'markdown' when 'yaml' then 'yaml' end"


@query(f"""with {S.FILE_SQL}, a as (select path, coalesce({_LANG}, '.' || {_X}) subject, case when {_LANG} is not null then 'language' else 'class' end kind, classification, read_status, trim(coalesce(mapped_source_ids, '')) <> '' mapped, sha256 is not null and read_status = 'reviewed' sealed from fil where path is not null),
  g as (select subject, kind, count(*) n_artifacts, count(*) filter (classification = 'mapped' and kind = 'language') n_parsed, count(*) filter (classification = 'mapped') n_records, count(*) filter (read_status = 'reviewed') n_ok, count(*) filter (mapped) n_fun, count(*) filter (mapped and sealed) n_der from a group by all)
  select subject, kind, n_artifacts, n_parsed, n_records, case when kind <> 'language' then 'L0_DISCOVERED' when n_parsed = 0 then 'L1_IDENTIFIED' when n_records = 0 then 'L2_SYNTAX' when n_ok = 0 then 'L3_TYPED_RECORDS' when n_fun = 0 then 'L4_OBLIGATIONS_EVALUATED' when n_der = 0 then 'L5_COMPOSED' else 'L6_AGENT_USABLE' end as level from g""")
def status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each language is supported: files, mapped files as records, reviews as obligations, files that name sources as functions,
    reviewed ones with a digest as derived."""
    fil = materialise(S.files(spark, sf_dir, "path", "kind", "classification", "read_status", "mapped_source_ids", "sha256").where("path is not null").select("file_id", "path", "classification", "read_status", (F.trim(F.coalesce("mapped_source_ids", F.lit(""))) != "").alias("mapped"), (F.col("sha256").isNotNull() & (F.col("read_status") == "reviewed")).alias("sealed"), language(F.col("path")).alias("language"), artifact_class(F.col("path")).alias("class")))
    art = fil.select(F.col("file_id").alias("path"), "language", "class", (F.col("classification") == "mapped").alias("parsed"))
    rec = fil.where("classification = 'mapped'").select(F.col("file_id").alias("path"))
    obl = fil.select(F.col("file_id").alias("path"), F.lit("READ").alias("dimension"), F.when(F.col("read_status") == "reviewed", "OBSERVED").otherwise("UNKNOWN").alias("status"))
    fun = fil.where("mapped").select(F.col("file_id").alias("id"), F.col("file_id").alias("path"))
    return E.support_levels(art, rec, obl, fun, fil.where("mapped and sealed").select(F.col("file_id").alias("id"))).select("subject", "kind", "n_artifacts", "n_parsed", "n_records", "level")


@query(f"""with {S.CAP_SQL}, {S.OVR_SQL}, m as (select cap_key, max(case o_status when 'verified' then 'L3' when 'implemented_unverified' then 'L2' else 'L1' end) as l from ovr where o_status is not null group by 1)
  select c.cap_key, case c.status when 'verified' then 'L3' when 'implemented_unverified' then 'L2' else 'L1' end as claimed, m.l as measured from cap c left join m using (cap_key) where m.l is null or case c.status when 'verified' then 'L3' when 'implemented_unverified' then 'L2' else 'L1' end > m.l""")
def excessive_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities that claim more than their last override says."""
    level = lambda c: F.when(F.col(c) == "verified", "L3").when(F.col(c) == "implemented_unverified", "L2").otherwise("L1").alias("level")
    return E.excessive_claims(S.capabilities(spark, sf_dir, "status").select("cap_key", level("status")), S.overrides(spark, sf_dir).where("o_status is not null").select("cap_key", level("o_status")), "cap_key", "level")


@query("with k as (select record_no, payload, case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload::json end p from campaign_record), f as (select record_no, unnest(json_keys(p)) field, p from k where p is not null), t as (select record_no, field, json_type(json_extract(p, '$.\"' || field || '\"')) t from f), g as (select record_no, field, case t when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end t from t where t <> 'NULL'), w as (select record_no, 'not_an_object' v from k where p is null union all select record_no, case when field not in ('donor', 'schema', 'ordinal', 'decision', 'reviewed') then 'unknown_field' when t <> case field when 'donor' then 'string' when 'schema' then 'string' when 'ordinal' then 'number' when 'decision' then 'object' else 'boolean' end then 'wrong_type' end from g union all select k.record_no, 'missing' from k, (values ('donor'), ('schema')) r(f) where p is not null and not exists (select 1 from g where g.record_no = k.record_no and g.field = r.f)) select v as violation, count(*) as n_rows from w where v is not null group by 1")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign records against a closed schema."""
    fields = {"donor": "string", "schema": "string", "ordinal": "number", "decision": "object", "reviewed": "boolean"}
    return E.schema_violations(table(spark, sf_dir, "campaign_record"), "record_no", "payload", fields, ["donor", "schema"]).groupBy("violation").agg(F.count("*").alias("n_rows"))


_TOK = "list_filter(list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')), lambda w: length(w) >= 3)"


@query(f"""with {S.CAP_SQL}, {S.SRC_SQL}, c as (select cap_key, {_TOK.format("cap_key")} m, {_TOK.format("canonical_name")} s from cap), w as (select cap_key, unnest(m) w, 2 p from c union all select cap_key, unnest(list_filter(s, lambda x: not list_contains(m, x))), 1 from c),
  o as (select distinct module from src where module is not null), h as (select module, unnest({_TOK.format("replace(module, '_', ' ')")}) w from o), x as (select cap_key, module, sum(p)::bigint score, count(*) filter (p = 2) n from w join h using (w) group by all)
  select cap_key, module, score, case when n >= 2 then 'HIGH' when n = 1 then 'MEDIUM' else 'LOW' end as confidence from x qualify row_number() over (partition by cap_key order by score desc, module) = 1""")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The module that fits each capability best by words."""
    cap = S.capabilities(spark, sf_dir, "canonical_name")
    return E.best_candidates(cap, "cap_key", F.col("cap_key"), F.col("canonical_name"), S.sources(spark, sf_dir, "module", "canonical_name"), "module")


@query(f"with {S.FILE_SQL}, u as (select distinct split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as r from fil where path is not null) select r as unit, count(distinct path) as n_files from fil join u on fil.path = u.r or starts_with(fil.path, u.r || '/') where read_status = 'unread_pending' group by 1")
def affected_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that hold unread files."""
    fil = S.files(spark, sf_dir, "path", "read_status").where("path is not null")
    units = fil.select(F.concat_ws("/", F.get(F.split("path", "/"), F.lit(0)), F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit(""))).alias("unit")).distinct()
    return E.affected_units(fil.where("read_status = 'unread_pending'"), "path", units.withColumn("root", F.col("unit")), "root", "unit")


@query("with recursive e(src, dst) as (select n_nationkey, n_nationkey // 2 from nation where n_nationkey > 0 union all select n_nationkey, n_nationkey // 3 from nation where n_nationkey > 0), d(node, w) as (select 0, 1 union all select e.src, d.w + 1 from d join e on e.dst = d.node) select node, max(w)::int as wave from d group by 1")
def dependency_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which wave each node can be done."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    pos = n.where("node > 0")
    edges = pos.select(F.col("node").alias("src"), F.floor(F.col("node") / 2).cast("int").alias("dst")).union(pos.select("node", F.floor(F.col("node") / 3).cast("int")))
    return E.waves(n, edges)


@query(f"with {S.FILE_SQL} select donor, count(*) as n_total, count(*) filter (read_status = 'reviewed') as n_done, round(count(*) filter (read_status = 'reviewed') * 100.0 / count(*), 1) as percent, case when count(*) filter (read_status = 'reviewed') = count(*) then 'DONE' when count(*) filter (read_status = 'reviewed') = 0 then 'NOT_STARTED' else 'IN_PROGRESS' end as state from fil group by 1")
def burn_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.burn_down(S.files(spark, sf_dir, "donor", "read_status"), "donor", F.col("read_status") == "reviewed")


@query(f"with {S.OPP_SQL}, a as (select date_diff('day', created_at::date, date '2026-01-01') d from opp) select case when d is null or d < 0 then 'INVALID' when d <= 90 then 'FRESH' when d <= 365 then 'AGING' else 'STALE' end as freshness, count(*) as n_rows from a group by 1")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.freshness(S.opportunities(spark, sf_dir, "created_at"), "created_at", F.lit("2026-01-01").cast("date"), 90, 365).groupBy("freshness").agg(F.count("*").alias("n_rows"))


@query(f"with {S.ARCH}, {S.SRC_SQL} select 'no owner crate' as gap, count(*) as n from anode where crate is null union all select 'edge without evidence', count(*) from aedge where evidence_ref is null union all select 'source without crate', count(*) from src where target_crate is null")
def understanding_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = S.architecture(spark, sf_dir)
    return E.understanding_gaps([("no owner crate", nodes.where("crate is null")), ("edge without evidence", edges.where("evidence_ref is null")), ("source without crate", S.sources(spark, sf_dir, "target_crate").where("target_crate is null"))])


@query(f"with {S.CAP_SQL}, {S.SRC_SQL}, m as (select canonical_id, count(distinct target_crate) n, min(target_crate) f from src group by 1) select c.cap_key, case when coalesce(m.n, 0) = 0 then 'UNSUPPORTED' when m.n > 1 then 'AMBIGUOUS' when m.f is not distinct from c.target_crate then 'AGREE' else 'DISAGREE' end as verdict from cap c left join m on m.canonical_id = c.id")
def crate_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crate of a capability against those of its sources."""
    found = S.sources(spark, sf_dir, "canonical_id", "target_crate").where("canonical_id is not null").select(F.col("canonical_id").alias("id"), F.col("target_crate").alias("found"))
    cap = S.capabilities(spark, sf_dir, "id", "target_crate").select("id", "cap_key", "target_crate")
    return cap.join(E.agreement(cap, "id", found, "target_crate", "found"), "id").select("cap_key", "verdict")


@query(f"with {S.CAP_SQL}, {S.LINK_SQL}, {S.SRC_SQL} select cap_key, array_to_string(list_sort(list_filter([case when not (coalesce(status, '') in ('verified', 'implemented_unverified')) then 'built' end, case when id not in (select canonical_id from lnk where canonical_id is not null) then 'linked' end, case when id not in (select canonical_id from src where canonical_id is not null) then 'sourced' end], lambda x: x is not null)), ',') as blockers, (coalesce(status, '') in ('verified', 'implemented_unverified') and id in (select canonical_id from lnk where canonical_id is not null) and id in (select canonical_id from src where canonical_id is not null)) as passes from cap")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities against three reports; a report without the capability blocks it."""
    cap = S.capabilities(spark, sf_dir, "id", "status")
    ids = cap.select("id")
    yes = lambda df: df.where("id is not null").distinct().join(ids, "id", "left_semi").withColumn("ok", F.lit(True))
    reports = [("built", cap.select("id", F.coalesce(F.col("status").isin("verified", "implemented_unverified"), F.lit(False)).alias("ok"))), ("linked", yes(S.links(spark, sf_dir).select(F.col("canonical_id").alias("id")))), ("sourced", yes(S.sources(spark, sf_dir, "canonical_id").select(F.col("canonical_id").alias("id"))))]
    return E.gate(reports, "id").join(cap.select("id", "cap_key"), "id").select("cap_key", "blockers", "passes")


@query("with l as (select p_brand arm, (p_partkey % 6)::int joint, max(p_size) / 7.0 len, max(p_retailprice) / 1009.0 mass from part group by all) select a.arm, a.joint, round(sum(b.len), 3) as reach, round(sum(b.mass * 9.80665 * (b.len / 2 + coalesce((select sum(c.len) from l c where c.arm = a.arm and c.joint >= a.joint and c.joint < b.joint), 0))) + 2.0 * 9.80665 * sum(b.len), 2) as torque from l a join l b on a.arm = b.arm and b.joint >= a.joint group by all")
def arm_torques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static torques of arms made from parts."""
    links = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("arm"), (F.col("p_partkey") % 6).cast("int").alias("joint")).agg((F.max("p_size") / 7.0).alias("length"), (F.max("p_retailprice") / 1009.0).alias("mass"))
    arms = links.select("arm").distinct().withColumn("payload", F.lit(2.0))
    out = M.arm_torques(links, arms)
    return out.select("arm", "joint", F.round("reach", 3).alias("reach"), F.round("torque", 2).alias("torque"))


@query("with b as (select l_partkey, l_linenumber, min(case when l_quantity > 25 then 'wide' else 'narrow' end) f from lineitem group by all), s as (select l_partkey, lag(l_linenumber) over w below, l_linenumber above, lag(f) over w before, f after from b window w as (partition by l_partkey order by l_linenumber)) select l_partkey, below, above, before, after from s where below is not null and before <> after")
def layout_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a form changes from one width to the next."""
    b = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.min(F.when(F.col("l_quantity") > 25, "wide").otherwise("narrow")).alias("f"))
    return M.breakpoints(b, "l_partkey", "l_linenumber", "f")


@query()
def easing_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The easing nearest to each user's running total of events."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(F.col("user_id").alias("motion"), F.row_number().over(w).alias("k"), F.sum(F.abs("value")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("value"))
    return M.infer_easing(rows).withColumn("rms", F.round("rms", 9))


@query()
def pendulum_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One damped pendulum for each part."""
    p = table(spark, sf_dir, "part")
    runs = p.select(F.col("p_partkey").alias("run"), (F.col("p_size") / 50).alias("angle"), F.lit(0.0).alias("speed"), (F.col("p_retailprice") / 1000).alias("length"), F.lit(0.2).alias("damping"), F.lit(0.01).alias("dt"))
    return M.simulate(runs, 200)


@query("with n as (select user_id, value, row_number() over w i, count(*) over (partition by user_id) c from events window w as (partition by user_id order by ts, event_id)) select user_id, count(*) as n, round(sum(power(0.8, (c - i)::double) * case when i = 1 then 1.0 else 0.2 end * value), 6) as ema from n group by 1")
def running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recurrence as a weighted sum."""
    rows = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return M.ema_state(rows, "user_id", "o", "value", 0.2).withColumn("ema", F.round("ema", 6))


@query(f"with {S.ARCH} select count(*) filter (src = dst) as n_loops, count(distinct src) as n_sources from aedge where src is not null and dst is not null")
def edge_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = GQ.architecture(spark, sf_dir)[1].where("src is not null and dst is not null")
    return edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("n_loops"), F.countDistinct("src").alias("n_sources"))
