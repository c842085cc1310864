"""Canned reports over the capability and architecture stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.plans import store as S
from cairnwork.plans.registry import query
from cairnwork.session import broadcast_if_small, cached



def n() -> Column:
    return F.count("*").alias("n_rows")


def money() -> Column:
    return F.coalesce(F.col("moves_money"), F.lit(0)) == 1


@query(f"""with {S.CAP_SQL}, {S.SRC_SQL}, {S.FILE_SQL} select (select count(*) from cap) as n_capabilities, (select count(*) from cap where moves_money = 1) as n_money, (select count(*) from cap where status = 'verified') as n_verified,
  (select count(distinct domain) from cap) as n_domains, (select count(*) from src) as n_sources, (select count(distinct donor) from src) as n_donors, (select count(*) from fil) as n_files, (select count(*) from fil where read_status = 'reviewed') as n_reviewed""")
def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline counts; three aggregates of one row each, joined."""
    cap = S.capabilities(spark, sf_dir, "domain", "moves_money", "status").agg(F.count("*").alias("n_capabilities"), F.count_if(money()).alias("n_money"), F.count_if(F.col("status") == "verified").alias("n_verified"), F.countDistinct("domain").alias("n_domains"))
    src = S.sources(spark, sf_dir, "donor", "moves_money").agg(F.count("*").alias("n_sources"), F.countDistinct("donor").alias("n_donors"))
    fil = S.files(spark, sf_dir, "donor", "read_status").agg(F.count("*").alias("n_files"), F.count_if(F.col("read_status") == "reviewed").alias("n_reviewed"))
    return reduce(lambda a, b: a.join(b, "_one"), (x.withColumn("_one", F.lit(1)) for x in (cap, src, fil))).drop("_one")


@query(f"with {S.CAP_SQL} select cap_key, domain, donor_count from cap where moves_money = 1 and status = 'unimplemented' order by donor_count desc nulls last, cap_key limit 20")
def next_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue's head: money capabilities still unimplemented, most donors first."""
    return S.capabilities(spark, sf_dir, "domain", "moves_money", "donor_count", "status").where(money() & (F.col("status") == "unimplemented")).orderBy(F.desc_nulls_last("donor_count"), "cap_key").limit(20).select("cap_key", "domain", "donor_count")


@query(f"with {S.CAP_SQL} select cap_key, target_crate, status from cap where contains(target_crate, 'tr')")
def by_crate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.capabilities(spark, sf_dir, "target_crate", "status").where(F.col("target_crate").contains("tr")).select("cap_key", "target_crate", "status")


@query(f"with {S.CAP_SQL} select cap_key, target_crate from cap where status = 'blocked' order by cap_key limit 50")
def by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.capabilities(spark, sf_dir, "target_crate", "status").where(F.col("status") == "blocked").orderBy("cap_key").limit(50).select("cap_key", "target_crate")


@query(f"with {S.SRC_SQL} select donor, count(*) as n_sources, count(distinct canonical_id) as n_capabilities, count(*) filter (moves_money = 1) as n_money from src group by 1")
def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sources(spark, sf_dir, "donor", "moves_money", "canonical_id").groupBy("donor").agg(F.count("*").alias("n_sources"), F.countDistinct("canonical_id").alias("n_capabilities"), F.count_if(money()).alias("n_money")).orderBy(F.desc("n_sources"), "donor")


@query(f"with {S.CAP_SQL}, {S.OVR_SQL} select c.cap_key, c.target_crate, o.set_by from cap c left join ovr o using (cap_key) where coalesce(o.o_status, c.status) = 'verified'")
def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities whose status, as overridden, is verified."""
    c, o = S.capabilities(spark, sf_dir, "target_crate", "status"), S.overrides(spark, sf_dir)
    return c.join(o, "cap_key", "left").where(F.coalesce("o_status", "status") == "verified").select("cap_key", "target_crate", "set_by")


def _file_totals() -> list[Column]:
    counted = {
        "n_files": F.count("*"), "n_directories": F.count_if(F.col("is_directory") == 1), "n_reviewed": F.count_if(F.col("read_status") == "reviewed"), "n_pending": F.count_if(F.col("read_status") == "unread_pending"),
        "n_mapped": F.count_if(F.col("classification") == "mapped"), "n_excluded": F.count_if(F.col("classification") == "excluded"), "n_blocked": F.count_if(F.col("read_status") == "blocked"), "n_bytes": F.coalesce(F.sum("size_bytes"), F.lit(0)),
    }
    return [v.alias(k) for k, v in counted.items()]


_FILE_SQL = "count(*) as n_files, count(*) filter (is_directory = 1) as n_directories, count(*) filter (read_status = 'reviewed') as n_reviewed, count(*) filter (read_status = 'unread_pending') as n_pending, count(*) filter (classification = 'mapped') as n_mapped, count(*) filter (classification = 'excluded') as n_excluded, count(*) filter (read_status = 'blocked') as n_blocked, coalesce(sum(size_bytes), 0)::bigint as n_bytes"


@query(f"with {S.FILE_SQL} select {_FILE_SQL} from fil")
def file_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.files(spark, sf_dir, "is_directory", "classification", "read_status", "size_bytes").agg(*_file_totals())


@query(f"with {S.FILE_SQL} select donor, {_FILE_SQL} from fil group by 1 order by count(*) filter (read_status = 'unread_pending') desc, donor limit 25")
def file_census_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors with most unread files."""
    return S.files(spark, sf_dir, "donor", "is_directory", "classification", "read_status", "size_bytes").groupBy("donor").agg(*_file_totals()).orderBy(F.desc("n_pending"), "donor").limit(25)


@query(f"with {S.FILE_SQL}, d as (select donor, kind from fil group by all having count(*) filter (read_status = 'unread_pending') = 0) select (select count(*) from d) as n_complete_groups, (select count(distinct (donor, kind)) from fil) as n_groups, (select count(*) from fil where classification = 'mapped' and coalesce(trim(mapped_source_ids), '') = '') as n_mapped_without_source")
def file_census_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many (donor, kind) groups have nothing unread, and mapped files that name no source."""
    fil = cached(S.files(spark, sf_dir, "donor", "kind", "classification", "read_status", "mapped_source_ids").select("donor", "kind", "read_status", "classification", "mapped_source_ids"))
    groups = fil.groupBy("donor", "kind").agg(F.count_if(F.col("read_status") == "unread_pending").alias("p")).agg(F.count_if(F.col("p") == 0).alias("n_complete_groups"), F.count("*").alias("n_groups"))
    loose = fil.agg(F.count_if((F.col("classification") == "mapped") & (F.coalesce(F.trim("mapped_source_ids"), F.lit("")) == "")).alias("n_mapped_without_source"))
    return groups.withColumn("_one", F.lit(1)).join(loose.withColumn("_one", F.lit(1)), "_one").drop("_one")


@query(f"with {S.FILE_SQL} select file_id, donor, path, kind from fil where read_status = 'unread_pending' or suffix(classification, 'review_pending') order by donor, path, file_id limit 100")
def file_census_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are still to be read, or whose review is pending."""
    pending = (F.col("read_status") == "unread_pending") | F.col("classification").endswith("review_pending")
    return S.files(spark, sf_dir, "donor", "path", "kind", "read_status", "classification").where(pending).orderBy("donor", "path", "file_id").limit(100).select("file_id", "donor", "path", "kind")


@query(f"with {S.FILE_SQL} select donor, count(*) filter (kind = 'source') as source, count(*) filter (kind = 'test') as test, count(*) filter (kind = 'documentation') as documentation, count(*) filter (kind = 'asset') as asset from fil group by 1")
def census_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds as columns."""
    return S.files(spark, sf_dir, "donor", "kind").groupBy("donor").pivot("kind", ["source", "test", "documentation", "asset"]).agg(F.count(F.lit(1))).na.fill(0)


@query(f"with {S.CAP_SQL} select coalesce(domain, '<none>') as domain, count(*) as n_rows, count(*) filter (moves_money = 1) as n_money, coalesce(sum(donor_count), 0)::bigint as n_donor_links from cap group by 1")
def canonical_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.capabilities(spark, sf_dir, "domain", "moves_money", "donor_count").groupBy(F.coalesce("domain", F.lit("<none>")).alias("domain")).agg(n(), F.count_if(money()).alias("n_money"), F.coalesce(F.sum("donor_count"), F.lit(0)).alias("n_donor_links"))


@query(f"with {S.CAP_SQL} select cap_key, status, donor_count from cap where moves_money = 1")
def money_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.capabilities(spark, sf_dir, "moves_money", "donor_count", "status").where(money()).orderBy(F.desc("donor_count"), "cap_key").select("cap_key", "status", "donor_count")


@query(f"with {S.CAP_SQL} select cap_key, donor_count from cap where status = 'unimplemented' order by donor_count desc nulls last, cap_key limit 40")
def next_unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.capabilities(spark, sf_dir, "donor_count", "status").where("status = 'unimplemented'").orderBy(F.desc_nulls_last("donor_count"), "cap_key").limit(40).select("cap_key", "donor_count")


@query(f"""with {S.CAP_SQL}, {S.ARCH}, k as (select distinct lower(crate) crate from anode where kind = 'crate' and crate is not null),
  r as (select c.*, k.crate is not null known, row_number() over (partition by coalesce(target_crate, '<none>') order by cap_key) rn from cap c left join k on k.crate = c.target_crate)
  select coalesce(target_crate, '<none>') as target_crate, bool_or(known) as known, count(*) as n_rows, count(*) filter (status = 'verified') as n_verified, count(*) filter (status = 'blocked') as n_blocked, count(*) filter (moves_money = 1) as n_money, string_agg(case when rn <= 5 then cap_key end, ',' order by rn) as examples from r group by 1""")
def target_crate_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities by target crate, whether a crate node of that name is known, and five examples."""
    nodes, _ = S.architecture(spark, sf_dir)
    known = broadcast_if_small(nodes.where("kind = 'crate' and crate is not null").select(F.lower("crate").alias("target_crate")).distinct().withColumn("_known", F.lit(True)))
    rows = S.capabilities(spark, sf_dir, "domain", "side_effect_class", "moves_money", "target_crate", "status", "blocker").join(known, "target_crate", "left").withColumn("target_crate", F.coalesce("target_crate", F.lit("<none>")))
    rows = cached(rows)
    few = rows.select("target_crate", "cap_key", F.row_number().over(W.partitionBy("target_crate").orderBy("cap_key")).alias("_rn")).where("_rn <= 5")
    some = few.groupBy("target_crate").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "cap_key"))), lambda x: x["cap_key"]), ",").alias("examples"))
    counted = rows.groupBy("target_crate").agg(F.coalesce(F.bool_or("_known"), F.lit(False)).alias("known"), n(), F.count_if(F.col("status") == "verified").alias("n_verified"), F.count_if(F.col("status") == "blocked").alias("n_blocked"), F.count_if(money()).alias("n_money"))
    return counted.join(some, "target_crate")


_SECTIONS = ("status", "domain", "side_effect_class", "target_crate", "blocker")


@query(f"with {S.CAP_SQL} " + " union all ".join(f"select '{c}' as section, coalesce({c}, '<none>') as label, count(*) as n_rows, count(*) filter (moves_money = 1) as n_money from cap group by all" for c in _SECTIONS))
def full_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rollups in one pass: every row counts once in each section, by one aggregation."""
    rows = S.capabilities(spark, sf_dir, "domain", "side_effect_class", "moves_money", "target_crate", "status", "blocker").select("moves_money", F.explode(F.array(*(F.struct(F.lit(c).alias("section"), F.coalesce(c, F.lit("<none>")).alias("label")) for c in _SECTIONS))).alias("s"))
    return rows.groupBy(F.col("s.section").alias("section"), F.col("s.label").alias("label")).agg(n(), F.count_if(money()).alias("n_money"))


@query(f"""with {S.CAP_SQL}, {S.SRC_SQL}, {S.LINK_SQL}, {S.OVR_SQL}, p as (select l.canonical_id, count(*) n_links, count(distinct s.donor) n_donors, string_agg(distinct s.donor, ',' order by s.donor) donors from lnk l join src s on s.id = l.source_id group by 1)
  select c.cap_key, coalesce(o.o_status, c.status) as status, coalesce(o.o_blocker, c.blocker) as blocker, coalesce(p.n_links, 0) as n_links, coalesce(p.n_donors, 0) as n_donors, coalesce(p.donors, '') as donors from cap c left join ovr o using (cap_key) left join p on p.canonical_id = c.id""")
def canonical_with_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capability with its overrides applied and its donors. Links are folded to one row for each
    capability and donor before anything is listed."""
    c, o = S.capabilities(spark, sf_dir, "id", "status", "blocker"), S.overrides(spark, sf_dir)
    per_donor = S.links(spark, sf_dir).join(S.sources(spark, sf_dir, "donor", "canonical_id").select(F.col("id").alias("source_id"), "donor"), "source_id").groupBy("canonical_id", "donor").agg(F.count("*").alias("k"))
    p = per_donor.groupBy("canonical_id").agg(F.sum("k").alias("n_links"), F.count("donor").alias("n_donors"), F.array_join(F.array_sort(F.collect_list("donor")), ",").alias("donors"))
    rows = c.join(o, "cap_key", "left").join(p, c["id"] == p["canonical_id"], "left")
    return rows.select("cap_key", F.coalesce("o_status", "status").alias("status"), F.coalesce("o_blocker", "blocker").alias("blocker"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_donors", F.lit(0)).alias("n_donors"), F.coalesce("donors", F.lit("")).alias("donors"))


@query(f"with {S.CAP_SQL} select cap_key, status, substring(blocker, 1, 24) as note from cap where status = 'blocked' or (status = 'implemented_unverified' and blocker is not null)")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.capabilities(spark, sf_dir, "status", "blocker").where("status = 'blocked' or (status = 'implemented_unverified' and blocker is not null)").select("cap_key", "status", F.substring("blocker", 1, 24).alias("note"))


@query(f"with {S.ARCH} select node, crate, status from anode where kind = coalesce('gate', kind) order by node limit 200")
def nodes_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional filter: a null argument keeps every kind but null ones."""
    return S.architecture(spark, sf_dir)[0].where(F.coalesce(F.lit("gate"), "kind") == F.col("kind")).orderBy("node").limit(200).select("node", "crate", "status")


@query(f"with {S.ARCH} select id, src, dst from aedge where kind = 'guards' order by id limit 200")
def edges_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.architecture(spark, sf_dir)[1].where("kind = 'guards'").orderBy("id").limit(200).select("id", "src", "dst")


@query(f"""with {S.CAP_SQL}, {S.LINK_SQL}, l as (select distinct canonical_id id from lnk where canonical_id > 0), g as (select id from cap where status in ('blocked', 'excluded'))
  select (select count(*) from l) as n_linked, (select count(*) from g) as n_gap, (select count(*) from (select id from l union select id from g)) as n_accounted, (select count(*) from (select id from cap except select id from l except select id from g)) as n_unaccounted""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked, gap, accounted by either, and unaccounted capabilities, in one aggregation by id."""
    cap = S.capabilities(spark, sf_dir, "id", "status").select("id", F.lit(True).alias("c"), F.lit(None).cast("boolean").alias("l"), F.col("status").isin("blocked", "excluded").alias("g"))
    lnk = S.links(spark, sf_dir).where("canonical_id > 0").select(F.col("canonical_id").alias("id"), F.lit(None).cast("boolean").alias("c"), F.lit(True).alias("l"), F.lit(None).cast("boolean").alias("g"))
    by = cap.unionByName(lnk).groupBy("id").agg(*(F.coalesce(F.bool_or(x), F.lit(False)).alias(x) for x in "clg"))
    return by.agg(F.count_if("l").alias("n_linked"), F.count_if("g").alias("n_gap"), F.count_if(F.col("l") | F.col("g")).alias("n_accounted"), F.count_if(F.col("c") & ~F.col("l") & ~F.col("g")).alias("n_unaccounted"))


@query(f"with {S.ARCH} select kind, coalesce(crate, '<none>') as crate, status, count(*) as n_rows from anode where status <> 'verified' group by all")
def architecture_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped by all three keys."""
    return S.architecture(spark, sf_dir)[0].where("status <> 'verified'").groupBy("kind", F.coalesce("crate", F.lit("<none>")).alias("crate"), "status").agg(n())


@query(f"with {S.ARCH} select node, crate from anode where status = 'planned' order by crate nulls last, node limit 400")
def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.architecture(spark, sf_dir)[0].where("status = 'planned'").orderBy(F.asc_nulls_last("crate"), "node").limit(400).select("node", "crate")


@query(f"with {S.ARCH} select id, src, dst from aedge where contains(src, 'ledger') or contains(dst, 'ledger') or contains(evidence_ref, 'ledger') order by id limit 200")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fragment in any of three columns."""
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.col(c).contains("ledger"), F.lit(False)) for c in ("src", "dst", "evidence_ref")))
    return S.architecture(spark, sf_dir)[1].where(hit).orderBy("id").limit(200).select("id", "src", "dst")
