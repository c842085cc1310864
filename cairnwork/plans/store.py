"""The relational store: each table as it counts now, with comparable texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.functions.text import instant_us, normal_form
from cairnwork.operators.versions import latest_version
from cairnwork.plans.graph_queries import ARCH_SQL, architecture
from cairnwork.plans.registry import sql_normal_form as nf
from cairnwork.session import table


CAPABILITY = ("id", "canonical_name", "domain", "target_module", "side_effect_class", "moves_money", "requires_approval", "donor_count", "target_crate", "status", "blocker")
SOURCE = ("donor", "module", "canonical_name", "surface", "side_effect_class", "moves_money", "requires_approval", "canonical_id", "created_pass", "target_crate")
FILE = ("donor", "path", "is_directory", "kind", "classification", "read_status", "mapped_source_ids", "exclusion_reason", "size_bytes", "mtime_ms", "sha256", "reviewed_by")
OPPORTUNITY = ("title", "category", "impact", "reach", "leverage", "effort", "confidence", "ev", "priority", "source_repo", "status", "created_at")
SCORE = ("opportunity_id", "learning_value", "optionality", "adaptability", "knowledge_gain", "evolution_score", "scored_at")
#: Columns that are compared as text, and so read in normal form.
_FOLDED = ("target_crate", "blocker")


def _folded(c: str) -> Column:
    return normal_form(F.col(c)).alias(c) if c in _FOLDED else F.col(c)


def capabilities(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """`cap_key` and `columns` (all when none is named) of capabilities that are not deleted. The columns named are
    all that is read: a version is chosen by an aggregation that carries no others."""
    keep = list(columns or CAPABILITY)
    t = table(spark, sf_dir, "canonical_capability")
    named = t.select(normal_form(F.col("key")).alias("cap_key"), *(normal_form(F.col(c)).alias(c) if c == "status" else _folded(c) for c in keep), "deleted_at", "synced_at")
    return latest_version(named, ["cap_key"], "synced_at", [*keep, "deleted_at"]).where("deleted_at is null").drop("deleted_at")


def sources(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """`id` and `columns` of source capabilities that are not deleted."""
    keep = list(columns or SOURCE)
    named = table(spark, sf_dir, "source_capability").select("id", *(_folded(c) for c in keep), "deleted_at", "synced_at")
    return latest_version(named, ["id"], "synced_at", [*keep, "deleted_at"]).where("deleted_at is null").drop("deleted_at")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_version(table(spark, sf_dir, "provenance"), ["link_id"], "synced_at", ["source_id", "canonical_id"])


def files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """`file_id` and `columns` of the file census."""
    return latest_version(table(spark, sf_dir, "donor_file_census"), ["file_id"], "synced_at", list(columns or FILE))


def opportunities(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """`opp_id` and `columns` of opportunities that are not deleted."""
    keep = list(columns or OPPORTUNITY)
    named = table(spark, sf_dir, "opportunity").withColumn("opp_id", normal_form(F.col("id")))
    return latest_version(named, ["opp_id"], "synced_at", [*keep, "deleted_at"]).where("deleted_at is null").drop("deleted_at")


def scores(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """`score_id` and `columns` of scores."""
    t = table(spark, sf_dir, "evolution_score").withColumn("opportunity_id", normal_form(F.col("opportunity_id")))
    return latest_version(t, ["score_id"], "synced_at", list(columns or SCORE))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The update that holds last for each capability, withdrawals included (a null status)."""
    t = table(spark, sf_dir, "canonical_status_override")
    named = t.select(normal_form(F.col("canonical_key")).alias("cap_key"), instant_us(F.col("set_at")).alias("at_us"), "override_id", normal_form(F.col("status")).alias("o_status"), normal_form(F.col("blocker")).alias("o_blocker"), "set_by")
    return latest_version(named.where("at_us is not null").withColumn("_by", F.struct("at_us", "override_id")), ["cap_key"], "_by", ["at_us", "o_status", "o_blocker", "set_by"])


__all__ = ["architecture", "capabilities", "files", "links", "opportunities", "overrides", "scores", "sources"]

CAP_SQL = f"""cap as (select cap_key, id, canonical_name, domain, target_module, side_effect_class, moves_money, requires_approval, donor_count, crate_ as target_crate, status_ as status, blocker_ as blocker
  from (select *, {nf("key")} cap_key, {nf("target_crate")} crate_, {nf("status")} status_, {nf("blocker")} blocker_ from canonical_capability qualify row_number() over (partition by {nf("key")} order by synced_at desc) = 1) where deleted_at is null and cap_key is not null)"""
SRC_SQL = f"""src as (select id, donor, module, canonical_name, surface, side_effect_class, moves_money, requires_approval, canonical_id, created_pass, crate_ as target_crate
  from (select *, {nf("target_crate")} crate_ from source_capability qualify row_number() over (partition by id order by synced_at desc) = 1) where deleted_at is null)"""
LINK_SQL = "lnk as (select * from provenance qualify row_number() over (partition by link_id order by synced_at desc) = 1)"
FILE_SQL = "fil as (select * from donor_file_census qualify row_number() over (partition by file_id order by synced_at desc) = 1)"
OPP_SQL = f"""opp as (select *, {nf("id")} as opp_id from (select * from opportunity qualify row_number() over (partition by {nf("id")} order by synced_at desc) = 1) where deleted_at is null)"""
SCORE_SQL = f"""sco as (select * replace ({nf("opportunity_id")} as opportunity_id) from evolution_score qualify row_number() over (partition by score_id order by synced_at desc) = 1)"""
OVR_SQL = f"""raw as (select {nf("canonical_key")} k, override_id o, {nf("status")} s, {nf("blocker")} b, trim(set_at) t, set_by from canonical_status_override),
shaped as (select *, case
    when regexp_matches(t, '^\\d{{13}}$') then make_timestamp(t::bigint * 1000)
    when regexp_matches(t, '^\\d{{10}}$') then make_timestamp(t::bigint * 1000000)
    when regexp_matches(t, '^[A-Z][a-z]{{2}}, ') then try_strptime(t, '%a, %d %b %Y %H:%M:%S GMT')
    else try_cast(regexp_replace(replace(regexp_extract(t, '^[0-9/-]{{10}}([T ][0-9:.]+)?'), '/', '-'), 'T', ' ') as timestamp)
      - coalesce(try_cast(regexp_extract(t, 'T.*([+-])\\d\\d:?\\d\\d$', 1) || '1' as int), 1)
        * (coalesce(try_cast(regexp_extract(t, 'T.*[+-](\\d\\d):?\\d\\d$', 1) as int), 0) * interval 1 hour + coalesce(try_cast(regexp_extract(t, 'T.*[+-]\\d\\d:?(\\d\\d)$', 1) as int), 0) * interval 1 minute)
  end as ts from raw where k is not null),
ovr as (select k as cap_key, epoch_us(ts) as at_us, s as o_status, b as o_blocker, set_by from shaped where ts is not null qualify row_number() over (partition by k order by ts desc, o desc) = 1)"""
ARCH = ARCH_SQL
