"""Problems 1 to 5 on the capability census: the operators with the tables they are meant for."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.functions.text import instant_us, normal_form
from cairnwork.operators.copydiff import diff_copies
from cairnwork.operators.history import append_snapshot, snapshot_changes, stored_history, version_history
from cairnwork.operators.orphans import orphan_counts, orphan_references
from cairnwork.operators.unpack import unpack_values
from cairnwork.operators.versions import latest_version
from cairnwork.session import stored, table, use_checkpoint_dir

#: A snapshot is taken every 30 days of event time.
SNAPSHOT_US = 30 * 86_400 * 1_000_000


def live_capabilities(df: DataFrame) -> DataFrame:
    """`cap_key`, `status`, `target_crate` in normal form of the capabilities that are not deleted."""
    named = df.select(normal_form(F.col("key")).alias("cap_key"), normal_form(F.col("status")).alias("status"), normal_form(F.col("target_crate")).alias("target_crate"), "deleted_at", "synced_at")
    return latest_version(named, ["cap_key"], "synced_at", ["status", "target_crate", "deleted_at"]).where("deleted_at is null").drop("deleted_at")


def p1_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, replica = (live_capabilities(table(spark, sf_dir, t)) for t in ("canonical_capability", "canonical_capability_replica"))
    return diff_copies(primary, replica, ["cap_key"], ["status", "target_crate"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each capability that only one copy holds, and each field in which the copies differ."""
    only = F.when(F.col("right").isNull(), F.array(F.lit("only_primary"))).when(F.col("left").isNull(), F.array(F.lit("only_replica")))
    return p1_differences(spark, sf_dir).select("cap_key", F.explode(F.coalesce(only, F.col("differing"))).alias("finding")).distinct()


def p1_row_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows of both copies as bags, every stored version included: how many rows of a key were
    paired, and with which values."""
    fields = ["status", "target_crate"]
    copies = [table(spark, sf_dir, t).select(normal_form(F.col("key")).alias("cap_key"), *(normal_form(F.col(f)).alias(f) for f in fields)) for t in ("canonical_capability", "canonical_capability_replica")]
    diff = diff_copies(*copies, ["cap_key"], fields)
    held = F.when(F.col("right").isNull(), "primary").when(F.col("left").isNull(), "replica").otherwise("both")
    return diff.select("cap_key", held.alias("held_by"), *(F.col(f"{side}.{f}").alias(f"{side}_{f}") for side in ("left", "right") for f in fields), F.col("n").alias("n_rows"), F.array_join("differing", ",").alias("differing"))


def p1_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the raw rows of each key compare: differing rows of the primary copy and of the replica, and how many of
    them found a partner."""
    rows = p1_row_differences(spark, sf_dir)
    held = lambda *w: F.coalesce(F.sum(F.when(F.col("held_by").isin(*w), F.col("n_rows"))), F.lit(0)).cast("long")
    return rows.groupBy("cap_key").agg(held("primary", "both").alias("n_primary"), held("replica", "both").alias("n_replica"), held("both").alias("n_paired"))


def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "canonical_status_override")
    return t.select(normal_form(F.col("canonical_key")).alias("cap_key"), instant_us(F.col("set_at")).alias("at_us"), "override_id", normal_form(F.col("status")).alias("status"), normal_form(F.col("blocker")).alias("blocker"))


def p2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = version_history(status_updates(spark, sf_dir), ["cap_key"], "at_us", "override_id", ["status", "blocker"], F.col("status").isNotNull(), SNAPSHOT_US)
    return history.select("cap_key", "status", "blocker", F.col("valid_from").alias("valid_from_us"), F.coalesce("valid_to", F.lit(-1)).cast("long").alias("valid_to_us"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period of every version of every capability."""
    return p2_history(spark, sf_dir).select("cap_key", "valid_from_us", "valid_to_us")


def p2_snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capability list as its two copies hold it, compared as two snapshots."""
    old, new = (live_capabilities(table(spark, sf_dir, t)) for t in ("canonical_capability_replica", "canonical_capability"))
    both = snapshot_changes(old, new, ["cap_key"], ["status", "target_crate"])
    return both.select("cap_key", "change", F.col("old.status").alias("old_status"), F.col("new.status").alias("new_status"), F.col("old.target_crate").alias("old_crate"), F.col("new.target_crate").alias("new_crate"))


#: Instants at which p2_appended takes its snapshots.
SNAPSHOTS = ("2024-07-01", "2025-01-01", "2025-07-01", "2026-01-01", "2027-01-01")


def p2_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of status and crate in the capability list, from the whole list as it stood at each of SNAPSHOTS,
    taken one after the other into a stored history."""
    folder = f"{use_checkpoint_dir(spark)}/history-{uuid4().hex}"
    rows = table(spark, sf_dir, "canonical_capability")
    for n, day in enumerate(SNAPSHOTS):
        append_snapshot(folder, live_capabilities(rows.where(F.col("synced_at") <= F.lit(day).cast("timestamp_ntz"))), ["cap_key"], ["status", "target_crate"], n, 1)
    return stored_history(spark, folder, ["cap_key"], ["status", "target_crate"]).select("cap_key", "status", "target_crate", F.col("valid_from").alias("from_snapshot"), F.coalesce("valid_to", F.lit(-1)).cast("long").alias("to_snapshot"))


def packed_fields(spark: SparkSession, sf_dir: str, counts: bool) -> DataFrame:
    """(src_table, row_key, is_path, packed) of the four packed fields; `counts`: of versions that count,
    else of all rows."""
    parts = []
    for name, key, field, textual in (("source_capability", "id", "source_files", False), ("opportunity", "id", "related_capabilities", True), ("donor_file_census", "file_id", "mapped_source_ids", False), ("end_state_pillar", "id", "crates", True)):
        t = table(spark, sf_dir, name)
        own = (normal_form(F.col(key)) if textual and counts else F.col(key)).cast("string").alias("_id")
        synced = F.col("synced_at") if "synced_at" in t.columns else F.lit(None).cast("timestamp_ntz").alias("synced_at")
        rows = t.select(own, synced, F.col(key).cast("string").alias("row_key"), F.col(field).alias("packed"))
        if counts:
            rows = latest_version(rows, ["_id"], "synced_at", ["row_key", "packed"])
        parts.append(rows.select(F.lit(name).alias("src_table"), "row_key", F.lit(field == "source_files").alias("is_path"), "packed"))
    return reduce(DataFrame.unionByName, parts)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the four packed fields with its position."""
    values = unpack_values(packed_fields(spark, sf_dir, True), "packed", "is_path", ["src_table", "row_key"], rules_from=packed_fields(spark, sf_dir, False))
    return values.select("src_table", "row_key", F.col("item_pos").cast("int").alias("item_pos"), "item")


_CHILDREN = (
    ("provenance", "link_id", "source_id", "linked_at", "source_capability"),
    ("provenance", "link_id", "canonical_id", "linked_at", "canonical_capability"),
    ("evolution_score", "score_id", "opportunity_id", "scored_at", "opportunity"),
    ("architecture_edge", "id", "to_node", "observed_at", "architecture_node"),
)


def _reference(c: Column, dtype: str) -> Column:
    return normal_form(c) if dtype == "string" else F.when(c > 0, c.cast("string"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references of the three referring tables, of the versions that count: one row each."""
    parts = []
    for name, key, ref, at, parent in _CHILDREN:
        t = table(spark, sf_dir, name)
        rows = latest_version(t.select(key, "synced_at", ref, at), [key], "synced_at", [ref, at])
        parts.append(rows.select(F.lit(name).alias("child_table"), F.col(key).cast("long").alias("row_id"), F.lit(ref).alias("ref_field"), F.col(at).alias("at"), F.lit(parent).alias("parent_table"), _reference(F.col(ref), dict(t.dtypes)[ref]).alias("ref")).where("ref is not null"))
    return reduce(DataFrame.unionByName, parts)


def referred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that may be referred to, of the versions that count."""
    parts = []
    for name, key, ident in (("source_capability", "id", "id"), ("canonical_capability", "key", "id"), ("opportunity", "id", "id"), ("architecture_node", "id", "id")):
        t = table(spark, sf_dir, name)
        own = F.col(key) if dict(t.dtypes)[key] != "string" else normal_form(F.col(key))
        rows = latest_version(t.select(own.alias("_key"), "synced_at", F.col(ident).alias("_ident") if ident != key else own.alias("_ident"), "created_at", F.col("deleted_at").isNotNull().alias("deleted")), ["_key"], "synced_at", ["_ident", "created_at", "deleted"])
        parts.append(rows.select(F.lit(name).alias("parent_table"), F.col("_ident").cast("string").alias("ref"), "deleted", "created_at"))
    return reduce(DataFrame.unionByName, parts)


_BY = ("child_table", "ref_field", "period")


def _dated_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(references(spark, sf_dir).withColumn("period", F.date_format("at", "yyyy-MM")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference whose record is missing, deleted or came later."""
    found = orphan_references(_dated_references(spark, sf_dir), referred(spark, sf_dir), ["parent_table", "ref"], "at", _BY)
    return found.select("child_table", "row_id", "ref_field", "defect", "period")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references by table, field, kind and month."""
    return orphan_counts(_dated_references(spark, sf_dir), referred(spark, sf_dir), ["parent_table", "ref"], "at", _BY).select("child_table", "ref_field", "defect", "period", "n_rows")
