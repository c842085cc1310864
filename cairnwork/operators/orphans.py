"""References to records that are missing, deleted, or came later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.session import broadcast_if_small, materialise, stored

#: A key is heavy when it has more references than this share of what one of the session's shuffle partitions gets.
HEAVY_PART = 1 / 8


def heavy_keys(counted: DataFrame, keys: Sequence[str], heavy_part: float = HEAVY_PART) -> DataFrame:
    """The keys of `counted` (`keys`, `n`) of which one alone would fill `heavy_part` of a shuffle partition. There
    are at most partitions / heavy_part of them, however many rows there are."""
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return materialise(counted.groupBy(*keys).agg(F.sum("n").alias("_n")).where(F.col("_n") > max(1, total / parts * heavy_part)).select(*keys))


def orphan_groups(refs: DataFrame, parent: DataFrame, keys: Sequence[str], at: str, by: Sequence[str], heavy_part: float = HEAVY_PART) -> DataFrame:
    """References counted by `keys` and `by` (the period, and what else tells groups apart) before any join, and what
    is wrong with each group: `n` (its rows), `defect`, `created_at`, and `mixed`: the record came within
    the group's time, so that the rows before it are `late` and the others fine. Groups that are fine are left out.

    The groups of heavy keys take the parent's word along in a broadcast of checked size; the groups of
    all other keys meet the parents by shuffle; both are united. What is shuffled is one row for each group, so a
    key with a third of all references weighs as many rows as it has periods.
    """
    keys = list(keys)
    by = [c for c in by if c not in keys]
    counted = refs.groupBy(*keys, *by).agg(F.count("*").alias("n"), F.count(at).alias("_dated"), F.min(at).alias("_first"), F.max(at).alias("_last"))
    counted = stored(counted)
    heavy = heavy_keys(counted, keys, heavy_part)
    facts = parent.select(*keys, F.struct(F.col("deleted"), F.col("created_at")).alias("_p"))
    hot = broadcast_if_small(materialise(heavy.join(facts.join(broadcast_if_small(heavy), keys), keys, "left")))
    tagged = counted.join(hot, keys).unionByName(counted.join(broadcast_if_small(heavy), keys, "left_anti").join(facts, keys, "left"))
    found = F.col("_p")
    kind = F.when(found.isNull(), "missing").when(found["deleted"], "deleted").when(found["created_at"] > F.col("_first"), "late")
    mixed = F.coalesce((kind == "late") & ~((found["created_at"] > F.col("_last")) & (F.col("_dated") == F.col("n"))), F.lit(False))
    return tagged.select(*keys, *by, "n", kind.alias("defect"), found["created_at"].alias("created_at"), mixed.alias("mixed")).where("defect is not null")


def orphan_references(child: DataFrame, parent: DataFrame, keys: Sequence[str], at: str, by: Sequence[str], heavy_part: float = HEAVY_PART) -> DataFrame:
    """The rows of `child` whose `keys` have no good record in `parent`, with `defect`: `missing` (no such
    record), else `deleted` (parent's `deleted`), else `late` (parent's `created_at` after the row's `at`).

    `child` keeps its columns, but for one named `defect`; `parent` needs `keys` (unique together), `deleted` (boolean) and
    `created_at`. A row with a null in `keys` refers to nothing and is no case; a null time is never late.
    Repeated child rows stay repeated. Empty inputs are fine.

    The defective groups come from orphan_groups; only their rows are taken, by a broadcast of the groups when they
    are few by measure, else by (keys, `by`). Give `child` materialised: it is read for the groups and again here.
    """
    keys = list(keys)
    by = [c for c in by if c not in keys]
    refs = child.drop("defect").dropna(subset=keys)
    bad = materialise(orphan_groups(refs, parent, keys, at, by, heavy_part).drop("n"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"c.{k}") == F.col(f"g.{k}"))
    for k in by:
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"g.{k}"))
    rows = refs.alias("c").join(broadcast_if_small(bad).alias("g"), on)
    ok = (F.col("g.defect") != "late") | (F.col("g.created_at") > F.col(f"c.{at}"))
    return rows.where(ok).select("c.*", "g.defect")


def orphan_counts(child: DataFrame, parent: DataFrame, keys: Sequence[str], at: str, by: Sequence[str], heavy_part: float = HEAVY_PART) -> DataFrame:
    """How many orphan references of each kind each group `by` has: `by`, `defect`, `n_rows`. Counted from groups of
    references; rows are looked at only in groups within whose time the record came."""
    keys, by = list(keys), list(by)
    refs = child.dropna(subset=keys)
    groups = materialise(orphan_groups(refs, parent, keys, at, by, heavy_part))
    whole = groups.where("not mixed").select(*by, "defect", "n")
    within = broadcast_if_small(groups.where("mixed").select(*dict.fromkeys((*keys, *by)), "created_at"))
    on = F.lit(True)
    for k in dict.fromkeys((*keys, *by)):
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"g.{k}"))
    partly = refs.alias("c").join(within.alias("g"), on).where(F.col("g.created_at") > F.col(f"c.{at}")).select(*(F.col(f"c.{k}").alias(k) for k in by), F.lit("late").alias("defect"), F.lit(1).cast("long").alias("n"))
    return whole.unionByName(partly).groupBy(*by, "defect").agg(F.sum("n").cast("bigint").alias("n_rows"))
