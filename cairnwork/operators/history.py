"""Histories of changing attributes, built from periodic snapshots that are compared as Merkle trees."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.session import broadcast_if_small, materialise, stored

#: A snapshot's keys fall into 16 ** levels leaf buckets; every inner node has 16 children.
LEVELS, MOST_LEVELS, FAN_BITS = 3, 6, 4
#: Updates of a leaf in a snapshot for which the number of levels is chosen: few, so that a leaf can be unchanged.
LEAF_UPDATES = 1
#: Updates of one key in one period that one task sorts; more are cut by time.
SEGMENT_ROWS = 100_000
#: Bits of a segment's number that tell its place within the period.
_SLICES = 20


def leaf_of(*keys: Column | str, levels: int = LEVELS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << (FAN_BITS * levels))).cast("int")


def differing_leaves(leaves: DataFrame, snapshot: str = "snapshot", levels: int = LEVELS) -> DataFrame:
    """(snapshot, leaf) of the leaf buckets whose content differs, found from the top downwards.

    `leaves` has `snapshot`, `leaf`, `old` and `new` (digests of the bucket in the snapshot before and in
    this one; null: the bucket was empty). Leaves that are the same may be left out: a node's digest is
    the XOR of its leaves' digests, each tied to its place, to which an equal leaf adds the same on either
    side. The sixteen trees below a snapshot's root are compared by themselves, each in one task that holds
    at most 16 ** (levels - 1) pairs of digests, whatever the number of records; each level is compared only
    below nodes that differ.
    """
    kind = dict(leaves.dtypes)[snapshot]
    tied = leaves.select(
        F.col(snapshot).alias("s"), F.shiftright("leaf", FAN_BITS * (levels - 1)).alias("branch"), F.col("leaf").cast("int").alias("leaf"),
        F.xxhash64("leaf", F.coalesce("old", F.lit(0))).alias("o"), F.xxhash64("leaf", F.coalesce("new", F.lit(0))).alias("n"),
    )

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf", kind="stable")
        leaf, both = pdf["leaf"].to_numpy(), np.stack([pdf["o"].to_numpy(), pdf["n"].to_numpy()])
        for level in range(1, levels + 1):
            if not len(leaf):
                break
            node = leaf >> (FAN_BITS * (levels - level))
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            digest = np.bitwise_xor.reduceat(both, start, axis=1)
            open_ = np.repeat(digest[0] != digest[1], np.diff(np.r_[start, len(node)]))
            leaf, both = leaf[open_], both[:, open_]
        return pd.DataFrame({snapshot: [pdf["s"].iloc[0]] * len(np.unique(leaf)), "leaf": np.unique(leaf)})

    return tied.groupBy("s", "branch").applyInPandas(descend, f"`{snapshot}` {kind}, leaf int")


def snapshot_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Keys whose attributes differ between two snapshots: `keys`, `old`, `new` (structs; null: not there)
    and `change` (added, removed, changed).

    Leaf digests are aggregated first, the trees compared, and only rows of differing buckets are joined.
    Repeated rows of a key count once when equal; of unequal ones the greatest counts. Keys with a null
    are left out.
    """
    keys, attributes = list(keys), list(attributes)

    def digests(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("_leaf").agg(F.bit_xor(F.xxhash64(*keys, "_v")).alias(name))

    a, b = (_snapshot_rows(df, keys, attributes) for df in (old, new))
    leaves = digests(a, "old").join(digests(b, "new"), "_leaf", "full_outer").select(F.lit(0).alias("snapshot"), F.col("_leaf").alias("leaf"), "old", "new")
    changed = differing_leaves(leaves).select(F.col("leaf").alias("_leaf"))
    x, y = (df.join(changed, "_leaf", "left_semi").drop("_leaf") for df in (a, b))
    return _row_changes(x, y, keys)


def _snapshot_rows(df: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    present = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    return present.groupBy(*keys).agg(F.max(F.struct(*attributes)).alias("_v")).withColumn("_leaf", leaf_of(*keys))


def _row_changes(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    both = x.withColumnRenamed("_v", "old").join(y.withColumnRenamed("_v", "new"), keys, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed"))


def append_snapshot(folder: str, snapshot: DataFrame, keys: Sequence[str], attributes: Sequence[str], at: int, part_levels: int = 2) -> dict[str, int]:
    """Take a whole snapshot, valid from `at` (later than any before), into the history kept in `folder`, and say how
    many leaves there were, how many differed, and how many stored rows were read.

    Kept are the tree (a digest for each leaf), the state in as many parts as the tree has branches at `part_levels`
    below its root, and the versions. The snapshot's own tree is compared with the kept one; only parts of branches with a changed
    leaf are read and only these are written anew; their new versions, and the ends of old ones, are
    appended. A generation becomes the current one by its last write, so a run that fails half way changes nothing.
    Rows as in snapshot_changes.
    """
    spark, keys, attributes = snapshot.sparkSession, list(keys), list(attributes)
    rows = stored(_snapshot_rows(snapshot, keys, attributes).withColumn("_part", F.shiftright("_leaf", FAN_BITS * (LEVELS - part_levels))))
    tree = rows.groupBy("_leaf").agg(F.bit_xor(F.xxhash64(*keys, "_v")).alias("new"))
    last = _current(spark, folder)
    own = uuid4().hex
    held = {} if last is None else {r["_part"]: r["gen"] for r in spark.read.parquet(f"{folder}/{last}/parts").collect()}
    before = rows.select("_leaf", F.lit(None).cast("long").alias("old")).limit(0) if last is None else spark.read.parquet(f"{folder}/{last}/tree")
    leaves = materialise(tree.join(before, "_leaf", "full_outer").select(F.lit(0).alias("snapshot"), F.col("_leaf").alias("leaf"), "old", "new"))
    changed = materialise(differing_leaves(leaves).select(F.col("leaf").alias("_leaf")))
    parts = sorted(r["p"] for r in changed.select(F.shiftright("_leaf", FAN_BITS * (LEVELS - part_levels)).alias("p")).distinct().collect())  # at most 256
    paths = [f"{folder}/{held[p]}/state/_part={p}" for p in parts if p in held]
    state = spark.read.schema(rows.drop("_part").schema).parquet(*paths) if paths else rows.drop("_part").limit(0)
    read = state.count()
    new = rows.where(F.col("_part").isin(parts)).drop("_part")
    diff = _row_changes(state.join(changed, "_leaf", "left_semi").drop("_leaf"), new.join(changed, "_leaf", "left_semi").drop("_leaf"), keys)
    diff.select(*keys, F.lit(at).cast("long").alias("_at"), F.col("new").alias("_v")).write.parquet(f"{folder}/{own}/versions")
    spread = F.pmod(F.xxhash64(*keys), F.lit(16))  # a part is written by several tasks, each of few parts
    rows.where(F.col("_part").isin(parts)).repartition("_part", spread).write.partitionBy("_part").parquet(f"{folder}/{own}/state")
    leaves.where("new is not null").select(F.col("leaf").alias("_leaf"), F.col("new").alias("old")).write.parquet(f"{folder}/{own}/tree")
    filled = {r["_part"] for r in rows.where(F.col("_part").isin(parts)).select("_part").distinct().collect()}
    kept = {p: g for p, g in held.items() if p not in parts} | dict.fromkeys(filled, own)
    spark.createDataFrame(sorted(kept.items()), "_part int, gen string").coalesce(1).write.parquet(f"{folder}/{own}/parts")
    done = [(0 if last is None else _chain(spark, folder).count(), own, at)]
    spark.createDataFrame(done, "n long, gen string, at long").coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return {"leaves": leaves.count(), "changed": changed.count(), "rows_read": read}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _chain(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("n long, gen string, at long").parquet(f"{folder}/log")


def _current(spark: SparkSession, folder: str) -> str | None:
    return _chain(spark, folder).orderBy(F.desc("n")).first()["gen"] if _exists(spark, f"{folder}/log") else None


def stored_history(spark: SparkSession, folder: str, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """The history kept by append_snapshot: `keys`, `attributes`, `valid_from`, `valid_to` (null: still valid)."""
    gens = [r["gen"] for r in _chain(spark, folder).collect()]  # one name for each snapshot taken
    steps = spark.read.parquet(*(f"{folder}/{g}/versions" for g in gens))
    ended = steps.withColumn("valid_to", F.lead("_at").over(W.partitionBy(*keys).orderBy("_at"))).where("_v is not null")
    return ended.select(*keys, *(F.col(f"_v.{a}").alias(a) for a in attributes), F.col("_at").alias("valid_from"), "valid_to")


def _segments(instants: DataFrame, keys: list[str], segment_rows: int) -> DataFrame:
    """`instants` with `_seg`, which grows with time within a key: the period, cut at quantiles of time where a key
    has more than `segment_rows` updates in it."""
    whole = instants.withColumn("_seg", F.shiftleft("_period", _SLICES))
    hot = instants.groupBy(*keys, "_period").agg(F.count("*").alias("_n")).where(F.col("_n") > segment_rows)
    hot = materialise(hot)
    if hot.isEmpty():
        return whole
    most = hot.agg(F.max("_n").alias("n")).first()["n"]
    cuts = min(2 * most // segment_rows + 1, 4096)
    marked = instants.join(F.broadcast(hot) if hot.count() <= 10_000 else hot, [*keys, "_period"])
    bounds = marked.groupBy(*keys, "_period").agg(F.percentile_approx("_at", [i / cuts for i in range(1, cuts)], F.lit(max(10_000, 2 * cuts))).alias("_cuts"))
    sliced = whole.join(broadcast_if_small(materialise(bounds)), [*keys, "_period"], "left")
    before = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_at"))), F.lit(0))
    return sliced.withColumn("_seg", F.col("_seg") + F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(before)).drop("_cuts")


def version_history(updates: DataFrame, keys: Sequence[str], at: str, order: str, attributes: Sequence[str], present: Column, period: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The full history of every key: `keys`, `attributes`, `valid_from`, `valid_to` (null: still valid).

    `updates` tells by rows what the attributes of a key were from `at` (a long) on; of rows of a key with
    the same `at` the one with the greatest `order` counts (then the greatest attributes). Where `present`
    is false the update withdraws: it ends the version and starts none. Neighbouring versions with equal
    attributes (nulls equal nulls) are one. Rows with a null key or `at` do not count. Row order and late
    arrival do not matter; an empty table gives an empty history.

    The updates are seen as snapshots, one at the end of every `period` of time. A leaf bucket's digest in a snapshot
    is the XOR over its keys of the key's state then and of what the key went through since the snapshot before,
    so that updates which only restate what held leave it as it was. Consecutive snapshots are compared as
    Merkle trees; updates of unchanged leaves are not read again. Rows of changed leaves are differenced against
    the key's state in the snapshot before. States are compared by 64-bit hashes.

    All windows over records are bounded by (key, segment): a period, or where a key has more than
    `segment_rows` updates in it a slice of the period. What passes between segments is one row for each key
    and segment, so a key with a third of all updates is split over its segments.
    """
    keys, attributes = list(keys), list(attributes)
    known = updates.where(F.col(at).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    known = known.select(*keys, F.col(at).cast("long").alias("_at"), F.struct(F.col(order).alias("o"), F.when(present, F.struct(*attributes)).alias("s")).alias("_u"))
    folded = known.groupBy(*keys, "_at").agg(F.max("_u").alias("_u")).select(*keys, "_at", F.col("_u.s").alias("_s"))
    state = F.when(F.col("_s").isNull(), F.lit(0)).otherwise(F.xxhash64("_s"))  # 0: nothing valid
    instants = stored(folded.withColumns({"_h": state, "_period": F.floor(F.col("_at") / period).cast("long")}))
    rows, levels = differing_updates(_segments(instants, keys, segment_rows), keys)

    inside = W.partitionBy(*keys, "_seg").orderBy("_at")
    was = F.coalesce(F.lag("_h").over(inside), F.col("_prev"))
    changes = rows.withColumn("_was", was).where("_h <> _was").select(*keys, "_seg", "_at", "_s")
    begins = changes.groupBy(*keys, "_seg").agg(F.min("_at").alias("_begin"))
    after = begins.withColumn("_next", F.lead("_begin").over(W.partitionBy(*keys).orderBy("_seg"))).select(*keys, "_seg", "_next")
    ended = changes.withColumn("_lead", F.lead("_at").over(inside)).join(after, [*keys, "_seg"], "left")
    versions = ended.where(F.col("_s").isNotNull())
    return versions.select(*keys, *(F.col(f"_s.{a}").alias(a) for a in attributes), F.col("_at").alias("valid_from"), F.coalesce("_lead", "_next").alias("valid_to"))


def differing_updates(instants: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """The updates (keys, _seg, _period, _at, _h, _s) whose leaf differs between the snapshots before and after
    their period, with `_prev`, the hash of the key's state before its segment; and the levels of the trees."""
    ends = instants.groupBy(*keys, "_period", "_seg").agg(F.max_by("_h", "_at").alias("_end"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"), F.count("*").alias("_n"))
    line = stored(ends.withColumn("_prev", F.coalesce(F.lag("_end").over(W.partitionBy(*keys).orderBy("_seg")), F.lit(0))))
    size = line.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.approx_count_distinct("_period").alias("p")).first()
    levels = LEVELS
    while levels < MOST_LEVELS and size["n"] > size["p"] * LEAF_UPDATES << (FAN_BITS * levels):
        levels += 1
    leaf = leaf_of(*keys, levels=levels)
    of_state = lambda c: F.when(F.col(c) == 0, F.lit(0)).otherwise(F.xxhash64(*keys, c))
    passed = F.when(F.col("_lo") == F.col("_hi"), F.lit(0)).otherwise(F.xxhash64(*keys, "_seg", "_n", "_lo", "_hi"))
    delta = of_state("_end").bitwiseXOR(of_state("_prev")).bitwiseXOR(passed)
    touched = line.groupBy("_period", leaf.alias("_leaf")).agg(F.bit_xor(delta).alias("_delta"))
    running = W.partitionBy("_leaf").orderBy("_period").rowsBetween(W.unboundedPreceding, W.currentRow)
    leaves = touched.withColumn("new", F.bit_xor("_delta").over(running)).select(F.col("_period").alias("snapshot"), F.col("_leaf").alias("leaf"), F.col("new").bitwiseXOR(F.col("_delta")).alias("old"), "new")
    changed = differing_leaves(leaves, levels=levels).select(F.col("snapshot").alias("_period"), F.col("leaf").alias("_leaf"))
    changed = broadcast_if_small(materialise(changed))
    here = lambda df: df.withColumn("_leaf", leaf).join(changed, ["_period", "_leaf"], "left_semi").drop("_leaf")
    return here(instants).join(here(line).select(*keys, "_seg", "_prev"), [*keys, "_seg"]), levels
