"""Ranked, running and adjacent-row operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.session import broadcast_if_small, materialise, stored


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The first row of each key in `order` (a total order: give a tie-break). Folded by an aggregation, so a
    key with very many rows is never sorted in one task. Null orders come first."""
    o = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    best = df.groupBy(*keys).agg(F.min(F.struct(*o, *keep)).alias("_m"))
    return best.select(*keys, *(F.col(f"_m.{c}").alias(c) for c in keep))


def stratified_sample(df: DataFrame, stratum: str, id_: Column, per_stratum: int, seed: int = 0) -> DataFrame:
    """`per_stratum` rows of each stratum, those with the least mixed id: the same rows whatever the order or
    partitioning. Each task first keeps its own least, so what is ranked in the end is small."""
    mixed = F.pmod((id_ + seed) * 2654435761, F.lit(4294967296))
    drawn = df.withColumns({"_mix": mixed, "_part": F.spark_partition_id(), "_id": id_})
    local = drawn.withColumn("_rn", F.row_number().over(W.partitionBy(stratum, "_part").orderBy("_mix", "_id"))).where(F.col("_rn") <= per_stratum)
    return local.withColumn("_rn", F.row_number().over(W.partitionBy(stratum).orderBy("_mix", "_id"))).where(F.col("_rn") <= per_stratum).drop("_mix", "_part", "_id", "_rn")


def _sliced(df: DataFrame, group: str, order: Sequence[str], carried: Sequence[Column]) -> DataFrame:
    """`df` in slices of its order (`_part`), which a sample of the rows cuts to even sizes, with what earlier slices of
    the group carry over: aggregates `carried`, given as columns with an alias, of each slice before. A window over
    (group, slice) then sorts one slice, however large the group is."""
    parts = stored(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    names = [f"_c{i}" for i in range(len(carried))]
    each = parts.groupBy(F.col(group).alias("_g"), "_part").agg(*(c.alias(n) for c, n in zip(carried, names)))
    earlier = W.partitionBy("_g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    told = each.select("_g", F.col("_part").alias("_p"), *(F.collect_list(F.struct(n)).over(earlier).alias(n) for n in names))
    return parts.join(broadcast_if_small(materialise(told)), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).drop("_g", "_p")


def chain_breaks(df: DataFrame, group: str, seq: str, link: str, digest: str) -> DataFrame:
    """Rows of a hash chain whose `link` is not the `digest` of the row before (the first row's link is null). Long
    chains are cut into slices, which pass their last digest on."""
    rows = _sliced(df, group, [seq], [F.max_by(F.struct(digest), seq)])
    inside = W.partitionBy(group, "_part").orderBy(seq)
    before = F.coalesce(F.lag(F.struct(digest)).over(inside), F.element_at(F.when(F.size("_c0") > 0, F.col("_c0")), -1)["_c0"])
    return rows.withColumn("_prev", before).where(~F.col(link).eqNullSafe(F.col(f"_prev.{digest}"))).select(*df.columns)


def tiling_defects(ranges: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Ranges that do not begin where all before end, with `defect` (hole or overlap) and by how much. Groups with many
    ranges are cut into slices, which pass their greatest end on."""
    rows = _sliced(ranges, group, [start, end], [F.max(end)])
    inside = W.partitionBy(group, "_part").orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    reached = F.greatest(F.max(end).over(inside), F.array_max(F.transform("_c0", lambda x: x["_c0"])))
    gap = F.col(start) - F.coalesce(reached, F.lit(0))
    sized = rows.withColumn("size", gap).select(*ranges.columns, "size").where("size <> 0")
    return sized.withColumn("defect", F.when(F.col("size") > 0, "hole").otherwise("overlap")).withColumn("size", F.abs("size"))


def shares(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Count of each group and its share of the rows `within`; counted first, so the window sees groups only."""
    counts = df.groupBy(*within, *keys).agg(F.count("*").alias("n_rows"))
    return counts.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(W.partitionBy(*within)))


def admit_within_budget(queue: DataFrame, lane: str, order: Sequence[str], size: str, budget: float) -> DataFrame:
    """The queue with `total` (running sum in its lane) and whether the row still fits the budget. Long lanes are cut
    into slices, which pass their sums on."""
    rows = _sliced(queue, lane, order, [F.sum(size)])
    inside = W.partitionBy(lane, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.aggregate("_c0", F.lit(0).cast(dict(rows.select(F.sum(size).alias("s")).dtypes)["s"]), lambda a, x: F.coalesce(a + x["_c0"], a))
    return rows.withColumn("total", before + F.sum(size).over(inside)).withColumn("admitted", F.col("total") <= budget).select(*queue.columns, "total", "admitted")


def adjacent_changes(df: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Neighbouring rows of a group whose `value` differs: the value before and after."""
    w = W.partitionBy(group).orderBy(*order)
    moved = df.withColumns({"before": F.lag(value).over(w), "_n": F.row_number().over(w)}).withColumn("after", F.col(value))
    return moved.where((F.col("_n") > 1) & ~F.col("before").eqNullSafe(F.col("after"))).drop("_n")
