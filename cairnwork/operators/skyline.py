"""Pareto fronts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts of a group in the first round of the general front; each round folds this many into fewer.
ROUNDS = (64, 8, 1)


def front_of_two(df: DataFrame, group: Sequence[str], maximise: str, minimise: str, slices: int = 64) -> DataFrame:
    """The rows of each group that no other row of it dominates, for two objectives; equal rows are all kept.
    Rows with a null objective do not compete.

    Distinct score pairs are cut at quantiles of the first objective into slices; the best second objective of the
    better slices (one number a slice) is carried over, so a task ranks one slice of a group, however large
    the group is.
    """
    scored = df.where(F.col(maximise).isNotNull() & F.col(minimise).isNotNull())
    points = scored.groupBy(*group, maximise).agg(F.min(minimise).alias("_y"))  # others of the same first objective are dominated
    bounds = points.groupBy(*group).agg(F.percentile_approx(maximise, [i / slices for i in range(1, slices)], 100 * slices).alias("_cuts"))
    cut = points.join(bounds, list(group)).withColumn("_slice", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(maximise))), F.lit(0))).drop("_cuts")
    best = cut.groupBy(*group, "_slice").agg(F.min("_y").alias("_b"))
    ahead = best.withColumn("_ahead", F.min("_b").over(W.partitionBy(*group).orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1))).select(*group, "_slice", "_ahead")
    inside = cut.join(ahead, [*group, "_slice"]).withColumn("_near", F.min("_y").over(W.partitionBy(*group, "_slice").orderBy(F.desc(maximise)).rowsBetween(W.unboundedPreceding, -1)))
    front = inside.where(F.col("_y") < F.coalesce(F.least("_ahead", "_near"), F.col("_y") + 1)).select(*group, maximise, F.col("_y").alias(minimise))
    return scored.join(front, [*group, maximise, minimise], "left_semi")


def _keep(scores: np.ndarray) -> np.ndarray:
    """Which of the distinct rows (all to be maximised) are not dominated, by sort and filter."""
    order = np.lexsort(scores.T[::-1])[::-1]
    kept: list[int] = []
    front = np.empty((0, scores.shape[1]))
    for i in order:
        if not ((front >= scores[i]).all(1) & (front > scores[i]).any(1)).any():
            kept.append(i)
            front = np.vstack([front, scores[i]])
    out = np.zeros(len(scores), bool)
    out[kept] = True
    return out


def pareto_front(df: DataFrame, group: Sequence[str], objectives: Sequence[tuple[str, bool]]) -> DataFrame:
    """The undominated rows of each group for any number of objectives (column, whether greater is better).

    Distinct score vectors are filtered in salted parts of a group, then the survivors in fewer parts, and
    the fronts of the parts at last in one; a row dominated anywhere is gone after the first round.
    """
    cols = [c for c, _ in objectives]
    scored = df.dropna(subset=cols)
    points = scored.select(*group, *cols).distinct()
    signs = np.array([1.0 if up else -1.0 for _, up in objectives])

    def front(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[_keep(pdf[cols].to_numpy(float) * signs)]

    for parts in ROUNDS:
        salted = points.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(parts)))
        schema = salted.schema
        points = salted.groupBy(*group, "_salt").applyInPandas(front, schema).drop("_salt")
    return scored.join(points, [*group, *cols], "left_semi")


def verified_front(df: DataFrame, group: Sequence[str], objectives: Sequence[tuple[str, bool]], verdict: str) -> DataFrame:
    """Only verified and fully measured rows compete."""
    return pareto_front(df.where(F.col(verdict) == "SATISFIED"), group, objectives)
