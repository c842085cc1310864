"""Which version of a record counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_version(df: DataFrame, keys: Sequence[str], by: str, keep: Sequence[str]) -> DataFrame:
    """One row for each key, with `keep` of the row whose `by` is latest.

    Rows with a null in a key are no records and left out. A null `by` counts as earliest; rows with an
    equal `by` are told apart by the kept values, the greatest of which counts, so that the result never
    depends on the order of rows. An aggregation, not a window: versions are folded before the shuffle,
    so a key with very many versions costs no more than another.
    """
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    best = present.groupBy(*keys).agg(F.max(F.struct(F.col(by).alias("_by"), *keep)).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in keep))
