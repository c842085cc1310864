"""Differences between snapshots, and which entity became which."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.functions import ranks as R


class SnapshotRefused(ValueError):
    """The snapshots cannot be compared."""


def inventory_delta(before: DataFrame, after: DataFrame, path: str, kind: str, digest: str, ignored_kind: str | None = None, classified: Sequence[str] = ()) -> DataFrame:
    """(path, change, cause, drift) of every path that came, went or changed, and of unchanged paths whose
    classification (`classified` columns) drifted, as change `unchanged`.

    Causes: appeared, disappeared, kind_changed, content_digest_differs, content_identity_unavailable (a
    digest is missing on a side). Paths of `ignored_kind` on both sides never change. A path twice in a
    snapshot is refused.
    """
    for side, df in (("before", before), ("after", after)):
        twice = df.where(F.col(path).isNotNull()).groupBy(path).count().where("count > 1").select(path).limit(1).collect()
        if twice:
            raise SnapshotRefused(f"the {side} snapshot lists {twice[0][0]} more than once")
    pick = lambda df, name: df.where(F.col(path).isNotNull()).select(path, F.struct(F.col(kind).alias("k"), F.col(digest).alias("d"), *classified).alias(name))
    both = pick(before, "a").join(pick(after, "b"), path, "full_outer")
    a, b = F.col("a"), F.col("b")
    cause = (
        F.when(a.isNull(), "appeared").when(b.isNull(), "disappeared").when(~a["k"].eqNullSafe(b["k"]), "kind_changed")
        .when(b["k"].eqNullSafe(F.lit(ignored_kind)) & F.lit(ignored_kind is not None), F.lit(None))
        .when(a["d"].isNull() | b["d"].isNull(), "content_identity_unavailable").when(a["d"] != b["d"], "content_digest_differs")
    )
    drift = F.lit(False)
    for c in classified:
        drift = drift | ~a[c].eqNullSafe(b[c])
    found = both.select(path, cause.alias("cause"), drift.alias("drift"))
    change = F.when(F.col("cause") == "appeared", "created").when(F.col("cause") == "disappeared", "deleted").when(F.col("cause").isNotNull(), "modified").otherwise("unchanged")
    return found.withColumn("change", change).where("cause is not null or drift").withColumn("drift", F.col("cause").isNull() & F.col("drift")).select(path, "change", "cause", "drift")


def count_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, before, after, delta) of counts by key that differ; both sides in one aggregation."""
    both = before.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(after.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy(key).agg(F.sum("a").alias("before"), F.sum("b").alias("after")).withColumn("delta", F.col("after") - F.col("before")).where("delta <> 0")


def namespace(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)::", 1)


def leaf(c: Column) -> Column:
    return F.substring_index(c, "::", -1)


def correspond(before: DataFrame, after: DataFrame) -> DataFrame:
    """Which entity of `before` became which of `after` (descriptor, signature, body, visibility): rows
    (change, before, after, evidence), entities that stayed the same left out.

    changed: one entity on either side has the descriptor, and something differs. Entities whose
    descriptor the other side lacks are matched by identical signature and body, when exactly one on
    either side has them: renamed (same namespace), moved (same name), moved_renamed. A body `-` never
    matches. ambiguous: several candidates, or a descriptor given several times whose rows differ.
    deleted, created: the rest. Counts decide, so no groups are paired up.
    """
    cols = ["signature", "body", "visibility"]
    whole = F.struct(*cols)
    row_digest = F.xxhash64(*(F.coalesce(F.col(c), F.lit("\x00")) for c in cols))

    def sides(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy("descriptor").agg(F.count("*").alias(f"n{n}"), F.max(whole).alias(f"v{n}"), F.bit_xor(row_digest).alias(f"x{n}"), F.sum(F.shiftright(row_digest, 32)).alias(f"s{n}"))

    both = sides(before, "a").join(sides(after, "b"), "descriptor", "full_outer")
    differs = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"va.{c}").eqNullSafe(F.col(f"vb.{c}")), F.lit(c)) for c in cols))), ",")
    one = F.lit(None).cast("string")
    matched = both.where("na is not null and nb is not null")
    single = F.expr("na = 1 and nb = 1")
    changed = matched.where(single).withColumn("e", differs).where("e <> ''").select(F.lit("changed").alias("change"), F.col("descriptor").alias("before"), F.col("descriptor").alias("after"), F.col("e").alias("evidence"))
    unclear = matched.where(~single & ((F.col("na") != F.col("nb")) | (F.col("xa") != F.col("xb")) | (F.col("sa") != F.col("sb"))))
    unclear = unclear.select(F.lit("ambiguous").alias("change"), F.col("descriptor").alias("before"), F.col("descriptor").alias("after"), F.concat(F.lit("descriptor declared "), F.col("na").cast("string"), F.lit(" -> "), F.col("nb").cast("string"), F.lit(" times")).alias("evidence"))

    old = before.join(after.select("descriptor").distinct(), "descriptor", "left_anti")
    new = after.join(before.select("descriptor").distinct(), "descriptor", "left_anti")
    usable = (F.col("body") != "-") & F.col("signature").isNotNull()
    prints = lambda df, n: df.where(usable).groupBy("signature", "body").agg(F.count("*").alias(f"n{n}"), F.min("descriptor").alias(f"d{n}"), F.max("descriptor").alias(f"e{n}"), F.min("visibility").alias(f"w{n}"))
    pairs = prints(old, "a").join(prints(new, "b"), ["signature", "body"])
    kind = F.when(namespace(F.col("da")) == namespace(F.col("db")), "renamed").when(leaf(F.col("da")) == leaf(F.col("db")), "moved").otherwise("moved_renamed")
    seen = F.when(F.col("wa").eqNullSafe(F.col("wb")), F.lit("identical signature and body")).otherwise(F.concat(F.lit("identical signature and body; visibility "), F.coalesce("wa", F.lit("")), F.lit(" -> "), F.coalesce("wb", F.lit(""))))
    became = pairs.where("na = 1 and nb = 1").select(kind.alias("change"), F.col("da").alias("before"), F.col("db").alias("after"), seen.alias("evidence"))
    several = pairs.where("na > 1 or nb > 1").select(F.lit("ambiguous").alias("change"), F.col("da").alias("before"), F.col("db").alias("after"), F.concat(F.col("na").cast("string"), F.lit(" -> "), F.col("nb").cast("string"), F.lit(" entities share one signature and body")).alias("evidence"))
    keys = pairs.select("signature", "body")
    gone = old.join(keys, ["signature", "body"], "left_anti").select(F.lit("deleted").alias("change"), F.col("descriptor").alias("before"), one.alias("after"), F.lit("").alias("evidence"))
    come = new.join(keys, ["signature", "body"], "left_anti").select(F.lit("created").alias("change"), one.alias("before"), F.col("descriptor").alias("after"), F.lit("").alias("evidence"))
    return changed.unionByName(unclear).unionByName(became).unionByName(several).unionByName(gone).unionByName(come)


def status_delta(before: DataFrame, after: DataFrame, id_: str, status: str, order: tuple[str, ...]) -> DataFrame:
    """(id, change) of items whose status moved in `order` (first is strongest): new, dropped, strengthened,
    weakened."""
    both = before.select(id_, F.col(status).alias("a"), F.lit(True).alias("_a")).join(after.select(id_, F.col(status).alias("b"), F.lit(True).alias("_b")), id_, "full_outer")
    ra, rb = R.rank(order, F.col("a")), R.rank(order, F.col("b"))
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "dropped").when(rb < ra, "strengthened").when(rb > ra, "weakened")
    return both.select(id_, F.col("a").alias("before"), F.col("b").alias("after"), change.alias("change")).where("change is not null")


def within_tolerance(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, uncertainty: str) -> DataFrame:
    """Two instruments compared: (keys, verdict): agree when the values lie within both uncertainties, differ
    when not, missing_a / missing_b, and unmeasured when a value is null."""
    x = a.select(*keys, F.struct(F.col(value).alias("v"), F.coalesce(uncertainty, F.lit(0)).alias("u")).alias("a"))
    y = b.select(*keys, F.struct(F.col(value).alias("v"), F.coalesce(uncertainty, F.lit(0)).alias("u")).alias("b"))
    gap = F.abs(F.col("a.v") - F.col("b.v"))
    verdict = F.when(F.col("a").isNull(), "missing_a").when(F.col("b").isNull(), "missing_b").when(gap.isNull(), "unmeasured").when(gap <= F.col("a.u") + F.col("b.u"), "agree").otherwise("differ")
    return x.join(y, list(keys), "full_outer").select(*keys, verdict.alias("verdict"))


def check_intent(changes: DataFrame, intent: DataFrame) -> DataFrame:
    """Observed changes (item, change) against intended ones (item, change, forbidden): (item, change, verdict).
    intended: both; forbidden: observed though ruled out; unintended: observed only; unfulfilled: only
    intended."""
    said = intent.groupBy("item", "change").agg(F.bool_or(F.coalesce("forbidden", F.lit(False))).alias("_f"))
    both = changes.select("item", "change").distinct().withColumn("_o", F.lit(True)).join(said, ["item", "change"], "full_outer")
    verdict = F.when(F.col("_o") & F.col("_f"), "forbidden").when(F.col("_o") & F.col("_f").isNotNull(), "intended").when(F.col("_o"), "unintended").when(~F.col("_f"), "unfulfilled")
    return both.select("item", "change", verdict.alias("verdict")).where("verdict is not null")
