"""Who may touch what: owned against forbidden paths, files that tasks share, exceptions to a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.operators.joins import path_prefixes


def forbidden_paths(owned: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(task, n_hits): for each task of `owned` (task, path) how many (other task, path) of `forbidden` (task, path) are
    a path it owns, or above or below one. A task does not stand against itself. Null tasks or paths are left out.

    Those who forbid a path are counted before they meet its owners, so a directory that everybody owns and everybody
    forbids makes as many rows as it has owners, never a row for each pair.
    """
    clean = lambda df: df.where("task is not null and path is not null").select("task", F.rtrim(F.col("path"), F.lit("/")).alias("path")).distinct()
    own, ban = clean(owned), clean(forbidden)
    places = own.select("path").distinct()
    at = ban.groupBy(F.col("path").alias("q")).agg(F.count("*").alias("n"))
    above = places.select("path", F.explode(path_prefixes(F.col("path"))).alias("q")).join(at, "q").select("path", "q", "n")
    below = at.select("q", "n", F.explode(path_prefixes(F.col("q"))).alias("path")).where("q <> path").join(places, "path").select("path", "q", "n")
    related = above.unionByName(below)
    total = own.join(related.groupBy("path").agg(F.sum("n").alias("n")), "path").groupBy("task").agg(F.sum("n").alias("n"))
    # What a task forbids itself counts for nothing: its own pairs of related paths are taken off.
    b = ban.select("task", F.col("path").alias("q"))
    up = own.select("task", "path", F.explode(path_prefixes(F.col("path"))).alias("q")).join(b, ["task", "q"])
    down = b.select("task", "q", F.explode(path_prefixes(F.col("q"))).alias("path")).where("q <> path").join(own, ["task", "path"])
    self_made = up.select("task").unionAll(down.select("task")).groupBy("task").agg(F.count("*").alias("m"))
    hits = F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0))
    return own.select("task").distinct().join(total, "task", "left").join(self_made, "task", "left").select("task", hits.alias("n_hits"))


def shared_file_conflicts(tasks: DataFrame, allows: DataFrame) -> DataFrame:
    """(task, n_conflicts): with how many tasks each of `tasks` (task, shared) is in conflict, because one of the two needs
    shared files and they do not both list each other in `allows` (task, other). Counted from totals: only pairs that
    list each other are ever made."""
    t = tasks.where("task is not null").groupBy("task").agg(F.coalesce(F.bool_or("shared"), F.lit(False)).alias("shared"))
    one = t.agg(F.count("*").alias("_all"), F.count_if("shared").alias("_shared"))
    a = allows.select("task", "other").where("task <> other").distinct()
    mutual = a.join(a.select(F.col("other").alias("task"), F.col("task").alias("other")), ["task", "other"])
    mutual = mutual.join(t.select(F.col("task").alias("other"), F.col("shared").alias("_o")), "other").groupBy("task").agg(F.count("*").alias("_m"), F.count_if("_o").alias("_ms"))
    free = lambda c: F.coalesce(c, F.lit(0))
    n = F.when(F.col("shared"), F.col("_all") - 1 - free("_m")).otherwise(F.col("_shared") - free("_ms"))
    return t.join(mutual, "task", "left").join(F.broadcast(one)).select("task", n.alias("n_conflicts"))  # one row


def apply_exceptions(scan: DataFrame, exceptions: DataFrame, today: Column) -> DataFrame:
    """(unit, final_status, exception): a scan (unit, status, fingerprint) after the exceptions (unit, fingerprint,
    expires) granted to units of status ISLAND. Without one an island is BLOCKED; with one it is EXCEPTED, unless
    the evidence has changed since (`STALE_FINGERPRINT`) or it has run out (`EXPIRED`), which block too. An exception for a unit
    that is none any more is STALE_LIVE. Of several exceptions of a unit the one that runs longest counts."""
    e = exceptions.where("unit is not null").groupBy("unit").agg(F.max(F.struct("expires", F.col("fingerprint").alias("granted"))).alias("_e"))
    rows = scan.join(e, "unit", "left")
    island, has = F.col("status") == "ISLAND", F.col("_e").isNotNull()
    why = F.when(~has, F.lit(None).cast("string")).when(~island, "STALE_LIVE").when(~F.col("_e.granted").eqNullSafe(F.col("fingerprint")), "STALE_FINGERPRINT").when(F.coalesce(F.col("_e.expires") > today, F.lit(False)), "GRANTED").otherwise("EXPIRED")
    return rows.withColumn("exception", why).select("unit", F.when(~island, F.col("status")).when(F.col("exception") == "GRANTED", "EXCEPTED").otherwise("BLOCKED").alias("final_status"), "exception")
