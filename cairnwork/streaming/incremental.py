"""Incremental forms: snapshots kept by a stream, memoised derivations, expiring leases, watched folders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnwork.sources.catalogue import exists


#: Micro-batches after which what they brought is folded into the snapshot's base.
COMPACT = 16


def _latest(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c != at]
    return rows.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("_l")).select(*keys, F.col(f"_l.{at}").alias(at), *(F.col(f"_l.{c}").alias(c) for c in rest))


def _parts(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the finished parts `path/kind=N`."""
    if not exists(spark, path):
        return []
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in p.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(x.split("=")[1]) for x in names if x.startswith(f"{kind}=") and exists(spark, f"{path}/{x}/_SUCCESS"))


def read_snapshot(spark: SparkSession, path: str, keys: Sequence[str], at: str, upto: int | None = None) -> DataFrame | None:
    """The latest row of each key in a snapshot kept by maintain_snapshot; null where nothing has been kept."""
    bases = [n for n in _parts(spark, path, "base") if upto is None or n <= upto]
    deltas = [n for n in _parts(spark, path, "delta") if (not bases or n > bases[-1]) and (upto is None or n <= upto)]
    paths = [f"{path}/base={n}" for n in bases[-1:]] + [f"{path}/delta={n}" for n in deltas]
    return _latest(spark.read.parquet(*paths), keys, at) if paths else None


def maintain_snapshot(stream: DataFrame, path: str, keys: Sequence[str], at: str, checkpoint: str, compact: int = COMPACT) -> StreamingQuery:
    """Keep a snapshot of the latest row of each key under `path`. A micro-batch writes its own latest rows as a delta;
    every `compact` batches the deltas are folded into a new base, and older parts are removed. So a batch costs what
    it brings, and the whole is written once in `compact` batches. A batch that is run again writes the same
    parts again, and a part counts only when it is whole, so the result is exact after failures."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        _latest(batch, keys, at).write.mode("overwrite").parquet(f"{path}/delta={epoch}")
        if (epoch + 1) % compact == 0 and epoch not in _parts(spark, path, "base"):
            read_snapshot(spark, path, keys, at, epoch).write.mode("overwrite").parquet(f"{path}/base={epoch}")
        bases = _parts(spark, path, "base")
        old = [f"delta={n}" for n in _parts(spark, path, "delta") if bases and n < bases[-1]] + [f"base={n}" for n in bases[:-1]]
        for name in old:
            sc = spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def watch_folder(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream of rows, a bounded number in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def append_ledger(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only ledger of all rows of a stream, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def memoised(inputs: DataFrame, cache: DataFrame | None, digest: str, version: str, derive: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results, fresh): results of all inputs, derived only for contents that the cache lacks under this version of
    the derivation. `derive` keeps `digest` and adds columns; `fresh` is what to append to the cache. Equal
    contents are derived once. A null digest is never cached and always derived."""
    tagged = inputs.withColumn("derived_by", F.lit(version))
    if cache is None:
        fresh = derive(tagged.dropDuplicates([digest]))
        return fresh, fresh.where(F.col(digest).isNotNull())
    known = cache.where(F.col("derived_by") == version)
    miss = tagged.join(known.select(digest), digest, "left_anti").dropDuplicates([digest])
    fresh = derive(miss)
    hit = known.join(inputs.select(digest).distinct(), digest, "left_semi")
    return hit.unionByName(fresh, allowMissingColumns=True), fresh.where(F.col(digest).isNotNull())


def lease_states(leases: DataFrame, now: Column) -> DataFrame:
    """Leases (lease_id, task_id, status, expires_at) with the state that holds now: an active lease past its expiry
    is EXPIRED; one without an expiry never expires."""
    return leases.withColumn("state", F.when((F.col("status") == "ACTIVE") & (F.col("expires_at") <= now), "EXPIRED").otherwise(F.col("status")))


def claim_conflicts(claims: DataFrame, active: DataFrame) -> DataFrame:
    """Claims (lease_id, path) that overlap a path held by another active lease: the same path, or one above or below."""
    from cairnwork.operators.joins import path_prefixes

    c, a = claims.select(F.col("lease_id").alias("claim"), F.col("path").alias("cp")), active.select(F.col("lease_id").alias("held_by"), F.col("path").alias("hp"))
    below = c.withColumn("hp", F.explode(path_prefixes(F.col("cp")))).join(a, "hp").select("claim", "held_by")
    above = a.withColumn("cp", F.explode(path_prefixes(F.col("hp")))).join(c, "cp").select("claim", "held_by")
    return below.union(above).where("claim <> held_by").distinct()
