"""Session helpers: table reading, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that an explicitly broadcast side may have (measured before the hint is given).
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Make checkpoint() usable, and say where. The cluster names the shared folder in spark.checkpoint.dir, and
    that folder is used as it is. Where the setting is absent, a single machine gets a temporary folder, and a
    cluster is refused: a folder that only one machine sees would lose its parts with an executor."""
    sc = spark.sparkContext
    if (there := sc.getCheckpointDir()) is not None:
        return there
    conf = sc._jsc.sc().conf()
    if not conf.contains("spark.cleaner.referenceTracking.cleanCheckpoints"):
        conf.set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # files go with the frames that need them
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        shared = tempfile.mkdtemp(prefix="cairnwork-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: the files lie in the shared folder, so that a lost
    executor costs nothing but its running tasks.

    A checkpointed frame would keep the size that was estimated for the plan it came from. In a loop each round's
    joins multiply the sizes of the round before, into numbers of ever more digits that in the end take
    longer to plan with than the data take to join. So the size is forgotten, and runtime statistics decide.
    """
    use_checkpoint_dir(df.sparkSession)
    spark, done = df.sparkSession, df.checkpoint(eager=True)
    plain = spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(plain, spark)


def stored(df: DataFrame) -> DataFrame:
    """As `materialise`, but written as a columnar table, which for many rows is a fraction of the size and
    lets later readers take single columns. The tables of a session are removed when it ends."""
    spark = df.sparkSession
    path = f"{use_checkpoint_dir(spark)}/table-{uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended before the interpreter
        pass


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES, row_bytes: Column | None = None) -> DataFrame:
    """`df`, hinted for broadcast when its measured size is at most `limit`; else `df` as it is, which
    joins by shuffle. Give it a frame that is cheap to read (materialised or a small dimension table)."""
    size = row_bytes if row_bytes is not None else F.length(F.to_json(F.struct(*df.columns))) + F.lit(40)
    total = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(df) if total <= limit else df


def cached(df: DataFrame) -> DataFrame:
    """Kept in memory and on disk for reuse inside one query; recomputed from its source when lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
