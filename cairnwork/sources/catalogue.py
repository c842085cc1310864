"""Where tables come from, and where they go."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cairnwork.operators.normalise import canonical_json
from cairnwork.session import stored


class ConflictingReplay(ValueError):
    """The target holds something else than what was to be written."""


def exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    p, kept = (sc._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.previous"))
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p) and fs.exists(kept):  # a run ended between taking the old table away and putting the new one there
        fs.rename(kept, p)
    return fs.exists(p)


def first_present(spark: SparkSession, name: str, folders: Sequence[str], columns: Sequence[str] = ()) -> DataFrame | None:
    """The table from the first folder that has it with rows and the columns asked for; a table without rows counts
    as missing. Parquet before JSON lines in each folder. None when no folder has it."""
    for folder in folders:
        for suffix, read in ((".parquet", spark.read.parquet), (".jsonl", spark.read.json)):
            path = f"{folder}/{name}{suffix}"
            if not exists(spark, path):
                continue
            try:
                df = read(path)
            except AnalysisException:
                continue
            if set(columns) <= set(df.columns) and not df.isEmpty():
                return df
    return None


def with_columns_or(df: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """`df` with all wanted columns: those it lacks get the literal given."""
    return df.select(*df.columns, *(v.alias(k) for k, v in wanted.items() if k not in df.columns))


def rows_table(spark: SparkSession, rows: Sequence[dict], schema: str | None = None) -> DataFrame:
    """A table of dictionaries; without a schema, columns in order of name and types from the values."""
    names = sorted({k for r in rows for k in r})
    if schema is None and not rows:
        raise ValueError("no rows and no schema")
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema or names)


def write_once(df: DataFrame, path: str) -> str:
    """Write a table, or accept it as it is there already: `created` or `identical`; other content is refused and
    stays untouched. Compared as bags of rows."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
        return "created"
    there = spark.read.parquet(path)
    if sorted(there.columns) != sorted(df.columns):
        raise ConflictingReplay(f"{path} has other columns")
    a, b = there.select(*sorted(df.columns)), df.select(*sorted(df.columns))
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ConflictingReplay(f"{path} has other rows")
    return "identical"


def _publish(df: DataFrame, path: str) -> None:
    """Replace a table by one that was computed from it: written beside it first, then put in its place. The old table
    is kept beside it until the new one is there; `exists` puts it back where a run ended in between."""
    spark = df.sparkSession
    fresh = f"{path}.next"
    df.write.mode("overwrite").parquet(fresh)
    sc = spark.sparkContext
    jpath = sc._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(sc._jsc.hadoopConfiguration())
    fs.delete(jpath(f"{path}.previous"), True)
    if fs.exists(jpath(path)):
        fs.rename(jpath(path), jpath(f"{path}.previous"))
    fs.rename(jpath(fresh), jpath(path))
    fs.delete(jpath(f"{path}.previous"), True)


def full_sync(df: DataFrame, path: str, keys: Sequence[str]) -> dict[str, int]:
    """Make the table at `path` equal to `df`: rows of known keys updated, new ones added, others deleted. Returns how
    many of each."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.parquet(path)
        return {"added": df.count(), "updated": 0, "deleted": 0}
    old = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in keys]
    both = old.select(*keys, F.struct(*rest).alias("_o")).join(df.select(*keys, F.struct(*rest).alias("_n")), list(keys), "full_outer")
    counts = both.agg(F.count_if(F.col("_o").isNull()).alias("added"), F.count_if(F.col("_o").isNotNull() & F.col("_n").isNotNull() & (F.col("_o") != F.col("_n"))).alias("updated"), F.count_if(F.col("_n").isNull()).alias("deleted")).first().asDict()
    _publish(df, path)
    return counts


def insert_or_ignore(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Append rows whose key is not there; of new rows with one key the least counts. Returns how many were added."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in keys]
    new = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    new = stored(new)
    new.write.mode("append").parquet(path)
    return new.count()


def insert_or_replace(df: DataFrame, path: str, keys: Sequence[str], order: str) -> None:
    """Rows of `df` take the place of rows with their key; of several the one with the greatest `order` counts."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in keys]
    new = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))
    if exists(spark, path):
        new = new.unionByName(spark.read.parquet(path).join(new.select(*keys), list(keys), "left_anti"))
    _publish(new, path)


def write_json_lines(df: DataFrame, path: str, order: Sequence[str], partitions: int | None = None) -> None:
    """JSON lines with sorted keys in a total order over files: the same rows always give the same bytes."""
    ranged = df.repartitionByRange(partitions or 1, *order).sortWithinPartitions(*order)
    ranged.select(canonical_json(df.columns).alias("value")).write.mode("overwrite").text(path)


def sample_head(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first rows, as a table to look at."""
    return df.orderBy(*order).limit(n)


def merge_shards(shards: Sequence[tuple[str, DataFrame]], id_: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(rows, duplicates) of shards with their `lane`; shards of different versions are refused."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("lane", F.lit(name)) for name, df in shards))
    versions = [r[0] for r in whole.select(version).distinct().limit(3).collect()]
    if len(versions) > 1:
        raise ConflictingReplay(f"shards of several versions: {sorted(map(str, versions))}")
    twice = whole.groupBy(id_).agg(F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("lanes")).where("n_rows > 1")
    return whole, twice

