"""Sources, sinks and incremental forms as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.plans import store as S
from cairnwork.plans.registry import query
from cairnwork.session import materialise, table, use_checkpoint_dir
from cairnwork.sources import records
from cairnwork.sources.inventory import artifact_class, language
from cairnwork.streaming import incremental as I


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared checkpoint folder."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("select user_id, event_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def streaming_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, kept by a stream over the events file."""
    events = table(spark, sf_dir, "events")
    folder = _scratch(spark, "stream")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(_as_folder(sf_dir))
    rows = stream.where("event_id is not null").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "value")
    I.maintain_snapshot(rows, f"{folder}/snapshot", ["user_id"], "at", f"{folder}/checkpoint").awaitTermination()
    return I.read_snapshot(spark, f"{folder}/snapshot", ["user_id"], "at").select("user_id", "event_id", "value")


def _as_folder(sf_dir: str) -> str:
    return f"{sf_dir}/events.parquet*"


@query(f"with {S.FILE_SQL} select sha256 as digest, min(length(path)) as path_length, count(*) as n_files from fil where sha256 is not null group by 1")
def memoised_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derivation by content, half of it found in a cache: equal to deriving all."""
    fil = materialise(S.files(spark, sf_dir, "path", "sha256").where("sha256 is not null").groupBy(F.col("sha256").alias("digest")).agg(F.min(F.length("path")).alias("path_length"), F.count("*").alias("n_files")))
    derive = lambda df: df.select("digest", "path_length", "n_files", "derived_by")
    first, fresh = I.memoised(fil.where(F.substring("digest", 1, 1) < "8"), None, "digest", "v1", derive)
    return I.memoised(fil, materialise(fresh), "digest", "v1", derive)[0].select("digest", "path_length", "n_files")


@query("with l as (select o_orderkey, o_orderstatus s, o_orderdate + interval 90 day e from orders) select case when s = 'O' and e <= timestamp '1998-01-01' then 'EXPIRED' when s = 'O' then 'ACTIVE' else s end as state, count(*) as n_rows from l group by 1")
def lease_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders seen as leases of ninety days."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lease_id"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise(F.col("o_orderstatus")).alias("status"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("expires_at"))
    return I.lease_states(o, F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("state").agg(F.count("*").alias("n_rows"))


_EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '.\\.([^.]+)$', 1))"


@query(f"with {S.FILE_SQL}, e as (select *, {_EXT} x from fil) select case x when 'rs' then 'rust' when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'py' then 'python' when 'go' then 'go' when 'java' then 'java' when 'rb' then 'ruby' when 'sql' then 'sql' when 'md' then 'markdown' when 'yaml' then 'yaml' end as language, case when x = '' then '(no extension)' else '.' || x end as class, count(*) as n_files from e group by all")
def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by language and class."""
    return S.files(spark, sf_dir, "path").groupBy(language(F.col("path")).alias("language"), artifact_class(F.col("path")).alias("class")).agg(F.count("*").alias("n_files"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) l from documents where text is not null) select doc_id, count(*) as n_rows, sum(length(l) - length(replace(l, '|', '')) + 1)::bigint as n_cells from l where regexp_matches(l, '^[^|]+\\|[^|]+\\|[^|].*$') and not regexp_matches(l, '\\|\\s*$') group by 1")
def document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and cells of tables in documents."""
    rows = records.table_rows(table(spark, sf_dir, "documents"), "doc_id", "text", bare=True).where(F.element_at("cells", -1) != "")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.sum(F.size("cells")).alias("n_cells"))


@query("select doc_id, len(string_split(text, chr(10))) as n_lines from documents where len(string_split(text, chr(10))) > 20")
def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnwork.sources.inventory import long_files

    return long_files(table(spark, sf_dir, "documents"), "doc_id", "text", 20)


@query("select date_trunc('day', ts) as start, event_type, count(*) as n_rows from events group by all")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and type."""
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").withColumn("at", ts).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n_rows"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n_rows")


@query("with r as (select user_id, value, ts, lag(ts) over (partition by user_id order by ts, event_id) p from events), g as (select user_id, value, sum(case when p is null or ts - p > interval 6 hour then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) s from r) select user_id, count(distinct s) as n_sessions from g group by 1")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events with no gap above six hours."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    started = table(spark, sf_dir, "events").withColumn("new", F.when(gap.isNull() | (gap > 6 * 3_600_000_000), 1).otherwise(0))
    return started.groupBy("user_id").agg(F.sum("new").alias("n_sessions"))
