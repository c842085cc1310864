"""Problem 4 on the campaign records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.operators.drift import column_labels, fields_of, schema_changes, top_level_changes, unified_table
from cairnwork.session import materialise, table


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "campaign_record"), "feed", "file_no", "donor", "payload")


def p4_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the edit scripts, nested fields included."""
    return _changes(spark, sf_dir).select("feed", "file_no", "change", "path", F.size(F.coalesce("old_path", "new_path")).alias("depth"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of top-level fields."""
    return top_level_changes(_changes(spark, sf_dir)).select("feed", F.col("file_no").cast("int").alias("file_no"), "field", "change")


def p4_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projections into which the scripts are compiled: each field of a file that stands in the column of
    another name (null: in `extra`)."""
    changes = materialise(_changes(spark, sf_dir))
    rows = table(spark, sf_dir, "campaign_record").where("feed is not null and file_no is not null").select("feed", "file_no", "payload")
    present = fields_of(rows, "payload").select("feed", "file_no", "field").distinct()
    return column_labels(present, changes, "feed", "file_no").select("feed", F.col("file_no").cast("int").alias("file_no"), "field", F.col("label").alias("column_name"))


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readable records with one set of columns."""
    records = table(spark, sf_dir, "campaign_record")
    whole = unified_table(records, materialise(_changes(spark, sf_dir)), "feed", "file_no", "payload", ["record_no", "feed", "file_no"])
    return whole.withColumn("extra", F.to_json("extra"))
