"""Problems 6 to 8 on the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.functions.text import normal_form
from cairnwork.llm.bpe import encode_texts
from cairnwork.llm.langid import fit, fitting_lines, label_languages
from cairnwork.llm.mixing import mix_sources
from cairnwork.session import broadcast_if_small, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").withColumn("_doc", F.struct("doc_id", normal_form(F.col("source")).alias("source")))
    targets = table(spark, sf_dir, "mix_target").withColumn("source", normal_form(F.col("source")))
    named = docs.where("_doc.source is not null").join(broadcast_if_small(targets.select(F.col("source").alias("_source"))), F.col("_doc.source") == F.col("_source"), "left_semi")
    sized = encode_texts(named, "_doc", "text", counts=True)
    return mix_sources(sized.select("_doc.doc_id", "_doc.source", "n_tokens"), targets)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, with how often each is in it."""
    return _mix(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source was to have and has."""
    return _mix(spark, sf_dir)[1]


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and every line of documents in several languages, with language and confidence."""
    docs = table(spark, sf_dir, "documents")
    return label_languages(docs, "doc_id", "text", "lang", fit(fitting_lines(docs, "text", "lang")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label names no language or another, and the lines of those in several languages."""
    found = p8_languages(spark, sf_dir).where("lang is not null and (line_no > 0 or stated is null or stated <> lang)")
    return found.select("doc_id", "line_no", "lang")


QUERIES |= {"p6_ids": p6_ids, "p7_mix": p7_mix, "p7_report": p7_report, "p8_found": p8_found, "p8_languages": p8_languages}
