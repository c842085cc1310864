"""SQL over a data folder: every table a temporary view, and only statements that read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cairnwork.plans.registry import query
from cairnwork.sources.catalogue import first_present

#: Fixed value: what a statement must begin with.
_READS = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)
_WRITES = re.compile(r"\b(insert\s+(into|overwrite)|create|drop|alter|truncate|merge\s+into|delete\s+from|update\s+\w+\s+set|cache|refresh|add\s+jar|set\s+spark|load\s+data)\b", re.IGNORECASE)


class RefusedStatement(ValueError):
    """The statement does more than read."""


def register_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def read_only_sql(spark: SparkSession, statement: str) -> DataFrame:
    """Run a SELECT (WITH included). Several statements, or words that write outside of quotes, are refused."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", " ", statement, flags=re.S)
    if not _READS.match(bare) or ";" in bare.rstrip().rstrip(";") or _WRITES.search(bare):
        raise RefusedStatement("only a single SELECT is run")
    return spark.sql(statement.rstrip().rstrip(";"))


_TOP = "select c_mktsegment as segment, o_orderpriority as priority, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey where o_orderdate >= timestamp '1997-01-01' group by c_mktsegment, o_orderpriority having count(*) > 1"


@query(_TOP)
def sql_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ["orders", "customer"])
    return read_only_sql(spark, _TOP)


def attach(spark: SparkSession, sf_dir: str, store: str, names: list[str]) -> None:
    """Tables of one more store for the same statement, as views `store__table`."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"{store}__{name}")


_ACROSS = "select n.n_name as nation, count(*) as n_customers, count(distinct s.s_suppkey) as n_suppliers from {0}nation n join {1}customer c on c.c_nationkey = n.n_nationkey left join {0}supplier s on s.s_nationkey = n.n_nationkey group by n.n_name"


@query(_ACROSS.format("", ""))
def federated_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement over two stores."""
    attach(spark, sf_dir, "places", ["nation", "supplier"])
    attach(spark, sf_dir, "people", ["customer"])
    return read_only_sql(spark, _ACROSS.format("places__", "people__"))


@query("select r_regionkey, r_name from region")
def fallback_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over the first folder that has the table."""
    found = first_present(spark, "region", [f"{sf_dir}/nowhere", sf_dir], ["r_regionkey", "r_name"])
    found.createOrReplaceTempView("fallback_region")
    return read_only_sql(spark, "select r_regionkey, r_name from fallback_region")
