"""Declarative rules with three-valued verdicts: SATISFIED, VIOLATED, UNKNOWN."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions.quantity import comparable
from cairnwork.session import materialise

SATISFIED, VIOLATED, UNKNOWN = "SATISFIED", "VIOLATED", "UNKNOWN"


def all_of(verdict: Column) -> Column:
    """Aggregate: strong Kleene conjunction. A counterexample decides; else anything undecided leaves it
    undecided (a null verdict is undecided too); no verdicts at all are satisfied."""
    v = F.coalesce(verdict, F.lit(UNKNOWN))
    return F.when(F.coalesce(F.bool_or(v == VIOLATED), F.lit(False)), VIOLATED).when(F.coalesce(F.bool_or(v == UNKNOWN), F.lit(False)), UNKNOWN).otherwise(SATISFIED)


@dataclass(frozen=True)
class ForAll:
    """forall x: kind [where attribute == value] require attribute op value"""

    name: str
    kind: str
    require: str
    op: str
    value: str
    where: str | None = None
    where_value: str | None = None


@dataclass(frozen=True)
class Materialized:
    """require materialized target"""

    name: str
    target: str


@dataclass(frozen=True)
class Forbid:
    """forall f: function in scope forbid effect category | forbid call to target"""

    name: str
    scope: str
    what: str  # effect or call
    target: str


@dataclass(frozen=True)
class Within:
    """forall f: function in scope observed effect within a, b | none"""

    name: str
    scope: str
    allowed: tuple[str, ...]


@dataclass(frozen=True)
class Unparsed:
    """A rule that could not be read; it never passes."""

    name: str
    text: str


Rule = ForAll | Materialized | Forbid | Within | Unparsed

_WORD = r"([\w.:/-]+)"
_VALUE = r"(\"[^\"]*\"|[^\s].*?)"
_FORALL = re.compile(rf"^forall\s+\w+\s*:\s*{_WORD}(?:\s+where\s+{_WORD}\s*==\s*{_VALUE})?\s+require\s+{_WORD}\s*(==|!=|<=|>=|<|>)\s*{_VALUE}$")
_MATERIALIZED = re.compile(rf"^require\s+materialized\s+{_WORD}$")
_FORBID = re.compile(rf"^forall\s+\w+\s*:\s*function\s+in\s+{_WORD}\s+forbid\s+(?:(effect)\s+{_WORD}|(call)\s+to\s+{_WORD})$")
_WITHIN = re.compile(rf"^forall\s+\w+\s*:\s*function\s+in\s+{_WORD}\s+observed\s+effect\s+within\s+(none|[\w.:/-]+(?:\s*,\s*[\w.:/-]+)*)$")


_NUMERIC = re.compile(r"^\s*[-+]?\d")


def parse_rule(name: str, text: str) -> Rule:
    t = " ".join(text.split())
    bare = lambda v: v[1:-1] if v and v[0] == v[-1] == '"' and len(v) > 1 else v
    if m := _FORBID.match(t):
        return Forbid(name, m[1], m[2] or m[4], m[3] or m[5])
    if m := _WITHIN.match(t):
        return Within(name, m[1], () if m[2] == "none" else tuple(x.strip() for x in m[2].split(",")))
    if m := _FORALL.match(t):
        return ForAll(name, m[1], m[4], m[5], bare(m[6]), m[2], bare(m[3]) if m[3] else None)
    if m := _MATERIALIZED.match(t):
        return Materialized(name, m[1])
    return Unparsed(name, text)


def compare_attribute(declared: Column, op: str, value: str) -> Column:
    """The verdict of one comparison. Quantities (a number, or a number with a unit) compare by SI value when
    their dimensions agree, and violate when they do not; other texts know only == and !=."""
    text = {"==": declared == value, "!=": declared != value}.get(op)
    verdict = lambda ok: F.when(ok, SATISFIED).otherwise(VIOLATED)
    as_text = verdict(text) if text is not None else F.lit(UNKNOWN)
    if not _NUMERIC.match(value):  # no need to look for quantities
        return F.when(declared.isNull(), UNKNOWN).otherwise(as_text)
    left, right = comparable(declared), comparable(F.lit(value))
    si = left["value"]
    numeric = {"==": si == right["value"], "!=": si != right["value"], "<": si < right["value"], "<=": si <= right["value"], ">": si > right["value"], ">=": si >= right["value"]}[op]
    both = si.isNotNull() & right["value"].isNotNull()
    return F.when(declared.isNull(), UNKNOWN).when(both & (left["dimension"] == right["dimension"]), verdict(numeric)).when(both, F.lit(VIOLATED)).otherwise(as_text)


def evaluate(rules: Iterable[Rule], nodes: DataFrame, materialized: DataFrame | None = None, effects: DataFrame | None = None, calls: DataFrame | None = None, coverage: DataFrame | None = None, examples: int = 12) -> DataFrame:
    """(rule, verdict, n_facts, n_violations, n_unknown, counterexamples) of every rule.

    `nodes`: name, kind, attributes (map). `materialized`: target. `effects`: function, scope, category.
    `calls`: function, scope, callee (null when unresolved), spelled (the name at an unresolved site).
    `coverage`: function, scope, observed (whether all its sites were resolved). A forbidden effect or call
    found is a violation; none found is satisfied only where coverage is observed. `within` speaks of
    observed effects alone and is always decided. A missing attribute is unknown, never a pass; a rule
    that cannot be read is unknown. The examples are the least names, at most `examples`.
    """
    spark = nodes.sparkSession
    parts: list[DataFrame] = []
    row = lambda rule, df: df.select(F.lit(rule.name).alias("rule"), "fact", "verdict")
    const = lambda rule, verdict, fact=None: spark.createDataFrame([(rule.name, fact, verdict)], "rule string, fact string, verdict string")
    for r in rules:
        if isinstance(r, ForAll):
            mine = nodes.where(F.col("kind") == r.kind)
            if r.where is not None:
                mine = mine.where(F.try_element_at("attributes", F.lit(r.where)) == r.where_value)
            parts.append(row(r, mine.select(F.col("name").alias("fact"), compare_attribute(F.try_element_at("attributes", F.lit(r.require)), r.op, r.value).alias("verdict"))))
            parts.append(const(r, SATISFIED))
        elif isinstance(r, Materialized):
            there = materialized is not None and not materialized.where(F.col("target") == r.target).isEmpty()
            parts.append(const(r, SATISFIED if there else VIOLATED, r.target))
        elif isinstance(r, Forbid):
            if r.what == "effect":
                hits = effects.where((F.col("scope") == r.scope) & (F.col("category") == r.target)).select(F.col("function").alias("fact"), F.lit(VIOLATED).alias("verdict"))
                hits = hits.distinct()
            else:
                inside = calls.where(F.col("scope") == r.scope)
                hits = inside.where(F.col("callee") == r.target).select(F.col("function").alias("fact"), F.lit(VIOLATED).alias("verdict")).distinct()
                may = inside.where(F.col("callee").isNull() & (F.col("spelled") == F.substring_index(F.lit(r.target), "::", -1))).select(F.col("function").alias("fact"), F.lit(UNKNOWN).alias("verdict")).distinct()
                hits = hits.unionByName(may)
            parts.append(row(r, hits))
            if coverage is not None:
                dim = coverage.where((F.col("scope") == r.scope) & ~F.coalesce("observed", F.lit(False))).select(F.col("function").alias("fact"), F.lit(UNKNOWN).alias("verdict"))
                parts.append(row(r, dim))
            parts.append(const(r, SATISFIED))
        elif isinstance(r, Within):
            bad = effects.where(F.col("scope") == r.scope)
            bad = bad.where(~F.col("category").isin(*r.allowed)) if r.allowed else bad
            parts.append(row(r, bad.select(F.col("function").alias("fact"), F.lit(VIOLATED).alias("verdict")).distinct()))
            parts.append(const(r, SATISFIED))
        else:
            parts.append(const(r, UNKNOWN))
    facts = parts[0]
    for p in parts[1:]:
        facts = facts.unionByName(p)
    facts = materialise(facts)
    rank = F.row_number().over(W.partitionBy("rule").orderBy("fact"))  # filtered at once: no rule's violations are sorted whole
    few = facts.where((F.col("verdict") == VIOLATED) & F.col("fact").isNotNull()).select("rule", "fact").withColumn("_rn", rank).where(F.col("_rn") <= examples)
    listed = few.groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "fact"))), lambda x: x["fact"]), ",").alias("counterexamples"))
    counted = facts.groupBy("rule").agg(all_of(F.col("verdict")).alias("verdict"), F.count("fact").alias("n_facts"), F.count_if(F.col("verdict") == VIOLATED).alias("n_violations"), F.count_if(F.col("verdict") == UNKNOWN).alias("n_unknown"))
    return counted.join(listed, "rule", "left").withColumn("counterexamples", F.coalesce("counterexamples", F.lit("")))


def interval_requirement(low: Column, high: Column, op: str, limit: Column | float) -> Column:
    """Verdict of an interval against a limit: satisfied only when all of it is, violated only when none is."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    yes, no = {"<=": (high <= limit, low > limit), "<": (high < limit, low >= limit), ">=": (low >= limit, high < limit), ">": (low > limit, high <= limit)}[op]
    return F.when(low.isNull() | high.isNull() | limit.isNull(), UNKNOWN).when(yes, SATISFIED).when(no, VIOLATED).otherwise(UNKNOWN)


def hypothesis_outcome(found: DataFrame, covered: DataFrame, refutes: bool) -> str:
    """VALIDATED, FALSIFIED or STILL_HYPOTHESIZED of an existence claim: `found` holds evidence (which refutes
    when the claim is a denial); without evidence only full coverage (`observed` of every row) decides."""
    if not found.isEmpty():
        return "FALSIFIED" if refutes else "VALIDATED"
    if covered.where(~F.coalesce("observed", F.lit(False))).isEmpty() and not covered.isEmpty():
        return "VALIDATED" if refutes else "FALSIFIED"
    return "STILL_HYPOTHESIZED"
