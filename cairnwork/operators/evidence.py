"""Evidence: how far it reaches, what claims exceed it, and what it belongs to."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions import ranks as R
from cairnwork.operators.joins import path_prefixes, tokens
from cairnwork.session import materialise


def ladder(rungs: Sequence[tuple[str, Column]], lowest: str) -> tuple[Column, Column]:
    """(level, missing): the highest rung below which all hold, and the first that does not (null at the top)."""
    level, missing = F.lit(rungs[-1][0]), F.lit(None).cast("string")
    for i in range(len(rungs) - 1, -1, -1):
        name, holds = rungs[i]
        below = rungs[i - 1][0] if i else lowest
        level = F.when(F.coalesce(holds, F.lit(False)), level).otherwise(F.lit(below))
        missing = F.when(F.coalesce(holds, F.lit(False)), missing).otherwise(F.lit(name))
    return level, missing


def support_levels(artifacts: DataFrame, records: DataFrame, obligations: DataFrame, functions: DataFrame, derived: DataFrame) -> DataFrame:
    """(subject, kind, level, missing, counts) of each language or file class.

    artifacts: path, language, class, parsed; records: path; obligations: path, dimension, status; functions:
    id, path; derived: id (functions with a derived relation). Each table is folded to subjects by path
    before the subjects meet. The best status of a dimension counts, in the order of coverage.
    """
    subject = artifacts.select("path", F.coalesce("language", "class").alias("subject"), F.when(F.col("language").isNotNull(), "language").otherwise("class").alias("kind"), "parsed")
    subject = materialise(subject)
    of = subject.select("path", "subject", "kind")
    files = subject.groupBy("subject", "kind").agg(F.count("*").alias("n_artifacts"), F.count_if(F.coalesce("parsed", F.lit(False)) & (F.col("kind") == "language")).alias("n_parsed"))
    rec = records.groupBy("path").agg(F.count("*").alias("k")).join(of, "path").groupBy("subject", "kind").agg(F.sum("k").alias("n_records"))
    best = obligations.join(of, "path").groupBy("subject", "kind", "dimension").agg(R.strongest(R.COVERAGE, F.col("status")).alias("s")).groupBy("subject", "kind").agg(F.count_if(F.col("s").isin("OBSERVED", "DERIVED")).alias("n_evaluated"))
    fun = functions.join(derived.select("id").distinct().withColumn("_d", F.lit(True)), "id", "left").join(of, "path").groupBy("subject", "kind").agg(F.count("*").alias("n_functions"), F.count_if("_d").alias("n_derived"))
    all_ = reduce(lambda a, b: a.join(b, ["subject", "kind"], "left"), (rec, best, fun), files).na.fill(0)
    # The names of the levels.
    level, missing = ladder((("L1_IDENTIFIED", F.col("kind") == "language"), ("L2_SYNTAX", F.col("n_parsed") > 0), ("L3_TYPED_RECORDS", F.col("n_records") > 0), ("L4_OBLIGATIONS_EVALUATED", F.col("n_evaluated") > 0), ("L5_COMPOSED", F.col("n_functions") > 0), ("L6_AGENT_USABLE", F.col("n_derived") > 0)), "L0_DISCOVERED")
    return all_.withColumns({"level": level, "missing": missing})


def excessive_claims(claims: DataFrame, measured: DataFrame, subject: str, level: str) -> DataFrame:
    """Claims (subject, level) above the measured level, or of subjects never measured. Levels compare as text."""
    m = measured.select(subject, F.col(level).alias("measured"))
    return claims.join(m, subject, "left").where(F.col("measured").isNull() | (F.col(level) > F.col("measured"))).select(subject, F.col(level).alias("claimed"), "measured")


def obligation_states(obligations: DataFrame, evidence: DataFrame, id_: str, passed: str) -> DataFrame:
    """(id, state) of obligations: DISCHARGED when some evidence passed and none failed, REFUTED when some failed,
    OPEN without evidence that decides."""
    e = evidence.groupBy(id_).agg(F.bool_or(passed).alias("_any"), F.bool_and(passed).alias("_all"))
    state = F.when(F.col("_any").isNull(), "OPEN").when(F.col("_all"), "DISCHARGED").otherwise("REFUTED")
    return obligations.select(id_).distinct().join(e, id_, "left").select(id_, state.alias("state"))


def schema_violations(df: DataFrame, id_: str, payload: str, fields: dict[str, str], required: Sequence[str] = ()) -> DataFrame:
    """(id, field, violation) of JSON objects against a closed schema of field types (string, number, boolean, object,
    array): not_an_object, missing, unknown_field, wrong_type. Null values count as missing."""
    whole = F.when(F.col(payload).rlike(r"(?s)^\s*\{.*\}\s*$"), F.try_parse_json(F.col(payload)))
    parsed = df.select(id_, F.try_variant_get(whole, "$", "map<string,variant>").alias("_m"))
    bad = parsed.where("_m is null").select(id_, F.lit(None).cast("string").alias("field"), F.lit("not_an_object").alias("violation"))
    ok = parsed.where("_m is not null")
    wants = F.create_map(*(F.lit(x) for kv in sorted(fields.items()) for x in kv)) if fields else F.create_map(F.lit(""), F.lit(""))
    got = ok.select(id_, F.explode("_m").alias("field", "_v")).where("not is_variant_null(_v)").select(id_, "field", F.regexp_extract(F.schema_of_variant("_v"), "^([A-Z]+)", 1).alias("_t"))
    kind = F.when(F.col("_t") == "STRING", "string").when(F.col("_t") == "BOOLEAN", "boolean").when(F.col("_t") == "OBJECT", "object").when(F.col("_t") == "ARRAY", "array").otherwise("number")
    want = F.try_element_at(wants, F.col("field"))
    off = got.select(id_, "field", F.when(want.isNull(), "unknown_field").when(want != kind, "wrong_type").alias("violation")).where("violation is not null")
    need = ok.select(id_, "_m", F.explode(F.array(*(F.lit(x) for x in required))).alias("field")) if required else ok.select(id_, "_m", F.lit("").alias("field")).limit(0)
    missing = need.where(F.try_element_at("_m", F.col("field")).isNull() | F.is_variant_null(F.try_element_at("_m", F.col("field")))).select(id_, "field", F.lit("missing").alias("violation"))
    return bad.unionByName(off).unionByName(missing)


def best_candidates(wanted: DataFrame, key: str, main: Column, side: Column, offers: DataFrame, offer: str, hint: Column | None = None) -> DataFrame:
    """(key, offer, score, confidence): for each wanted key the offer with most words in common, words of `main`
    counting two, other words of `side` one; then offers that the hint favours, then the least offer.
    HIGH: two words of `main` or more; MEDIUM: one; LOW: of `side` only. Offers are words by themselves
    (joined by anything), met by equi join on words; distinct keys and offers only."""
    w = wanted.select(key, tokens(main, least=3).alias("_m"), tokens(side, least=3).alias("_s")).dropDuplicates([key])
    words = w.select(key, F.explode(F.concat(F.transform("_m", lambda x: F.struct(x.alias("w"), F.lit(2).alias("p"))), F.transform(F.array_except("_s", "_m"), lambda x: F.struct(x.alias("w"), F.lit(1).alias("p"))))).alias("_x")).select(key, "_x.w", "_x.p")
    have = offers.select(offer, *([hint.alias("_h")] if hint is not None else [F.lit(0).alias("_h")])).where(F.col(offer).isNotNull()).groupBy(offer).agg(F.max("_h").alias("_h")).withColumn("w", F.explode(tokens(F.regexp_replace(offer, "_", " "), least=3)))
    scored = words.join(have, "w").groupBy(key, offer).agg(F.sum("p").cast("long").alias("score"), F.count_if(F.col("p") == 2).alias("_n"), F.max("_h").alias("_h"))
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("_h")).alias("h"), offer, "_n")).alias("b"))
    return best.select(key, F.col(f"b.{offer}").alias(offer), (-F.col("b.s")).alias("score"), F.when(F.col("b._n") >= 2, "HIGH").when(F.col("b._n") == 1, "MEDIUM").otherwise("LOW").alias("confidence"))


def affected_units(changed: DataFrame, path: str, units: DataFrame, root: str, unit: str) -> DataFrame:
    """(unit, n_files) of units whose root holds a changed file."""
    keys = changed.select(path).distinct().withColumn("_r", F.explode(path_prefixes(F.col(path))))
    return keys.join(units.select(F.rtrim(F.col(root), F.lit("/")).alias("_r"), unit).distinct(), "_r").groupBy(unit).agg(F.countDistinct(path).alias("n_files"))


def waves(nodes: DataFrame, rests_on: DataFrame) -> DataFrame:
    """(node, wave): when each node can be done, everything it rests on (src rests on dst) being done in an earlier
    wave; null for nodes on or behind a cycle. A peel: each round takes out what waits for nothing."""
    left = materialise(nodes.select("node").distinct())
    edges = materialise(rests_on.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").distinct())
    done = []
    for wave in count(1):
        ready = materialise(left.join(edges.select(F.col("src").alias("node")), "node", "left_anti").withColumn("wave", F.lit(wave)))
        if ready.isEmpty():
            break
        done.append(ready)
        left = materialise(left.join(ready, "node", "left_anti"))
        edges = materialise(edges.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done, left.withColumn("wave", F.lit(None).cast("int")))


def minimum_counts(df: DataFrame, key: str, minimums: DataFrame) -> DataFrame:
    """(key, n, least) of the classes that have fewer rows than they must (`minimums`: key, least)."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return minimums.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < least").select(key, "n", "least")


def burn_down(df: DataFrame, by: str, done: Column) -> DataFrame:
    """(by, n_total, n_done, percent, state) of work by group."""
    g = df.groupBy(by).agg(F.count("*").alias("n_total"), F.count_if(done).alias("n_done"))
    state = F.when(F.col("n_done") == F.col("n_total"), "DONE").when(F.col("n_done") == 0, "NOT_STARTED").otherwise("IN_PROGRESS")
    return g.withColumns({"percent": F.round(F.col("n_done") * 100.0 / F.col("n_total"), 1), "state": state})


def freshness(df: DataFrame, at: str, now: Column, fresh_days: int, stale_days: int) -> DataFrame:
    """`df` with `freshness`: FRESH, AGING or STALE by age, INVALID without a time or with one in the future."""
    age = F.datediff(now, F.col(at))
    return df.withColumn("freshness", F.when(age.isNull() | (age < 0), "INVALID").when(age <= fresh_days, "FRESH").when(age <= stale_days, "AGING").otherwise("STALE"))


def understanding_gaps(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(gap, n) of what cannot be answered; each part is folded to one number."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("gap"), F.count("*").alias("n")) for name, df in parts))


def agreement(df: DataFrame, id_: str, matches: DataFrame, stated: str, found: str) -> DataFrame:
    """(id, verdict): what is stated against what was found (id, found): AGREE with the only finding, DISAGREE with it,
    AMBIGUOUS with several, UNSUPPORTED without any. Several findings never decide."""
    m = matches.groupBy(id_).agg(F.countDistinct(found).alias("_n"), F.min(found).alias("_f"))
    verdict = F.when(F.col("_n").isNull() | (F.col("_n") == 0), "UNSUPPORTED").when(F.col("_n") > 1, "AMBIGUOUS").when(F.col("_f").eqNullSafe(F.col(stated)), "AGREE").otherwise("DISAGREE")
    return df.join(m, id_, "left").select(id_, verdict.alias("verdict"))


def gate(reports: Sequence[tuple[str, DataFrame]], id_: str) -> DataFrame:
    """(id, blockers, passes): candidates against several reports (id, ok); a report that says no, or nothing, blocks.
    One aggregation over all reports."""
    rows = reduce(DataFrame.unionByName, (df.select(id_, F.lit(name).alias("_r"), F.coalesce("ok", F.lit(False)).alias("ok")) for name, df in reports))
    yes = rows.groupBy(id_, "_r").agg(F.bool_and("ok").alias("ok")).groupBy(id_).agg(F.collect_set(F.when(F.col("ok"), F.col("_r"))).alias("_y"))
    missing = F.array_sort(F.array_except(F.array(*(F.lit(n) for n, _ in reports)), F.col("_y")))
    return yes.select(id_, F.array_join(missing, ",").alias("blockers"), (F.size(missing) == 0).alias("passes"))


def scorecard(checks: DataFrame, area: str, passed: str) -> DataFrame:
    """(area, n_passed, n_total, percent) with one decimal."""
    return checks.groupBy(area).agg(F.count_if(passed).alias("n_passed"), F.count("*").alias("n_total"), F.round(F.count_if(passed) * 100.0 / F.count("*"), 1).alias("percent"))
