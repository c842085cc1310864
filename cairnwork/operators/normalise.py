"""Normal forms of facts, duplicates and conflicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_predicate(c: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits as one underscore, none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(F.trim(c), "[^A-Za-z0-9]+", "_"), F.lit("_")))


def canonical_json(columns: Sequence[str]) -> Column:
    """The row as JSON with sorted keys; nulls are left out, map keys sorted."""
    return F.to_json(F.struct(*sorted(columns)))


def normalise_facts(facts: DataFrame) -> DataFrame:
    """Facts (id, kind, subject, predicate, object) with trimmed ends, canonical predicate and a new id that
    follows from the content."""
    text = lambda c: F.trim(F.col(c))
    fresh = facts.withColumns({"subject": text("subject"), "predicate": canonical_predicate(F.col("predicate")), "object": text("object")})
    return fresh.withColumn("fact_id", F.sha2(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("\x00")) for c in ("id", "kind", "subject", "predicate", "object"))), 256))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Rows equal in every column count once; rows that share only an id or a hash stay apart."""
    return df.dropDuplicates()


def conflicting_claims(df: DataFrame, id_: str, payload: Sequence[str], no_claim: Column | None = None) -> DataFrame:
    """Ids whose rows disagree in `payload`: (id, n_rows, n_claims). Rows for which `no_claim` holds disagree
    with nobody; nulls are values."""
    claim = F.struct(*payload)
    claim = claim if no_claim is None else F.when(~F.coalesce(no_claim, F.lit(False)), claim)
    per = df.where(F.col(id_).isNotNull()).groupBy(id_, claim.alias("_c")).agg(F.count("*").alias("_n"))
    return per.groupBy(id_).agg(F.sum("_n").alias("n_rows"), F.count("_c").alias("n_claims")).where("n_claims > 1")


def token_stem(c: Column, stop: Sequence[str] = ()) -> Column:
    """A key under which wordings meet: words without punctuation, stop words and a plural s, sorted."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*stop)) if stop else F.filter(words, lambda w: w != "")
    return F.array_join(F.array_sort(F.transform(kept, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w))), " ")


def synonym_key(c: Column, synonyms: Mapping[str, str]) -> Column:
    """Like token_stem, with each word replaced by its chief synonym first."""
    table = F.create_map(*(F.lit(x) for kv in sorted(synonyms.items()) for x in kv))
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    return F.array_join(F.array_sort(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))), " ")


def classify(c: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The class of the first pattern that is found; one expression in the JVM."""
    out: Column | None = None
    for pattern, name in rules:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def duplicate_clusters(df: DataFrame, id_: str, key: Column, flags: Sequence[str], name: str) -> DataFrame:
    """Rows that share a key, collapsed: (cluster, head, n_members, flags by or, least name). A row of a key of
    its own is a cluster of one. Rows whose key is null are left out."""
    keyed = df.withColumn("cluster", key).where("cluster is not null")
    return keyed.groupBy("cluster").agg(F.min(id_).alias("head"), F.count("*").alias("n_members"), *(F.max(F.coalesce(f, F.lit(0))).alias(f) for f in flags), F.min(name).alias(name))
