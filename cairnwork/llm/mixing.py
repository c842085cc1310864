"""Mixing sources to target weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.session import broadcast_if_small, materialise

#: Bits of the hash that one histogram resolves, and all its bits.
LEVEL_BITS, HASH_BITS = 10, 60


@dataclass
class SourcePlan:
    source: str
    share: float
    max_repeats: int
    tokens: int
    docs: int
    want: float = 0.0
    full: int = 0  # copies of every document
    threshold: int = 0  # documents whose hash is below have one copy more


def plan_sizes(sources: list[SourcePlan], total: float | None = None) -> float:
    """Fill in how many tokens are wanted of each source; the size of the mix.

    The mix is as large as the caps allow at exact shares, or `total`, where sources that are too small
    give all that their cap allows. Shares are relative to those of sources that have tokens.
    """
    able = [s for s in sources if s.tokens > 0 and s.share > 0 and s.max_repeats > 0]
    weight = sum(s.share for s in able)
    most = min((s.max_repeats * s.tokens * weight / s.share for s in able), default=0.0)
    size = most if total is None else float(total)
    for s in able:
        s.want = min(size * s.share / weight, float(s.max_repeats * s.tokens))
        s.full = min(int(s.want * (1 + 1e-12) // s.tokens), s.max_repeats)
    return size


def thresholds(sized: DataFrame, plans: list[SourcePlan]) -> None:
    """Find each source's threshold: the tokens of its documents with a smaller hash come closest to what is
    wanted beyond full copies.

    Histograms of tokens by source and hash bucket, the first over all documents, each later one only over
    the bucket in which a source's budget ends, so that after n levels 1 / 2 ** (10 n) of the documents are
    read. What comes to the driver is at most 1024 numbers a source and level.
    """
    rest = {s.source: s.want - s.full * s.tokens for s in plans if s.full < s.max_repeats and s.want - s.full * s.tokens > 0.5}
    by_name = {s.source: s for s in plans}
    prefix = dict.fromkeys(rest, 0)
    shift = HASH_BITS
    while rest and shift > 0:
        shift -= LEVEL_BITS
        place = sized.sparkSession.createDataFrame([(k, v) for k, v in prefix.items()], "source string, _prefix bigint")
        inside = sized.join(F.broadcast(place), "source").where(F.shiftright("h", shift + LEVEL_BITS) == F.col("_prefix"))
        rows = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
        histogram: dict[str, list] = {}
        for r in rows:
            histogram.setdefault(r["source"], []).append((r["b"], r["t"], r["n"]))
        going = {}
        for source, need in rest.items():
            plan, done = by_name[source], True
            plan.threshold = prefix[source] << (shift + LEVEL_BITS)
            for b, t, n in sorted(histogram.get(source, ())):
                if t <= need:
                    need -= t
                    plan.threshold = (b + 1) << shift
                    continue
                if n > 1 and shift > 0:
                    prefix[source], going[source], done = b, need, False
                elif t - need < need:
                    plan.threshold = (b + 1) << shift
                break
            if done:
                prefix.pop(source, None)
        rest = going


def mix_sources(sized: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, report). `sized`: `doc_id`, `source`, `n_tokens`; `targets`: `source` (unique), `target_share`,
    `max_repeats`.

    The mix holds the documents with `repeats`, how often each is in it: `repeats` is the same for all
    documents of a source but for one more below the source's hash threshold, and never above its cap. The
    report holds, for each target, the share wanted and reached (0 for a source without tokens; null
    shares of an empty mix), what it was made of, and whether the source `binds`: all that its cap allows is in the
    mix, so that it holds the size of the mix down. Documents of sources without a target, or without a
    source, stay out; so do documents with 0 repeats. Null token counts are 0. No sort, no window.
    """
    wanted = materialise(targets.where("source is not null"))
    small = broadcast_if_small(wanted.select("source"))
    hashed = sized.join(small, "source", "left_semi").select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - HASH_BITS).alias("h"))
    hashed = materialise(hashed)
    sums = {r["source"]: r for r in hashed.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    plans = [SourcePlan(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0), int(sums[r["source"]]["t"]) if r["source"] in sums else 0, int(sums[r["source"]]["n"]) if r["source"] in sums else 0) for r in wanted.select("source", "target_share", "max_repeats").collect()]
    plan_sizes(plans, total)
    thresholds(hashed, plans)
    spark = sized.sparkSession
    rules = spark.createDataFrame([(p.source, p.share, p.max_repeats, p.full, p.threshold, p.tokens, p.docs, 0 < p.max_repeats * p.tokens <= p.want * (1 + 1e-9)) for p in plans], "source string, target_share double, max_repeats int, _full int, _threshold bigint, tokens_available bigint, docs_available bigint, binds boolean")
    copies = F.col("_full") + (F.col("h") < F.col("_threshold")).cast("int")
    mix = hashed.join(F.broadcast(rules), "source").select("doc_id", "source", "n_tokens", copies.alias("repeats")).where("repeats > 0")
    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_in_mix"), F.count("*").alias("docs_in_mix"), F.max("repeats").alias("most_repeats"))
    report = rules.join(used, "source", "left")
    total_tokens = report.agg(F.sum("tokens_in_mix").alias("_total"))
    report = report.crossJoin(F.broadcast(total_tokens))  # one row
    in_mix = F.coalesce("tokens_in_mix", F.lit(0))
    report = report.select("source", "target_share", F.try_divide(in_mix, F.col("_total")).alias("actual_share"), "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "docs_available", F.coalesce("docs_in_mix", F.lit(0)).alias("docs_in_mix"), "tokens_available", in_mix.alias("tokens_in_mix"), "binds")
    return mix, report
