"""Joins that have no single Spark operator, each as equi joins on derived keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.session import broadcast_if_small, materialise


def path_prefixes(path: Column) -> Column:
    """The path and all directories above it: a/b/c gives a, a/b and a/b/c. Trailing slashes do not count."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def longest_prefix_owner(paths: DataFrame, path: str, roots: DataFrame, root: str, owner: str) -> DataFrame:
    """`paths` with `owner` of the longest root that is the path or a directory above it (null: none).

    The prefixes of a path are its join keys, so it is an equi join however many roots there are; of roots
    given twice the least owner counts. Distinct paths are looked up once.
    """
    one_root = roots.where(F.col(root).isNotNull()).groupBy(F.rtrim(F.col(root), F.lit("/")).alias("_prefix")).agg(F.min(owner).alias(owner))
    keys = paths.select(path).where(F.col(path).isNotNull()).distinct().withColumn("_prefix", F.explode(path_prefixes(F.col(path))))
    best = keys.join(one_root, "_prefix").groupBy(path).agg(F.max_by(owner, F.length("_prefix")).alias(owner))
    return paths.join(best, path, "left")


def unowned_paths(packages: DataFrame, path: str, owners: DataFrame, root: str) -> DataFrame:
    """Packages that no owner's root covers and that cover no owner's root: a prefix anti join both ways."""
    own = owners.where(F.col(root).isNotNull()).select(F.rtrim(F.col(root), F.lit("/")).alias("_r")).distinct()
    up = packages.select(path).distinct().withColumn("_r", F.explode(path_prefixes(F.col(path)))).join(own, "_r", "left_semi").select(path)
    above = own.select(F.explode(path_prefixes(F.col("_r"))).alias(path)).distinct()
    return packages.join(up.distinct(), path, "left_anti").join(above, path, "left_anti")


def unique_name_join(left: DataFrame, right: DataFrame, name: str, id_: str) -> DataFrame:
    """`left` with the `id_` of the row of `right` that alone has its name; null where none or several do.
    Ambiguous names are refused, never guessed."""
    single = right.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n"), F.min(id_).alias(id_)).where("_n = 1").select(name, id_)
    return left.join(single, name, "left")


def resolve_references(refs: DataFrame, ref: str, files: DataFrame, path: str) -> DataFrame:
    """`refs` with `resolved` and `how`: the path itself when it exists, else the only path of that file
    name, else null."""
    known = files.select(F.col(path).alias("_p")).where("_p is not null").distinct()
    base = lambda c: F.substring_index(c, "/", -1)
    single = known.groupBy(base(F.col("_p")).alias("_b")).agg(F.count("*").alias("_n"), F.min("_p").alias("_only")).where("_n = 1").select("_b", "_only")
    joined = refs.join(known, F.col(ref) == F.col("_p"), "left").withColumn("_b", base(F.col(ref))).join(single, "_b", "left")
    return joined.withColumn("resolved", F.coalesce("_p", "_only")).withColumn("how", F.when(F.col("_p").isNotNull(), "exact").when(F.col("_only").isNotNull(), "unique name")).drop("_p", "_b", "_only")


def producer_consumer(access: DataFrame, key: str, actor: str, role: str, writes: str = "write") -> DataFrame:
    """For each key: writers, readers, and flows (pairs of a writer with another actor that reads). Flows
    are counted from the sizes of the sides, without making the pairs."""
    sides = access.groupBy(key, actor).agg(F.bool_or(F.col(role) == writes).alias("w"), F.bool_or(F.col(role) != writes).alias("r"))
    return sides.groupBy(key).agg(F.count_if("w").alias("n_writers"), F.count_if("r").alias("n_readers"), (F.count_if("w") * F.count_if("r") - F.count_if(F.col("w") & F.col("r"))).alias("n_flows"))


#: The verdicts of a three-way reconciliation.
CONFIRMED, NO_CALL, NOT_CENSUSABLE, NOT_BUILT = "CONFIRMED", "DECLARED_AND_BUILT_NO_RESOLVED_CALL", "DECLARED_NOT_CENSUSABLE", "DECLARED_NOT_BUILT"
UNDECLARED, VIA_REEXPORT, WITHOUT_DEPENDENCY = "UNDECLARED", "TRANSITIVE_VIA_REEXPORT", "CALL_WITHOUT_DEPENDENCY"


def reconcile_three_way(declared: DataFrame, built: DataFrame, called: DataFrame, members: DataFrame, reach: DataFrame) -> DataFrame:
    """(src, dst, declared, built, calls, verdict) of every pair in any of three edge sets.

    `called` has `calls`; `members` (node) are those that can be built; `reach` (src, dst) is the transitive
    closure of `built`. One aggregation by pair takes the place of full outer joins.
    """
    mark = lambda df, d, b, c: df.select("src", "dst", F.lit(d).alias("declared"), F.lit(b).alias("built"), c.cast("long").alias("calls"))
    rows = mark(declared, True, False, F.lit(0)).unionByName(mark(built, False, True, F.lit(0))).unionByName(mark(called, False, False, F.col("calls")))
    pairs = rows.groupBy("src", "dst").agg(F.bool_or("declared").alias("declared"), F.bool_or("built").alias("built"), F.sum("calls").alias("calls"))
    known = members.select(F.col("node")).distinct()
    pairs = pairs.join(known.select(F.col("node").alias("src"), F.lit(True).alias("_s")), "src", "left").join(known.select(F.col("node").alias("dst"), F.lit(True).alias("_d")), "dst", "left").join(reach.select("src", "dst", F.lit(True).alias("_t")).distinct(), ["src", "dst"], "left")
    both = F.coalesce(F.col("_s") & F.col("_d"), F.lit(False))
    d, b, c = F.col("declared"), F.col("built"), F.col("calls") > 0
    verdict = F.when(d & b & c, CONFIRMED).when(d & b, NO_CALL).when(d & ~both, NOT_CENSUSABLE).when(d, NOT_BUILT).when(b, UNDECLARED).when(F.col("_t"), VIA_REEXPORT).otherwise(WITHOUT_DEPENDENCY)
    return pairs.select("src", "dst", "declared", "built", "calls", verdict.alias("verdict"))


def declared_against_observed(declared: DataFrame, observed: DataFrame, membership: DataFrame) -> DataFrame:
    """(src, dst, verdict) of entities' declared dependencies against those observed between their members.

    `membership` (entity, member) is many to many. `agreed`: declared and observed between some members;
    `declared_not_observed`; `not_censusable`: an end has no member; `observed_not_declared`: some pair
    of members of two entities, which are not declared.
    """
    m = membership.select("entity", "member").distinct()
    seen = observed.join(m.select(F.col("member").alias("src"), F.col("entity").alias("_a")), "src").join(m.select(F.col("member").alias("dst"), F.col("entity").alias("_b")), "dst").where("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct()
    said = declared.select("src", "dst").distinct()
    has = m.select(F.col("entity").alias("e")).distinct()
    full = said.withColumn("_d", F.lit(True)).join(seen.withColumn("_o", F.lit(True)), ["src", "dst"], "full_outer")
    full = full.join(has.select(F.col("e").alias("src"), F.lit(True).alias("_ms")), "src", "left").join(has.select(F.col("e").alias("dst"), F.lit(True).alias("_md")), "dst", "left")
    verdict = F.when(F.col("_d") & F.col("_o"), "agreed").when(F.col("_d") & (F.col("_ms").isNull() | F.col("_md").isNull()), "not_censusable").when(F.col("_d"), "declared_not_observed").otherwise("observed_not_declared")
    return full.select("src", "dst", verdict.alias("verdict"))


def tokens(text: Column, stop: Sequence[str] = (), least: int = 1) -> Column:
    """The distinct lower-case words of a text, of `least` letters and more, without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop) if stop else F.length(w) >= least)


#: Names on the right side in which a word may be before it is a hot one.
HOT_NAMES = 10_000


def best_token_overlap(left: DataFrame, left_name: str, right: DataFrame, right_name: str, stop: Sequence[str] = (), least: int = 1, least_shared: int = 1, hot_names: int = HOT_NAMES) -> DataFrame:
    """(left name, right name, shared): for each distinct left name the right name with most words in common,
    the least of equals. Only distinct names meet, by equi join on words; names that share no word do not.

    A word that more than `hot_names` right names have is no join key: names that share other words too are
    found by those, and their hot words counted where they meet. For names that share hot words alone, a right name is
    as good as any other with the same hot words, so only the distinct sets of hot words meet, each with
    its least name. Nothing is lost, and no hot word makes a row for each pair of its names.
    """
    a = left.select(F.col(left_name).alias("a")).where("a is not null").distinct().withColumn("wa", tokens(F.col("a"), stop, least))
    b = right.select(F.col(right_name).alias("b")).where("b is not null").distinct().withColumn("wb", tokens(F.col("b"), stop, least))
    hot = materialise(b.select(F.explode("wb").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") > hot_names).select("w"))
    if hot.isEmpty():
        shared = a.select("a", F.explode("wa").alias("w")).join(b.select("b", F.explode("wb").alias("w")), "w").groupBy("a", "b").agg(F.count("*").alias("shared"))
    else:
        mark = broadcast_if_small(hot.withColumn("_hot", F.lit(True)))

        def parted(df: DataFrame, name: str, words: str) -> DataFrame:
            each = df.select(name, F.explode(words).alias("w")).join(mark, "w", "left")
            return materialise(each.groupBy(name).agg(F.array_sort(F.collect_list(F.when(F.col("_hot"), F.col("w")))).alias("hot"), F.collect_list(F.when(F.col("_hot").isNull(), F.col("w"))).alias("rare")))

        x, y = parted(a, "a", "wa"), parted(b, "b", "wb")
        met = x.select("a", F.col("hot").alias("ha"), F.explode("rare").alias("w")).join(y.select("b", F.col("hot").alias("hb"), F.explode("rare").alias("w")), "w").groupBy("a", "b").agg(F.count("*").alias("n"), F.first("ha").alias("ha"), F.first("hb").alias("hb"))
        met = met.select("a", "b", (F.col("n") + F.size(F.array_intersect("ha", "hb"))).alias("shared"))
        sets_a = x.where("size(hot) > 0").select(F.col("hot").alias("sa")).distinct()
        sets_b = y.where("size(hot) > 0").groupBy(F.col("hot").alias("sb")).agg(F.min("b").alias("b"))
        pairs = sets_a.select("sa", F.explode("sa").alias("w")).join(sets_b.select("sb", "b", F.explode("sb").alias("w")), "w").groupBy("sa", "sb", "b").agg(F.count("*").alias("shared"))
        top = pairs.groupBy("sa").agg(F.min(F.struct((-F.col("shared")).alias("s"), "b")).alias("m")).select(F.col("sa").alias("hot"), F.col("m.b").alias("b"), (-F.col("m.s")).alias("shared"))
        shared = met.unionByName(x.select("a", "hot").join(top, "hot").select("a", "b", "shared"))
    return shared.where(F.col("shared") >= least_shared).groupBy("a").agg(F.min(F.struct((-F.col("shared")).alias("s"), "b")).alias("m")).select(F.col("a").alias(left_name), F.col("m.b").alias(right_name), (-F.col("m.s")).alias("shared"))


def mentions(texts: DataFrame, id_: str, text: str, needles: DataFrame, needle: str, words: str = r"[\p{L}\p{N}_-]+") -> DataFrame:
    """(id, needle, n): how often each text mentions each one-word needle; whole words, any case. The words of a
    text are counted in the text before they meet the needles."""
    spoken = texts.select(id_, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(words), F.lit(0))).alias("_w"))
    wanted = needles.select(F.lower(F.col(needle)).alias("_w"), F.col(needle)).distinct()
    return spoken.join(wanted, "_w").groupBy(id_, needle).agg(F.count("*").alias("n"))


#: Buckets of hashes by which places in texts are thinned out before they meet the phrases.
PHRASE_BUCKETS = 1 << 19


def phrase_mentions(texts: DataFrame, id_: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """(id, needle): which texts hold which phrases of one word or more, as whole words, in any case, whatever stands
    between the words. Needles without a word hold nowhere; repeated texts and needles count once.

    No text is shuffled. Each word of a text is a place where a phrase may begin. Places whose word has no
    phrase's first word in its bucket of hashes are left out; at the others the next words, as many as there are in
    some phrase, are compared whole: by equi join, a broadcast one while the phrases are small. The buckets, at most
    `PHRASE_BUCKETS` numbers, are broadcast; they only save work, and a phrase that shares its bucket costs nothing else.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(PHRASE_BUCKETS))
    n = needles.select(F.col(needle).alias("_needle")).where("_needle is not null").distinct().withColumn("_w", words(F.col("_needle"))).where("size(_w) > 0")
    n = materialise(n.select("_needle", F.array_join("_w", " ").alias("_phrase"), F.get("_w", F.lit(0)).alias("_first"), F.size("_w").alias("_size")))
    sizes = sorted(r[0] for r in n.select("_size").distinct().collect())
    held = lambda c: F.broadcast(n.select(bucket(F.col(c)).alias("_bucket")).distinct())
    # The outer form, as for the other one the planner adds a filter that looks for the words a second time.
    places = texts.select(F.col(id_).alias("_id"), words(F.col(text)).alias("_w")).select("_id", "_w", F.posexplode_outer("_w").alias("_at", "_first"))
    places = places.withColumn("_bucket", bucket(F.col("_first"))).join(held("_first"), "_bucket", "left_semi")
    next_ = F.array(*(F.when(F.col("_at") + k <= F.size("_w"), F.array_join(F.slice("_w", F.col("_at") + 1, F.lit(k)), " ")) for k in sizes)).cast("array<string>")
    spoken = places.select("_id", F.explode(F.array_compact(next_)).alias("_phrase")).withColumn("_bucket", bucket(F.col("_phrase"))).join(held("_phrase"), "_bucket", "left_semi")
    met = spoken.join(broadcast_if_small(n.select("_needle", "_phrase")), "_phrase")
    return met.select(F.col("_id").alias(id_), F.col("_needle").alias(needle)).distinct()


def first_matching_rule(rows: DataFrame, keys: Sequence[tuple[str, Column]], rules: DataFrame) -> DataFrame:
    """`rows` with `target` and `via` of the first rule that matches: a ladder of ranked equi joins in one.

    `keys` names what a row offers (kind, value); `rules` has kind, value, rank, target. The lowest rank wins,
    then the least target. Rows without a match keep nulls; rows are told apart by all their columns.
    """
    tagged = materialise(rows.withColumn("_row", F.monotonically_increasing_id()))  # read twice, numbered once
    offers = tagged.select("_row", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in keys))).alias("_o")).select("_row", "_o.kind", "_o.value")
    best = offers.join(rules, ["kind", "value"]).groupBy("_row").agg(F.min(F.struct("rank", "target", "kind")).alias("_m"))
    return tagged.join(best, "_row", "left").select(*rows.columns, F.col("_m.target").alias("target"), F.col("_m.kind").alias("via"))


def ordered_allocation(rows: DataFrame, id_: str, matches: DataFrame) -> DataFrame:
    """(id, main, others): `matches` (id, rank, target) give the first distinct target as main, the further ones in
    order; ids without a match have nulls. Targets repeated at a later rank count once."""
    once = matches.groupBy(id_, "target").agg(F.min("rank").alias("rank"))
    listed = once.groupBy(id_).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target"))), lambda x: x["target"]).alias("_t"))
    return rows.select(id_).distinct().join(listed, id_, "left").select(id_, F.get("_t", F.lit(0)).alias("main"), F.array_join(F.slice("_t", 2, F.lit(1 << 30)), ",").alias("others"))


def precedence_union(first: DataFrame, second: DataFrame, key: str, id_: str) -> DataFrame:
    """All of `first`, and the rows of `second` whose key it lacks, numbered after the greatest id in order of
    key. Numbers are given by range-partitioned parts, so no task holds all rows."""
    added = second.join(first.select(key), key, "left_anti").drop(id_)
    top = first.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_top"))
    parts = materialise(added.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()))
    parts = parts.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(key)))
    before = parts.groupBy("_part").count().withColumn("_off", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_off")
    numbered = parts.join(F.broadcast(before), "_part").crossJoin(F.broadcast(top)).withColumn(id_, F.col("_top") + F.col("_off") + F.col("_n"))
    return first.unionByName(numbered.select(*first.columns))


def unify_families(members: DataFrame, id_: str, family: str, key: str) -> DataFrame:
    """(key, id, hub): members of different families that share a key, each tied to the key's least member.

    A star instead of all pairs: two members are unified exactly when they hang on the same hub under one
    key. Keys held by one family alone tie nothing.
    """
    held = members.where(F.col(key).isNotNull()).select(key, id_, family).distinct()
    hubs = held.groupBy(key).agg(F.min(id_).alias("hub"), F.min(family).alias("_a"), F.max(family).alias("_b")).where("_a <> _b").select(key, "hub")
    return held.join(hubs, key).select(key, F.col(id_).alias("member"), "hub").distinct()


def dimension_status(required: DataFrame, observed: DataFrame, key: str, at: str, current: Column) -> DataFrame:
    """(key, state): MISSING for a required key without a record, CURRENT when the latest record is, else OTHER;
    observed keys that are not required are listed too."""
    last = observed.groupBy(key).agg(F.max_by(F.struct(*observed.columns), at).alias("_l")).select(key, "_l")
    keys = required.select(key).union(observed.select(key)).where(F.col(key).isNotNull()).distinct()
    flag = observed.withColumn("_c", current).groupBy(key).agg(F.max_by("_c", at).alias("_c"))
    return keys.join(last.select(key, F.lit(True).alias("_has")), key, "left").join(flag, key, "left").select(key, F.when(F.col("_has").isNull(), "MISSING").when(F.col("_c"), "CURRENT").otherwise("OTHER").alias("state"))


def path_conflicts(owned: DataFrame, id_: str, path: str) -> DataFrame:
    """(id, n_conflicts): for each owner how many other owners hold a path that is one of its own, or above or
    below one. Prefixes are equi-join keys. The other owners have to be told apart to be counted, so owners that meet at a
    path are paired; where only hits are wanted, `ownership.forbidden_paths` counts them without pairs."""
    held = owned.where(F.col(path).isNotNull()).select(id_, F.rtrim(F.col(path), F.lit("/")).alias("_p")).distinct()
    up = held.select(id_, "_p", F.explode(path_prefixes(F.col("_p"))).alias("_q"))
    above = up.join(held.select(F.col(id_).alias("_o"), F.col("_p").alias("_q")), "_q").where(F.col(id_) != F.col("_o")).select(id_, "_o")
    both = above.union(above.select("_o", id_)).distinct()
    return held.select(id_).distinct().join(both.groupBy(id_).agg(F.count("*").alias("n_conflicts")), id_, "left").na.fill(0, ["n_conflicts"])


def forbidden_edges(edges: DataFrame, classes: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges whose ends' classes make a forbidden pair: `classes` (node, class), `rules` (src_class, dst_class)."""
    c = classes.select("node", "class")
    typed = edges.join(c.select(F.col("node").alias("src"), F.col("class").alias("src_class")), "src").join(c.select(F.col("node").alias("dst"), F.col("class").alias("dst_class")), "dst")
    return typed.join(rules.select("src_class", "dst_class").distinct(), ["src_class", "dst_class"], "left_semi")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
