"""Recursive and graph operators. Edges are (src, dst) rows; every loop keeps its tuples in DataFrames and
only asks whether a round found anything. Lineage is cut by checkpoints in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.session import materialise


@dataclass(frozen=True)
class FixedPoint:
    """How a loop ended; a loop that reached its bound says so instead of hiding it."""

    iterations: int
    converged: bool
    delta_remaining: int


def fixed_point(seed: DataFrame, derive: Callable[[DataFrame], DataFrame], max_rounds: int | None = None) -> tuple[DataFrame, FixedPoint]:
    """Semi-naive fixed point: `derive` sees only the tuples new in the last round; what it derives is joined
    against all known tuples. Returns all tuples, those of an unfinished round included, and the record. Without
    `max_rounds` it runs until nothing new is found.

    Tuples are whole rows; rows with nulls are compared null-safe. Repeated seeds count once. The known set
    is the union of the rounds' checkpoints, each written once.
    """
    columns = seed.columns

    def fresh(found: DataFrame, known: DataFrame | None) -> DataFrame:
        found = found.select(*columns).distinct()
        if known is None:
            return found
        on = reduce(Column.__and__, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns))
        return found.alias("a").join(known.alias("b"), on, "left_anti")

    delta = materialise(fresh(seed, None))
    known, iterations = delta, 0
    while not delta.isEmpty():
        if iterations == max_rounds:
            return known, FixedPoint(iterations, False, delta.count())
        iterations += 1
        delta = materialise(fresh(derive(delta), known))
        known = known.unionByName(delta)
    return known, FixedPoint(iterations, True, 0)


def transitive_closure(edges: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, FixedPoint]:
    """All pairs (src, dst) connected by one edge or more; cycles are fine."""
    pairs = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    steps = materialise(pairs).select(F.col("src").alias("_via"), F.col("dst").alias("_to"))
    return fixed_point(pairs, lambda d: d.join(steps, d["dst"] == F.col("_via")).select("src", F.col("_to").alias("dst")), max_rounds)


def labelled_reach(edges: DataFrame, roots: DataFrame, blocked: Column | None = None, max_rounds: int | None = None) -> tuple[DataFrame, FixedPoint]:
    """(node, label): every label of `roots` (node, label) spread along edges (src, dst and further columns).
    `blocked`, over the edge's columns and `label`, tells steps that a label may not take."""
    steps = materialise(edges)
    passable = F.lit(True) if blocked is None else ~F.coalesce(blocked, F.lit(False))
    return fixed_point(roots.select("node", "label"), lambda d: d.join(steps, d["node"] == steps["src"]).where(passable).select(F.col("dst").alias("node"), "label"), max_rounds)


def bfs_depth(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of all nodes reached from `seeds` (node), the seeds themselves left out; no further than
    `max_depth` where that is given."""
    steps = materialise(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    frontier = materialise(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = materialise(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


#: The kinds of inferred steps, in the order in which they are preferred at equal depth.
INFERRED_STEPS = ("ENCLOSES", "DISPATCHES_TO", "UNIQUE_NAME")


def upstream(steps: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth, reason): dependents of `seeds`, where a step is (src, dst, why) and `why` is null for a
    resolved step, else why it is only inferred. `reason` is the first inferred step of the way.
    All of them, unless `max_depth` is given.

    The least depth counts; of ways of equal depth a resolved one is preferred, then the order of
    INFERRED_STEPS, so that the result does not depend on the order of rows.
    """
    order = F.create_map(*(F.lit(x) for k, v in enumerate(INFERRED_STEPS, 1) for x in (v, k)))
    rank = lambda c: F.when(c.isNull(), F.lit(0)).otherwise(F.coalesce(F.try_element_at(order, c), F.lit(len(INFERRED_STEPS) + 1)))
    edges = materialise(steps.select("src", "dst", "why").where("src is not null and dst is not null").distinct())
    frontier = materialise(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("reason")))
    seen = frontier
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node"), F.coalesce("reason", "why").alias("reason"))
        best = step.groupBy("node").agg(F.min(F.struct(rank(F.col("reason")).alias("k"), "reason")).alias("m")).select("node", F.lit(depth).alias("depth"), F.col("m.reason").alias("reason"))
        frontier = materialise(best.join(seen.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def impact_frontier(reached: DataFrame, group: str, nearest: int = 12) -> DataFrame:
    """For each `group`: how many nodes were reached, the least depth, the nearest few (depth, then name)
    and how many those leave out. A ranking that is filtered at once keeps but the nearest few of each task, so no
    group is sorted whole; the counts are an aggregation of their own."""
    rank = F.row_number().over(W.partitionBy(group).orderBy("depth", "node"))
    few = reached.select(group, "depth", "node").withColumn("_rn", rank).where(F.col("_rn") <= nearest)
    listed = few.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "node"))), lambda x: x["node"].cast("string")), ",").alias("nearest")).alias("l")
    counted = reached.groupBy(group).agg(F.count("*").alias("n_nodes"), F.min("depth").alias("min_depth")).alias("c")
    both = counted.join(listed, F.col(f"c.{group}").eqNullSafe(F.col(f"l.{group}")))
    return both.select("c.*", "l.nearest", F.greatest(F.col("n_nodes") - nearest, F.lit(0)).alias("n_omitted"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their greatest node.

    Colouring: the greatest node that reaches a node colours it; the nodes of a colour that reach its root
    backwards are the root's component and are taken out; what is left is coloured again. Nodes without
    an incoming or outgoing edge left are components of their own and are trimmed first.
    """
    live = materialise(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    nodes = materialise(live.select(F.col("src").alias("node")).union(live.select("dst")).distinct())
    done: list[DataFrame] = []
    while not nodes.isEmpty():
        ends = live.select(F.col("src").alias("node")).intersect(live.select(F.col("dst").alias("node")))
        lone = materialise(nodes.join(ends, "node", "left_anti").select("node", F.col("node").alias("component")))
        if not lone.isEmpty():
            done.append(lone)
            nodes = materialise(nodes.join(lone, "node", "left_anti"))
            live = materialise(live.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"))
            continue
        colour = nodes.select("node", F.col("node").alias("colour"))
        delta = colour
        while True:  # spread the greatest colour; only nodes whose colour grew go on
            offered = delta.join(live, delta["node"] == live["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_new"))
            grown = materialise(colour.join(offered, "node").where("_new > colour").select("node", F.col("_new").alias("colour")))
            if grown.isEmpty():
                break
            colour = materialise(colour.join(grown.select("node", F.col("colour").alias("_g")), "node", "left").select("node", F.coalesce("_g", "colour").alias("colour")))
            delta = grown
        colour = materialise(colour)
        inner = live.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("_a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("_b")), "dst").where("_a = _b").select("src", "dst")
        inner = materialise(inner)
        roots = colour.where("node = colour").select("node", F.col("colour").alias("label"))
        backward = inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found, _ = labelled_reach(backward, roots)
        part = materialise(found.select("node", F.col("label").alias("component")))
        done.append(part)
        nodes = materialise(nodes.join(part, "node", "left_anti"))
        live = materialise(live.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"))
    return reduce(DataFrame.unionByName, done) if done else nodes.select("node", F.col("node").alias("component"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node, component, n_nodes) of nodes on a cycle; a self-edge is a cycle."""
    parts = materialise(strong_components(edges))
    sizes = parts.groupBy("component").agg(F.count("*").alias("n_nodes"))
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("_loop", F.lit(True))
    return parts.join(sizes, "component").join(loops, "node", "left").where("n_nodes > 1 or _loop").select("node", "component", "n_nodes")


def weakest_link(nodes: DataFrame, rests_on: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, FixedPoint]:
    """(node, effective): the least `strength` among a node (node, strength) and all it rests on (src rests on
    dst). Each round sends on only what fell in the last; the record tells whether it converged, which without `max_rounds` it always has."""
    edges = materialise(rests_on.select("src", "dst").distinct())
    state = materialise(nodes.select("node", F.col("strength").alias("effective")))
    delta, rounds = state, 0
    while max_rounds is None or rounds < max_rounds:
        offered = edges.join(delta, edges["dst"] == delta["node"]).groupBy(F.col("src").alias("node")).agg(F.min("effective").alias("_new"))
        delta = materialise(state.join(offered, "node").where("_new < effective").select("node", F.col("_new").alias("effective")))
        if delta.isEmpty():
            return state, FixedPoint(rounds, True, 0)
        rounds += 1
        state = materialise(state.join(delta.select("node", F.col("effective").alias("_d")), "node", "left").select("node", F.coalesce("_d", "effective").alias("effective")))
    return state, FixedPoint(rounds, False, delta.count())


def explode_quantities(lines: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bill-of-material explosion: (root, item, quantity), quantities multiplied down and summed over all ways,
    and (root, item) pairs where a bill meets an item that is on a cycle. Such a bill is invalid: it has no finite
    quantities, and none is given.

    `lines`: parent, item, quantity. Ways to an item are summed at every level before they go on, so that a level
    has one row for each root and item, however many ways there are. Items on cycles are found first and not
    gone through, which leaves a graph without cycles: the levels end.
    """
    steps = materialise(lines.where("parent is not null and item is not null").groupBy("parent", F.col("item").alias("_item")).agg(F.sum(F.col("quantity").cast("double")).alias("_q")))
    looped = materialise(cyclic_nodes(steps.select(F.col("parent").alias("src"), F.col("_item").alias("dst"))).select(F.col("node").alias("item"), F.lit(True).alias("_loop")))
    start = roots.select(F.col("node").alias("root"), F.col("node").alias("item"), F.lit(1.0).alias("quantity")).distinct()
    front = materialise(start.join(looped, "item", "left").select("root", "item", "quantity", "_loop"))
    levels, met = [front.where("false").select("root", "item", "quantity")], [front.where("_loop").select("root", "item")]
    while True:
        ahead = front.where("_loop is null").join(steps, front["item"] == steps["parent"])
        step = ahead.groupBy("root", F.col("_item").alias("item")).agg(F.sum(F.col("quantity") * F.col("_q")).alias("quantity"))
        front = materialise(step.join(looped, "item", "left").select("root", "item", "quantity", "_loop"))
        if front.isEmpty():
            break
        levels.append(front.select("root", "item", "quantity"))
        met.append(front.where("_loop").select("root", "item"))
    cycles = materialise(reduce(DataFrame.unionByName, met).distinct())
    total = reduce(DataFrame.unionByName, levels).groupBy("root", "item").agg(F.sum("quantity").alias("quantity"))
    return total.join(cycles.select("root").distinct(), "root", "left_anti"), cycles


def realizable_path(moves: DataFrame, origins: DataFrame, targets: DataFrame) -> DataFrame:
    """The steps (step, src, kind, dst, evidence) of a shortest path along `moves` (src, dst, kind, move,
    evidence, inferred) that a value can take, and whether each step is inferred; no rows when there is none.

    `move` is descend, return or state. A search state is a node with whether the path may still return: a
    return is open only before the first descent and again after a state step. Ties go to the least
    predecessor, kind and evidence. A start that is a target gives no steps.
    """
    edges = materialise(moves.select("src", "dst", "kind", "move", "evidence", "inferred").where("src is not null and dst is not null").distinct())
    goal = targets.select(F.col("node").alias("dst")).distinct()
    layer = materialise(origins.select("node").distinct().withColumn("open", F.lit(True)))
    seen = layer
    empty = edges.select(F.lit(0).alias("step"), "src", "kind", "dst", "evidence", "inferred").limit(0)
    if not layer.join(goal, layer["node"] == goal["dst"], "left_semi").isEmpty():
        return empty
    trail: list[DataFrame] = []
    while True:
        ahead = layer.join(edges, layer["node"] == edges["src"]).where("move <> 'return' or open")
        ahead = ahead.select("src", F.col("open").alias("was_open"), "kind", "evidence", "inferred", "dst", (F.col("move") != "descend").alias("open"))
        best = ahead.groupBy("dst", "open").agg(F.min(F.struct("src", "was_open", "kind", "evidence", "inferred")).alias("by"))
        fresh = materialise(best.join(seen.select(F.col("node").alias("dst"), "open"), ["dst", "open"], "left_anti"))
        if fresh.isEmpty():
            return empty
        trail.append(fresh)
        hit = fresh.join(goal, "dst", "left_semi").orderBy("dst", "open").limit(1)
        if not hit.isEmpty():
            out, at = [], hit
            for step in range(len(trail), 0, -1):
                row = at.select(F.lit(step).alias("step"), F.col("by.src").alias("src"), F.col("by.kind").alias("kind"), "dst", F.col("by.evidence").alias("evidence"), F.col("by.inferred").alias("inferred"), F.col("by.was_open").alias("_o"))
                row = materialise(row)
                out.append(row.drop("_o"))
                if step > 1:
                    at = trail[step - 2].join(row.select(F.col("src").alias("dst"), F.col("_o").alias("open")), ["dst", "open"], "left_semi")
            return reduce(DataFrame.unionByName, out)
        layer = fresh.select(F.col("dst").alias("node"), "open")
        seen = seen.unionByName(layer)


def first_writer_nodes(facts: DataFrame, id_: str, order: Sequence[str]) -> DataFrame:
    """Nodes made from facts: of several rows with one id the first in `order` (then the least row) counts."""
    return facts.where(F.col(id_).isNotNull()).groupBy(id_).agg(F.min(F.struct(*order, *[c for c in facts.columns if c not in (*order, id_)])).alias("_f")).select(id_, *(F.col(f"_f.{c}").alias(c) for c in facts.columns if c != id_))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(node, direction, kind) of the nodes next to one node."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("node"), F.lit("out").alias("direction"), "kind")
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("node"), F.lit("in").alias("direction"), "kind")
    return out.unionByName(into).distinct()
