import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnwork.operators import graph as G


def reach(edges):
    nodes = {x for e in edges for x in e}
    pairs = set(edges)
    while True:
        more = {(a, d) for a, b in pairs for c, d in edges if b == c} - pairs
        if not more:
            return nodes, pairs
        pairs |= more


def frame(spark, edges, names="src int, dst int"):
    return spark.createDataFrame(edges, names)


def graphs():
    rnd = random.Random(8)
    for n, m in ((6, 9), (12, 14), (9, 20)):
        yield [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]


def test_closure_components_cycles(spark):
    for edges in graphs():
        nodes, pairs = reach(edges)
        df = frame(spark, edges + edges[:3])
        got, record = G.transitive_closure(df)
        assert {tuple(r) for r in got.collect()} == pairs and record.converged
        want = {n: max([n, *(m for m in nodes if (n, m) in pairs and (m, n) in pairs)]) for n in nodes}
        assert {r["node"]: r["component"] for r in G.strong_components(df).collect()} == want
        assert {r["node"] for r in G.cyclic_nodes(df).collect()} == {n for n in nodes if (n, n) in pairs}


def test_fixed_point_says_when_it_did_not_converge(spark):
    chain = frame(spark, [(i, i + 1) for i in range(10)])
    pairs, record = G.transitive_closure(chain, max_rounds=2)
    assert not record.converged and record.iterations == 2 and record.delta_remaining == 8
    assert pairs.count() == 10 + 9 + 8
    assert G.transitive_closure(frame(spark, []))[0].collect() == []


def test_depths_and_reasons(spark):
    df = frame(spark, [(1, 2), (2, 3), (1, 3), (3, 1), (3, 4), (None, 9)])
    assert {tuple(r) for r in G.bfs_depth(df, frame(spark, [(1,)], "node int")).collect()} == {(2, 1), (3, 1), (4, 2)}
    steps = spark.createDataFrame([(1, 2, None), (1, 3, "ENCLOSES"), (2, 4, "UNIQUE_NAME"), (3, 4, None), (4, 5, "DISPATCHES_TO")], "src int, dst int, why string")
    got = {tuple(r) for r in G.upstream(steps, frame(spark, [(1,)], "node int")).collect()}
    assert got == {(2, 1, None), (3, 1, "ENCLOSES"), (4, 2, "ENCLOSES"), (5, 3, "ENCLOSES")}


def test_weakest_link_and_explosion(spark):
    nodes = spark.createDataFrame([(i, 10 - i) for i in range(5)], "node int, strength int")
    state, record = G.weakest_link(nodes, frame(spark, [(0, 1), (1, 2), (2, 0), (3, 4)]))
    assert dict(state.collect()) == {0: 8, 1: 8, 2: 8, 3: 6, 4: 6} and record.converged
    assert not G.weakest_link(nodes, frame(spark, [(0, 1), (1, 2), (2, 3), (3, 4)]), max_rounds=2)[1].converged
    lines = spark.createDataFrame([("p", "a", 2.0), ("p", "b", 1.0), ("a", "b", 3.0), ("b", "c", 4.0), ("q", "a", 1.0), ("q", "x", 1.0), ("x", "y", 1.0), ("y", "x", 1.0)], "parent string, item string, quantity double")
    total, cycles = G.explode_quantities(lines, spark.createDataFrame([("p",), ("q",), ("lone",)], "node string"))
    got = {(r["root"], r["item"]): r["quantity"] for r in total.collect()}
    assert got == {("p", "a"): 2.0, ("p", "b"): 7.0, ("p", "c"): 28.0} and {tuple(r) for r in cycles.collect()} == {("q", "x")}
    diamonds = [(f"n{i}", f"{s}{i}", 1.0) for i in range(9) for s in "ab"] + [(f"{s}{i}", f"n{i + 1}", 1.0) for i in range(9) for s in "ab"]
    deep = spark.createDataFrame(diamonds, "parent string, item string, quantity double")  # each level doubles the ways
    assert G.explode_quantities(deep, spark.createDataFrame([("n0",)], "node string"))[0].where("item = 'a8'").first()["quantity"] == 256.0


def test_realizable_paths(spark):
    schema = "src string, dst string, kind string, move string, evidence string, inferred boolean"
    moves = [("a", "b", "call", "descend", "1", False), ("b", "c", "data", "return", "2", False), ("a", "s", "state", "state", "3", False), ("b", "s", "state", "state", "3", False), ("s", "d", "state", "state", "3", True)]
    node = lambda *x: spark.createDataFrame([(i,) for i in x], "node string")
    df = spark.createDataFrame(moves, schema)
    assert G.realizable_path(df, node("a"), node("c")).collect() == []  # no return after a descent
    assert [(r["step"], r["src"], r["dst"]) for r in G.realizable_path(df, node("b"), node("c")).collect()] == [(1, "b", "c")]
    assert [(r["step"], r["src"], r["dst"]) for r in G.realizable_path(df, node("a"), node("d")).orderBy("step").collect()] == [(1, "a", "s"), (2, "s", "d")]
    opened = spark.createDataFrame([*moves, ("d", "c", "data", "return", "5", False)], schema)
    assert [r["dst"] for r in G.realizable_path(opened, node("b"), node("c")).collect()] == ["c"]
    assert G.realizable_path(df, node("a"), node("a")).collect() == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=9))
def test_closure_property(spark, edges):
    assert {tuple(r) for r in G.transitive_closure(frame(spark, edges))[0].collect()} == reach(edges)[1]


def test_small_ones(spark):
    edges = spark.createDataFrame([("a", "b", "k"), ("c", "a", "l"), ("a", "b", "k")], "src string, dst string, kind string")
    assert {tuple(r) for r in G.neighbours(edges, "a").collect()} == {("b", "out", "k"), ("c", "in", "l")}
    facts = spark.createDataFrame([("x", 2, "late"), ("x", 1, "first"), (None, 0, "no")], "id string, seq int, v string")
    assert [tuple(r) for r in G.first_writer_nodes(facts, "id", ["seq"]).collect()] == [("x", 1, "first")]
    reached = spark.createDataFrame([("g", f"n{i:02d}", 1 + i % 2) for i in range(20)], "g string, node string, depth int")
    r = G.impact_frontier(reached, "g").first()
    assert (r["n_nodes"], r["min_depth"], r["n_omitted"]) == (20, 1, 8) and r["nearest"].split(",")[:2] == ["n00", "n02"]
    spread, _ = G.labelled_reach(spark.createDataFrame([(1, 2, "dev"), (1, 3, "x")], "src int, dst int, kind string"), spark.createDataFrame([(1, "r")], "node int, label string"), F.col("kind") == "dev")
    assert {tuple(r) for r in spread.collect()} == {(1, "r"), (3, "r")}
