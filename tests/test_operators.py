import random

import pytest
from pyspark.sql import functions as F

from cairnwork.functions import quantity as Q
from cairnwork.functions import ranks as R
from cairnwork.operators import constraints as C
from cairnwork.operators import diff as D
from cairnwork.operators import joins as J
from cairnwork.operators import normalise as N
from cairnwork.operators import skyline as Y
from cairnwork.operators import windows as X
from cairnwork.operators.versions import latest_version


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_latest_version(spark):
    df = table(spark, [("a", 1, "x", 0), ("a", 2, "y", 0), ("a", 2, "y", 0), (None, 9, "n", 0), ("b", None, "z", 0), ("t", 1, "p", 0), ("t", 1, None, 0)], "k string, at int, v string, extra int")
    assert sorted(tuple(r) for r in latest_version(df, ["k"], "at", ["v"]).collect()) == [("a", "y"), ("b", "z"), ("t", "p")]
    assert latest_version(df.limit(0), ["k"], "at", ["v"]).collect() == []


def test_prefix_joins(spark):
    paths = table(spark, [("a/b/c.rs",), ("a/bc/d.rs",), ("a",), ("z",), (None,)], "p string")
    roots = table(spark, [("a", "A"), ("a/b/", "B"), ("a/b", "C"), ("a/b/c.rs/x", "no"), (None, "null")], "r string, o string")
    assert {r["p"]: r["o"] for r in J.longest_prefix_owner(paths, "p", roots, "r", "o").collect()} == {"a/b/c.rs": "B", "a/bc/d.rs": "A", "a": "A", "z": None, None: None}
    owners = table(spark, [("x/y",), ("q",)], "r string")
    assert {r["p"] for r in J.unowned_paths(table(spark, [("x",), ("x/y/z",), ("xx",), ("q/r",), ("w",)], "p string"), "p", owners, "r").collect()} == {"xx", "w"}
    held = table(spark, [("t1", "a/b"), ("t2", "a"), ("t3", "a/bb"), ("t4", "c"), ("t5", "c/d/e"), ("t5", "c/d/f")], "t string, p string")
    assert dict(J.path_conflicts(held, "t", "p").collect()) == {"t1": 1, "t2": 2, "t3": 1, "t4": 1, "t5": 1}


def test_name_and_reference_joins(spark):
    left = table(spark, [("n1",), ("n2",), (None,)], "name string")
    right = table(spark, [("n1", 1), ("n2", 2), ("n2", 3), (None, 4)], "name string, id int")
    assert {r["name"]: r["id"] for r in J.unique_name_join(left, right, "name", "id").collect()} == {"n1": 1, "n2": None, None: None}
    files = table(spark, [("a/x.rs",), ("b/y.rs",), ("c/y.rs",)], "path string")
    refs = table(spark, [("a/x.rs",), ("q/x.rs",), ("q/y.rs",), ("none.rs",), (None,)], "ref string")
    assert {r["ref"]: (r["resolved"], r["how"]) for r in J.resolve_references(refs, "ref", files, "path").collect()} == {"a/x.rs": ("a/x.rs", "exact"), "q/x.rs": ("a/x.rs", "unique name"), "q/y.rs": (None, None), "none.rs": (None, None), None: (None, None)}


def test_flows_without_pairs(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("xy"), rnd.randrange(6), rnd.choice(["read", "write"])) for _ in range(40)]
    got = {r["key"]: r["n_flows"] for r in J.producer_consumer(table(spark, rows, "key string, actor int, role string"), "key", "actor", "role").collect()}
    for k in "xy":
        w, r = {a for q, a, x in rows if q == k and x == "write"}, {a for q, a, x in rows if q == k and x == "read"}
        assert got[k] == sum(a != b for a in w for b in r)


def test_three_way_verdicts(spark):
    e = lambda *x: table(spark, list(x), "src string, dst string")
    built = e(("a", "b"), ("a", "c"), ("b", "d"))
    called = table(spark, [("a", "b", 3), ("a", "d", 1), ("q", "a", 2)], "src string, dst string, calls int")
    reach = e(("a", "b"), ("a", "c"), ("b", "d"), ("a", "d"))
    got = {(r["src"], r["dst"]): r["verdict"] for r in J.reconcile_three_way(e(("a", "b"), ("b", "d"), ("c", "d"), ("a", "out")), built, called, table(spark, [(x,) for x in "abcd"], "node string"), reach).collect()}
    assert got == {("a", "b"): J.CONFIRMED, ("b", "d"): J.NO_CALL, ("c", "d"): J.NOT_BUILT, ("a", "out"): J.NOT_CENSUSABLE, ("a", "c"): J.UNDECLARED, ("a", "d"): J.VIA_REEXPORT, ("q", "a"): J.WITHOUT_DEPENDENCY}


def test_rules_and_union(spark):
    rules = table(spark, [("dom", "x", 2, "t2"), ("key", "k", 1, "t1"), ("dom", "x", 2, "t0")], "kind string, value string, rank int, target string")
    rows = table(spark, [("k", "x"), ("n", "x"), ("n", "n"), ("n", "n"), (None, None)], "key string, dom string")
    got = J.first_matching_rule(rows, [("key", F.col("key")), ("dom", F.col("dom"))], rules).collect()
    assert sorted((r["key"] or "", r["target"]) for r in got if r["target"]) == [("k", "t1"), ("n", "t0")] and len(got) == 5
    first = table(spark, [("a", 5), ("b", 7)], "k string, id long")
    second = table(spark, [("b", 0), ("d", 0), ("c", 0)], "k string, id long")
    assert sorted(tuple(r) for r in J.precedence_union(first, second, "k", "id").collect()) == [("a", 5), ("b", 7), ("c", 8), ("d", 9)]
    alloc = J.ordered_allocation(table(spark, [(1,), (2,)], "id int"), "id", table(spark, [(1, 3, "c"), (1, 1, "a"), (1, 2, "c"), (1, 4, "a")], "id int, rank int, target string"))
    assert {tuple(r) for r in alloc.collect()} == {(1, "a", "c"), (2, None, None)}


def test_unify_and_status(spark):
    m = table(spark, [("1", "f", "k"), ("2", "g", "k"), ("3", "f", "l"), ("4", "f", "l"), ("5", "g", None)], "id string, family string, key string")
    assert sorted(tuple(r) for r in J.unify_families(m, "id", "family", "key").collect()) == [("k", "1", "1"), ("k", "2", "1")]
    seen = table(spark, [("a", 1, "old"), ("a", 2, "new"), ("b", 5, "old")], "k string, at int, v string")
    assert dict(J.dimension_status(table(spark, [("a",), ("c",)], "k string"), seen, "k", "at", F.col("v") == "new").collect()) == {"a": "CURRENT", "b": "OTHER", "c": "MISSING"}


def test_windows(spark):
    df = table(spark, [("g", 1, 10), ("g", 1, 9), ("h", None, 3)], "g string, o int, v int")
    assert sorted(tuple(r) for r in X.first_per_key(df, ["g"], [F.col("o"), F.col("v")], ["v"]).collect()) == [("g", 9), ("h", 3)]
    big = spark.range(1000).select((F.col("id") % 3).alias("s"), "id")
    a = {tuple(r) for r in X.stratified_sample(big, "s", F.col("id"), 5, 1).collect()}
    assert len(a) == 15 and a == {tuple(r) for r in X.stratified_sample(big.repartition(7), "s", F.col("id"), 5, 1).collect()}
    chain = table(spark, [("g", 1, None, "a"), ("g", 2, "a", "b"), ("g", 3, "x", "c")], "g string, seq int, link string, digest string")
    assert [r["seq"] for r in X.chain_breaks(chain, "g", "seq", "link", "digest").collect()] == [3]
    tiles = table(spark, [("g", 0, 5), ("g", 5, 9), ("g", 8, 12), ("g", 14, 15)], "g string, s int, e int")
    assert sorted((r["s"], r["defect"], r["size"]) for r in X.tiling_defects(tiles, "g", "s", "e").collect()) == [(8, "overlap", 1), (14, "hole", 2)]


def test_normal_forms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(N.canonical_predicate(F.lit("  Calls--The  API! "))) == "calls_the_api"
    assert one(N.token_stem(F.lit("The Classes, of Glass & boxes"), ("the", "of"))) == "boxe classe glass"
    assert one(N.synonym_key(F.lit("Drop-Invoice"), {"drop": "remove"})) == "invoice remove"
    claims = table(spark, [("a", "x", 1), ("a", "x", 1), ("a", None, 2), ("b", "x", 1), ("b", "y", 1), (None, "z", 1)], "id string, v string, w int")
    assert {tuple(r) for r in N.conflicting_claims(claims, "id", ["v"]).collect()} == {("a", 3, 2), ("b", 2, 2)}
    assert {r["id"] for r in N.conflicting_claims(claims, "id", ["v"], F.col("v").isNull()).collect()} == {"b"}


def test_inventory_delta(spark):
    schema = "p string, k string, d string, c string"
    before = table(spark, [("same", "F", "1", "x"), ("mod", "F", "1", "x"), ("kind", "F", "1", "x"), ("gone", "F", "1", "x"), ("drift", "F", "1", "x"), ("dark", "F", None, "x"), ("dir", "P", None, "x")], schema)
    after = table(spark, [("same", "F", "1", "x"), ("mod", "F", "2", "x"), ("kind", "D", "1", "x"), ("new", "F", "1", "x"), ("drift", "F", "1", "y"), ("dark", "F", "1", "x"), ("dir", "P", None, "x")], schema)
    got = {r["p"]: (r["change"], r["cause"], r["drift"]) for r in D.inventory_delta(before, after, "p", "k", "d", "P", ["c"]).collect()}
    assert got == {"mod": ("modified", "content_digest_differs", False), "kind": ("modified", "kind_changed", False), "gone": ("deleted", "disappeared", False), "new": ("created", "appeared", False), "drift": ("unchanged", None, True), "dark": ("modified", "content_identity_unavailable", False)}
    with pytest.raises(D.SnapshotRefused):
        D.inventory_delta(before.union(before), after, "p", "k", "d")


def test_correspondence(spark):
    schema = "descriptor string, signature string, body string, visibility string"
    before = table(spark, [("m::same", "s", "b", "p"), ("m::chg", "s", "b1", "p"), ("m::old", "s", "b2", "p"), ("m::mv", "s", "b3", "p"), ("m::both", "s", "b4", "p"), ("m::del", "s", "b5", "p"), ("m::dup", "s", "1", "p"), ("m::dup", "s", "2", "p"), ("m::x1", "t", "t", "p"), ("m::x2", "t", "t", "p"), ("m::nob", "s", "-", "p")], schema)
    after = table(spark, [("m::same", "s", "b", "p"), ("m::chg", "s", "b9", "q"), ("m::new", "s", "b2", "q"), ("n::mv", "s", "b3", "p"), ("n::other", "s", "b4", "p"), ("m::cre", "s", "c", "p"), ("m::dup", "s", "1", "p"), ("m::x3", "t", "t", "p"), ("k::nob", "s", "-", "p")], schema)
    got = {(r["change"], r["before"], r["after"]) for r in D.correspond(before, after).collect()}
    assert got == {("changed", "m::chg", "m::chg"), ("renamed", "m::old", "m::new"), ("moved", "m::mv", "n::mv"), ("moved_renamed", "m::both", "n::other"), ("deleted", "m::del", None), ("created", None, "m::cre"), ("ambiguous", "m::dup", "m::dup"), ("ambiguous", "m::x1", "m::x3"), ("deleted", "m::nob", None), ("created", None, "k::nob")}


def test_other_deltas(spark):
    s = lambda rows: table(spark, rows, "id string, status string")
    got = {(r["id"], r["change"]) for r in D.status_delta(s([("a", "verified"), ("b", "blocked"), ("c", None), ("d", "blocked")]), s([("a", "blocked"), ("b", "verified"), ("d", "blocked"), ("e", None)]), "id", "status", R.PROGRESS).collect()}
    assert got == {("a", "weakened"), ("b", "strengthened"), ("c", "dropped"), ("e", "new")}
    m = lambda rows: table(spark, rows, "k int, v double, u double")
    assert dict(D.within_tolerance(m([(1, 1.0, 0.1), (2, 1.0, None), (3, None, 1.0), (4, 1.0, 1.0)]), m([(1, 1.2, 0.1), (2, 1.5, 0.1), (3, 1.0, 1.0), (5, 1.0, 1.0)]), ["k"], "v", "u").collect()) == {1: "agree", 2: "differ", 3: "unmeasured", 4: "missing_b", 5: "missing_a"}
    ch = table(spark, [("a", "x"), ("b", "x"), ("c", "y")], "item string, change string")
    it = table(spark, [("a", "x", False), ("b", "x", True), ("d", "x", False), ("e", "x", True)], "item string, change string, forbidden boolean")
    assert {(r[0], r[2]) for r in D.check_intent(ch, it).collect()} == {("a", "intended"), ("b", "forbidden"), ("c", "unintended"), ("d", "unfulfilled")}


def test_kleene(spark):
    def fold(*v):
        return table(spark, [(x,) for x in v], "v string").agg(C.all_of(F.col("v"))).first()[0]

    assert fold("SATISFIED", "UNKNOWN", "VIOLATED") == "VIOLATED" and fold("SATISFIED", None) == "UNKNOWN" and fold("SATISFIED") == "SATISFIED" and fold() == "SATISFIED"


def test_rules(spark):
    assert C.parse_rule("r", "forall x: Arm where side == left require mass <= 2 kg") == C.ForAll("r", "Arm", "mass", "<=", "2 kg", "side", "left")
    assert C.parse_rule("r", "require materialized X") == C.Materialized("r", "X")
    assert isinstance(C.parse_rule("r", "please"), C.Unparsed)
    nodes = table(spark, [("a", "Arm", {"mass": "1500 g", "side": "left"}), ("b", "Arm", {"mass": "3 kg", "side": "right"}), ("c", "Arm", {"side": "left"}), ("d", "Arm", {"mass": "1 m", "side": "left"})], "name string, kind string, attributes map<string,string>")
    out = lambda *t: {r["rule"]: (r["verdict"], r["n_violations"], r["n_unknown"], r["counterexamples"]) for r in C.evaluate([C.parse_rule(str(i), x) for i, x in enumerate(t)], nodes).collect()}
    got = out("forall x: Arm where side == left require mass <= 2 kg", "forall x: Arm where side == right require mass <= 2 kg", "forall x: Arm require side != up", "forall x: Leg require mass == 1", "nonsense", "forall x: Arm where side == left require mass < 0.1 kg")
    assert got["0"] == ("VIOLATED", 1, 1, "d") and got["1"] == ("VIOLATED", 1, 0, "b") and got["2"][0] == "SATISFIED" and got["3"][0] == "SATISFIED" and got["4"][0] == "UNKNOWN" and got["5"] == ("VIOLATED", 2, 1, "a,d")
    effects = table(spark, [("f", "s", "W"), ("f", "s", "W"), ("g", "s", "R")], "function string, scope string, category string")
    calls = table(spark, [("f", "s", "m::t", None), ("g", "s", None, "t"), ("g", "s", None, None)], "function string, scope string, callee string, spelled string")
    seen = table(spark, [("f", "s", True), ("g", "s", False)], "function string, scope string, observed boolean")
    rules = ["forall f: function in s forbid effect W", "forall f: function in s forbid effect X", "forall f: function in s forbid call to m::t", "forall f: function in s observed effect within W, R", "forall f: function in s observed effect within none"]
    got = {r["rule"]: r["verdict"] for r in C.evaluate([C.parse_rule(str(i), x) for i, x in enumerate(rules)], nodes, effects=effects, calls=calls, coverage=seen).collect()}
    assert got == {"0": "VIOLATED", "1": "UNKNOWN", "2": "VIOLATED", "3": "SATISFIED", "4": "VIOLATED"}


def test_quantities(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    parse = lambda t: (lambda r: r and (round(r["value"], 9), r["dimension"]))(one(Q.parse_quantity(F.lit(t))))
    assert parse("0.25 m") == (0.25, "1,0,0,0,0,0,0,0") and parse("300 mm") == (0.3, "1,0,0,0,0,0,0,0") and parse("2 N*m") == (2.0, "2,1,-2,0,0,0,0,0") and parse("9.81 m/s^2") == (9.81, "1,0,-2,0,0,0,0,0")
    assert parse("5") == (5.0, "0,0,0,0,0,0,0,0") and parse("x") is None and parse("5 furlong") is None and parse("60 rpm")[1] == "0,0,-1,0,0,0,0,1"
    r = lambda n, d: Q.rational(F.lit(n), F.lit(d))
    pair = lambda c: (lambda x: x and (int(x["num"]), int(x["den"])))(one(c))
    assert pair(r(6, -4)) == (-3, 2) and pair(r(1, 0)) is None and pair(r(0, 7)) == (0, 1) and pair(Q.rational_add(r(1, 3), r(1, 6))) == (1, 2) and pair(Q.rational_multiply(r(2, 3), r(3, 4))) == (1, 2)
    big = F.lit("99999999999999999999999999999999999999").cast("decimal(38,0)")
    assert one(Q.rational_multiply(Q.rational(big, F.lit(1)), Q.rational(big, F.lit(1)))) is None
    i = lambda t: Q.parse_interval(F.lit(t))
    both = lambda c: tuple(one(c))
    assert both(Q.interval_subtract(i("1..2"), i("0.5..3"))) == (-2.0, 1.5) and both(Q.interval_multiply(i("-1..2"), i("3..4"))) == (-4.0, 8.0) and both(Q.interval_hull(i("1..2"), i("5"))) == (1.0, 5.0) and one(i("3..1")) is None
    assert both(Q.parse_money(F.lit("10..12.5 EUR/h"))) == (10.0, 12.5, "EUR", "h") and one(Q.locate(i("1..2"), F.lit(3))) == "above"
    assert one(C.interval_requirement(F.lit(1), F.lit(3), "<=", 2)) == "UNKNOWN"


def test_fronts(spark):
    rnd = random.Random(6)
    pts = [(rnd.choice("gh"), rnd.randrange(12), rnd.randrange(12), rnd.randrange(5)) for _ in range(120)] + [("g", None, 1, 1)]
    df = table(spark, pts, "g string, x int, y int, z int")

    def front(keys, signs):
        full = [p for p in pts if all(p[k] is not None for k in keys)]
        better = lambda a, b: all(s * a[k] >= s * b[k] for k, s in zip(keys, signs)) and any(a[k] != b[k] for k in keys)
        return sorted(p for p in full if not any(q[0] == p[0] and better(q, p) for q in full))

    assert sorted(tuple(r) for r in Y.front_of_two(df, ["g"], "x", "y").collect()) == front((1, 2), (1, -1))
    assert sorted(tuple(r) for r in Y.front_of_two(df, ["g"], "x", "y", slices=1).collect()) == front((1, 2), (1, -1))
    assert sorted(tuple(r) for r in Y.pareto_front(df, ["g"], [("x", True), ("y", False), ("z", True)]).collect()) == front((1, 2, 3), (1, -1, 1))
    assert Y.front_of_two(df.limit(0), ["g"], "x", "y").collect() == []


def test_ranks(spark):
    df = table(spark, [("OBSERVED",), ("UNKNOWN",), ("odd",), (None,)], "s string")
    assert df.agg(R.strongest(R.STRENGTH, F.col("s"))).first()[0] == "OBSERVED"
    assert df.where("s <> 'odd' and s is not null").agg(R.weakest(R.COVERAGE, F.col("s"))).first()[0] == "UNKNOWN"


def test_one_hot_group_in_slices(spark):
    """Windows over slices of a group's order give what windows over the whole group would."""
    rnd = random.Random(21)
    rows = [("hot" if i % 10 else None, i, rnd.randint(0, 5000), rnd.randint(1, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id int, s int, size int").withColumn("e", F.col("s") + F.col("size"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: r["total"] for r in X.admit_within_budget(df, "g", ["s", "id"], "size", 100).collect()}
        holes = {(r["id"], r["size"] if r["defect"] == "hole" else -r["size"]) for r in X.tiling_defects(df.where("g is not null"), "g", "s", "e").collect()}
        link = df.withColumns({"seq": F.col("id"), "link": F.when(F.col("id") % 7 == 0, -1).otherwise(F.col("id") - F.when(F.col("id") % 10 == 1, 2).otherwise(1)), "digest": F.col("id")}).where("g is not null")
        breaks = {r["id"] for r in X.chain_breaks(link, "g", "seq", "link", "digest").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in ("hot", None):
        total = 0
        for _, i, s, n in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            total += n
            want[i] = total
    assert got == want
    reached, seen = 0, {}
    for _, i, s, n in sorted((r for r in rows if r[0]), key=lambda r: (r[2], r[2] + r[3])):
        seen.setdefault((s, s + n), []).append((i, s - reached))
        reached = max(reached, s + n)
    assert sorted(x for _, x in holes) == sorted(gap for v in seen.values() for _, gap in v if gap)
    assert breaks == {i for i in range(600) if i % 10 and (i % 7 == 0 or i == 1)}
