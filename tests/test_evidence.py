import math

import numpy as np
from pyspark.sql import functions as F

from cairnwork.operators import evidence as E
from cairnwork.operators import measured as M
from cairnwork.operators import world as L


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ladder_and_levels(spark):
    art = table(spark, [("a.rs", "rust", None, True), ("b.rs", "rust", None, False), ("c.png", None, "image", True), ("d.go", "go", None, False)], "path string, language string, class string, parsed boolean")
    rec = table(spark, [("a.rs",), ("c.png",)], "path string")
    obl = table(spark, [("a.rs", "CALL", "UNKNOWN"), ("b.rs", "CALL", "DERIVED")], "path string, dimension string, status string")
    fun = table(spark, [("f", "a.rs"), ("g", "b.rs")], "id string, path string")
    got = {r["subject"]: (r["level"], r["missing"]) for r in E.support_levels(art, rec, obl, fun, table(spark, [("f",)], "id string")).collect()}
    assert got == {"rust": ("L6_AGENT_USABLE", None), "image": ("L0_DISCOVERED", "L1_IDENTIFIED"), "go": ("L1_IDENTIFIED", "L2_SYNTAX")}


def test_claims_obligations_and_gates(spark):
    c = table(spark, [("a", "L3"), ("b", "L1"), ("c", "L1")], "s string, l string")
    assert {r["s"] for r in E.excessive_claims(c, table(spark, [("a", "L2"), ("b", "L1")], "s string, l string"), "s", "l").collect()} == {"a", "c"}
    o = table(spark, [("1",), ("2",), ("3",)], "id string")
    assert dict(E.obligation_states(o, table(spark, [("1", True), ("2", True), ("2", False)], "id string, ok boolean"), "id", "ok").collect()) == {"1": "DISCHARGED", "2": "REFUTED", "3": "OPEN"}
    r1, r2 = table(spark, [("x", True), ("y", True)], "id string, ok boolean"), table(spark, [("x", True), ("y", False), ("z", None)], "id string, ok boolean")
    assert {r["id"]: (r["blockers"], r["passes"]) for r in E.gate([("r1", r1), ("r2", r2)], "id").collect()} == {"x": ("", True), "y": ("r2", False), "z": ("r1,r2", False)}
    m = table(spark, [("1", "p"), ("2", "p"), ("2", "q"), ("3", "z")], "id string, found string")
    assert dict(E.agreement(table(spark, [("1", "p"), ("2", "p"), ("3", "p"), ("4", "p")], "id string, stated string"), "id", m, "stated", "found").collect()) == {"1": "AGREE", "2": "AMBIGUOUS", "3": "DISAGREE", "4": "UNSUPPORTED"}
    low = E.minimum_counts(table(spark, [("a",), ("a",)], "k string"), "k", table(spark, [("a", 2), ("b", 1)], "k string, least int"))
    assert [tuple(r) for r in low.collect()] == [("b", 0, 1)]


def test_json_schema(spark):
    rows = [(1, '{"a": 1, "b": "x"}'), (2, '{"a": "1", "c": null, "d": 1}'), (3, "[1]"), (4, None), (5, '{"a": null}')]
    got = {tuple(r) for r in E.schema_violations(table(spark, rows, "id int, p string"), "id", "p", {"a": "number", "b": "string"}, ["a"]).collect()}
    assert got == {(2, "a", "wrong_type"), (2, "d", "unknown_field"), (3, None, "not_an_object"), (4, None, "not_an_object"), (5, "a", "missing")}


def test_waves(spark):
    nodes = table(spark, [(x,) for x in "abcdex"], "node string")
    edges = table(spark, [("b", "a"), ("c", "b"), ("c", "a"), ("d", "e"), ("e", "d"), ("x", "d"), ("a", "gone")], "src string, dst string")
    assert dict(E.waves(nodes, edges).collect()) == {"a": 1, "b": 2, "c": 3, "d": None, "e": None, "x": None}


def test_candidates(spark):
    caps = table(spark, [("pay.invoice.send", "bill")], "k string, n string")
    offers = table(spark, [("send_invoice", 0), ("invoice_x", 1), ("invoice_a", 0), (None, 0)], "o string, h int")
    r = E.best_candidates(caps, "k", F.col("k"), F.col("n"), offers, "o").first()
    assert (r["o"], r["score"], r["confidence"]) == ("send_invoice", 4, "HIGH")
    r = E.best_candidates(caps, "k", F.col("k"), F.col("n"), offers.where("o <> 'send_invoice'"), "o", F.col("h")).first()
    assert (r["o"], r["confidence"]) == ("invoice_x", "MEDIUM")


def test_arm(spark):
    links = table(spark, [("a", 0, 0.25, 2.0), ("a", 1, 0.3, 1.0)], "arm string, joint int, length double, mass double")
    got = {r["joint"]: (r["reach"], r["torque"]) for r in M.arm_torques(links, table(spark, [("a", 0.5)], "arm string, payload double")).collect()}
    g = M.GRAVITY
    assert math.isclose(got[0][0], 0.55) and math.isclose(got[0][1], g * (2 * 0.125 + 1 * 0.4 + 0.5 * 0.55)) and math.isclose(got[1][1], g * (0.15 + 0.5 * 0.3))


def test_motions(spark):
    x = np.linspace(0, 1, 21)
    rows = [("m1", k, float(5 + 3 * y)) for k, y in enumerate(M.bezier_progress(M.EASINGS["ease-in"], x))] + [("m2", k, float(k)) for k in range(10)] + [("still", k, 1.0) for k in range(5)]
    got = {r["motion"]: (r["easing"], r["accepted"]) for r in M.infer_easing(table(spark, rows, "motion string, k int, value double")).collect()}
    assert got == {"m1": ("ease-in", True), "m2": ("linear", True)}
    runs = table(spark, [(1, 0.3, 0.0, 1.0, 0.0, 0.001), (2, 0.3, 0.0, 1.0, 0.5, 0.001)], "run int, angle double, speed double, length double, damping double, dt double")
    out = {r["run"]: r for r in M.simulate(runs, 2000).collect()}
    assert math.isclose(out[1]["energy_end"], out[1]["energy_start"], rel_tol=1e-9) and out[2]["energy_end"] < out[2]["energy_start"]


def test_layout(spark):
    b = table(spark, [("e", 320, "column"), ("e", 768, "row"), ("e", 1024, "row"), ("f", 320, "row")], "e string, v int, form string")
    assert [tuple(r) for r in M.breakpoints(b, "e", "v", "form").collect()] == [("e", 320, 768, "column", "row")]
    boxes = table(spark, [("p", "a", 0, 0.0, 0.0, 10.0, 10.0), ("p", "b", 1, 14.0, 0.0, 10.0, 10.0), ("p", "c", 2, 0.0, 20.0, 5.0, 5.0), ("p", "d", 3, 2.0, 22.0, 5.0, 5.0)], "parent string, element string, ordinal int, x double, y double, w double, h double")
    assert [(r["a"], r["b"], r["relation"], r["gap"]) for r in M.sibling_relations(boxes).orderBy("a").collect()] == [("a", "b", "row", 4.0), ("b", "c", "column", 10.0), ("c", "d", "overlap", 0.0)]


def small_world(spark, ids="abcd", extra=()):
    fn = [(i, f"n{i}", "T<x>" if i == "a" else "U", f"src/{'x' if i in 'ab' else 'y'}/{i}.rs", "S1" if i in "ab" else "S2", True, False, 0) for i in ids]
    functions = table(spark, fn, "id string, name string, owner_type string, path string, subsystem string, public boolean, test boolean, unresolved int")
    calls = table(spark, [(1, "a", "b", True, False), (2, "a", "b", False, True), (3, "c", "a", False, False), (4, "d", "zz", False, False), *extra], "site int, function string, callee string, supplies boolean, returns boolean")
    state = table(spark, [("k", "b", "write"), ("k", "d", "read"), ("k", "b", "read")], "key string, function string, role string")
    rel = L.compose(functions, calls, state, table(spark, [("d", "c")], "outer string, inner string"), table(spark, [], "declaration string, implementation string"))
    eff = table(spark, [("a", "IO", "OBSERVED", "x"), ("b", "IO", "INFERRED", "y"), ("c", "NET", "DERIVED", "z")], "function string, category string, status string, label string")
    cov = table(spark, [("src/x/a.rs", "CALL", "UNKNOWN"), ("src/x/b.rs", "CALL", "OBSERVED"), ("src/y/c.rs", "CALL", "UNSUPPORTED")], "path string, dimension string, status string")
    dep = table(spark, [("S2", "S1", True, True, 1, "CONFIRMED")], "src string, dst string, declared boolean, built boolean, calls int, verdict string")
    inv = table(spark, [("I1", "DEPENDENCY", "DERIVED", ["S1", "S2"], []), ("I2", "STATE", "OBSERVED", ["S1"], ["b"]), ("I3", "STATE", "OBSERVED", ["S1"], ["d"])], "id string, kind string, status string, scope array<string>, evidence array<string>")
    return L.World(functions, rel, eff, state, cov, dep, inv, table(spark, [("d", "nb", 2)], "function string, name string, n int"))


def test_world(spark):
    w = small_world(spark)
    rel = {(r["kind"], r["src"], r["dst"], r["weight"]) for r in w.relations.collect()}
    assert ("INVOKES", "a", "b", 2) in rel and ("SUPPLIES_DATA", "a", "b", 1) in rel and ("SUPPLIES_DATA", "b", "a", 1) in rel and ("STATE_FLOW", "b", "state:k", 1) in rel and ("ENCLOSES", "d", "c", 1) in rel
    s1 = L.resolve(w, "S1")
    assert {r["id"] for r in s1.functions.collect()} == {"a", "b"}
    assert {r["id"] for r in L.resolve(w, "fn:T::na").functions.collect()} == {"a"} and {r["id"] for r in L.resolve(w, "src/y").functions.collect()} == {"c", "d"} and {r["id"] for r in L.resolve(w, "state:k").functions.collect()} == {"b", "d"}
    for bad in ("subsystem:nope", "fn:nope", "state:nope", "no/such/path"):
        try:
            L.resolve(w, bad)
            raise AssertionError(bad)
        except L.UnknownSelector:
            pass
    assert {tuple(r) for r in L.effects(w, s1).collect()} == {("IO", 2, "OBSERVED", 2)}
    assert {(r["id"], r["depth"], r["reason"]) for r in L.frontier(w, s1).collect()} == {("c", 1, None), ("d", 1, "UNIQUE_NAME")}
    assert {(r["section"], r["item"]) for r in L.impact(w, [s1]).collect()} == {("component", "src/y/c.rs"), ("state_readers", "k"), ("invariant", "I1"), ("invariant", "I2")}
    assert [r["id"] for r in L.invariants(w, s1).collect()] == ["I2", "I1"]
    assert {(r["section"], r["item"], r["held"]) for r in L.compare(w, s1, L.resolve(w, "S2")).collect()} == {("effect", "IO", "only_a"), ("effect", "NET", "only_b"), ("state", "k", "shared")}
    assert {(r["direction"], r["counterpart"]) for r in L.boundary(w, s1).collect()} == {("in", "S2")}
    assert {(r["section"], r["detail"]) for r in L.why(w, s1, L.resolve(w, "S2")).collect()} == {("relation", "INVOKES"), ("dependency", "CONFIRMED"), ("invariant", "I1")}
    assert tuple(L.state_model(w, s1).first()) == ("k", 1, 0, 1, 1)
    assert [r["dst"] for r in L.trace(w, L.resolve(w, "fn:a"), L.resolve(w, "fn:d")).orderBy("step").collect()] == ["b", "state:k", "d"]
    assert {r["section"] for r in L.understand(w, s1).collect()} >= {"total", "effect", "state", "entry_point", "frontier"}
    assert L.plan(w, s1).count() > 0 and L.explain(w, s1).count() == 2 and L.dependencies(w, s1).count() == 1
    assert {(r["dimension"], r["n_unknown"]) for r in L.unknowns(w, s1).collect()} == {("CALL", 1), ("(calls)", 0)}


def test_closure_is_sound(spark):
    before, after = small_world(spark), small_world(spark, "abcde", extra=((9, "e", "a", False, False),))
    after_functions = after.functions
    closure = L.impact_closure(before, after, after_functions.where("id = 'e'").select("path"))
    assert {tuple(r) for r in closure.collect()} == {("e", "R1_SEED"), ("a", "R2_CALLEE")}
    assert L.outside_closure(before, after, closure).collect() == []
    assert {r["function"] for r in L.outside_closure(before, after, closure.limit(0)).collect()} == {"a", "e"}
