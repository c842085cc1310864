import json
import random
from itertools import permutations

from pyspark.sql import functions as F

from cairnwork.operators.drift import ELEMENT, MOVE, NODE, RENAME, RETYPE, assign, best_pairs, column_labels, edit_script, read_tree, schema_changes, top_level_changes, unified_table

SCHEMA = "feed string, n int, payload string, path string"
LEAF = ("string", {})


def test_assignment_is_least():
    rnd = random.Random(2)
    for n in range(1, 6):
        for m in (n, n + 2):
            for _ in range(20):
                c = [[rnd.randint(0, 9) for _ in range(m)] for _ in range(n)]
                got = assign(c)
                assert len(set(got)) == n
                assert sum(c[i][j] for i, j in enumerate(got)) == min(sum(c[i][p[i]] for i in range(n)) for p in permutations(range(m), n))


def test_assignment_of_many_fields():
    rnd = random.Random(4)
    gain = {(f"a{i}", f"b{j}"): 1.5 + rnd.random() for i in range(400) for j in range(300)}
    assert len(best_pairs(gain)) == 300


def size(t):
    return NODE + sum(map(size, t[1].values()))


def brute(a, b):
    """The least cost over all ways to pair children of paired nodes."""
    cost = RETYPE if a[0] != b[0] else 0
    xs, ys = list(a[1]), list(b[1])

    def pairings(i, free):
        if i == len(xs):
            return sum(size(b[1][y]) for y in free)
        best = size(a[1][xs[i]]) + pairings(i + 1, free)
        for y in free:
            best = min(best, (0 if xs[i] == y else RENAME) + brute(a[1][xs[i]], b[1][y]) + pairings(i + 1, free - {y}))
        return best

    return cost + pairings(0, frozenset(ys))


def tree(rnd, depth=0):
    if depth == 2 or rnd.random() < 0.4:
        return rnd.choice(["string", "number"]), {}
    return "object", {n: tree(rnd, depth + 1) for n in rnd.sample("abcd", rnd.randint(0, 3))}


def test_scripts_are_least():
    rnd = random.Random(11)
    for _ in range(400):
        a, b = ("object", {n: tree(rnd) for n in rnd.sample("abcd", 3)}), ("object", {n: tree(rnd) for n in rnd.sample("abcd", 3)})
        cost, steps = edit_script(a, b)
        moves = [s for s in steps if s[0] == "moved"]
        at = lambda t, p: at(t[1][p[0]], p[1:]) if p else t
        assert abs(cost + sum(2 * size(at(a, m[1])) - MOVE for m in moves) - brute(a, b)) < 1e-9
        price = {"retyped": lambda s: RETYPE, "renamed": lambda s: RENAME, "moved": lambda s: MOVE, "removed": lambda s: size(at(a, s[1])), "added": lambda s: size(at(b, s[2]))}
        assert abs(sum(price[s[0]](s) for s in steps) - cost) < 1e-9  # the steps are what the cost says
        assert all(at(a, m[1]) == at(b, m[2]) and m[1][-1] == m[2][-1] for m in moves)


def test_edit_scripts():
    t = read_tree("OBJECT<a: STRING, b: OBJECT<x: BIGINT, `we,ird: y`: ARRAY<STRING>>, c: VOID>")
    assert t == ("object", {"a": LEAF, "b": ("object", {"x": ("number", {}), "we,ird: y": ("array", {ELEMENT: LEAF})})})
    assert edit_script(t, t) == (0.0, [])
    old = ("object", {"a": LEAF, "b": LEAF, "c": ("object", {"x": LEAF})})
    new = ("object", {"a": ("number", {}), "d": LEAF, "c": ("object", {"y": LEAF}), "x": LEAF})
    cost, steps = edit_script(old, new, {("b", "d"): 3.0})
    assert ("renamed", ("b",), ("d",)) in steps and ("retyped", ("a",), ("a",)) in steps and ("renamed", ("c", "x"), ("c", "y")) in steps and ("added", None, ("x",)) in steps and 0 < cost < 4
    moved = edit_script(("object", {"p": ("object", {"k": LEAF, "z": LEAF}), "q": ("object", {})}), ("object", {"p": ("object", {"z": LEAF}), "q": ("object", {"k": LEAF})}))[1]
    assert moved == [("moved", ("p", "k"), ("q", "k"))]


def test_names_that_change_places():
    """Two renames are cheaper than matching equal names."""
    x, y = ("object", {"u": LEAF, "v": LEAF, "w": LEAF}), ("object", {"i": ("number", {}), "j": ("array", {ELEMENT: LEAF})})
    cost, steps = edit_script(("object", {"o": ("object", {"a": x, "b": y})}), ("object", {"o": ("object", {"a": y, "b": x})}))
    assert cost == 1.0 and {s[0] for s in steps} == {"renamed"} and len(steps) == 2
    top = edit_script(("object", {"a": x, "b": y}), ("object", {"a": y, "b": x}), {})[1]  # top-level names stand for themselves
    assert not any(s[0] == "renamed" and len(s[1]) == 1 for s in top)


def frame(spark, rows):
    return spark.createDataFrame([(f, n, p if p is None or isinstance(p, str) else json.dumps(p), "clash") for f, n, p in rows], SCHEMA)


def changes(spark, rows):
    found = top_level_changes(schema_changes(frame(spark, rows), "feed", "n", "donor", "payload"))
    return {(r["feed"], r["n"], r["change"], r["field"]) for r in found.collect()}


def test_changes(spark):
    rows = [
        ("f", 1, {"donor": "a", "x": 1, "y": "s", "gone": None, "z": 5}), ("f", 1, {"donor": "b", "x": 2, "y": "t"}), ("f", 1, "{broken"), ("f", 1, None), ("f", 1, "[1]"), ("f", 1, "7"),
        ("f", 3, {"donor": "a", "x2": 1, "y": 3, "z2": 6}), ("f", 3, {"donor": "c", "x2": 9}), ("f", 3, {"donor": "c", "x2": 9}),
        ("g", 1, {"donor": "a", "k": [1]}), ("g", 2, {"donor": "a", "k": [1], "X": 1}), ("g", 4, "nothing to read"),
        (None, 1, {"donor": "a", "q": 1}), (None, 2, {"donor": "a"}), ("g", None, {"v": 1}),
    ]
    want = {
        ("f", 3, "renamed", "x>x2"), ("f", 3, "retyped", "y"), ("f", 3, "removed", "z"), ("f", 3, "added", "z2"),
        ("g", 2, "added", "X"), ("g", 4, "removed", "X"), ("g", 4, "removed", "k"), ("g", 4, "removed", "donor"),
    }
    assert changes(spark, rows) == want
    random.Random(1).shuffle(rows)
    assert changes(spark, rows + rows) == want
    assert changes(spark, []) == set()


def test_moves_and_names_with_dots(spark):
    """A top-level field that turns up inside another is gone; a name may hold a dot or brackets."""
    rows = [("f", 1, {"x": "1", "meta": {"k": "v"}, "a.b": "1"}), ("f", 2, {"meta": {"k": "v", "x": "1"}}), ("f", 3, {"meta": {"k": "v"}, "x": "1", "c[]": 2}), ("f", 4, {"meta": {"k": "v"}, "x": "1", "c[]": "2"})]
    assert changes(spark, rows) == {("f", 2, "removed", "x"), ("f", 2, "removed", "a.b"), ("f", 3, "added", "x"), ("f", 3, "added", "c[]"), ("f", 4, "retyped", "c[]")}
    steps = {(r["change"], r["path"]) for r in schema_changes(frame(spark, rows[:2]), "feed", "n", "donor", "payload").collect()}
    assert steps == {("moved", "x>meta.x"), ("removed", "a.b")}


def test_renames_need_equal_values_everywhere(spark):
    rows = [
        ("f", 1, {"donor": "a", "x": 1, "y": 7, "p": [1, {"k": 2, "j": 3}]}), ("f", 1, {"donor": "b", "x": 2, "y": 8}),
        ("f", 2, {"donor": "a", "u": 1, "v": 7, "w": 7, "q": [1, {"j": 3, "k": 2}]}), ("f", 2, {"donor": "b", "u": 3, "v": 8}),
    ]
    # u holds another value than x in one record; both v and w hold what y held; key order is no difference
    assert changes(spark, rows) == {("f", 2, "removed", "x"), ("f", 2, "added", "u"), ("f", 2, "renamed", "y>v"), ("f", 2, "renamed", "y>w"), ("f", 2, "renamed", "p>q")}


def test_labels_follow_the_own_feed(spark):
    ch = [("f", 2, "renamed", ["a"], ["b"]), ("f", 4, "renamed", ["b"], ["c"]), ("f", 3, "added", None, ["a"]), ("g", 2, "renamed", ["a"], ["z"]), ("h", 2, "removed", ["a"], None), ("h", 4, "renamed", ["a"], ["y"]), ("h", 3, "added", None, ["a"]), ("i", 3, "renamed", ["b"], ["a"])]
    ch = spark.createDataFrame(ch, "feed string, n int, change string, old_path array<string>, new_path array<string>")
    fields = [("f", 1, "a"), ("f", 2, "b"), ("f", 3, "b"), ("f", 3, "a"), ("f", 4, "c"), ("f", 4, "a"), ("g", 1, "a"), ("g", 2, "z"), ("h", 1, "a"), ("h", 3, "a"), ("h", 4, "y"), ("i", 2, "a"), ("i", 2, "b")]
    got = {tuple(r) for r in column_labels(spark.createDataFrame(fields, "feed string, n int, field string"), ch, "feed", "n").collect()}
    assert got == {("f", 1, "a", "c"), ("f", 2, "b", "c"), ("f", 3, "b", "c"), ("g", 1, "a", "z"), ("h", 3, "a", "y"), ("i", 2, "b", None)}


def test_unified_table(spark):
    rows = [("f", 1, {"donor": "d", "sha": "x", "n": 1}), ("f", 2, {"donor": "d", "commitSha": "x", "n": "two", "Feed": {"b": 1, "a": 2}}), ("g", 1, {"sha": "p", "commitSha": "q"}), ("g", 1, "{oops"), ("g", 1, None), (None, None, {"sha": "lone"})]
    df = frame(spark, rows)
    ch = schema_changes(df, "feed", "n", "donor", "payload")
    got = {(r["feed"], r["n"]): r for r in unified_table(df, ch, "feed", "n", "payload", ["feed", "n"]).collect()}
    assert set(got) == {("f", 1), ("f", 2), ("g", 1), (None, None)}
    assert got["f", 1]["commitSha"] == "x" == got["f", 2]["commitSha"] and got["f", 1]["sha"] is None and got["f", 2]["n_"] == "two" and got["f", 1]["n_"] == "1"
    assert (got["g", 1]["sha"], got["g", 1]["commitSha"]) == ("p", "q")  # the rename of another feed has no say
    assert got[None, None]["sha"] == "lone" and json.loads(got["f", 2]["Feed_"]) == {"a": 2, "b": 1}
    few = unified_table(df, ch, "feed", "n", "payload", ["feed", "n"], max_columns=1)
    assert len(few.columns) == 4 and {k: v for r in few.where(F.col("feed") == "g").collect() for k, v in r["extra"].items()}.get("sha") == "p"
