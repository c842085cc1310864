import random
from collections import Counter
from itertools import permutations

import pytest

from cairnwork.operators import copydiff
from cairnwork.operators.copydiff import cost_bounds, diff_copies, min_cost_pairs

SCHEMA = "k string, a string, b string, extra int"


def cost(x, y):
    return sum(i != j for i, j in zip(x, y))


def brute(left, right):
    """Least total cost of pairing as many rows as the smaller bag has."""
    if len(left) > len(right):
        left, right = right, left
    return min((sum(cost(x, y) for x, y in zip(left, p)) for p in permutations(right, len(left))), default=0)


def test_flow_finds_the_least_cost():
    rnd = random.Random(5)
    for _ in range(150):
        fields = rnd.randint(1, 3)
        bag = lambda: [tuple(rnd.choice("xyz") for _ in range(fields)) for _ in range(rnd.randint(0, 5))]  # noqa: B023, E731
        left, right = bag(), bag()
        cl, cr = list(Counter(left).items()), list(Counter(right).items())
        pairs = min_cost_pairs([(n, v) for v, n in cl], [(n, v) for v, n in cr])
        assert sum(n for _, _, n in pairs) == min(len(left), len(right))
        used_l, used_r = Counter(), Counter()
        for i, j, n in pairs:
            used_l[i] += n
            used_r[j] += n
        assert all(n <= cl[i][1] for i, n in used_l.items()) and all(n <= cr[j][1] for j, n in used_r.items())
        assert sum(n * cost(cl[i][0], cr[j][0]) for i, j, n in pairs) == brute(left, right)


def textbook(left, right):
    """The least cost by another way: shortest augmenting paths on the whole matrix, one row a time."""
    from cairnwork.operators.drift import assign

    left, right = sorted((left, right), key=len)
    grid = [[cost(x, y) for y in right] for x in left]
    return sum(grid[i][j] for i, j in enumerate(assign(grid)))


@pytest.mark.parametrize("fields", [1, 2, 3, 5, 8])
def test_larger_bags_against_another_solver(fields):
    rnd = random.Random(fields)
    bag = lambda n: [tuple(rnd.choice("abcdef") for _ in range(fields)) for _ in range(n)]
    left, right = bag(90), bag(120)
    cl, cr = list(Counter(left).items()), list(Counter(right).items())
    pairs = min_cost_pairs([(n, v) for v, n in cl], [(n, v) for v, n in cr])
    assert sum(n for _, _, n in pairs) == 90
    assert sum(n * cost(cl[i][0], cr[j][0]) for i, j, n in pairs) == textbook(left, right)


def test_many_classes_in_one_task():
    rnd = random.Random(1)
    side = lambda: [(1, (rnd.randint(0, 40), rnd.randint(0, 40))) for _ in range(600)]
    assert sum(n for _, _, n in min_cost_pairs(side(), side())) == 600


def run(spark, left, right, **more):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    return diff_copies(frame(left), frame(right), ["k"], ["a", "b"], **more).collect()


def test_cases(spark):
    left = [("same", "1", "2", 0), ("one", "1", "2", 0), ("l", "1", None, 0), ("twice", "1", "1", 1), ("twice", "1", "1", 2), (None, "n", None, 0), ("nul", None, None, 0)]
    right = [("same", "1", "2", 9), ("one", "1", "3", 0), ("r", None, None, 0), ("twice", "1", "1", 3), (None, "n", None, 5), ("nul", None, "x", 0)]
    got = {(r["k"], tuple(r["left"]) if r["left"] else None, tuple(r["right"]) if r["right"] else None, r["n"], tuple(r["differing"])) for r in run(spark, left, right)}
    assert got == {("one", ("1", "2"), ("1", "3"), 1, ("b",)), ("l", ("1", None), None, 1, ()), ("r", None, (None, None), 1, ()), ("twice", ("1", "1"), None, 1, ()), ("nul", (None, None), (None, "x"), 1, ("b",))}


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert len(run(spark, [("a", "1", "1", 0)], [])) == 1
    assert len(run(spark, [], [("a", "1", "1", 0)])) == 1


@pytest.mark.parametrize("pair_work", [10**6, 3])
def test_bags_of_a_key(spark, pair_work):
    """In one task, and for keys above the bound in chunks: rows are kept whole either way."""
    rnd = random.Random(7)
    make = lambda: [(rnd.choice("pq"), rnd.choice(["x", "y", None]), rnd.choice("uvw"), 0) for _ in range(14)]
    left, right = make(), make()
    got = run(spark, left, right, pair_work=pair_work)
    for k in "pq":
        mine = [r for r in got if r["k"] == k]
        cl, cr = (Counter((r[1], r[2]) for r in rows if r[0] == k) for rows in (left, right))
        lo, ro = list((cl - cr).elements()), list((cr - cl).elements())
        back_l = Counter({tuple(r["left"]): 0 for r in mine if r["left"]})
        back_r = Counter()
        for r in mine:
            if r["left"]:
                back_l[tuple(r["left"])] += r["n"]
            if r["right"]:
                back_r[tuple(r["right"])] += r["n"]
        assert back_l == Counter(lo) and back_r == Counter(ro)
        paired = [r for r in mine if r["left"] and r["right"]]
        assert sum(r["n"] for r in paired) == min(len(lo), len(ro))
        assert all(len(r["differing"]) == cost(r["left"], r["right"]) for r in paired)
        if pair_work > 3 and len(lo) <= 7 and len(ro) <= 7:
            assert sum(r["n"] * len(r["differing"]) for r in paired) == brute(lo, ro)


def test_hot_keys_in_chunks(spark):
    """A key too large for one task, with many fields: nothing is lost, all that can be is paired, near the bound."""
    rnd = random.Random(3)
    fields = ["a", "b", "c", "d"]
    make = lambda n: [("hot", *(rnd.choice("uvwxyz") for _ in fields)) for _ in range(n)]
    left, right = make(300), make(260)
    frames = [spark.createDataFrame(rows, "k string, " + ", ".join(f"{f} string" for f in fields)) for rows in (left, right)]
    got = diff_copies(*frames, ["k"], fields, pair_work=900)
    rows = got.collect()
    cl, cr = Counter(r[1:] for r in left), Counter(r[1:] for r in right)
    back = [Counter(), Counter()]
    for r in rows:
        for side, c in zip(("left", "right"), back):
            if r[side]:
                c[tuple(r[side])] += r["n"]
    assert back[0] == cl - cr and back[1] == cr - cl
    lo, ro = list((cl - cr).elements()), list((cr - cl).elements())
    paired = sum(r["n"] for r in rows if r["left"] and r["right"])
    assert paired == min(len(lo), len(ro))
    bounds = cost_bounds(got, ["k"], fields).first()
    best = textbook(lo, ro)
    assert bounds["n_pairs"] == paired and bounds["least"] <= best <= bounds["cost"] <= 1.5 * best


@pytest.mark.parametrize("members", [1 << 24, 20])
def test_ways_to_look_up_costs_give_the_same_pairs(monkeypatch, members):
    """From a matrix, by groups of equal values, and from a matrix where the groups would take too much."""
    monkeypatch.setattr(copydiff, "_MEMBERS", members)
    monkeypatch.setattr(copydiff, "_PIECE", 50)
    rnd = random.Random(11)
    for _ in range(60):
        fields, letters = rnd.randint(1, 5), "abcdefgh"[: rnd.randint(1, 8)]
        bag = lambda n: [(n, v) for v, n in Counter(tuple(rnd.choice(letters) for _ in range(fields)) for _ in range(n)).items()]  # noqa: B023, E731
        left, right = bag(rnd.randint(0, 60)), bag(rnd.randint(0, 60))
        assert min_cost_pairs(left, right, matrix=0) == min_cost_pairs(left, right)


def test_size_does_not_change_the_result(spark):
    """The least cost and the same pairs, whether a key's classes are few or many by `pair_work`."""
    rnd = random.Random(3)
    fields = ["a", "b", "c", "d"]
    make = lambda n: [("hot", *(rnd.choice("uvwxyz") for _ in fields)) for _ in range(n)]
    left, right = make(300), make(260)
    frames = [spark.createDataFrame(rows, "k string, " + ", ".join(f"{f} string" for f in fields)) for rows in (left, right)]
    few, many = (diff_copies(*frames, ["k"], fields, pair_work=w).collect() for w in (10**9, 1))
    assert sorted(few, key=repr) == sorted(many, key=repr)
    cl, cr = Counter(r[1:] for r in left), Counter(r[1:] for r in right)
    assert sum(r["n"] * len(r["differing"]) for r in many) == textbook(list((cl - cr).elements()), list((cr - cl).elements()))


def test_not_a_number_is_no_null(spark):
    left, right = ([("k", float("nan"), "1"), ("k", None, "2")], [("k", None, "3"), ("k", float("nan"), "4")])
    got = diff_copies(*(spark.createDataFrame(x, "k string, a double, b string") for x in (left, right)), ["k"], ["a", "b"]).collect()
    assert sorted((r["left"]["b"], r["right"]["b"], *r["differing"]) for r in got) == [("1", "4", "b"), ("2", "3", "b")]
