import random

from test_lens import architecture_tables

from cairnwork.plans import graph_queries as Q

CHAIN = 9


def deep_tables(spark, folder, kinds):
    """A chain of nine steps from the crate, a cycle back, and edges at random; returns the seeds and the edges."""
    rnd = random.Random(5)
    names = [f"n{i:02d}" for i in range(30)]
    edges = [(f"n{i + 1:02d}", f"n{i:02d}", kinds[i % len(kinds)]) for i in range(CHAIN)] + [("n00", f"n{CHAIN:02d}", "calls")]
    edges += [(*rnd.sample(names[CHAIN:], 2), rnd.choice([*kinds, "reads"])) for _ in range(40)]
    architecture_tables(spark, folder, [(n, "vantor-core" if n == "n00" else "other") for n in names], edges)
    return {"n00"}, [e for e in edges if e[2] in kinds]


def layers(seeds, edges, weigh):
    """{node: (depth, weight)} by brute force: the least weight over all ways of least depth."""
    found, last, depth = {}, dict.fromkeys(seeds, 0), 0
    while last:
        depth += 1
        step = [(s, last[d] or weigh[k]) for s, d, k in edges if d in last and s not in seeds and s not in found]
        last = {n: min(w for m, w in step if m == n) for n, _ in step}
        found |= {n: (depth, w) for n, w in last.items()}
    return found


def test_upstream_has_no_bound(spark, tmp_path):
    weigh = {"calls": 0, "owns": 1, "guards": 2}
    want = layers(*deep_tables(spark, tmp_path, list(weigh)), weigh)
    assert max(d for d, _ in want.values()) > CHAIN
    got = Q.architecture_upstream(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((n, d, [None, "ENCLOSES", "DISPATCHES_TO"][w]) for n, (d, w) in want.items()), key=repr)


def test_dependents_have_no_bound(spark, tmp_path):
    weigh = {"calls": 0, "depends_on": 0}
    want = layers(*deep_tables(spark, tmp_path, list(weigh)), weigh)
    assert max(d for d, _ in want.values()) > CHAIN
    got = Q.architecture_dependents(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((n, d) for n, (d, _) in want.items())
