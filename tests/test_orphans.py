import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairnwork.operators.orphans import orphan_counts, orphan_references


@pytest.mark.parametrize("share", [1 / 8, 1e9, 1e-9])  # some heavy keys, none, all
def test_against_brute_force(spark, share):
    rnd = random.Random(4)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    parents = {(t, str(i)): (rnd.random() < 0.3, rnd.choice([None, day(rnd.randint(0, 60))])) for t in "pq" for i in range(20)}
    kids = [(i, rnd.choice("pq"), rnd.choice(["0", "0", "0", None, *map(str, range(25))]), rnd.choice([None, day(rnd.randint(0, 60))])) for i in range(500)]
    kids += kids[:20]
    child = spark.createDataFrame(kids, "id long, t string, ref string, at timestamp_ntz").withColumns({"month": F.date_format("at", "yyyy-MM"), "n": F.lit(1), "deleted": F.lit("x"), "defect": F.lit("y")})
    parent = spark.createDataFrame([(t, r, d, c, 1) for (t, r), (d, c) in parents.items()], "t string, ref string, deleted boolean, created_at timestamp_ntz, id long")
    want = []
    for i, t, r, at in kids:
        if r is None:
            continue
        p = parents.get((t, r))
        defect = "missing" if p is None else "deleted" if p[0] else "late" if p[1] and at and p[1] > at else None
        if defect:
            want.append((i, t, r, at, defect))
    found = orphan_references(child, parent, ["t", "ref"], "at", ["month"], share)
    got = [(r["id"], r["t"], r["ref"], r["at"], r["defect"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    counts = {(r["month"], r["defect"]): r["n_rows"] for r in orphan_counts(child, parent, ["t", "ref"], "at", ["month"], share).collect()}
    assert counts == Counter((at.strftime("%Y-%m") if at else None, d) for *_, at, d in want)
    whole = orphan_counts(child, parent, ["t", "ref"], "at", ["t"], share)  # groups that hold undated rows
    assert {(r["t"], r["defect"]): r["n_rows"] for r in whole.collect()} == Counter((t, d) for _, t, _, _, d in want)


def test_empty(spark):
    child = spark.createDataFrame([], "id long, ref string, at timestamp_ntz")
    parent = spark.createDataFrame([], "ref string, deleted boolean, created_at timestamp_ntz")
    assert orphan_references(child, parent, ["ref"], "at", []).collect() == []
    one = spark.createDataFrame([(1, "x", None)], "id long, ref string, at timestamp_ntz")
    assert [r["defect"] for r in orphan_references(one, parent, ["ref"], "at", []).collect()] == ["missing"]
