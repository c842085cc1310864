import random

from pyspark.sql import functions as F

from cairnwork.operators.history import append_snapshot, differing_leaves, differing_updates, leaf_of, snapshot_changes, stored_history, version_history

SCHEMA = "key string, at long, o long, status string, blocker string, set_at string"


def brute(rows):
    by = {}
    for k, at, o, s, b, _ in rows:
        if k is not None and at is not None:
            by.setdefault(k, {}).setdefault(at, []).append((o, s or "", b or "", s, b))
    out = set()
    for k, instants in by.items():
        open_, since = None, None
        for at in sorted(instants):
            _, _, _, s, b = max(instants[at])
            new = None if s is None else (s, b)
            if new != open_:
                if open_ is not None:
                    out.add((k, *open_, since, at))
                open_, since = new, at
        if open_ is not None:
            out.add((k, *open_, since, None))
    return out


def history(spark, rows, period=10, **more):
    df = version_history(spark.createDataFrame(rows, SCHEMA), ["key"], "at", "o", ["status", "blocker"], F.col("status").isNotNull(), period, **more)
    assert df.columns == ["key", "status", "blocker", "valid_from", "valid_to"]
    return {tuple(r) for r in df.collect()}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None, "hot", "hot", "hot"]), rnd.choice([None, *range(120)]), i, rnd.choice(["x", "y", None]), rnd.choice([None, "p"]), "clash") for i in range(400)]
    assert history(spark, rows) == brute(rows)
    assert history(spark, rows + rows[:50], period=1000) == brute(rows)
    rnd.shuffle(rows)
    assert history(spark, rows, period=1) == brute(rows)


def test_edges(spark):
    assert history(spark, []) == set()
    assert history(spark, [("a", 1, 1, None, None, "")]) == set()  # a withdrawal alone
    assert history(spark, [("a", 1, 1, "x", None, ""), ("a", 5, 2, "x", None, ""), ("a", 9, 3, None, None, ""), ("a", 30, 4, "x", None, "")]) == {("a", "x", None, 1, 9), ("a", "x", None, 30, None)}
    assert history(spark, [("a", 1, 1, "x", None, ""), ("a", 1, 2, "y", None, "")]) == {("a", "y", None, 1, None)}
    assert history(spark, [("a", -5, 1, "x", "", "")]) == {("a", "x", "", -5, None)}


def test_merkle_descends_to_differing_leaves(spark):
    rows = [(0, i, i, i if i % 500 else i + 1) for i in range(0, 4096, 7)] + [(1, 5, None, 7), (1, 6, 3, None), (1, 7, 3, 3)]
    found = {tuple(r) for r in differing_leaves(spark.createDataFrame(rows, "snapshot int, leaf int, old long, new long")).collect()}
    assert found == {(0, i) for i in range(0, 4096, 7) if i % 500 == 0} | {(1, 5), (1, 6)}


def test_snapshot_changes(spark):
    old = spark.createDataFrame([(str(i), i, "x") for i in range(300)] + [(None, 1, "x")], "k string, v int, extra string")
    new = spark.createDataFrame([(str(i), i if i % 50 else -i - 1, "y") for i in range(10, 310)] + [("11", 11, "z")], "k string, v int, extra string")
    got = {(r["k"], r["change"]) for r in snapshot_changes(old, new, ["k"], ["v"]).collect()}
    assert got == {(str(i), "removed") for i in range(10)} | {(str(i), "added") for i in range(300, 310)} | {(str(i), "changed") for i in range(50, 300, 50)}
    assert snapshot_changes(old.limit(0), old.limit(0), ["k"], ["v"]).collect() == []


def test_leaves_are_in_range(spark):
    low, high = spark.range(5000).select(leaf_of("id").alias("l")).agg(F.min("l"), F.max("l")).first()
    assert 0 <= low and high < 4096


def test_hot_keys_are_cut_by_time(spark):
    rnd = random.Random(8)
    rows = [("hot" if i % 3 else "b", rnd.randint(0, 900), i, rnd.choice("xyz"), None, "") for i in range(900)]
    assert history(spark, rows, period=500, segment_rows=40) == brute(rows)


def test_unchanged_leaves_are_not_read(spark):
    """Updates that restate what held leave their leaf as it was; one change reads that leaf alone."""
    first = [(f"k{i}", 0, 1, i + 5) for i in range(200)]
    again = [(f"k{i}", 1, 11, i + 5) for i in range(200) if i != 7] + [("k7", 1, 11, 99), ("k7", 1, 12, 12), ("k8", 1, 13, 0), ("k8", 1, 14, 13)]
    df = spark.createDataFrame(first + again, "key string, _period long, _at long, _h long").withColumns({"_seg": F.col("_period"), "_s": F.struct("_h")})
    found = differing_updates(df, ["key"])[0].where("_period = 1").collect()
    leaves = {r["l"] for r in spark.createDataFrame([("k7",), ("k8",)], "key string").select(leaf_of("key").alias("l")).collect()}
    with_leaf = {r["key"] for r in df.withColumn("l", leaf_of("key")).where(F.col("l").isin(*leaves)).collect()}
    assert {"k7", "k8"} <= {r["key"] for r in found} <= with_leaf and len(found) < 12
    assert {(r["key"], r["_prev"]) for r in found if r["key"] in ("k7", "k8")} == {("k7", 12), ("k8", 13)}


def test_appended_snapshots(spark, tmp_path):
    folder = str(tmp_path / "h")
    frame = lambda d: spark.createDataFrame([(k, v, "x") for k, v in d.items()] + [(None, 1, "x")], "k string, v int, more string")
    states, at = [{f"k{i}": i for i in range(500)}], [10, 20, 30, 40]
    states.append(states[0] | {"k3": -1, "new": 1})
    states.append(dict(states[1]))
    states.append({k: v for k, v in states[2].items() if k != "k4"} | {"k3": 3})
    told = [append_snapshot(folder, frame(s), ["k"], ["v"], t) for s, t in zip(states, at)]
    assert told[0]["rows_read"] == 0 and told[2] == {"leaves": told[1]["leaves"], "changed": 0, "rows_read": 0}
    assert told[1]["changed"] == 2 and told[1]["rows_read"] < 30 and told[3]["rows_read"] < 30  # parts of changed branches alone
    got = {tuple(r) for r in stored_history(spark, folder, ["k"], ["v"]).collect()}
    want = {(f"k{i}", i, 10, None) for i in range(500) if i not in (3, 4)} | {("k3", 3, 10, 20), ("k3", -1, 20, 40), ("k3", 3, 40, None), ("k4", 4, 10, 40), ("new", 1, 20, None)}
    assert got == want
