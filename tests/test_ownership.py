import random

import pytest
from pyspark.sql import functions as F

from cairnwork.operators import joins
from cairnwork.operators import ownership as O
from cairnwork.operators.joins import best_token_overlap, phrase_mentions


def related(p, q):
    return p == q or p.startswith(q + "/") or q.startswith(p + "/")


def test_forbidden_paths(spark):
    rnd = random.Random(3)
    path = lambda: "/".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4)))
    own, ban = ([(rnd.choice("pqr"), path()) for _ in range(25)] for _ in range(2))
    frame = lambda rows: spark.createDataFrame([*rows, *rows[:3], (None, "a"), ("p", None)], "task string, path string")
    got = dict(O.forbidden_paths(frame(own), frame(ban)).collect())
    assert got == {t: sum(1 for o, p in set(own) if o == t for u, q in set(ban) if u != t and related(p, q)) for t in {o for o, _ in own}}
    assert O.forbidden_paths(frame(own).limit(0), frame(ban)).collect() == []


def test_shared_file_conflicts(spark):
    rnd = random.Random(4)
    tasks = {t: rnd.random() < 0.4 for t in "abcdefgh"}
    allows = {(a, b) for a in tasks for b in tasks if rnd.random() < 0.6}
    got = dict(O.shared_file_conflicts(spark.createDataFrame([*tasks.items(), (None, True)], "task string, shared boolean"), spark.createDataFrame([*allows, *list(allows)[:5]], "task string, other string")).collect())
    assert got == {a: sum(a != b and (tasks[a] or tasks[b]) and not ((a, b) in allows and (b, a) in allows) for b in tasks) for a in tasks}


def test_exceptions(spark):
    scan = spark.createDataFrame([("live", "LIVE", "1"), ("plain", "LIVE", "1"), ("none", "ISLAND", "1"), ("good", "ISLAND", "1"), ("old", "ISLAND", "1"), ("moved", "ISLAND", "2"), ("null", "ISLAND", None)], "unit string, status string, fingerprint string")
    given = spark.createDataFrame([("live", "1", 9), ("good", "1", 9), ("good", "0", 3), ("old", "1", 2), ("moved", "1", 9), ("null", None, None), (None, "1", 9)], "unit string, fingerprint string, expires int")
    got = {r["unit"]: (r["final_status"], r["exception"]) for r in O.apply_exceptions(scan, given, F.lit(5)).collect()}
    assert got == {"live": ("LIVE", "STALE_LIVE"), "plain": ("LIVE", None), "none": ("BLOCKED", None), "good": ("EXCEPTED", "GRANTED"), "old": ("BLOCKED", "EXPIRED"), "moved": ("BLOCKED", "STALE_FINGERPRINT"), "null": ("BLOCKED", "EXPIRED")}


def test_hot_words_make_no_pairs(spark):
    rnd = random.Random(6)
    words = ["hot", "warm", *(f"w{i}" for i in range(8))]
    name = lambda: " ".join(rnd.sample(words[:2], rnd.randint(0, 2)) + rnd.sample(words[2:], rnd.randint(0, 3)))
    left, right = ({name() for _ in range(40)} for _ in range(2))
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in sorted(rows)] + [(None,)], f"{c} string")
    shared = lambda a, b: len(set(a.split()) & set(b.split()))
    want = {a: max((shared(a, b), [-ord(c) for c in b], b) for b in right) for a in left}
    want = {(a, min(b for b in right if shared(a, b) == n), n) for a, (n, _, _) in want.items() if n}
    for limit in (10_000, 12, 0):
        assert {tuple(r) for r in best_token_overlap(frame(left, "l"), "l", frame(right, "r"), "r", hot_names=limit).collect()} == want


def test_phrases(spark):
    texts = spark.createDataFrame([(1, "The file-lock, and FILE  lock again."), (2, "file a lock; lock"), (3, None), (4, ""), (1, "file lock"), (5, "profile lock file")], "id int, t string")
    needles = spark.createDataFrame([("file_lock",), ("Lock",), ("file_lock",), (None,), ("--",), ("lock and file",), ("lock again x",)], "n string")
    assert {tuple(r) for r in phrase_mentions(texts, "id", "t", needles, "n").collect()} == {(1, "file_lock"), (1, "Lock"), (2, "Lock"), (5, "Lock"), (1, "lock and file")}
    assert phrase_mentions(texts.limit(0), "id", "t", needles, "n").collect() == []


def shuffled_bytes(plan):
    """Bytes that the exchanges of a plan that has run wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_bytes(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_bytes(plan.plan())
    below = plan.children()
    own = plan.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(shuffled_bytes(below.apply(i)) for i in range(below.size()))


@pytest.mark.parametrize("broadcast", [True, False])
def test_phrases_move_no_texts(spark, monkeypatch, broadcast):
    """With few phrases or with so many that they join by shuffle."""
    if not broadcast:
        monkeypatch.setattr(joins, "broadcast_if_small", lambda df: df)
    rnd = random.Random(4)
    bodies = [[f"w{rnd.randint(0, 2000)}" for _ in range(500)] for _ in range(40)]
    phrases = [["w7"], ["w7", "w7"], ["none", "such"], *(b[k : k + n] for b, k, n in zip(bodies, (0, 9, 498, 495, 100), (1, 2, 2, 5, 12)))]
    texts = spark.createDataFrame([(i, ", ".join(b).upper()) for i, b in enumerate(bodies)] + [(0, None), (1, "--")], "id int, t string")
    got = phrase_mentions(texts, "id", "t", spark.createDataFrame([("_".join(p),) for p in phrases], "n string"), "n")
    holds = lambda b, p: any(b[k : k + len(p)] == p for k in range(len(b)))
    assert {tuple(r) for r in got.collect()} == {(i, "_".join(p)) for i, b in enumerate(bodies) for p in phrases if holds(b, p)}
    assert shuffled_bytes(got._jdf.queryExecution().executedPlan()) < sum(len(" ".join(b)) for b in bodies)
    assert phrase_mentions(texts, "id", "t", spark.createDataFrame([(None,), ("-",)], "n string"), "n").collect() == []
