import random

from cairnwork.llm.mixing import SourcePlan, mix_sources, plan_sizes

TARGETS = [("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 1), ("none", 0.0, 5), ("absent", 0.1, 2)]
S_SCHEMA, T_SCHEMA = "doc_id long, source string, n_tokens long, repeats string", "source string, target_share double, max_repeats int"


def test_sizes():
    plans = [SourcePlan("a", 0.5, 2, 1000, 10), SourcePlan("b", 0.5, 4, 100, 5)]
    assert plan_sizes(plans) == 800 and (plans[0].want, plans[0].full, plans[1].want, plans[1].full) == (400, 0, 400, 4)
    plan_sizes(plans, 10_000)
    assert (plans[0].want, plans[1].want) == (2000, 400)
    assert plan_sizes([SourcePlan("x", 1.0, 2, 0, 0)]) == 0


def mixed(spark, docs, targets=TARGETS, **more):
    mix, report = mix_sources(spark.createDataFrame(docs, S_SCHEMA), spark.createDataFrame(targets, T_SCHEMA), **more)
    return {r["doc_id"]: r["repeats"] for r in mix.collect()}, {r["source"]: r for r in report.collect()}, mix


def test_shares_and_caps(spark):
    rnd = random.Random(9)
    docs = [(i, rnd.choice(["a"] * 6 + ["b", "c", "other", None]), rnd.choice([0, 1, rnd.randint(1, 400), None]), "clash") for i in range(4000)]
    repeats, report, mix = mixed(spark, docs)
    weight = 1.0
    total = sum(r["tokens_in_mix"] for r in report.values())
    for s, share, cap in TARGETS[:3]:
        own = [(i, n or 0) for i, src, n, _ in docs if src == s]
        used = {repeats.get(i, 0) for i, _ in own}
        assert max(used) <= cap and max(used) - min(used) <= 1
        assert report[s]["tokens_in_mix"] == sum(n * repeats.get(i, 0) for i, n in own)
        assert abs(report[s]["tokens_in_mix"] / total - share / weight) < 401 / total + 1e-9
        assert report[s]["tokens_available"] == sum(n for _, n in own)
    assert any(r["binds"] for r in report.values()) and not report["absent"]["binds"]
    assert report["absent"]["tokens_in_mix"] == 0 and report["absent"]["actual_share"] == 0
    assert not {i for i, s, _, _ in docs if s in ("other", None)} & repeats.keys()
    assert mix.columns == ["doc_id", "source", "n_tokens", "repeats"]
    again, _, _ = mixed(spark, list(reversed(docs)))
    assert again == repeats


def test_total_is_honoured_or_capped(spark):
    docs = [(i, "a" if i % 2 else "b", 10, "") for i in range(1000)]
    _, report, _ = mixed(spark, docs, [("a", 0.5, 2), ("b", 0.5, 2)], total=4000)
    assert abs(report["a"]["tokens_in_mix"] - 2000) <= 5 and abs(report["b"]["tokens_in_mix"] - 2000) <= 5
    repeats, report, _ = mixed(spark, docs, [("a", 0.9, 1), ("b", 0.1, 1)], total=8000)
    assert report["a"]["tokens_in_mix"] == 5000 and set(repeats.values()) == {1}


def test_empty(spark):
    repeats, report, _ = mixed(spark, [])
    assert repeats == {} and all(r["tokens_in_mix"] == 0 and r["actual_share"] is None for r in report.values())
    assert mixed(spark, [(1, "a", 5, "")], [])[:2] == ({}, {})
    assert mixed(spark, [(1, "a", 5, ""), (1, "a", 5, "")], [("a", 1.0, 2)])[0] == {1: 2}
