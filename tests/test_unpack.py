import pytest

from cairnwork.operators.unpack import unpack_values

PATHS = {
    "a/b.rs": ["a/b.rs"], "a/b.rs, c/d.ts": ["a/b.rs", "c/d.ts"], "a.rs;b.rs|c.rs\td.rs\ne.rs": ["a.rs", "b.rs", "c.rs", "d.rs", "e.rs"], "a.rs b.rs": ["a.rs", "b.rs"],
    '["a/x.rs", "caf\\u00e9/6\\" p.rs"]': ["a/x.rs", 'café/6" p.rs'], "['a.rs', 'v's-x.rs']": ["a.rs", "v's-x.rs"], "{a.rs,\"x|y.rs\"}": ["a.rs", "x|y.rs"], "[a/[slug]/b.ts]": ["a/[slug]/b.ts"], "[slug]/b.ts": ["[slug]/b.ts"],
    "`a.rs`; `6\" p/b.rs`": ["a.rs", '6" p/b.rs'], '"6"" p/x.rs", b.rs': ['6" p/x.rs', "b.rs"], "'read and write/a.rs' b.rs": ["read and write/a.rs", "b.rs"], "- a.rs\n- \"b, c.rs\"\n* d.rs": ["a.rs", "b, c.rs", "d.rs"], "• a.rs\n• b.rs": ["a.rs", "b.rs"],
    "a.rs, ,b.rs,": ["a.rs", "b.rs"], "; a.rs ;; b.rs": ["a.rs", "b.rs"], "x/C++/a.rs;@s/b.ts;(shop)/c.ts": ["x/C++/a.rs", "@s/b.ts", "(shop)/c.ts"], "vendor's-a.rs, b.rs": ["vendor's-a.rs", "b.rs"], "a.rs, none, b.rs": ["a.rs", "b.rs"],
    "a.rs and b.rs & c.rs + d.rs / e.rs": ["a.rs", "b.rs", "c.rs", "d.rs", "e.rs"], "a.rs, a.rs": ["a.rs", "a.rs"], "none": [], "N/A": [], "-": [], "?": [], "TBD": [], "[]": [], "{}": [], "": [], " \t": [], ",;|": [], '""': [], "\"open.rs": ['"open.rs'],
}
OTHERS = {
    "a.b.c/d.e.f": ["a.b.c", "d.e.f"], "a.b.c and d.e.f & g.h.i+j.k.l": ["a.b.c", "d.e.f", "g.h.i", "j.k.l"], "1/2 / 3": ["1", "2", "3"], "* vantor-report": ["vantor-report"], "vantor-* vantor-x-*": ["vantor-*", "vantor-x-*"],
    "{115}": ["115"], "['1', '2']": ["1", "2"], "n/a": [], "n/a / 7": ["7"], "android.x.y und and.or.y": ["android.x.y", "and.or.y"], "trésorerie.zählung.x": ["trésorerie.zählung.x"],
}


@pytest.fixture(scope="module")
def packed(spark):
    rows = [(k, "left", i, True) for i, k in enumerate(PATHS)] + [(k, "left", 1000 + i, False) for i, k in enumerate(OTHERS)] + [(None, "left", 5000, True)]
    return spark.createDataFrame(rows, "t string, item string, id int, p boolean")


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_cases(packed, limit):
    """With rules broadcast, and with none small enough for that."""
    got = {}
    for r in unpack_values(packed, "t", "p", ["id"], broadcast_bytes=limit).orderBy("id", "item_pos").collect():
        got.setdefault(r["id"], []).append(r["item"])
        assert r["item_pos"] == len(got[r["id"]])
    want = {i: v for i, v in enumerate(PATHS.values()) if v} | {1000 + i: v for i, v in enumerate(OTHERS.values()) if v}
    texts = list(PATHS) + list(OTHERS)
    for i in want | got:
        assert got.get(i) == want.get(i), texts[i] if i < 1000 else texts[len(PATHS) + i - 1000]


def test_long_and_empty(spark):
    items = [f"dir/{i}.rs" for i in range(20_000)]
    df = spark.createDataFrame([(1, ", ".join(items), True), (2, "x" * 300_000, True)], "id int, t string, p boolean")
    assert unpack_values(df, "t", "p", ["id"]).where("id = 1").count() == 20_000
    assert unpack_values(df.limit(0), "t", "p", ["id"]).collect() == []
