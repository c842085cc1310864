import datetime

from cairnwork.operators import world as L
from cairnwork.plans import lens


def architecture_tables(spark, folder, nodes, edges):
    at = datetime.datetime(2026, 1, 1)
    n = [(i, "function", crate, "m", f"src/{i}.rs", "verified", None, at) for i, crate in nodes]
    e = [(k, src, dst, kind, None, at) for k, (src, dst, kind) in enumerate(edges)]
    spark.createDataFrame(n, "id string, kind string, crate string, module_path string, file_path string, status string, deleted_at timestamp, synced_at timestamp").write.parquet(f"{folder}/architecture_node.parquet")
    spark.createDataFrame(e, "id long, from_node string, to_node string, kind string, evidence_ref string, synced_at timestamp").write.parquet(f"{folder}/architecture_edge.parquet")


def test_every_state_with_a_writer_has_its_invariant(spark, tmp_path):
    writers = [f"f{i}" for i in range(5)]
    nodes = [("hot", "other"), ("cold", "other"), ("idle", "other"), *((w, "mine" if w == "f4" else "other") for w in writers)]
    architecture_tables(spark, tmp_path, nodes, [*((w, "hot", "writes") for w in [*writers, "f4"]), ("f4", "cold", "writes"), ("f4", "idle", "reads")])
    w = lens.architecture_world(spark, str(tmp_path))
    held = w.invariants.selectExpr("id", "explode(evidence) as f").collect()
    assert sorted(map(tuple, held)) == sorted([("INV-STATE:cold", "f4"), *(("INV-STATE:hot", f) for f in writers)])
    for scope, ids in (("subsystem:mine", ["cold", "hot"]), ("subsystem:other", ["hot"])):
        s = L.resolve(w, scope)
        want = [f"INV-STATE:{k}" for k in ids]
        assert [r["id"] for r in L.invariants(w, s).collect()] == want
        assert sorted(r["item"] for r in L.impact(w, [s]).where("section = 'invariant'").collect()) == want
        assert sorted(r["item"] for r in L.understand(w, s).where("section = 'invariant'").collect()) == want
        assert sorted(r["item"] for r in L.plan(w, s).where("step = 'preserve'").collect()) == want
