import datetime as dt
import json
import struct

import pytest
from pyspark.sql import functions as F

from cairnwork.plans.sqlapi import RefusedStatement, read_only_sql
from cairnwork.sources import catalogue, inventory, records
from cairnwork.streaming import incremental as I


def test_inventory(spark, tmp_path):
    for name, text in (("src/a.rs", "fn"), ("src/deep/b.PNG", "x"), ("target/skip.rs", "x"), ("top.xyz", "y"), ("noext", "z")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["path"]: (r["language"], r["disposition"], r["reason"]) for r in inventory.scan_inventory(spark, str(tmp_path)).collect()}
    assert got == {"src/a.rs": ("rust", "parsed", None), "src/deep/b.PNG": (None, "classified", "image"), "top.xyz": (None, "classified", ".xyz"), "noext": (None, "classified", "(no extension)")}
    some = {r["path"]: r["disposition"] for r in inventory.scan_inventory(spark, str(tmp_path), ["src/deep", "../..", "nowhere"]).collect()}
    assert some == {"src/deep/b.PNG": "classified", "../..": "rejected", "nowhere": "missing"}
    assert [tuple(r) for r in inventory.long_files(spark.createDataFrame([("a", "1\n2\n3"), ("b", "1")], "p string, t string"), "p", "t", 2).collect()] == [("a", 3)]


def test_record_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\n{broken\n[1]\n{"a": 2}\n')
    good, bad = records.read_json_lines(spark, str(tmp_path), "a int, b string")
    assert sorted((r["a"], r["b"]) for r in good.collect()) == [(1, "x"), (2, None)] and sorted(r["text"] for r in bad.collect()) == ["[1]", "{broken"]
    assert records.read_json_lines(spark, str(tmp_path))[0].columns == ["source_file", "a", "b"]
    docs = spark.createDataFrame([(1, 'pre\n```json\n{"k": "v", "n": 3}\n```\nmid\n```json\nnope\n```\n```json\n{"n": 1}\n```'), (2, None)], "id int, t string")
    got = {r["block"]: (r["defect"], r["k"], r["n"]) for r in records.fenced_records(docs, "id", "t", "k string, n int", ["k"]).collect()}
    assert got == {0: (None, "v", 3), 1: ("no json", None, None), 2: ("lacks k", None, None)}
    md = spark.createDataFrame([(1, "| a | b |\n|---|:-:|\n| 1 | x y |\ntext | no")], "id int, t string")
    assert [(r["line_no"], r["cells"]) for r in records.table_rows(md, "id", "t").orderBy("line_no").collect()] == [(1, ["a", "b"]), (3, ["1", "x y"])]
    lock = spark.createDataFrame([(1, '[[package]]\nname = "a"\nversion = "1"\nsource = "reg"\ndependencies = [\n "b",\n "c 2",\n]\n\n[[package]]\nname = "b"\nversion = "2"\n')], "id int, t string")
    assert {(r["name"], r["source"], r["dependency"]) for r in records.lock_packages(lock, "id", "t").collect()} == {("a", "reg", "b"), ("a", "reg", "c 2"), ("b", None, None)}


def test_tensors(spark):
    def blob(header, data):
        h = json.dumps(header).encode()
        return struct.pack("<Q", len(h)) + h + data

    files = [("ok", bytearray(blob({"w": {"dtype": "F32", "shape": [2, 2], "data_offsets": [0, 16]}, "__metadata__": {}}, b"\0" * 16))), ("bad", bytearray(b"xx")), ("size", bytearray(blob({"w": {"dtype": "F16", "shape": [3], "data_offsets": [0, 4]}}, b"\0" * 4)))]
    got = {r["path"]: (r["name"], r["bits"], r["defect"]) for r in records.tensor_catalogue(spark.createDataFrame(files, "p string, c binary"), "p", "c").collect()}
    assert got["ok"] == ("w", 32, None) and got["bad"][2].startswith("unreadable") and got["size"][2] == "size does not fit the shape"


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert catalogue.write_once(df, p) == "created" and catalogue.write_once(df, p) == "identical"
    with pytest.raises(catalogue.ConflictingReplay):
        catalogue.write_once(df.union(df), p)
    assert catalogue.full_sync(spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), p, ["k"]) == {"added": 1, "updated": 1, "deleted": 1}
    assert catalogue.insert_or_ignore(spark.createDataFrame([("b", 9), ("d", 5), ("d", 6)], "k string, v int"), p, ["k"]) == 1
    catalogue.insert_or_replace(spark.createDataFrame([("b", 7, 1), ("b", 8, 2)], "k string, v int, o int").drop("o").withColumn("v", F.col("v")), p, ["k"], "v")
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [("b", 8), ("c", 4), ("d", 5)]
    j = str(tmp_path / "j")
    catalogue.write_json_lines(df, j, ["k"])
    assert [r[0] for r in spark.read.text(j).collect()] == ['{"k":"a","v":1}', '{"k":"b","v":2}']
    empty, full = tmp_path / "e", tmp_path / "f"
    df.limit(0).write.parquet(str(empty / "t.parquet"))
    df.write.parquet(str(full / "t.parquet"))
    assert catalogue.first_present(spark, "t", [str(tmp_path / "none"), str(empty), str(full)]).count() == 2
    assert catalogue.first_present(spark, "t", [str(full)], ["missing"]) is None
    assert catalogue.rows_table(spark, [{"b": 1, "a": "x"}, {"a": "y"}]).columns == ["a", "b"]
    rows, twice = catalogue.merge_shards([("l1", df.withColumn("ver", F.lit(1))), ("l2", df.limit(1).withColumn("ver", F.lit(1)))], "k", "ver")
    assert rows.count() == 3 and [tuple(r) for r in twice.collect()] == [("a", 2, "l1,l2")]
    with pytest.raises(catalogue.ConflictingReplay):
        catalogue.merge_shards([("l1", df.withColumn("ver", F.lit(1))), ("l2", df.withColumn("ver", F.lit(2)))], "k", "ver")


def test_read_only(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert read_only_sql(spark, "with x as (select * from three) select count(*) c from x;").first()[0] == 3
    assert read_only_sql(spark, "select 'drop table x; --' as s").first()[0] == "drop table x; --"
    for bad in ("drop table three", "select 1; drop table three", "create view v as select 1", "with x as (select 1) insert into t select * from x", ""):
        with pytest.raises(RefusedStatement):
            read_only_sql(spark, bad)


def test_incremental(spark, tmp_path):
    src, snap = str(tmp_path / "in"), str(tmp_path / "snap")
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], "k int, at int, v string").write.parquet(src)
    stream = I.watch_folder(spark, src, "k int, at int, v string")
    I.maintain_snapshot(stream, snap, ["k"], "at", str(tmp_path / "ck"), compact=2).awaitTermination()
    for more in ([(1, 1, "late"), (3, 9, "d")], [(2, 5, "e")], [(4, 1, "f")]):
        spark.createDataFrame(more, "k int, at int, v string").write.mode("append").parquet(src)
        I.maintain_snapshot(I.watch_folder(spark, src, "k int, at int, v string"), snap, ["k"], "at", str(tmp_path / "ck"), compact=2).awaitTermination()
    assert sorted((r["k"], r["v"]) for r in I.read_snapshot(spark, snap, ["k"], "at").collect()) == [(1, "c"), (2, "e"), (3, "d"), (4, "f")]
    assert sum(p.name.startswith("base=") for p in (tmp_path / "snap").iterdir()) == 1 and I.read_snapshot(spark, str(tmp_path / "none"), ["k"], "at") is None
    ledger = str(tmp_path / "ledger")
    I.append_ledger(I.watch_folder(spark, src, "k int, at int, v string"), ledger, str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(ledger).count() == 7


def test_memo_and_leases(spark):
    calls = []

    def derive(df):
        calls.append(df.count())
        return df.select("d", F.length("d").alias("n"), "derived_by")

    docs = spark.createDataFrame([("x",), ("x",), ("yy",)], "d string")
    out, fresh = I.memoised(docs, None, "d", "v1", derive)
    again, more = I.memoised(docs.union(spark.createDataFrame([("zzz",)], "d string")), fresh, "d", "v1", derive)
    assert calls == [2, 1] and sorted(r["n"] for r in again.collect()) == [1, 2, 3] and more.count() == 1
    I.memoised(docs, fresh, "d", "v2", derive)
    assert calls[-1] == 2
    now = dt.datetime(2024, 1, 2)
    l = spark.createDataFrame([("1", "ACTIVE", dt.datetime(2024, 1, 1)), ("2", "ACTIVE", now), ("3", "ACTIVE", None), ("4", "DONE", dt.datetime(2023, 1, 1))], "lease_id string, status string, expires_at timestamp_ntz")  # noqa: E741
    assert {r["lease_id"]: r["state"] for r in I.lease_states(l, F.lit(now).cast("timestamp_ntz")).collect()} == {"1": "EXPIRED", "2": "EXPIRED", "3": "ACTIVE", "4": "DONE"}
    claims = spark.createDataFrame([("n", "a/b")], "lease_id string, path string")
    held = spark.createDataFrame([("x", "a"), ("y", "a/b/c"), ("z", "a/bc")], "lease_id string, path string")
    assert {r["held_by"] for r in I.claim_conflicts(claims, held).collect()} == {"x", "y"}
