import json

import pytest

from conftest import FILE
from factloom import sinks
from factloom.operators import relational as rel
from factloom.streaming import incremental


def test_write_facts_replaces_only_its_files(spark, tmp_path):
    path = str(tmp_path / "facts")
    sinks.write_facts(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "file_id string, v int"), path, 2)
    sinks.write_facts(spark.createDataFrame([("a", 2), ("d", 2)], "file_id string, v int"), path, 2)
    assert {(r.file_id, r.v) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1), ("c", 1), ("d", 2)}


def test_upsert_and_cascade(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "file_id string, v int")
    assert {tuple(r) for r in sinks.upsert(old, spark.createDataFrame([("a", 2)], "file_id string, v int"), ["file_id"]).collect()} == {("a", 2), ("b", 1)}
    files = spark.createDataFrame([("a", "p"), ("b", "q")], "file_id string, project_id string")
    got = sinks.cascade("p", {"facts": old, "files": files}, files)
    assert [r.file_id for r in got["facts"].collect()] == ["b"] and [r.file_id for r in got["files"].collect()] == ["b"]


def test_exports(spark):
    e = spark.createDataFrame([('a"<x>', "b", "confirmed"), ("b", "c", "inferred")], "src string, dst string, style string")
    assert '"a&quot;&lt;x&gt;"' in sinks.mermaid(e) and "-.->" in sinks.mermaid(e) and "style=dashed" in sinks.dot(e)
    assert json.loads(sinks.graph_json(e))["nodes"] == ['a"<x>', "b", "c"]
    with pytest.raises(ValueError):
        sinks.dot(e, 1)


def test_incremental_plan(spark):
    old = spark.createDataFrame([("a", "1", "v"), ("b", "1", "v"), ("h", "1", "v"), ("gone", "1", "v"), ("o", "1", "old")], "file_id string, content_hash string, analyzer_version string")
    new = spark.createDataFrame([("a", "1", False), ("b", "1", False), ("h", "2", True), ("n", "1", False), ("o", "1", False)], "file_id string, content_hash string, is_header boolean")
    inc = spark.createDataFrame([("a", "h2"), ("h2", "h")], "src string, dst string")
    got = {r.file_id: r.action for r in incremental.plan(old, new, inc, "v").collect()}
    assert got == {"a": "analyze", "b": "keep", "h": "analyze", "n": "analyze", "gone": "remove", "o": "analyze"}


def test_stream_keeps_latest(spark, tmp_path):
    schema = spark.createDataFrame([], FILE).schema
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, (i, day) in enumerate([("a", 1), ("a", 3), ("a", 2), ("b", 1)]):
        row = spark.sql(f"SELECT '{i}' AS file_id, 'p' AS project_id, 'x{day}.py' AS relative_path, 'python' AS language, 'h' AS content_hash, timestamp_ntz'2024-01-0{day} 00:00:00' AS last_analyzed_at, 'analyzed' AS analysis_status, 'v' AS analyzer_version")
        row.write.mode("append").parquet(src)
        incremental.latest_from_stream(spark, src, schema, out, str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.file_id, r.relative_path) for r in spark.read.parquet(out).collect()} == {("a", "x3.py"), ("b", "x1.py")}


def test_coupling_and_prefix(spark):
    c = spark.createDataFrame([(k, p) for k in range(3) for p in "xyx"] + [(9, f"f{i}") for i in range(40)] + [(8, "x")], "commit int, path string")
    assert [tuple(r) for r in rel.coupling(c).collect()] == [("x", "y", 3)]
    names = spark.createDataFrame([("os.path.join",), ("osx",), (None,)], "name string")
    d = spark.createDataFrame([("os", "fs"), ("os.path", "path")], "prefix string, category string")
    assert [tuple(r) for r in rel.longest_prefix(names, d).collect()] == [("os.path.join", "os.path", "path")]


def test_twins(spark):
    s = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "u"), ("d", None), ("e", "")], "sid string, usr string")
    got = {tuple(r) for r in rel.same_usr(s).collect()}
    assert got == {(x, x) for x in "abcde"} | {("b", "a"), ("a", "b"), ("c", "a"), ("a", "c")}


def test_files_without_facts_lose_their_old_ones(spark, tmp_path):
    path = str(tmp_path / "facts")
    schema = "file_id string, v int"
    sinks.write_facts(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], schema), path, 2)
    sinks.write_facts(spark.createDataFrame([("a", 2)], schema), path, 2, analysed=spark.createDataFrame([("a",), ("b",)], "file_id string"))
    assert {(r.file_id, r.v) for r in spark.read.parquet(path).collect()} == {("a", 2), ("c", 1)}
    sinks.write_facts(spark.createDataFrame([], schema), path, 2, analysed=spark.createDataFrame([("a",), ("c",)], "file_id string"))
    assert spark.read.schema(schema).parquet(path).count() == 0


def test_unreadable_old_facts_fail_and_stay(spark, tmp_path):
    path = tmp_path / "facts"
    schema = "file_id string, v int"
    sinks.write_facts(spark.createDataFrame([("a", 1), ("b", 1)], schema), str(path), 1)
    part = next(path.rglob("*.parquet"))
    whole = part.read_bytes()
    part.write_bytes(b"no parquet")
    before = sorted(p.name for p in path.rglob("*"))
    with pytest.raises(Exception):
        sinks.write_facts(spark.createDataFrame([("a", 2)], schema), str(path), 1)
    assert sorted(p.name for p in path.rglob("*")) == before and part.read_bytes() == b"no parquet"
    for crc in path.rglob(".*.crc"):
        crc.unlink()
    part.write_bytes(whole)
    assert {(r.file_id, r.v) for r in spark.read.parquet(str(path)).collect()} == {("a", 1), ("b", 1)}
    with pytest.raises(Exception):
        bad = str(tmp_path / "in")
        (tmp_path / "out").mkdir()
        (tmp_path / "out" / "x.parquet").write_bytes(b"no parquet")
        spark.createDataFrame([], FILE).write.parquet(bad)
        spark.sql("SELECT 'a' AS file_id, 'p' AS project_id, 'x.py' AS relative_path, 'python' AS language, 'h' AS content_hash, timestamp_ntz'2024-01-01 00:00:00' AS last_analyzed_at, 'analyzed' AS analysis_status, 'v' AS analyzer_version").write.mode("append").parquet(bad)
        incremental.latest_from_stream(spark, bad, spark.createDataFrame([], FILE).schema, str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination(120)
