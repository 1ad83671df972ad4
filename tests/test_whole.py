"""Queries that once returned less than the whole result."""

from test_queries import DATA, con, rows  # noqa: F401

import duckdb
import pytest

import __spark_entry__ as entry
from factloom.facts import Facts
from factloom.operators import retrieval


def test_all_references_are_ordered(spark, con, rows):  # noqa: F811
    got = entry.queries()["o_ref_order"](spark, DATA).toPandas()
    want = con.execute(entry.oracle_sql()["o_ref_order"].removesuffix(" LIMIT 100")).df()
    assert len(got) == len(want) > 100 and rows(got) == rows(want)
    key = [tuple((v is not None and v == v, v if v == v and v is not None else 0) for v in r) for r in got[["file_id", "start_line", "tname", "reference_id"]].astype(object).itertuples(index=False)]
    assert key == sorted(key)


@pytest.mark.parametrize("name", ["o_ref_order", "o_refs_in_order"])
def test_order_of_nulls_is_that_of_sql(spark, tmp_path, name):
    some = [(f"r{i:03}", None if i % 3 == 0 else f"f{i % 5}", None if i % 4 == 0 else i % 7, None if i % 5 == 0 else f" n{i % 11}") for i in range(300)] + [(None, "f1", 1, "n1"), ("r001", "f1", 1, "n1 ")]
    spark.createDataFrame([(*r, *[None] * 6) for r in some], "reference_id string, file_id string, start_line int, target_name string, source_symbol_id string, target_symbol_id string, reference_kind string, resolution_status string, confidence string, note string").write.parquet(f"{tmp_path}/refs.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW refs AS SELECT * FROM read_parquet('{tmp_path}/refs.parquet/*.parquet')")
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select("reference_id", "file_id", "start_line", "tname").collect()]
    sql = entry.oracle_sql()[name]
    assert got == c.execute(sql.removesuffix(" LIMIT 100")).fetchall() and len(got) == 301
    assert got[:100] == c.execute(sql).fetchall()[:100]


@pytest.mark.parametrize("name", ["t_bm25f_body", "t_scores_body", "t_eval_body"])
def test_body_counts(spark, con, rows, name):  # noqa: F811
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    if name == "t_scores_body":
        assert len(got) > con.execute(f"SELECT count(*) FROM ({entry.oracle_sql()['t_scores']})").fetchone()[0]


def test_body_is_what_children_leave(spark, tmp_path):
    text = "class A:\n    keeper = 1\n    def f(self):\n        return lantern\n"
    from hashlib import sha256

    spark.createDataFrame([("x", "p", "a.py", "python", sha256(text.encode()).hexdigest(), None, None, None), ("y", "p", "b.py", "python", "old", None, None, None)], "file_id string, project_id string, relative_path string, language string, content_hash string, last_analyzed_at timestamp_ntz, analysis_status string, analyzer_version string").write.parquet(f"{tmp_path}/source_files.parquet")
    spark.createDataFrame([("x", text), ("x", text), ("y", text), ("x", None)], "file_id string, content string").write.parquet(f"{tmp_path}/source_texts.parquet")
    from conftest import SYMBOL

    names = [c.split()[0] for c in SYMBOL.split(", ")]
    found = [dict(symbol_id="a", file_id="x", name="A", kind="class", start_line=1, end_line=4), dict(symbol_id="f", file_id="x", name="f", kind="method", start_line=3, end_line=9, parent_symbol_id="a"), dict(symbol_id="b", file_id="y", name="B", kind="class", start_line=1, end_line=4)]
    spark.createDataFrame([tuple(s.get(n) for n in names) for s in found], SYMBOL).write.parquet(f"{tmp_path}/symbols.parquet")
    f = Facts(spark, str(tmp_path))
    assert sorted((r.doc, *r.terms) for r in retrieval.symbol_bodies(f).collect()) == [("a", "class", "keeper"), ("f", "def", "self", "return", "lantern")]
    q = spark.createDataFrame([(1, "the lantern")], "qid int, question string")
    docs = retrieval.symbol_documents(f)
    assert retrieval.bm25(docs, q, 4).count() == 0 and [r.doc for r in retrieval.bm25(docs, q, 4, retrieval.symbol_bodies(f)).collect()] == ["f"]


def test_call_paths_of_up_to_eight_edges(spark, con, rows, tmp_path):  # noqa: F811
    chain = lambda k: ["s", *(f"c{k}_{i}" for i in range(k - 1)), "t"]
    pairs = {p for k in range(2, 11) for p in zip(chain(k), chain(k)[1:])} | {("c8_2", "c3_1"), ("c3_1", "c4_0"), ("c4_0", "c8_2"), ("t", "c2_0")}
    rest = [(f"r{i}", a, b, "call", "resolved") for i, (a, b) in enumerate(sorted(pairs))]
    rest += [("n1", "s", "t", "call", "ambiguous"), ("n2", "s", "t", "type_use", "resolved"), ("r0", *rest[0][1:])]
    spark.createDataFrame(rest, "reference_id string, source_symbol_id string, target_symbol_id string, reference_kind string, resolution_status string").write.parquet(f"{tmp_path}/refs.parquet")

    def walk(way):
        if way[-1] == "t":
            yield (" > ".join(way), len(way) - 1)
        elif len(way) <= 8:
            for a, b in pairs:
                if a == way[-1] and b not in way:
                    yield from walk([*way, b])

    got = {tuple(r) for r in entry.queries()["g_call_paths"](spark, str(tmp_path)).select("path", "length").collect()}
    assert got == set(walk(["s"])) and {n for _, n in got} == set(range(2, 9))
    assert rows(entry.queries()["g_call_paths"](spark, DATA).toPandas()) == rows(con.execute(entry.oracle_sql()["g_call_paths"]).df())
