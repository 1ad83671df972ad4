"""Queries against their SQL on the smallest tables; tools/compare.py does the same for all at any scale."""

import glob
import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("FACTLOOM_TESTDATA", "/root/testdata/sf0.001")
NAMES = ["f_lookup", "f_exclude", "f_unresolved_inbox", "j_ref_hit", "j_usr_group", "j_owner", "j_suffix_qname", "a_modules", "a_edge_merge", "a_describe", "w_topn_per_group", "x_hash_changed", "s_split_ident", "g_impact", "g_hierarchy", "g_paths", "g_dep_cycles", "g_extract", "u_unused", "c_validate", "t_bm25f", "p3_hierarchy", "p5_keys"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.fixture(scope="module")
def rows():
    spec = importlib.util.spec_from_file_location("compare", os.path.join(os.path.dirname(entry.__file__), "tools", "compare.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.rows


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, rows, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
