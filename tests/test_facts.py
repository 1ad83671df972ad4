"""Cleaned tables that are written once give the same results, and filters reach their scan."""

import io
from contextlib import redirect_stdout

from test_queries import DATA, con, rows  # noqa: F401

from factloom.facts import Facts
from factloom.operators import questions as qs, relational as rel


def test_clean_facts(spark, con, rows, tmp_path):  # noqa: F811
    f = Facts(spark, DATA)
    clean = f.save(str(tmp_path))
    for query in (rel.most_called, rel.described, rel.merged_edges, rel.modules, rel.ref_hits, qs.externals, rel.freshness):
        assert rows(query(clean).toPandas()) == rows(query(f).toPandas()), query.__name__
    shown = io.StringIO()
    with redirect_stdout(shown):
        clean.calls().explain("formatted")
    assert "EqualTo(kind,call)" in shown.getvalue() and "EqualTo(status,resolved)" in shown.getvalue()
