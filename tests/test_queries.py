"""Every core query with SQL gives what SQL gives; those without run."""

import importlib

import pytest

from tests.sqlcheck import connect, same

MODULES = [importlib.import_module(f"corvane.queries.{m}") for m in ("problems", "text", "corpus", "retrieval", "operations")]
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, small, name):
    same(spark, con, QUERIES[name], SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["bm25_topk_stated", "bm25_scores_stated", "hybrid_rrf_stated", "fan_out_stated", "rerank_overlap_stated"])
def test_whole_stated_set_is_asked(spark, name):
    d = "/root/testdata/sf0.01"
    asked = connect(d).execute("SELECT count(*) FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL").fetchone()[0]
    assert asked > 8 and QUERIES[name](spark, d).select("query_id").distinct().count() >= asked
