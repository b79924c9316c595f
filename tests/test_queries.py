"""Every query with SQL returns what DuckDB returns; the others return rows."""

from __future__ import annotations

import pytest

from loomwright.operators import graphs as G
from loomwright.plans import registry
from tests.conftest import DATA
from tests.oracle import compare, connect, rows, same

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    compare(registry.queries()[name](spark, SF), registry.oracle_sql()[name], duck)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns
    df.limit(5).collect()


def test_graph_measures_take_all_lines(spark, duck):
    joined = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"
    edges = duck.sql(f"SELECT c_nationkey::BIGINT, s_nationkey::BIGINT, count(*)::DOUBLE FROM {joined} GROUP BY 1, 2 HAVING count(*) >= 2").fetchall()
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    for name, measure in (("pagerank", G.pagerank), ("betweenness", G.betweenness), ("communities", G.communities), ("centrality", G.centrality)):
        got, want = (rows([r.asDict() for r in x.collect()]) for x in (registry.queries()[f"graph_{name}"](spark, SF), measure(df)))
        assert len(got) == len(want) and all(map(same, got, want)), name
    degrees = registry.queries()["graph_centrality"](spark, SF).agg({"in_degree": "sum"}).first()[0]
    assert degrees == sum(w for *_, w in edges)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
