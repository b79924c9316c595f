"""Graph queries: orders from customers' to suppliers' nations, and supplier to supplier along part names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import graphs as G
from loomwright.plans.registry import query, table

_EDGES = """WITH j AS (SELECT c.c_nationkey AS src, s.s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey),
e AS (SELECT src::BIGINT AS src, dst::BIGINT AS dst, count(*)::DOUBLE AS weight FROM j GROUP BY 1, 2 HAVING count(*) >= 2) """


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation of the customer to nation of the supplier, over all lines; at least twice."""
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src")), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    return G.weighted(j.select("src", "dst", F.lit(1).alias("weight")), 2)


@query(_EDGES + "SELECT * FROM e")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-01, SRC-09, AGG-12."""
    return _edges(spark, sf_dir)


@query(_EDGES + "SELECT node, sum(i) AS in_degree, sum(o) AS out_degree FROM (SELECT src AS node, 0 AS i, weight AS o FROM e UNION ALL SELECT dst, weight, 0 FROM e) GROUP BY 1")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-02."""
    return G.degrees(_edges(spark, sf_dir))


@query(_EDGES + "SELECT count(*) AS edges, avg(EXISTS (SELECT 1 FROM e b WHERE b.src = a.dst AND b.dst = a.src)::INT) AS reciprocity, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS nodes FROM e a WHERE src <> dst")
def graph_reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-06."""
    return G.reciprocity(_edges(spark, sf_dir))


@query(_EDGES.replace("WITH", "WITH RECURSIVE") + """, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT src, sum(weight) AS total FROM e GROUP BY 1),
k AS (SELECT a.node AS dst, b.node AS src, CASE WHEN total IS NULL THEN 1.0 / (SELECT count(*) FROM v) ELSE coalesce(weight, 0) / total END AS p FROM v a CROSS JOIN v b LEFT JOIN o ON o.src = b.node LEFT JOIN e ON e.src = b.node AND e.dst = a.node),
w AS (SELECT dst, list(p ORDER BY src) AS row FROM k GROUP BY 1), m AS (SELECT list(row ORDER BY dst) AS rows, list(dst ORDER BY dst) AS names, count(*) AS n FROM w),
r AS (SELECT 0 AS step, [1.0::DOUBLE / n for _ in names] AS rank, rows, names, n FROM m UNION ALL SELECT step + 1, [0.85::DOUBLE * list_dot_product(x, rank) + 0.15::DOUBLE / n for x in rows], rows, names, n FROM r WHERE step < 100)
SELECT unnest(names) AS node, round(unnest(rank), 8) AS rank FROM r WHERE step = 100""")
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-03, to more digits than the default, so that two ways of counting agree; tests hold it against numpy too."""
    return G.pagerank(_edges(spark, sf_dir), tolerance=1e-12).withColumn("rank", F.round("rank", 8))


@query()
def graph_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-04; tests hold it against path counting."""
    return G.betweenness(_edges(spark, sf_dir))


@query()
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-05, GR-08."""
    return G.communities(_edges(spark, sf_dir))


@query()
def graph_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-07."""
    return G.centrality(_edges(spark, sf_dir))
