"""Vector and similarity queries: labels of ``embeddings`` are languages, ids modulo 7 communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import stats
from loomwright.operators import vectors as V
from loomwright.operators.neighbours import nearest_packed
from loomwright.operators.terms import packed_tfidf
from loomwright.plans.registry import query, table
from loomwright.plans.texts import TOKENS


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("part"), F.col("embedding").alias("vector"))


_KNN = """
u AS (SELECT vec_id AS id, label AS part, [x::DOUBLE for x in embedding] AS v FROM embeddings),
p AS (SELECT a.id AS left_id, b.id AS right_id, a.part, round(list_cosine_similarity(a.v, b.v), 12) AS score FROM u a JOIN u b ON a.part = b.part AND a.id <> b.id {extra}),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS place FROM p WHERE score > 1e-12),
k AS (SELECT left_id, right_id, round(score, 9) AS score, place, part FROM r WHERE place <= 5)
"""
_SELF = "WITH " + _KNN.format(extra="")


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return V.nearest(v, v, 5, "part").withColumn("score", F.round("score", 9))


@query(_SELF + "SELECT left_id, right_id, score, place FROM k")
def knn_embeddings_same_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-17, ML-07, MTH-03, MTH-04: exact, where the reference asks an approximate index."""
    return _knn(spark, sf_dir)


#: Ids of the comments, which hold the posts' vectors once more.
COMMENT_IDS = 1_000_000_000


@query(f"""
WITH u AS (SELECT vec_id AS id, label AS part, [x::DOUBLE for x in embedding] AS v FROM embeddings),
p AS (SELECT a.id AS left_id, b.id + {COMMENT_IDS} AS right_id, round(list_cosine_similarity(a.v, b.v), 12) AS score FROM u a JOIN u b ON a.part = b.part),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS place FROM p WHERE score > 1e-12)
SELECT left_id, right_id, round(score, 9) AS score, place FROM r WHERE place <= 5
""")
def cross_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-18, JN-12: from all posts to all comments of their language; both tables hold the same vectors."""
    v = _vectors(spark, sf_dir)
    return V.nearest(v, v.withColumn("id", F.col("id") + F.lit(COMMENT_IDS)), 5, "part").withColumn("score", F.round("score", 9))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("lang"))
    m = _knn(spark, sf_dir).join(labels, F.col("left_id") == F.col("vec_id"))
    return m.select("score", "lang", (F.col("left_id") % 7).alias("left_community"), (F.col("right_id") % 7).alias("right_community"))


_MATCHES = _SELF + ", m AS (SELECT score, part AS lang, left_id % 7 AS left_community, right_id % 7 AS right_community FROM k) "


@query(_MATCHES + "SELECT count(*) AS pairs, avg(score) AS mean_score, quantile_cont(score, 0.5) AS median_score, count(DISTINCT lang) AS langs, avg((left_community = right_community)::INT) AS same_community_rate FROM m")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-38."""
    return V.match_summary(_matches(spark, sf_dir))


@query(_MATCHES + "SELECT lang, count(*) AS pairs, avg(score) AS mean_score FROM m GROUP BY 1 ORDER BY pairs DESC, lang LIMIT 12")
def match_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-39."""
    return _matches(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("pairs"), F.avg("score").alias("mean_score")).orderBy(F.desc("pairs"), "lang").limit(12)


THRESHOLDS = [0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]
_GRID = _MATCHES + f", t AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold), g AS (SELECT threshold, count(score) AS pair_count, coalesce(avg((left_community = right_community)::INT), 0) AS same_community_share FROM t LEFT JOIN m ON score >= threshold GROUP BY 1) "


@query(_GRID + "SELECT * FROM g")
def threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-40, JN-19."""
    return V.threshold_grid(_matches(spark, sf_dir), THRESHOLDS)


@query(_MATCHES + "SELECT b::INT AS bin, count(score) AS n FROM range(100) r(b) LEFT JOIN m ON greatest(0, least(99, floor(score * 100))) = b GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-41."""
    return V.histogram(_matches(spark, sf_dir))


@query(_GRID + ', d AS (SELECT threshold, 1 - pair_count / lag(pair_count) OVER (ORDER BY threshold) AS "drop", lag(pair_count) OVER (ORDER BY threshold) AS before FROM g) SELECT threshold, "drop" FROM d WHERE before > 0 ORDER BY "drop" DESC, threshold LIMIT 1')
def threshold_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-50."""
    return V.knee(V.threshold_grid(_matches(spark, sf_dir), THRESHOLDS))


_TFIDF = f"""WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents), t AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c, n GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.95 * any_value(n) ORDER BY total DESC, term LIMIT 1000),
x AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN t USING (term), n), s AS (SELECT doc_id, sqrt(sum(w * w)) AS size FROM x GROUP BY 1), u AS (SELECT doc_id, term, w / size AS w FROM x JOIN s USING (doc_id))"""


def _words(docs: DataFrame) -> DataFrame:
    from loomwright.functions import text as T

    return docs.select("doc_id", F.explode(T.tokens(T.clean_text(F.col("text")))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, _ = V.tfidf(_words(docs), "doc_id", docs.count(), 5, 0.95, 1000)
    return rows


@query(_TFIDF + " SELECT doc_id, count(*) AS terms, round(sum(w), 8) AS weight_sum, round(max(w), 8) AS weight_max FROM u GROUP BY 1")
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-01, ML-05."""
    total = F.aggregate("value", F.lit(0.0), lambda a, v: a + v)
    return _tfidf(spark, sf_dir).select("doc_id", F.size("index").cast("long").alias("terms"), F.round(total, 8).alias("weight_sum"), F.round(F.array_max("value"), 8).alias("weight_max"))


@query(_TFIDF + """, p AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, round(sum(a.w * b.w), 12) AS score FROM u a JOIN u b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS place FROM p WHERE score > 1e-12) SELECT left_id, round(score, 6) AS score, place FROM r WHERE place <= 3""")
def tfidf_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-16: scores by rank; which of two equally near texts stands first isn't part of the result."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    packed = packed_tfidf(docs, 5, 0.95, 1000)
    return nearest_packed(packed, 3, width=1000).select("left_id", F.round("score", 6).alias("score"), "place")


@query(_TFIDF + """, e AS (SELECT list_sort(list(term)) AS l, doc_id FROM u GROUP BY doc_id) SELECT a.doc_id, len(list_intersect(a.l, b.l)) AS shared FROM e a JOIN e b ON b.doc_id = a.doc_id + 1""")
def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-01: terms that a text shares with the next."""
    rows = _tfidf(spark, sf_dir).select("doc_id", "terms")
    return rows.join(rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("terms").alias("others")), "doc_id").select("doc_id", F.size(F.array_intersect("terms", "others")).cast("long").alias("shared"))


@query(_MATCHES + """, s AS (SELECT round(score, 6) AS s, left_community = right_community AS p FROM m), k AS (SELECT s, count(*) FILTER (p) AS a, count(*) FILTER (NOT p) AS b FROM s GROUP BY 1),
w AS (SELECT a, b, a * (coalesce(sum(b) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + b / 2) AS w FROM k) SELECT sum(w) / (sum(a) * sum(b)) AS auc, sum(a)::BIGINT AS positives, sum(b)::BIGINT AS negatives FROM w""".replace(", k AS", ", kk AS").replace("FROM k)", "FROM kk)"))
def lexical_baseline_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-10, ML-11: how well the score tells same-community pairs."""
    m = _matches(spark, sf_dir).select(F.round("score", 6).alias("score"), (F.col("left_community") == F.col("right_community")).alias("same"))
    return stats.auc(m, "score", "same")


@query(_MATCHES + "SELECT corr(score, left_community) AS r, avg(abs(score - 0.5)) AS mae FROM m")
def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-53, MTH-11."""
    return _matches(spark, sf_dir).agg(F.corr("score", F.col("left_community").cast("double")).alias("r"), F.avg(F.abs(F.col("score") - 0.5)).alias("mae"))


@query("""WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('a/' || doc_id), doc_id) AS i FROM documents), b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('b/' || doc_id), doc_id) AS i FROM documents)
SELECT a.doc_id, a.lang, b.doc_id AS shuffled FROM a JOIN b ON a.lang = b.lang AND a.i = b.i""")
def permuted_within_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-02: a seeded permutation inside each language, by two rankings."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    ranked = lambda seed: F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col("doc_id").cast("string"))), "doc_id"))
    return docs.withColumn("i", ranked("a")).join(docs.select(F.col("doc_id").alias("shuffled"), "lang", ranked("b").alias("i")), ["lang", "i"]).select("doc_id", "lang", "shuffled")


FEATURES = ["docs", "mean_chars", "share_long", "langs"]


@query()
def pca_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-12, MTH-13, AGG-05; tests hold it against numpy."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("docs"), F.avg("n_chars").alias("mean_chars"), F.avg((F.col("n_chars") > 2000).cast("double")).alias("share_long"), F.count_distinct("lang").cast("double").alias("langs"))
    return V.principal_components(rows, "source", FEATURES)


@query()
def semantic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-08, SMP-03's clusters: k-means over vectors, sizes per cluster and label."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=8, seed=42, maxIter=10).fit(rows).transform(rows).groupBy("prediction", "label").agg(F.count(F.lit(1)).alias("n"))


