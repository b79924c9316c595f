"""Relational queries: coverage, outer joins, threads, edges, listings, concentration, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import diffusion, stats, threads
from loomwright.plans.registry import query, table


@query("""
WITH d AS (SELECT doc_id AS id, 'document' AS doc_type, NULL::TIMESTAMP AS created FROM documents UNION ALL SELECT event_id, 'event', ts FROM events)
SELECT doc_type, count(*) AS total, count(DISTINCT id) AS unique_ids, count(*) FILTER (created IS NULL) AS missing_created, min(created) AS created_min, max(created) AS created_max,
  count(*) - count(DISTINCT id) AS duplicates, (count(*) - count(DISTINCT id)) / count(*) AS duplicate_ratio FROM d GROUP BY doc_type
""")
def coverage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02, SET-01."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("doc_type"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("doc_type"), F.col("ts").alias("created"))
    return stats.coverage(events.unionByName(docs, allowMissingColumns=True), "id", "doc_type", "created")


@query('SELECT (ts::DATE)::VARCHAR AS "day", count(*) AS "count" FROM events GROUP BY 1')
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01."""
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).count()


@query("""
WITH p AS (SELECT role AS author, count(DISTINCT conv_id) AS posts, avg(length(text)) AS mean_chars FROM conversations WHERE turn = 0 GROUP BY 1),
c AS (SELECT role AS author, count(*) AS comments, count(DISTINCT conv_id) AS threads FROM conversations WHERE turn > 0 GROUP BY 1)
SELECT coalesce(p.author, c.author) AS author, coalesce(posts, 0) AS posts, coalesce(mean_chars, 0) AS mean_chars, coalesce(comments, 0) AS comments, coalesce(threads, 0) AS threads
FROM p FULL JOIN c ON p.author IS NOT DISTINCT FROM c.author
""")
def author_stats_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-03, AGG-11."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("role", "author")
    posts = rows.where("turn = 0").groupBy("author").agg(F.count_distinct("conv_id").alias("posts"), F.avg(F.char_length("text")).alias("mean_chars"))
    comments = rows.where("turn > 0").groupBy("author").agg(F.count(F.lit(1)).alias("comments"), F.count_distinct("conv_id").alias("threads"))
    return stats.null_safe_full_join(posts, comments, "author")


@query("""
WITH p AS (SELECT source, count(DISTINCT doc_id) AS posts, count(DISTINCT lang) AS langs, avg(n_chars) AS mean_chars FROM documents GROUP BY 1),
c AS (SELECT source, count(*) AS labelled, avg(quality) AS mean_quality FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT coalesce(p.source, c.source) AS source, coalesce(posts, 0) AS posts, coalesce(langs, 0) AS langs, coalesce(mean_chars, 0) AS mean_chars, coalesce(labelled, 0) AS labelled, coalesce(mean_quality, 0) AS mean_quality
FROM p FULL JOIN c ON p.source IS NOT DISTINCT FROM c.source
""")
def community_stats_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01, JN-02, AGG-10."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    posts = docs.groupBy("source").agg(F.count_distinct("doc_id").alias("posts"), F.count_distinct("lang").alias("langs"), F.avg("n_chars").alias("mean_chars"))
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("labelled"), F.avg("quality").alias("mean_quality"))
    return stats.null_safe_full_join(posts, labelled, "source")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages: turn 0 is the post, every later turn answers the one before."""
    rows = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws("/", "conv_id", turn)
    return rows.select(F.col("conv_id").alias("post_id"), "turn", name(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_id"), F.col("role").alias("author"), "text")


@query("""
WITH m AS (SELECT conv_id AS post_id, turn, conv_id || '/' || turn AS id, CASE WHEN turn > 0 THEN conv_id || '/' || (turn - 1) END AS parent_id, role AS author FROM conversations)
SELECT a.post_id, a.id, a.parent_id, a.author, p.author AS parent_author FROM m a LEFT JOIN m p ON a.parent_id = p.id WHERE a.parent_id IS NOT NULL
""")
def reply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-04, JN-05."""
    return threads.reply_edges(messages(spark, sf_dir))


@query("""
SELECT * FROM (SELECT conv_id, turn AS source, lead(turn) OVER w AS target, role AS source_value, lead(role) OVER w AS target_value FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE target IS NOT NULL
""")
def adjacency_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-06."""
    return threads.adjacent_pairs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("""
SELECT c.conv_id || '/' || c.turn AS id, list(trim(p.text) ORDER BY p.turn DESC) FILTER (p.turn IS NOT NULL) AS chain
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn < c.turn AND p.turn >= c.turn - 3 GROUP BY 1
""".replace("list(trim", "coalesce(list(trim").replace(" AS chain", ", []) AS chain"))
def thread_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-07."""
    return threads.ancestors(messages(spark, sf_dir).select("id", "parent_id", "text"), 3)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations WHERE turn > 0),
c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY k) AS t FROM r WHERE k <= 3 GROUP BY 1)
SELECT p.conv_id AS post_id, CASE WHEN t IS NULL THEN p.text || chr(10) || chr(10) ELSE p.text || chr(10) || chr(10) || t END AS context_text FROM conversations p LEFT JOIN c USING (conv_id) WHERE turn = 0
""")
def context_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-08, WIN-07, STR-31: a post with its three longest comments."""
    rows = messages(spark, sf_dir)
    comments = rows.where("turn > 0").select("post_id", "text", F.char_length("text").alias("score"), F.col("turn").alias("ord"))
    out = threads.post_context(rows.where("turn = 0").select("post_id", "text"), comments)
    return out.select("post_id", "context_text")


@query(r"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '@([\pL\pN_][\pL\pN_\-]{1,49})', 1)) AS raw FROM documents),
k AS (SELECT DISTINCT lower(trim(split_part(text, ' ', 1))) AS known FROM documents)
SELECT doc_id, lower(raw) AS target, count(*) AS n, bool_or(known IS NOT NULL) AS is_known FROM e LEFT JOIN k ON lower(raw) = known GROUP BY 1, 2
""")
def edges_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-22, FLT-01, GR-09: mentions; the first words of texts stand in for known handles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", F.explode(T.mentions(F.col("text"))).alias("raw")).withColumn("target", F.lower("raw"))
    known = docs.select(F.lower(F.trim(F.split("text", " ", 2)[0])).alias("known")).distinct()
    return found.join(known, F.col("target") == F.col("known"), "left").groupBy("doc_id", "target").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("known").isNotNull()).alias("is_known"))


@query(r"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)(https?://[^\s"<>'']+|www\.[^\s"<>'']+)', 1)) AS raw FROM pages),
u AS (SELECT page_id, regexp_replace(raw, '[).,;!?:"\]'']+$', '') AS url FROM h)
SELECT page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', ''), '') AS "domain", count(*) AS n
FROM (SELECT page_id, CASE WHEN url LIKE 'www.%' THEN 'http://' || url ELSE url END AS url FROM u) GROUP BY 1, 2, 3
""")
def edges_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-24, GR-09."""
    pattern = r"""(?i)(https?://[^\s"<>']+|www\.[^\s"<>']+)"""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("raw"))
    urls = rows.select("page_id", T.norm_url(F.col("raw")).alias("url"))
    return urls.groupBy("page_id", "url", T.domain_for(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT tag, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '#([\pL\pN_\-]{1,50})', 1))) AS tag FROM documents) GROUP BY tag")
def edges_hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-23."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(T.hashtags(F.col("text")), F.lower)).alias("tag"))
    return found.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query('SELECT o_custkey AS author, o_orderkey AS post, count(*) AS weight FROM orders GROUP BY 1, 2')
def edges_authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-09, AGG-12."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("author"), F.col("o_orderkey").alias("post")).agg(F.count(F.lit(1)).alias("weight"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listings: a user is a post, a day is a run."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("post_id"), F.date_format("ts", "yyyyMMdd'T'000000'Z'").alias("run_id"), F.col("event_type").alias("community"), F.col("value").alias("score"),
        F.get_json_object("props", "$.k").try_cast("double").alias("comments"), F.col("event_id").cast("double").alias("rank"), F.col("ts").cast("timestamp").alias("seen"), F.col("event_id").alias("ord"),
    )


_GROUPED = """
WITH l AS (SELECT user_id AS post_id, strftime(ts, '%Y%m%dT000000Z') AS run_id, event_type AS community, value AS score, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS comments, event_id::DOUBLE AS rank, date_trunc('day', ts) AS run_time, event_id AS ord FROM events),
g AS (SELECT post_id, run_id, arg_min(community, ord) AS community, max(score) AS score, max(comments) AS comments, min(rank) AS rank, min(run_time)::TIMESTAMP AS run_time FROM l GROUP BY 1, 2),
p AS (SELECT post_id, arg_min(community, run_time) AS community, arg_min(run_id, run_time) AS first_run, arg_max(run_id, run_time) AS last_run, count(*) AS runs_seen, arg_min(score, run_time) AS score_first, arg_max(score, run_time) AS score_last,
  arg_min(comments, run_time) AS comment_first, arg_max(comments, run_time) AS comment_last, greatest(epoch(max(run_time) - min(run_time)) / 3600, 1e-6) AS span, min(rank) AS best_rank, avg(rank) AS mean_rank FROM g GROUP BY 1),
k AS (SELECT post_id, score AS peak_score, run_id AS peak_run FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY coalesce(score, -1) DESC, run_time) AS i FROM g) WHERE i = 1),
r AS (SELECT run_id, community, min(run_time) AS run_time, count(DISTINCT post_id) AS posts_seen, avg(score) AS mean_score, avg(comments) AS mean_comments FROM g GROUP BY 1, 2)
"""


@query(_GROUPED + """SELECT post_id, community, first_run, last_run, runs_seen, score_first, score_last, comment_first, comment_last, peak_score, peak_run, best_rank, mean_rank,
  score_last - score_first AS score_delta, comment_last - comment_first AS comment_delta, round(span, 3) AS hours_span, (score_last - score_first) / span AS score_velocity, (comment_last - comment_first) / span AS comment_velocity FROM p JOIN k USING (post_id)""")
def diffusion_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, AGG-14, WIN-05, DT-03, JN-09."""
    return diffusion.posts(diffusion.by_post_and_run(listings(spark, sf_dir)))


@query(_GROUPED + "SELECT run_id, community, strftime(run_time, '%Y-%m-%d %H:%M:%S') AS run_time, posts_seen, mean_score, mean_comments FROM r")
def diffusion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15."""
    out = diffusion.runs(diffusion.by_post_and_run(listings(spark, sf_dir)))
    return out.withColumn("run_time", F.date_format("run_time", "yyyy-MM-dd HH:mm:ss"))


@query(_GROUPED + "SELECT community, count(DISTINCT run_id) AS runs_seen, sum(posts_seen)::BIGINT AS posts_seen_total, avg(mean_score) AS mean_score, avg(mean_comments) AS mean_comments FROM r GROUP BY 1")
def diffusion_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16."""
    return diffusion.communities(diffusion.runs(diffusion.by_post_and_run(listings(spark, sf_dir))))


@query("""
WITH c AS (SELECT min(o_orderdate) AS c0, max(o_orderdate) AS c1, count(*) FILTER (o_orderdate IS NULL) AS missing, count(*) AS docs FROM orders),
p AS (SELECT strftime(ts, '%Y%m%dT000000Z') AS run_id, min(ts) AS t, count(DISTINCT ts) AS times, date_trunc('day', min(ts)) AS d FROM events GROUP BY 1),
r AS (SELECT min(t) AS r0, max(t) AS r1, count(*) FILTER (times > 1) AS bad, max(abs(epoch(t - d))) AS drift FROM p),
a AS (SELECT epoch(c1 - c0) / 86400 AS cd, epoch(r1 - r0) / 86400 AS rd, missing / docs AS rate, bad, drift FROM c, r)
SELECT 'CHK-001' AS id, CASE WHEN cd >= 0 THEN 'PASS' ELSE 'FAIL' END AS status, cd::DOUBLE AS value FROM a
UNION ALL SELECT 'CHK-002', CASE WHEN rd >= 0 THEN 'PASS' ELSE 'FAIL' END, rd FROM a UNION ALL SELECT 'CHK-003', CASE WHEN cd >= rd THEN 'PASS' ELSE 'WARN' END, cd - rd FROM a
UNION ALL SELECT 'CHK-004', CASE WHEN rate IS NULL THEN 'WARN' WHEN rate = 0 THEN 'PASS' WHEN rate <= 0.01 THEN 'WARN' ELSE 'FAIL' END, rate FROM a UNION ALL SELECT 'CHK-005', CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END, bad FROM a
UNION ALL SELECT 'CHK-006', CASE WHEN drift IS NULL THEN 'WARN' WHEN drift <= 300 THEN 'PASS' WHEN drift <= 900 THEN 'WARN' ELSE 'FAIL' END, drift FROM a UNION ALL SELECT 'CHK-007', 'WARN', NULL FROM a
""")
def temporal_contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-43, AGG-44, AGG-45, DQ-01, DT-02."""
    created = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("created"))
    return diffusion.temporal_checks(created, listings(spark, sf_dir).select("run_id", F.col("seen").alias("run_time")))


@query("WITH p AS (SELECT strftime(ts, '%Y%m%dT000000Z') AS run_id, min(ts) AS t FROM events GROUP BY 1) SELECT run_id, epoch(t - lag(t) OVER (ORDER BY t)) / 3600 AS gap_hours FROM p")
def run_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06."""
    return diffusion.cadence(listings(spark, sf_dir).select("run_id", F.col("seen").alias("run_time"))).select("run_id", "gap_hours")


_VOLUMES = "WITH v AS (SELECT count(*)::DOUBLE AS v FROM orders GROUP BY o_custkey), k AS (SELECT v, row_number() OVER (ORDER BY v) AS i, row_number() OVER (ORDER BY v DESC) AS j, count(*) OVER () AS n, sum(v) OVER () AS total FROM v) "


@query(_VOLUMES + "SELECT any_value(n) AS n, any_value(total) AS total, 2 * sum(i * v) / (any_value(n) * any_value(total)) - (any_value(n) + 1) / any_value(n) AS gini, sum(v) FILTER (j <= 5) / any_value(total) AS top5_share, sum(v) FILTER (j <= 10) / any_value(total) AS top10_share FROM k")
def gini_topshare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-46, AGG-47."""
    return stats.gini_and_shares(table(spark, sf_dir, "orders").groupBy("o_custkey").count(), "count")


@query(_VOLUMES + ", c AS (SELECT i, n, sum(v) OVER (ORDER BY i) / total AS share FROM k) SELECT s.step, i / n AS population, share FROM c, range(1, 21) s(step) WHERE i = floor(n * s.step / 20)")
def lorenz_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-48."""
    return stats.lorenz(table(spark, sf_dir, "orders").groupBy("o_custkey").count(), "count")


_EVAL = r"""
WITH p AS (SELECT l.quality AS truth, CASE WHEN len(regexp_extract_all(text, '[$%&*#|]')) * 100 < length(text) THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents USING (doc_id)),
m AS (SELECT truth, predicted, count(*) AS n FROM p GROUP BY 1, 2)
"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.regexp_count("text", F.lit("[$%&*#|]")) * 100 < F.char_length("text"), 1).otherwise(0).alias("predicted"))
    return stats.confusion(table(spark, sf_dir, "labels").join(docs, "doc_id"), "quality", "predicted")


@query(_EVAL + "SELECT * FROM m")
def label_eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-11: labels against a punctuation rule."""
    return _judged(spark, sf_dir)


@query(_EVAL + """, s AS (SELECT label, coalesce(sum(n) FILTER (truth = label), 0) AS support, coalesce(sum(n) FILTER (predicted = label), 0) AS guessed, coalesce(sum(n) FILTER (truth = label AND predicted = label), 0) AS hit
  FROM m, (SELECT truth AS label FROM m UNION SELECT predicted FROM m) GROUP BY label),
q AS (SELECT label, support::BIGINT AS support, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END::DOUBLE AS "precision", CASE WHEN support > 0 THEN hit / support ELSE 0 END::DOUBLE AS recall FROM s)
SELECT *, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END::DOUBLE AS f1 FROM q""")
def label_eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-11."""
    return stats.label_scores(_judged(spark, sf_dir))


@query("SELECT doc_id, text AS first_text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-06: the first of equal keys; min_by combines before the shuffle."""
    rows = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("k")).agg(F.min(F.struct("doc_id", "text")).alias("f"))
    return rows.select(F.col("f.doc_id").alias("doc_id"), F.col("f.text").alias("first_text"))


@query("""
WITH s AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42/' || doc_id), doc_id) AS k FROM documents)
SELECT doc_id, lang, k AS place FROM s WHERE k <= 20
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-05: a seeded sample of 20 per language."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("42/"), F.col("doc_id").cast("string"))), "doc_id")).alias("place"))
    return rows.where("place <= 20")


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
k AS (SELECT DISTINCT round(j * (n - 1) / 49.0)::BIGINT AS i FROM (SELECT count(*) AS n FROM orders), range(50) x(j))
SELECT o_orderkey, r.i AS position FROM r JOIN k USING (i)
""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-03: 50 evenly spaced places of a ranking."""
    from loomwright.operators.sampling import evenly_spaced

    return evenly_spaced(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50).select("o_orderkey", "position")
