"""Pair tables, merges, audit rows and readings of communities, on stand-ins from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import features as O
from loomwright.operators import pairs as P
from loomwright.operators import sociology as S
from loomwright.operators import vectors as V
from loomwright.plans.registry import query, table
from loomwright.plans.texts import ACTS, CLEAN, acts_of, sql_acts

LOW, HIGH, CANDIDATES, PAIRS, MIN_ALNUM, DROPPED = 0.2, 0.97, 400, 40, 24, ["src7"]
_MATCHES = f"""
u AS (SELECT vec_id AS id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b, a.label, round(list_cosine_similarity(a.v, b.v), 12) AS score FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM p WHERE score > 1e-12),
m AS (SELECT a, b, round(score, 9) AS score, label::VARCHAR AS lang, place FROM r WHERE place <= 5 AND label <> 9),
c AS (SELECT * FROM m WHERE round(score, 9) BETWEEN {LOW} AND {HIGH} ORDER BY score DESC, a DESC, place DESC LIMIT {CANDIDATES})"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, score, lang, place): the five nearest of each vector; label 9 stands for an unknown language."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("part"), F.col("embedding").alias("vector"))
    lang = F.when(F.col("part") == 9, "unknown").otherwise(F.col("part").cast("string"))
    near = V.nearest(v, v, 5, "part").join(v.select(F.col("id").alias("left_id"), "part"), "left_id")
    return near.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.round("score", 9).alias("score"), lang.alias("lang"), "place")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_candidates(matches(spark, sf_dir), ["a", "place"], LOW, HIGH, CANDIDATES)


@query(f"WITH {_MATCHES} SELECT a, b, score, lang FROM c")
def pair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-05, FLT-05: the best pairs in a score band, the last seen first among equals."""
    return _candidates(spark, sf_dir).select("a", "b", "score", "lang")


@query(f"""WITH RECURSIVE {_MATCHES},
d AS (SELECT doc_id AS id, source AS community, CASE WHEN length(c) > 220 THEN left(c, 219) || '…' ELSE c END AS x FROM (SELECT doc_id, source, {CLEAN} AS c FROM documents)),
e AS (SELECT *, len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]')) AS alnum, regexp_replace(lower(trim(x)), '\\s+', ' ', 'g') AS plain FROM d),
o AS (SELECT c.*, l.community AS a_community, k.community AS b_community, least(a, b) || ' ' || greatest(a, b) AS pair, least(l.plain, k.plain) || '\t' || greatest(l.plain, k.plain) AS texts,
  row_number() OVER (ORDER BY (l.community IS DISTINCT FROM k.community) DESC, score DESC, a DESC, place DESC) AS i
  FROM c JOIN e l ON l.id = a JOIN e k ON k.id = b WHERE l.alnum >= {MIN_ALNUM} AND k.alnum >= {MIN_ALNUM} AND coalesce(l.community, '') <> 'src7' AND coalesce(k.community, '') <> 'src7' AND l.plain <> k.plain
  AND NOT regexp_matches(l.x, '(?i)mbc-20|mbc20\\.xyz') AND NOT regexp_matches(k.x, '(?i)mbc-20|mbc20\\.xyz')),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS used, []::VARCHAR[] AS pairs, []::VARCHAR[] AS seen, false AS ok
  UNION ALL SELECT i, CASE WHEN ok THEN list_append(used, a) ELSE used END, CASE WHEN ok THEN list_append(pairs, pair) ELSE pairs END, CASE WHEN ok THEN list_append(seen, texts) ELSE seen END, ok
  FROM (SELECT o.i, g.used, g.pairs, g.seen, o.a, o.pair, o.texts, len(g.used) < {PAIRS} AND NOT list_contains(g.used, o.a) AND NOT list_contains(g.pairs, o.pair) AND NOT list_contains(g.seen, o.texts) AS ok FROM g JOIN o ON o.i = g.i + 1))
SELECT o.a, o.b, o.score, o.lang, o.a_community, o.b_community FROM o JOIN g USING (i) WHERE g.ok""")
def public_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-06, SET-09, JN-10, JN-11, FLT-05: pairs for readers, across communities first, nothing twice."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("community"), T.excerpt(T.clean_text(F.col("text"))).alias("excerpt"))
    described = P.described_pairs(_candidates(spark, sf_dir), docs, MIN_ALNUM, DROPPED)
    return P.greedy_pairs(described, ["a", "place"], PAIRS, CANDIDATES).select("a", "b", "score", "lang", "a_community", "b_community")


_COMMENTS = "k AS (SELECT conv_id * 7 + turn AS id, min(text) AS text FROM conversations GROUP BY 1)"


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("quality") == 1, "post").when(F.col("toxic") == 1, "comment")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), kind.alias("kind"))


@query(f"""WITH {_COMMENTS}, w AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'post' WHEN toxic = 1 THEN 'comment' END AS kind FROM labels),
n AS (SELECT id, bool_or(kind IS NOT DISTINCT FROM 'post') AS p, bool_or(kind IS NOT DISTINCT FROM 'comment') AS c, bool_or(kind IS NULL) AS u FROM w GROUP BY 1)
SELECT id, CASE WHEN c AND k.id IS NOT NULL THEN 'comment' WHEN (p OR u) AND d.doc_id IS NOT NULL THEN 'post' ELSE 'comment' END AS doc_type,
  CASE WHEN c AND k.id IS NOT NULL THEN k.text WHEN (p OR u) AND d.doc_id IS NOT NULL THEN d.text ELSE k.text END AS text
FROM n LEFT JOIN documents d ON d.doc_id = n.id LEFT JOIN k USING (id) WHERE (p OR u) AND d.doc_id IS NOT NULL OR (c OR u) AND k.id IS NOT NULL""")
def doc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-14, JN-10: texts of wanted ids, typed or not, posts before comments."""
    comments = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") * 7 + F.col("turn")).alias("id")).agg(F.min("text").alias("text"))
    posts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return P.looked_up(_wanted(spark, sf_dir), posts, comments)


@query("""WITH e AS (SELECT user_id AS post, event_id, nullif(event_type, 'click') AS title, CASE WHEN value > 50 THEN value END AS score, event_type AS source, (props::JSON ->> 'k')::BIGINT AS listing_rank FROM events),
s AS (SELECT post, source, min(event_id) AS o FROM e GROUP BY 1, 2)
SELECT post, arg_min(title, event_id) FILTER (title IS NOT NULL AND title <> '') AS title, arg_min(score, event_id) FILTER (score IS NOT NULL) AS score, min(listing_rank) AS listing_rank,
  any_value(l.sources) AS sources FROM e JOIN (SELECT post, string_agg(source, ',' ORDER BY o) AS sources FROM s GROUP BY 1) l USING (post) GROUP BY 1""")
def merged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-04: blanks filled in order, sources as first seen, the lowest rank."""
    e = table(spark, sf_dir, "events")
    rank = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(F.col("user_id").alias("post"), "event_id", F.nullif("event_type", F.lit("click")).alias("title"), F.when(F.col("value") > 50, F.col("value")).alias("score"), F.col("event_type").alias("source"), rank.alias("listing_rank"))
    return P.merged(rows, "post", "event_id", ["title", "score"], {"source": "sources"}, ["listing_rank"]).withColumn("sources", F.array_join("sources", ","))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05: the last record of each key."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return P.last_of_each(rows, ["user_id", "event_type"], "event_id")


@query("""WITH n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations)
SELECT conv_id AS post_id, conv_id || 'c' || k AS id, CASE WHEN k > 1 THEN conv_id || 'c' || (k - 1) END AS parent_id, k - 1 AS depth, conv_id || '/' || string_agg(conv_id || 'c' || k, '/') OVER (PARTITION BY conv_id ORDER BY k) AS thread_path, k - 1 AS "position" FROM n""")
def thread_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-38: each conversation as a chain of nested replies, flattened."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    fold = "aggregate(transform(sequence(1, n), i -> n + 1 - i), '[]', (acc, i) -> concat('[{\"id\": \"', conv_id, 'c', i, '\", \"replies\": ', acc, '}]'))"
    return P.flattened_replies(turns.select("conv_id", F.expr(fold).alias("c")), "conv_id", "c")


@query("SELECT user_id, event_id, 1 + value + 0.3::DOUBLE * n AS popularity, value + n AS engagement FROM events JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) USING (user_id)")
def popularity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-10: weights from a score and a number of comments."""
    e = table(spark, sf_dir, "events")
    rows = e.join(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")
    return rows.select("user_id", "event_id", *[c.alias(k) for k, c in P.popularity(F.col("value"), F.col("n")).items()])


_POINTS = "p AS (SELECT o_custkey AS id, count(*) AS n, avg(o_totalprice) / 1000 AS x, avg(day(o_orderdate))::DOUBLE AS y FROM orders GROUP BY 1)"


@query(f"""WITH {_POINTS}, t AS (SELECT * FROM p ORDER BY n DESC, id LIMIT 250), c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM t),
d AS (SELECT sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d FROM t, c)
SELECT CASE WHEN count(*) >= 12 AND quantile_cont(d, 0.5) > 0 THEN quantile_cont(d, 0.9) / quantile_cont(d, 0.5) END AS p90_p50, count(*) AS communities FROM d""")
def embedding_distance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-49: customers as communities in a plane."""
    points = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), (F.avg("o_totalprice") / 1000).alias("x"), F.avg(F.dayofmonth("o_orderdate")).alias("y"))
    return S.distance_ratio(points, "n", "id", "x", "y")


_FEATURES = [a for a in ACTS if a not in ("act_question_mark",)]
_BY_SOURCE = f"{sql_acts()}, g AS (SELECT source, count(*) AS docs, {', '.join(f'sum({a})::DOUBLE AS {a}' for a in _FEATURES)} FROM f GROUP BY 1)"
_ENTROPY = " + ".join(f"CASE WHEN {a} > 0 THEN -({a} / total) * ln({a} / total) ELSE 0 END" for a in _FEATURES)


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = O.normalized(table(spark, sf_dir, "documents").select("source", "text"))
    return acts_of(docs, "source").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(a).cast("double").alias(a) for a in _FEATURES])


@query(f"WITH {_BY_SOURCE}, t AS (SELECT *, {' + '.join(_FEATURES)} AS total FROM g) SELECT source, docs, CASE WHEN total > 0 THEN ({_ENTROPY}) / ln({len(_FEATURES)}) END AS diversity FROM t")
def community_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-54: normalised entropy of the speech acts of each community."""
    return by_source(spark, sf_dir).select("source", "docs", S.normalized_entropy([F.col(a) for a in _FEATURES]).alias("diversity"))


#: Names for communities, as those of the tables say nothing.
NAMES = ["aiagents", "Philosophy", "general", "tech-ethics", "llm-tools", "consciousness", "cooking"]
_NAMED = f"n AS (SELECT c_custkey, c_acctbal, {NAMES}[(c_nationkey % 7)::INT + 1] AS community FROM customer)"
_ORIENTED = f"""CASE WHEN regexp_matches(lower(community), '{S.TECHNICAL}') AND NOT regexp_matches(lower(community), '{S.REFLEXIVE}') THEN 'technical'
  WHEN regexp_matches(lower(community), '{S.REFLEXIVE}') AND NOT regexp_matches(lower(community), '{S.TECHNICAL}') THEN 'reflexive' ELSE 'other' END"""


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in NAMES])
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.get(names, (F.col("c_nationkey") % 7).cast("int")).alias("community"))


@query(f"""WITH {_NAMED}, c AS (SELECT community, count(*) AS docs, avg((c_acctbal < 0)::INT) AS hedge_rate, avg((c_acctbal > 5000)::INT) AS assertion_rate, {_ORIENTED} AS orientation FROM n GROUP BY 1)
SELECT orientation, sum(docs)::DOUBLE AS docs, sum(hedge_rate * docs) / sum(docs) AS hedge_rate, sum(assertion_rate * docs) / sum(docs) AS assertion_rate FROM c GROUP BY 1""")
def orientation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-55, STR-35: mean rates of technical and reflexive communities, weighted by their documents."""
    rates = [F.avg((F.col("c_acctbal") < 0).cast("int")).alias("hedge_rate"), F.avg((F.col("c_acctbal") > 5000).cast("int")).alias("assertion_rate")]
    rows = named(spark, sf_dir).groupBy("community").agg(F.count(F.lit(1)).alias("docs"), *rates).withColumn("orientation", S.orientation(F.col("community")))
    return S.weighted_rates(rows, "orientation", "docs", ["hedge_rate", "assertion_rate"])


@query(f"""WITH {_NAMED}, v AS (SELECT community, count(*) AS posts FROM n JOIN orders ON o_custkey = c_custkey GROUP BY 1), t AS (SELECT sum(posts) AS total FROM v),
c AS (SELECT upper(community) AS community, count(*) AS docs FROM n GROUP BY 1 HAVING count(*) >= 2)
SELECT lower(c.community) AS community, docs, posts, posts / total AS share FROM c JOIN v ON lower(c.community) = lower(v.community), t""")
def volume_share_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-25: rows that name communities in different case meet."""
    rows = named(spark, sf_dir)
    volumes = rows.join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("community").agg(F.count(F.lit(1)).alias("posts"))
    docs = rows.groupBy(F.upper("community").alias("name")).agg(F.count(F.lit(1)).alias("docs")).where("docs >= 2")
    both = docs.join(volumes, F.lower("name") == F.lower("community")).join(F.broadcast(volumes.agg(F.sum("posts").alias("total"))))  # one row
    return both.select(F.lower("name").alias("community"), "docs", "posts", (F.col("posts") / F.col("total")).alias("share"))


@query("""WITH t AS (SELECT (SELECT count(*) FROM orders) AS p, (SELECT count(*) FROM lineitem) AS c, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS sp, (SELECT count(*) FROM lineitem WHERE l_discount > 0) AS sc)
SELECT abs(p - sp) AS posts_delta, abs(c - sc) AS comments_delta, (abs(p - sp) / greatest(1, p))::DOUBLE AS posts_rel, (abs(c - sc) / greatest(1, c))::DOUBLE AS comments_rel, greatest(abs(p - sp) / greatest(1, p), abs(c - sc) / greatest(1, c))::DOUBLE AS max_rel FROM t""")
def denominator_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-56: totals of two sources held against each other."""
    o = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("p"), F.count_if(F.col("o_orderstatus") != "P").alias("sp"))
    i = table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("l_discount") > 0).alias("sc"))
    totals = o.join(F.broadcast(i))  # one row each
    return totals.select(*[c.alias(k) for k, c in S.drift(F.col("p"), F.col("c"), F.col("sp"), F.col("sc")).items()])


_RUNS = "d AS (SELECT strftime(ts, '%Y%m%dT000000Z') AS run_id, event_type AS community, max(ts) AS run_time, count(*) AS posts_seen FROM events GROUP BY 1, 2)"


def _diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("T000000Z"))
    return table(spark, sf_dir, "events").groupBy(run.alias("run_id"), F.col("event_type").alias("community")).agg(F.max(F.col("ts").cast("timestamp")).alias("run_time"), F.count(F.lit(1)).alias("posts_seen"))


@query(f"WITH {_RUNS} SELECT run_id, strftime(max(run_time), '%Y-%m-%d %H:%M:%S') AS run_time, sum(posts_seen)::BIGINT AS posts_seen_total, count(*) AS communities_seen FROM d GROUP BY 1")
def run_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-52, AGG-61: what each run saw."""
    rows = _diffusion(spark, sf_dir).groupBy("run_id").agg(F.max("run_time").alias("t"), F.sum("posts_seen").alias("posts_seen_total"), F.count(F.lit(1)).alias("communities_seen"))
    return rows.select("run_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("run_time"), "posts_seen_total", "communities_seen")


@query("""WITH s AS (SELECT user_id AS community, count(*) AS posts FROM events GROUP BY 1), d AS (SELECT user_id AS community, count(DISTINCT date_trunc('day', ts)) AS runs_seen, avg(value) AS mean_score FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT community, posts, coalesce(runs_seen, 0) AS runs_seen, coalesce(mean_score, 0) AS mean_score FROM s LEFT JOIN d USING (community)""")
def community_with_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-24: figures of another table, zeros where it has none."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "community")
    extra = e.where("event_type = 'purchase'").groupBy("community").agg(F.count_distinct(F.date_trunc("day", "ts")).alias("runs_seen"), F.avg("value").alias("mean_score"))
    return e.groupBy("community").agg(F.count(F.lit(1)).alias("posts")).join(extra, "community", "left").fillna(0, ["runs_seen", "mean_score"])


@query("""WITH r AS (SELECT ts::DATE AS day, count(*) AS seen FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT ts::DATE + 3 AS day, count(*) AS created FROM events WHERE event_type = 'signup' GROUP BY 1),
b AS (SELECT day, coalesce(seen, 0) AS seen, coalesce(created, 0) AS created FROM r FULL JOIN c USING (day)),
k AS (SELECT (SELECT arg_min(seen, day) FROM b WHERE seen > 0) AS s, (SELECT arg_min(created, day) FROM b WHERE created > 0) AS c)
SELECT day::VARCHAR AS day, b.seen, b.created, CASE WHEN b.seen > 0 THEN b.seen / k.s * 100 END AS seen_index, CASE WHEN b.created > 0 THEN b.created / k.c * 100 END AS created_index FROM b, k""")
def dual_day_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-26, WIN-11: two series on all days of either, each as percent of its first positive value."""
    e = table(spark, sf_dir, "events")
    seen = e.where("event_type = 'view'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("seen"))
    created = e.where("event_type = 'signup'").groupBy(F.date_add(F.to_date("ts"), 3).alias("day")).agg(F.count(F.lit(1)).alias("created"))
    days = seen.join(created, "day", "full").fillna(0, ["seen", "created"])
    both = S.indexed(S.indexed(days, "day", "seen", "seen_index"), "day", "created", "created_index")
    return both.select(F.col("day").cast("string").alias("day"), "seen", "created", "seen_index", "created_index")


_DOMAINS = [d for ds in S.GATES.values() for d in ds]
_FINDINGS = f"f AS (SELECT 'F' || o_orderkey AS finding_id, {_DOMAINS}[(o_custkey % {len(_DOMAINS)})::INT + 1] AS domain, 'P' || (left(o_orderpriority, 1)::INT - 1) AS severity, CASE WHEN o_orderstatus = 'F' OR o_custkey % 5 < 3 THEN 'mitigated' ELSE 'open' END AS status, o_orderpriority || '|' || o_orderkey AS evidence_ref FROM orders WHERE o_totalprice > 100000)"
_GATE_ROWS = " UNION ALL ".join(f"SELECT '{g}' AS gate, CASE WHEN bool_or(status <> 'mitigated' AND severity IN ('P0', 'P1') AND list_contains({d}, domain)) THEN 'fail' ELSE 'pass' END AS status FROM f" for g, d in S.GATES.items())


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings: priority as severity, the customer's place in the list as domain."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    domain = F.get(F.array(*[F.lit(d) for d in _DOMAINS]), (F.col("o_custkey") % len(_DOMAINS)).cast("int"))
    severity = F.concat(F.lit("P"), (F.left("o_orderpriority", F.lit(1)).cast("int") - 1).cast("string"))
    status = F.when((F.col("o_orderstatus") == "F") | (F.col("o_custkey") % 5 < 3), "mitigated").otherwise("open")
    return o.select(F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("finding_id"), domain.alias("domain"), severity.alias("severity"), status.alias("status"), F.concat_ws("|", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("evidence_ref"))


@query(f"WITH {_FINDINGS} {_GATE_ROWS}")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-60, DQ-05."""
    return S.gates(findings(spark, sf_dir))


@query(f"WITH {_FINDINGS} SELECT severity, count(f.severity) FILTER (status <> 'mitigated') AS open FROM (VALUES ('P0'), ('P1'), ('P2'), ('P3')) s(severity) LEFT JOIN f USING (severity) GROUP BY 1")
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-60."""
    return S.severity_counts(findings(spark, sf_dir))


@query(f"WITH {_FINDINGS} SELECT 'TASK-' || finding_id AS task_id, severity, domain AS component, CASE WHEN list_contains({S.METHOD_DOMAINS}, domain) THEN 'metodologico' ELSE 'tecnico' END AS fix_type, CASE WHEN severity IN ('P0', 'P1') THEN 'M' ELSE 'S' END AS effort_estimate, split_part(evidence_ref, '|', 1) AS dependency FROM f WHERE status <> 'mitigated'")
def findings_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-60, DQ-04."""
    return S.backlog(findings(spark, sf_dir))


_WORDS = "w AS (SELECT lower(unnest(regexp_extract_all(text, '[^\\s]+'))) AS term FROM documents), n AS (SELECT term, count(*) AS n FROM w GROUP BY 1)"


@query(f"WITH {_WORDS}, t AS (SELECT *, row_number() OVER (ORDER BY n DESC, term) AS k FROM n) SELECT count(*) FILTER (k <= 10 AND regexp_matches(term, '^(w|www|w-|-|\\\\|_+|[^A-Za-z0-9_]+)$')) AS noise_top10, count(*) FILTER (k <= 20 AND regexp_matches(term, '(?i)(api|curl|agentmarket|jq|discover|v1|mbc20|xyz|0x)')) AS api_like_top20, count(*) FILTER (k <= 50 AND length(term) <= 3) AS short_top50 FROM t")
def audit_noise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-59, STR-29: how much of the tops is noise. The place is given inside a list of 50."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("t")).groupBy(F.lower("t").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    listed = O.top(words, 50, "n", "term").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "term"))).alias("l"))
    rows = listed.select(F.posexplode("l").alias("k", "x")).select("k", F.col("x.term").alias("term"))
    noise = F.count_if((F.col("k") < 10) & F.col("term").rlike(S.NOISE_NODE)).alias("noise_top10")
    return rows.agg(noise, F.count_if((F.col("k") < 20) & F.col("term").rlike(S.API_LIKE)).alias("api_like_top20"), F.count_if(F.char_length("term") <= 3).alias("short_top50"))


_PREDICTED = "CASE WHEN greatest({all}) = 0 THEN 'unknown' {cases} END"
_ORDER = ["act_request", "act_offer", "act_promise", "act_declaration", "act_judgment", "act_assertion", "act_acceptance", "act_rejection", "act_clarification"]
_NINE = [a for a in _ORDER if a in ACTS] or ACTS
_PRED_SQL = _PREDICTED.format(all=", ".join(_NINE), cases=" ".join(f"WHEN {a} = greatest({', '.join(_NINE)}) THEN '{a[4:]}'" for a in _NINE))
_ES_SQL = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.ACTS_ES.items()) + " ELSE k END"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = O.normalized(table(spark, sf_dir, "documents").select("doc_id", "text"))
    key = T.first_largest({a[4:]: F.col(a) for a in _NINE}, "unknown")
    return acts_of(docs, "doc_id").select("doc_id", key.alias("act"), F.greatest(*_NINE).alias("act_score"))


@query(f"WITH {sql_acts()}, p AS (SELECT doc_id, {_PRED_SQL} AS k, greatest({', '.join(_NINE)}) AS act_score FROM f) SELECT doc_id, k AS act, {_ES_SQL} AS act_es, act_score::BIGINT AS act_score FROM p")
def predicted_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-34, STR-30, STR-32: the act with most hits, the first one among equals, and its Spanish name."""
    rows = _predicted(spark, sf_dir)
    return rows.select("doc_id", "act", S.translated(F.col("act"), S.ACTS_ES).alias("act_es"), F.col("act_score").cast("long").alias("act_score"))


@query(f"""WITH {sql_acts()}, p AS (SELECT doc_id, {_PRED_SQL} AS k FROM f), t AS (SELECT quality, doc_id FROM labels)
SELECT t.doc_id, coalesce(p.k, 'unknown') AS act, t.quality FROM t LEFT JOIN p USING (doc_id)""")
def benchmark_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-15, SRC-07: labelled ids keep their row; one without a text is unknown. The few labelled ids choose the texts."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return labels.join(_predicted(spark, sf_dir), "doc_id", "left").select("doc_id", F.coalesce("act", F.lit("unknown")).alias("act"), "quality")


@query("""WITH f AS (SELECT doc_id, lang FROM documents WHERE len(regexp_extract_all(text, '[^\\s]+')) >= 20 AND lang IS NOT NULL AND length(lang) >= 2),
p AS (SELECT *, row_number() OVER (ORDER BY md5('7/' || doc_id), doc_id) AS i FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42/' || doc_id), doc_id) AS place FROM p WHERE i <= 400)
SELECT doc_id, lang, place FROM k WHERE place <= 30""")
def benchmark_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06, SMP-04, SMP-06: texts of some length with a language, a pool of 400 of them, 30 per language."""
    fit = table(spark, sf_dir, "documents").where((F.regexp_count("text", F.lit(r"[^\s]+")) >= 20) & (F.char_length("lang") >= 2)).select("doc_id", "lang")
    pool = fit.orderBy(F.md5(F.concat(F.lit("7/"), F.col("doc_id").cast("string"))), "doc_id").limit(400)
    return S.sample_by(pool, ["lang"], "doc_id", 30).select("doc_id", "lang", "place")


@query(f"""WITH {_MATCHES}, b AS (SELECT a, b, score, least(4, floor(greatest(score, 0) * 5))::INT AS bin FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('42/' || a || '-' || b), a || '-' || b) AS place FROM b) SELECT a, b, score, bin, place FROM k WHERE place <= 40""")
def score_bin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-01: 40 pairs of each of five score bins, by a seeded hash."""
    rows = matches(spark, sf_dir).where("lang <> 'unknown'").withColumn("pair", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    rows = rows.withColumn("bin", F.least(F.lit(4), F.floor(F.greatest(F.col("score"), F.lit(0.0)) * 5)).cast("int"))
    return S.sample_by(rows, ["bin"], "pair", 40).select("a", "b", "score", "bin", "place")


@query("""WITH s AS (SELECT event_id, event_type, strftime(ts, '%Y-%m') AS month, (floor(value / 25))::INT AS cluster FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type, month, cluster ORDER BY md5('42/' || event_id), event_id) AS place, md5(event_type || '/' || month || '/' || cluster) AS stratum FROM s)
SELECT event_id, event_type, month, cluster, place FROM k ORDER BY place, stratum LIMIT 60""")
def labelling_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-03: one row of each stratum (community, month, cluster) in turn, until there are 60."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM").alias("month"), F.floor(F.col("value") / 25).cast("int").alias("cluster"))
    stratum = F.md5(F.concat_ws("/", "event_type", "month", F.col("cluster").cast("string")))
    return S.sample_by(e, ["event_type", "month", "cluster"], "event_id", 60).withColumn("s", stratum).orderBy("place", "s").limit(60).select("event_id", "event_type", "month", "cluster", "place")


@query(f"""WITH {sql_acts()}, p AS (SELECT doc_id, {_PRED_SQL} AS act FROM f)
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, act, count(*) AS "count", count(DISTINCT user_id) AS unique_authors FROM p JOIN events ON event_id = doc_id WHERE act <> 'unknown' GROUP BY 1, 2""")
def ritual_hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20, STR-33: documents by their dominant act and hour; events give time and author."""
    rows = _predicted(spark, sf_dir).where("act <> 'unknown'").join(table(spark, sf_dir, "events"), F.col("event_id") == F.col("doc_id"))
    return rows.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "act").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("user_id").alias("unique_authors"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, label AS cluster, count(*) AS \"count\", count(DISTINCT user_id) AS unique_authors FROM embeddings JOIN events ON event_id = vec_id GROUP BY 1, 2")
def cluster_hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21: vectors by cluster and hour."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster")).join(table(spark, sf_dir, "events"), F.col("event_id") == F.col("vec_id"))
    return rows.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "cluster").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("user_id").alias("unique_authors"))


@query("""WITH m AS (SELECT role, count(*) AS subscribers, max(conv_id) AS last_activity FROM conversations GROUP BY 1) SELECT role, subscribers, last_activity, row_number() OVER (ORDER BY subscribers DESC, last_activity DESC, role) AS place FROM m""")
def community_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-12: communities by subscribers, then by their last activity. Few rows get a place inside one list."""
    rows = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("subscribers"), F.max("conv_id").alias("last_activity"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("subscribers")).alias("s"), (-F.col("last_activity")).alias("l"), "role"))).alias("x"))
    return listed.select(F.posexplode("x").alias("k", "r")).select("r.role", (-F.col("r.s")).alias("subscribers"), (-F.col("r.l")).alias("last_activity"), (F.col("k") + 1).cast("long").alias("place"))


@query("""WITH n AS (SELECT *, length(trim(text)) >= 40 AS fit FROM conversations), p AS (SELECT bool_or(fit) AS any_fit FROM n)
SELECT conv_id, turn, CASE WHEN any_fit THEN 'non-trivial recency' ELSE 'fallback raw' END AS policy FROM n, p WHERE fit OR NOT any_fit""")
def transmission_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08: texts of some length, newest first; all of them where there is none."""
    return S.transmission_pool(table(spark, sf_dir, "conversations"), "text", "conv_id").select("conv_id", "turn", "policy")


@query("""WITH l AS (SELECT abs(sum(share) - 1) <= 0.03 AS ok FROM (SELECT count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY lang)),
r AS (SELECT min(o_orderdate) <= max(o_orderdate) AS ok, count(*) > 0 AS some FROM orders), e AS (SELECT min(ts) <= max(ts) AS ok, count(*) > 0 AS some FROM events)
SELECT 'normalized_language_shares' AS name, ok FROM l UNION ALL SELECT 'valid_time_ranges', r.ok AND e.ok FROM r, e UNION ALL SELECT 'non_empty_base_volume', r.some AND e.some FROM r, e UNION ALL SELECT 'cooccurrence_without_variants', true UNION ALL SELECT 'canonical_transmission_pool', (SELECT count(*) > 0 FROM conversations)""")
def coherence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-57, DQ-03, FLT-09: what must hold between the published tables."""
    from loomwright.plans.texts import concept_cooccurrence, lang_distribution

    shares = lang_distribution(spark, sf_dir).agg((F.abs(F.sum("share") - 1) <= 0.03).alias("language"))
    orders = table(spark, sf_dir, "orders").agg((F.min("o_orderdate") <= F.max("o_orderdate")).alias("orders"), (F.count(F.lit(1)) > 0).alias("some_orders"))
    events = table(spark, sf_dir, "events").agg((F.min("ts") <= F.max("ts")).alias("events"), (F.count(F.lit(1)) > 0).alias("some_events"))
    pairs = S.without_variants(concept_cooccurrence(spark, sf_dir)).agg(F.count_if(S.lemma(F.col("concept_a")) == S.lemma(F.col("concept_b"))).alias("variants"))
    pool = transmission_pool(spark, sf_dir).agg((F.count(F.lit(1)) > 0).alias("pool"))
    row = shares
    for one in (orders, events, pairs, pool):
        row = row.join(F.broadcast(one))  # one row each
    checks = {"normalized_language_shares": F.col("language"), "valid_time_ranges": F.col("orders") & F.col("events"), "non_empty_base_volume": F.col("some_orders") & F.col("some_events"), "cooccurrence_without_variants": F.col("variants") == 0, "canonical_transmission_pool": F.col("pool")}
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.alias("ok")) for k, c in checks.items()])).alias("r")).select("r.*")


@query(f"""WITH {_NAMED}, v AS (SELECT community, count(*) AS posts, avg((o_totalprice > 150000)::INT) AS diversity FROM n JOIN orders ON o_custkey = c_custkey GROUP BY 1), t AS (SELECT sum(posts) AS total FROM v),
h AS (SELECT corr(posts / total, diversity) AS c FROM v, t),
o AS (SELECT {_ORIENTED} AS orientation, (c_acctbal < 0)::INT AS hedge, (c_acctbal > 5000)::INT AS assertion FROM n),
r AS (SELECT avg(hedge) FILTER (orientation = 'technical') AS th, avg(hedge) FILTER (orientation = 'reflexive') AS rh, avg(assertion) FILTER (orientation = 'technical') AS ta, avg(assertion) FILTER (orientation = 'reflexive') AS ra FROM o),
u AS (SELECT count(*) FILTER (p_size > 25) AS tr, count(*) FILTER (p_size <= 25) AS cr, avg(p_size) FILTER (p_size > 25) AS tt, avg(p_size) FILTER (p_size <= 25) AS ct FROM part),
x AS (SELECT avg(l_discount) * 10 AS corr, avg(l_tax) AS lift, avg((l_returnflag = 'R')::INT) AS crossing FROM lineitem)
SELECT 'H1' AS hypothesis, CASE WHEN c <= -0.15 THEN 'Soportada' WHEN c > 0.05 THEN 'No soportada' ELSE 'Inconclusa' END AS status FROM h
UNION ALL SELECT 'H2', CASE WHEN tr >= 20 AND cr >= 20 AND tt - ct > 3 THEN 'Soportada' WHEN tt - ct < -1 THEN 'No soportada' ELSE 'Inconclusa' END FROM u
UNION ALL SELECT 'H3', CASE WHEN th < rh AND ta > ra THEN 'Soportada' WHEN th >= rh THEN 'No soportada' ELSE 'Inconclusa' END FROM r
UNION ALL SELECT 'H4', CASE WHEN corr >= 0.75 AND lift >= 0.08 AND crossing < 0.12 THEN 'Riesgo alto HB' WHEN corr <= 0.6 AND crossing >= 0.18 THEN 'Riesgo acotado HB' ELSE 'Competencia abierta' END FROM x""")
def hypothesis_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-14: four readings by fixed rules, on stand-in facts."""
    rows = named(spark, sf_dir)
    volumes = rows.join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("community").agg(F.count(F.lit(1)).alias("posts"), F.avg((F.col("o_totalprice") > 150000).cast("int")).alias("diversity"))
    shares = volumes.join(F.broadcast(volumes.agg(F.sum("posts").alias("total")))).agg(F.corr(F.col("posts") / F.col("total"), "diversity").alias("volume_diversity_corr"))  # one row
    kinds = rows.withColumn("o", S.orientation(F.col("community")))
    mean = lambda o, c: F.avg(F.when(F.col("o") == o, c.cast("int")))
    hedge, sure = F.col("c_acctbal") < 0, F.col("c_acctbal") > 5000
    rates = kinds.agg(*[mean(o, c).alias(f"{o}_{n}") for o in ("technical", "reflexive") for n, c in (("hedge", hedge), ("assertion", sure))])
    large = F.col("p_size") > 25
    touches = table(spark, sf_dir, "part").agg(F.count_if(large).alias("technical_rows"), F.count_if(~large).alias("cultural_rows"), F.avg(F.when(large, F.col("p_size"))).alias("technical_touches"), F.avg(F.when(~large, F.col("p_size"))).alias("cultural_touches"))
    control = table(spark, sf_dir, "lineitem").agg((F.avg("l_discount") * 10).alias("lexical_corr"), F.avg("l_tax").alias("lexical_lift"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("cross_rate"))
    facts = shares
    for one in (rates, touches, control):
        facts = facts.join(F.broadcast(one))  # one row each
    return S.hypotheses(facts)


@query("""WITH g AS (SELECT r_regionkey, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
v AS (SELECT n::DOUBLE AS v, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS k, sum(n) OVER () AS total FROM g),
q AS (SELECT 2 * sum(i * v) / (any_value(k) * any_value(total)) - (any_value(k) + 1) / any_value(k) AS gini FROM v)
SELECT gini, CASE WHEN gini >= 0.8 THEN 'Muy alta (oligárquica)' WHEN gini >= 0.65 THEN 'Alta' WHEN gini >= 0.45 THEN 'Media' ELSE 'Baja' END AS regime FROM q""")
def concentration_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-36: what the Gini of the volumes is called."""
    from loomwright.operators import stats

    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    volumes = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_regionkey").count()  # 25 nations
    return stats.gini_and_shares(volumes, "count").select("gini", S.concentration_regime(F.col("gini")).alias("regime"))


@query("""WITH j AS (SELECT c_nationkey::BIGINT AS src, s_suppkey::BIGINT AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
d AS (SELECT dst, count(DISTINCT src)::DOUBLE AS v FROM j GROUP BY 1), k AS (SELECT v, row_number() OVER (ORDER BY v) AS i, row_number() OVER (ORDER BY v DESC) AS p, count(*) OVER () AS n, sum(v) OVER () AS total FROM d)
SELECT any_value(n) AS nodes, sum(v) FILTER (p <= greatest(1, ceil(0.02 * n))) / any_value(total) AS top_share, 2 * sum(i * v) / (any_value(n) * any_value(total)) - (any_value(n) + 1) / any_value(n) AS gini FROM k""")
def network_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-10: share of in-degree that the top 2 % of nodes have, and its Gini. Degrees are few distinct numbers, so they are counted first."""
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    degrees = j.join(table(spark, sf_dir, "supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_suppkey").agg(F.count_distinct("c_nationkey").alias("v"))
    return S.concentration(degrees, "v", 0.02)


@query("""WITH e AS (SELECT user_id % 4 AS kind, user_id || '/' || event_type AS message, event_id, value FROM events)
SELECT kind, message, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY kind, message ORDER BY event_id) AS k FROM e) WHERE k = 1""")
def first_wins_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-02: the first record of each type and id."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("kind"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("message"), "event_id", "value")
    return rows.groupBy("kind", "message").agg(F.min(F.struct("event_id", "value")).alias("f")).select("kind", "message", "f.*")


@query("""WITH p AS (SELECT event_id AS ord, CASE WHEN event_id % 3 > 0 THEN user_id::VARCHAR END AS id, event_type AS title, floor(value / 10)::BIGINT AS body FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY id, CASE WHEN id IS NULL THEN title END, CASE WHEN id IS NULL THEN body END ORDER BY ord) AS n FROM p) SELECT ord, id, title, body FROM k WHERE n = 1""")
def dedup_by_id_or_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03: the first post of each id, of those without one the first of each title and body."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("ord"), F.when(F.col("event_id") % 3 > 0, F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("title"), F.floor(F.col("value") / 10).cast("long").alias("body"))
    lacking = F.col("id").isNull()
    keys = [F.col("id").alias("k1"), F.when(lacking, F.col("title")).alias("k2"), F.when(lacking, F.col("body")).alias("k3")]
    return rows.groupBy(*keys).agg(F.min(F.struct("ord", "id", "title", "body")).alias("f")).select("f.*")
