"""Raw records made of the driver's tables: read, normalised, written and read back, streamed, and reported on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import lexicons as L
from loomwright.functions import text as T
from loomwright.operators import diagnostics as D
from loomwright.operators import diffusion
from loomwright.operators import features as O
from loomwright.operators import memetics as M
from loomwright.operators import pragmatics as P
from loomwright.operators.lineage import shared_path
from loomwright.plans.registry import query, table
from loomwright.plans.relational import listings
from loomwright.plans.texts import NORMAL, sql_hits, sql_present
from loomwright.sources import records as R
from loomwright.sources import sinks
from loomwright.streaming import incremental as I

_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _joined(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON: the first turn as a post, later ones as comments under other names."""
    conv, turn = F.col("conv_id"), F.col("turn")
    day = F.lpad((conv % 28 + 1).cast("string"), 2, "0")
    post = F.struct(
        _joined("p", conv).alias("id"), F.struct(F.col("role").alias("name")).alias("submolt"), _joined("2024-01-", day, "T00:00:00Z").alias("createdAt"), F.col("text").alias("content"),
        F.lit("").alias("author_id"), F.struct(_joined("u", conv % 11).alias("id")).alias("author"),
    )
    comment = F.struct(
        _joined("c", conv, "-", turn).alias("comment_id"), _joined("p", conv).alias("post_id"), F.when(turn > 1, _joined("c", conv, "-", turn - 1)).alias("parent_id"), (conv % 1000 * 60 + turn + 1704067200).alias("timestamp"),
        F.col("text").alias("body"), F.col("role").alias("community"),
    )
    line = F.when(turn == 0, F.to_json(post)).otherwise(F.to_json(comment))
    return table(spark, sf_dir, "conversations").select(F.try_parse_json(line).alias("r"))


_CANONICAL = f"""SELECT CASE WHEN turn = 0 THEN 'post' ELSE 'comment' END AS record_type, coalesce(nullif(role, ''), 'unknown') AS community_id, 'p' || conv_id AS post_id,
  CASE WHEN turn = 0 THEN 'p' || conv_id ELSE 'c' || conv_id || '-' || turn END AS message_id, CASE WHEN turn > 1 THEN 'c' || conv_id || '-' || (turn - 1) END AS reply_to_id, CASE WHEN turn = 0 THEN 'u' || (conv_id % 11) ELSE 'unknown' END AS author_id,
  {_STAMP.format("CASE WHEN turn = 0 THEN TIMESTAMP '2024-01-01' + to_days((conv_id % 28)::INT) ELSE TIMESTAMP '2024-01-01' + to_seconds(conv_id % 1000 * 60 + turn) END")} AS "timestamp",
  coalesce(text, '') AS text, CASE WHEN turn > 0 THEN 'c' || conv_id || '-' || turn END AS comment_id FROM conversations"""


@query(_CANONICAL)
def canonical_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-02, PRJ-03, PRJ-04, SRC-02, DT-01, DT-04, JSN-01: posts and comments under different names as one relation."""
    return R.messages(_raw_messages(spark, sf_dir)).drop("language").withColumn("timestamp", _stamp(F.col("timestamp")))


@query(f"""WITH m AS ({_CANONICAL}) SELECT count(*) AS messages, count(*) FILTER (record_type = 'post') AS posts, count(*) FILTER (record_type = 'comment') AS comments, count(*) FILTER ("timestamp" IS NULL) AS missing_timestamp,
  count(*) FILTER (text = '') AS missing_text, count(*) FILTER (author_id = 'unknown') AS missing_author FROM m""")
def message_schema_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-36."""
    return R.schema_summary(R.messages(_raw_messages(spark, sf_dir)))


def _raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON posts; odd ids use the other name of each field."""
    user, name, body = F.col("user_id"), _joined("m", F.col("user_id") % 7), _joined("v", F.floor("value"))
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    one = F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("title"), body.alias("content"), F.floor("value").cast("string").alias("score"), F.struct(name.alias("name")).alias("submolt"),
        F.struct(_joined("u", user).alias("id"), _joined("n", user).alias("username")).alias("author"), F.array("event_type", name).alias("tags"), when.alias("created_at"),
    )
    other = F.struct(
        F.col("event_id").cast("string").alias("post_id"), F.col("event_type").alias("name"), body.alias("text"), F.floor("value").alias("likes"), name.alias("submolt"), _joined("u", user).alias("authorId"),
        _joined("n", user).alias("authorName"), when.alias("created"),
    )
    line = F.when(F.col("event_id") % 2 == 0, F.to_json(one)).otherwise(F.to_json(other))
    return table(spark, sf_dir, "events").select(F.try_parse_json(line).alias("r"))


@query("""SELECT event_id::VARCHAR AS id, event_type AS title, 'v' || floor(value)::BIGINT AS body, 'u' || user_id AS author_id, 'n' || user_id AS author_name, floor(value)::BIGINT AS score, 'm' || (user_id % 7) AS community,
  CASE WHEN event_id % 2 = 0 THEN event_type || ',m' || (user_id % 7) ELSE '' END AS tags, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM events""")
def normalized_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01, PRJ-05, SRC-01: one set of columns, whatever name a field has in a record."""
    found = R.posts(_raw_posts(spark, sf_dir))
    return found.select("id", "title", "body", "author_id", "author_name", "score", "community", F.array_join("tags", ",").alias("tags"), "created_at")


@query("SELECT 'c' || event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'own' || user_id ELSE 'page' || (event_id // 50) END AS post_id, floor(value)::BIGINT AS score, event_type AS body FROM events")
def payload_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13, SRC-14, SRC-16: items of pages of 50 under either of two keys; one without a post takes its page's."""
    own = F.when(F.col("event_id") % 3 == 0, _joined("own", F.col("user_id")))
    item = F.struct(_joined("c", F.col("event_id")).alias("comment_id"), own.alias("post_id"), F.floor("value").alias("score"), F.col("event_type").alias("text"))
    pages = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 50).alias("page")).agg(F.collect_list(item).alias("items"))  # of 50 ids each
    payload = F.when(F.col("page") % 2 == 0, F.to_json(F.struct(F.col("items").alias("results")))).otherwise(F.to_json("items"))
    items = R.payload_items(pages.select(_joined("page", F.col("page")).alias("listed"), payload.alias("payload")), "payload")
    return R.comments(items, "listed").select("id", "post_id", "score", "body")


_UNITS = {"mins": 60, "h": 3600, "d": 86400, "w": 604800, "mo": 2592000, "y": 31536000}


@query(f"""SELECT event_id, {_STAMP.format("ts - to_seconds((1 + user_id % 30) * [" + ", ".join(map(str, _UNITS.values())) + "][event_id % 6 + 1])")} AS at FROM events""")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-07: "3 mins ago" and the like, before each event's time."""
    unit = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (F.col("event_id") % 6 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(" ", (F.col("user_id") % 30 + 1).cast("string"), unit, F.lit("ago")).alias("said"))
    return e.select("event_id", _stamp(R.relative_time(F.col("said"), F.col("ts"))).alias("at"))


@query(f"""SELECT 'post' AS doc_type, event_id::VARCHAR AS doc_id, 'n' || user_id AS author_name, 'm' || (user_id % 7) AS community, {_STAMP.format('ts')} AS created_at, event_type || chr(10) || 'v' || floor(value)::BIGINT AS text FROM events
UNION ALL SELECT 'comment', 'c' || conv_id || '-' || turn, role, 'p' || conv_id, {_STAMP.format("TIMESTAMP '2024-01-01' + to_seconds(turn * 60)")}, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') FROM conversations WHERE turn % 4 <> 3""")
def unified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-06, PRJ-07, FLT-07: posts and comments as documents; comments whose time can't be read go (every fourth turn)."""
    turn = F.col("turn")
    record = F.struct(
        _joined("c", F.col("conv_id"), "-", turn).alias("id"), _joined("p", F.col("conv_id")).alias("community"), F.col("role").alias("authorName"), F.col("text").alias("body"),
        F.when(turn % 4 == 3, "some day").otherwise((turn * 60 + 1704067200).cast("string")).alias("created"),
    )
    raw = table(spark, sf_dir, "conversations").select(F.try_parse_json(F.to_json(record)).alias("r"))
    comments = R.comments(raw, keep=("r",)).withColumn("community", R.community(F.col("r")))
    docs = R.documents_of(R.posts(_raw_posts(spark, sf_dir)), comments)
    return docs.withColumn("created_at", _stamp(F.col("created_at")))


@query("""WITH t AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN value::VARCHAR WHEN 1 THEN event_type WHEN 2 THEN '' ELSE '-' || floor(value)::BIGINT || '.75' END AS x FROM events)
SELECT event_id, coalesce(TRY_CAST(x AS DOUBLE), 0) AS number, trunc(coalesce(TRY_CAST(x AS DOUBLE), 0))::BIGINT AS whole, strftime(ts, '%Y-%m-%d') AS "day" FROM t""")
def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-06, DT-08: numbers and days out of text, some of which says none."""
    k = F.col("event_id") % 4
    x = F.when(k == 0, F.col("value").cast("string")).when(k == 1, F.col("event_type")).when(k == 2, "").otherwise(_joined("-", F.floor("value"), ".75"))
    e = table(spark, sf_dir, "events").select("event_id", x.alias("x"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("t"))
    return e.select("event_id", R.safe_float(F.col("x")).alias("number"), R.safe_int(F.col("x")).alias("whole"), F.to_date(R.parsed_time(F.col("t"))).cast("string").alias("day"))


@query(f"""SELECT user_id AS post_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS run_id, CASE WHEN event_id % 9 > 0 THEN value END AS score, CASE WHEN event_id % 4 > 0 THEN event_id % 50 END AS rank, {_STAMP.format('ts')} AS run_time FROM events""")
def coerced_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: snapshot lines whose numbers are text, some of which says none; the time comes from the run's name."""
    line = F.struct(
        F.col("user_id").cast("string").alias("post_id"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("run_id"), F.when(F.col("event_id") % 9 > 0, F.col("value").cast("string")).otherwise("n/a").alias("score"),
        F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 50).cast("string")).otherwise("").alias("rank"),
    )
    r = F.col("r")
    raw = table(spark, sf_dir, "events").select(F.try_parse_json(F.to_json(line)).alias("r"))
    typed = raw.select(R.field(r, "post_id").try_cast("long").alias("post_id"), R.field(r, "run_id").alias("run_id"), R.field(r, "score").try_cast("double").alias("score"), R.field(r, "rank").try_cast("long").alias("rank"))
    return typed.withColumn("run_time", _stamp(diffusion.run_time(F.col("run_id"), F.lit(None).cast("timestamp"))))


@query("SELECT event_id, event_type, value, user_id % 5 = 0 AS flagged FROM events")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, SRC-01, SRC-03: written as JSON lines in two appends, read tolerantly and strictly; both must agree."""
    path = shared_path(spark, "lines")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", (F.col("user_id") % 5 == 0).alias("flagged"))
    sinks.write_jsonl(e.where("flagged"), path)
    sinks.write_jsonl(e.where("not flagged"), path, append=True)
    strict = R.jsonl_strict(spark, path, "event_id long, event_type string, value double, flagged boolean")
    loose = R.jsonl(spark, path, True).select(F.try_variant_get("r", "$.event_id", "long").alias("k"), F.try_variant_get("r", "$.value", "double").alias("v"))
    return strict.join(loose, (F.col("event_id") == F.col("k")) & F.col("value").eqNullSafe(F.col("v"))).drop("k", "v")


@query("SELECT doc_id, replace(text, chr(13), '') AS text, nullif(lang, '') AS lang, NULL::VARCHAR AS missing FROM documents")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03, SRC-08, SRC-25: whole texts with their quotes and line ends through CSV; a column that is missing stays empty."""
    path = shared_path(spark, "sheet")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\r", "").alias("text"), "lang")
    sinks.write_csv(docs, path, ["doc_id", "text", "lang", "missing"])
    return R.csv(spark, path).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("SELECT o_orderkey, o_totalprice, NULL::BIGINT AS views FROM orders")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02, SRC-06: written as Parquet; two columns are read, and one that the file lacks is null."""
    path = shared_path(spark, "orders")
    sinks.write_parquet(table(spark, sf_dir, "orders"), path)
    return R.parquet_columns(spark, path, {"o_orderkey": "long", "o_totalprice": "double", "views": "long"})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN c_mktsegment ELSE o_orderpriority END AS place FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def repaired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10, JN-13: blank values filled from a look-up by key."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("place"))
    lookup = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("place"))
    return sinks.repaired(rows, lookup, "key", ["place"]).drop("key")


@query("SELECT page_id, strlen(html) AS length, sha256(html) AS sha256 FROM pages")
def evidence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-62: length and SHA-256 of each page."""
    return sinks.hashed(table(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT vec_id, label, len(embedding) AS size FROM embeddings JOIN (SELECT event_id AS vec_id FROM events) USING (vec_id)")
def aligned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11, SRC-12: meta rows (events) past the last vector go."""
    meta = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"))
    return R.aligned(meta, table(spark, sf_dir, "embeddings"), "vec_id").select("vec_id", "label", F.size("embedding").alias("size"))


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_seen_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-01, STM-02, STM-05, SET-07: each event delivered twice and kept once; a second run finds nothing new."""
    out, state = shared_path(spark, "seen"), shared_path(spark, "state")
    twice = _event_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    for _ in range(2):
        I.sink(I.unseen(twice, ["event_id"], "ts").drop("delivery", "ts"), out, state).awaitTermination()
    return spark.read.parquet(out)


def _final(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    path = shared_path(spark, "batches")
    I.each_batch(stream, I.batch_writer(path), shared_path(spark, "state")).awaitTermination()
    return I.latest(spark, path, keys)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table may be one file; a stream takes a folder or a pattern, so its path is given as a pattern."""
    return I.file_stream(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema, "parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"SELECT user_id AS post_id, strftime(ts, '%Y%m%d') AS run_id, max(value) AS score, min((props::JSON ->> 'k')::BIGINT) AS rank, {_STAMP.format('min(ts)')} AS observed FROM events GROUP BY 1, 2")
def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-03, STM-04: a post's best rank and score in each run, in batches whose writing may be repeated."""
    rank = F.get_json_object("props", "$.k").cast("long").alias("rank")
    rows = _event_stream(spark, sf_dir).select(F.col("user_id").alias("post_id"), F.date_format("ts", "yyyyMMdd").alias("run_id"), F.col("value").alias("score"), rank, F.col("ts").alias("observed"))
    return _final(spark, I.snapshots(rows), ["post_id", "run_id"]).withColumn("observed", _stamp(F.col("observed")))


@query(f"""WITH e AS (SELECT event_type, value, ts, epoch_us(ts) AS us FROM events), w AS (SELECT *, unnest(generate_series(0, 4)) AS k FROM e),
s AS (SELECT event_type, value, us, (us // 604800000000 - k) * 604800000000 AS start FROM w) SELECT event_type, {_STAMP.format('make_timestamp(start)')} AS window_start, count(*) AS n, avg(value) AS mean FROM s WHERE us < start + 2592000000000 GROUP BY 1, start""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-06, STM-07: 30 days every 7 days on event time, aligned to the epoch."""
    rows = I.sliding(_event_stream(spark, sf_dir), "ts", ["event_type"], "value", late="60 days").select("event_type", F.col("window.start").alias("start"), "n", "mean")
    return _final(spark, rows, ["event_type", "start"]).select("event_type", _stamp(F.col("start")).alias("window_start"), "n", "mean")


_TAGGED = "t AS (SELECT date_trunc('hour', ts) AS hour, user_id::VARCHAR AS author, CASE WHEN user_id % 7 > 0 THEN 'm' || (user_id % 7) ELSE 'unknown' END AS community, '#' || event_type || ' #' || event_type || ' #k' || (event_id % 5) || CASE WHEN event_id % 3 = 0 THEN ' 🚀🔥' ELSE '' END AS text FROM events)"
_SERIES_SQL = f"""SELECT {_STAMP.format('hour')} AS hour, meme, meme_type, count(*) AS "count", count(DISTINCT author) AS unique_authors, CASE WHEN grouping(community) = 1 THEN 'global' ELSE 'submolt' END AS scope, community
FROM x GROUP BY GROUPING SETS ((hour, meme, meme_type), (hour, meme, meme_type, community))"""


@query(f"""WITH {_TAGGED}, x AS (SELECT hour, author, community, 'hashtag' AS meme_type, '#' || lower(unnest(regexp_extract_all(text, '#([\\pL\\pN_\\-]{{1,50}})', 1))) AS meme FROM t
UNION ALL SELECT hour, author, community, 'emoji', unnest(regexp_extract_all(text, '[\\x{{1F300}}-\\x{{1FAFF}}]')) FROM t) {_SERIES_SQL}""")
def token_meme_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19, SET-10, UDF-01: hashtags and emojis per hour, everywhere and per community. Events carry made-up texts."""
    e = table(spark, sf_dir, "events")
    text = F.concat(_joined("#", F.col("event_type"), " #", F.col("event_type"), " #k", F.col("event_id") % 5), F.when(F.col("event_id") % 3 == 0, " 🚀🔥").otherwise(""))
    docs = e.select("ts", F.col("user_id").alias("author"), F.when(F.col("user_id") % 7 > 0, _joined("m", F.col("user_id") % 7)).alias("community"), text.alias("text"))
    tags = F.transform(T.hashtags(F.col("text")), lambda t: F.concat(F.lit("#"), F.lower(t)))
    parts = [M.token_memes(docs, tags, "hashtag", "ts", "author", "community"), M.token_memes(docs, T.emojis(F.col("text")), "emoji", "ts", "author", "community")]
    return parts[0].unionByName(parts[1]).withColumn("hour", _stamp(F.col("hour")))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def top_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-01, TOP-10: the 25 largest, earlier ones first among equals."""
    return O.top(table(spark, sf_dir, "events").select("event_id", "value"), 25, "value", "event_id")


@query("SELECT doc_id, strip_accents(lower(text)) AS normal FROM documents")
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04: lower case without accents."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normal"))


@query(f"WITH n AS (SELECT doc_id, {NORMAL} AS t, text FROM documents) SELECT doc_id, {sql_hits(L.NARRATIVE)} AS hits, {sql_present(L.DISCLAIMERS, 'text')} AS present FROM n")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07, STR-08: all matches of a lexicon, and the patterns of another that match at all."""
    docs = O.normalized(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", T.hits(F.col("normal"), L.NARRATIVE).alias("hits"), T.patterns_present(F.col("text"), L.DISCLAIMERS).alias("present"))


@query("""SELECT doc_id, coalesce(lower(nullif(lang, '')), CASE WHEN length(trim(text)) >= 4 AND regexp_matches(text, '[a-z]') THEN 'guessed' ELSE 'unknown' END) AS language
FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 > 0 THEN upper(lang) END AS lang FROM documents)""")
def provided_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05: the language given, else what a detector says of longer texts (here one that knows Latin letters)."""
    given = F.when(F.col("doc_id") % 5 > 0, F.upper("lang"))
    detect = lambda t: F.when(t.rlike("[a-z]"), "guessed")
    return table(spark, sf_dir, "documents").select("doc_id", T.language_or_unknown(F.col("text"), given, detect).alias("language"))


@query("""WITH r AS (SELECT strftime(ts, '%Y%m%dT000000Z') AS run_id, min(ts) AS t FROM events GROUP BY 1), g AS (SELECT t, epoch(t - lag(t) OVER (ORDER BY t)) / 3600 AS gap FROM r),
a AS (SELECT round(epoch(max(o_orderdate) - min(o_orderdate)) / 86400, 4) AS created_days, round(avg((o_orderdate IS NULL)::INT), 6) AS missing_rate FROM orders),
b AS (SELECT round(epoch(max(t) - min(t)) / 86400, 4) AS run_days, count(*) AS runs, round(median(gap), 3) AS gap_median, round(max(gap), 3) AS gap_max, round(min(gap), 3) AS gap_min FROM g)
SELECT created_days, missing_rate, run_days, runs, gap_median, gap_max, gap_min, round(created_days / run_days, 4) AS ratio FROM a, b""")
def temporal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-02, DT-06: both windows, their ratio and the cadence of runs."""
    created = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("created"))
    runs = listings(spark, sf_dir).select("run_id", F.col("seen").alias("run_time"))
    return diffusion.temporal_summary(created, runs).drop("recommended")


_MEASURES = "value / (value + 100) AS mean_conflict_index, 1 / (1 + user_id % 5) AS mean_coordination_index, (event_id % 10) / 10 AS mean_rigidity_score, (user_id % 4) / 4 AS dominance_vs_reciprocity, (event_id % 3) / 3 AS identity_vs_task_orientation"
_WINDOWS = f"""e AS (SELECT event_type AS community, event_id, user_id, ts, value / (value + 100) AS c, (user_id % 4) / 4 AS u, {_MEASURES} FROM events),
s AS (SELECT community, min(ts) AS t0, max(ts) AS t1 FROM e GROUP BY 1), w AS (SELECT community, unnest(generate_series(t0, t1, INTERVAL 3 DAY)) AS ws FROM s),
m AS (SELECT w.community, ws, {', '.join(f'avg({k}) AS {k}' for k in D.MEANS)} FROM w JOIN e ON e.community = w.community AND e.ts >= ws AND e.ts < ws + INTERVAL 10 DAY GROUP BY 1, 2),
l AS (SELECT *, list(mean_conflict_index) OVER p AS p1, list(mean_coordination_index) OVER p AS p2 FROM m WINDOW p AS (PARTITION BY community ORDER BY ws ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, list_median(p1) AS m1, list_median(p2) AS m2 FROM l), f AS (SELECT *, list_median([abs(x - m1) for x in p1]) AS a1, list_median([abs(x - m2) for x in p2]) AS a2 FROM d),
al AS (SELECT *, concat_ws('+', CASE WHEN a1 >= 1e-9 AND abs(mean_conflict_index - m1) / (1.4826 * a1) >= 1.5 THEN 'mean_conflict_index' END, CASE WHEN a2 >= 1e-9 AND abs(mean_coordination_index - m2) / (1.4826 * a2) >= 1.5 THEN 'mean_coordination_index' END) AS metrics FROM f),
la AS (SELECT community, max(ws) AS ws FROM m GROUP BY 1), lm AS (SELECT m.* FROM m JOIN la USING (community, ws)),
q AS (SELECT community, 'control' AS key, c AS v FROM e UNION ALL SELECT community, 'identity', (1 - c) * u FROM e UNION ALL SELECT community, 'trust', (1 - c) * (1 - u) FROM e UNION ALL SELECT community, 'novelty', 0.3 FROM e WHERE event_id % 2 = 0),
z AS (SELECT community, count(*) AS n FROM e GROUP BY 1), sh AS (SELECT community, key, sum(v) / any_value(n) AS share FROM q JOIN z USING (community) GROUP BY 1, 2),
tc AS (SELECT community, string_agg(key, ',' ORDER BY k) AS top_concerns FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY share DESC, key) AS k FROM sh) WHERE k <= 3 GROUP BY 1),
ac AS (SELECT community, count(*) AS alerts_count, string_agg({_STAMP.format('ws')} || ' ' || metrics, '|' ORDER BY ws) AS alerts FROM al WHERE metrics <> '' GROUP BY 1)"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the five indices and a map of concerns, by plain rules."""
    event, user, value = F.col("event_id"), F.col("user_id"), F.col("value")
    c, u = value / (value + 100), user % 4 / 4
    held = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("control", c), ("identity", (1 - c) * u), ("trust", (1 - c) * (1 - u)), ("novelty", F.when(event % 2 == 0, 0.3)))]), lambda x: x["v"].isNotNull()))
    values = (c, 1 / (1 + user % 5), event % 10 / 10, u, event % 3 / 3)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("community"), F.col("ts").cast("timestamp").alias("ts"), "user_id", *[v.alias(k) for k, v in zip(D.MEANS, values, strict=True)], held.alias("concerns"))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measured(spark, sf_dir)
    windows = P.windows(rows, "community", "ts", 10, 3).groupBy("community", "window_start").agg(*[F.avg(k).alias(k) for k in D.MEANS])
    listed = list(D.MEANS[:2])
    marked = P.alerts(windows, "community", listed, 1.5).withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 10 DAYS"))
    return D.report(marked, D.mean_distribution(rows, ["community"], "concerns"), "community", listed)


@query(f"""WITH {_WINDOWS} SELECT lm.community, {_STAMP.format('lm.ws')} AS window_start, mean_conflict_index - mean_coordination_index AS conflict_vs_coordination, 2 * mean_rigidity_score - 1 AS rigidity_vs_plasticity,
  2 * dominance_vs_reciprocity - 1 AS profile_dominance, 2 * identity_vs_task_orientation - 1 AS profile_identity, mean_conflict_index, mean_coordination_index, mean_rigidity_score,
  row_number() OVER (ORDER BY mean_conflict_index DESC, lm.community) AS conflict_rank, row_number() OVER (ORDER BY mean_coordination_index DESC, lm.community) AS coordination_rank, top_concerns, coalesce(alerts, '') AS alerts, coalesce(alerts_count, 0) AS alerts_count
FROM lm LEFT JOIN tc USING (community) LEFT JOIN ac USING (community)""")
def diagnostics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-35, MAP-01: profile, ranks, concerns and alerts of each community, with a bound for alerts that fits the fixture."""
    shown = F.array_join(F.transform("alerts", lambda a: F.concat_ws(" ", _stamp(a["window_start"]), a["metrics"])), "|")
    return _report(spark, sf_dir).withColumns({"window_start": _stamp(F.col("window_start")), "top_concerns": F.array_join("top_concerns", ","), "alerts": shown})


@query(f"WITH {_WINDOWS} SELECT count(DISTINCT community) AS community_count, count(*) FILTER (metrics <> '') AS alerts_count FROM al")
def diagnostics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-35."""
    return D.summary(_report(spark, sf_dir))


@query(f"""WITH {_WINDOWS}, ci AS (SELECT community, -sum(share * ln(share)) AS h FROM (SELECT community, share / sum(share) OVER (PARTITION BY community) AS share FROM sh) WHERE share > 0 GROUP BY 1),
il AS (SELECT community, -sum(p * ln(p)) AS h FROM (SELECT community, count(*) / sum(count(*)) OVER (PARTITION BY community) AS p FROM e GROUP BY community, user_id % 5) GROUP BY 1), st AS (SELECT community, stddev_pop(c) AS sd FROM e GROUP BY 1)
SELECT community, least(1, greatest(0, (il.h / 2 + sd + ci.h / 2.5) / 3)) AS structural_entropy FROM ci JOIN il USING (community) JOIN st USING (community)""")
def community_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-09: how mixed the acts (here user modulo 5), stances and concerns of a community are."""
    rows = _measured(spark, sf_dir)
    concerns = D.mean_distribution(rows, ["community"], "concerns").groupBy("community").agg(F.collect_list("share").alias("concerns"))  # a few per community
    acts = rows.groupBy("community", (F.col("user_id") % 5).alias("act")).agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("community").agg(F.collect_list("n").alias("acts"))
    spread = rows.groupBy("community").agg(F.stddev_pop("mean_conflict_index").alias("sd"))
    return concerns.join(acts, "community").join(spread, "community").select("community", D.structural_entropy(F.col("acts"), F.col("sd"), F.col("concerns")).alias("structural_entropy"))
