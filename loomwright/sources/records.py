"""Reading raw records: tolerant and strict JSON lines, canonical posts, comments and messages, listings, edges.

Raw records keep their key aliases as a VARIANT, so that a field may be a string in one record and a
struct in the next, and so that a key nobody named costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as T

LIST_KEYS = ("data", "results", "items", "posts", "comments")
POST_FIELDS = {
    "id": ("id", "post_id", "uuid"), "title": ("title", "name"), "body": ("body", "content", "text"), "author_id": ("author_id", "authorId", "author.id"), "author_name": ("author_name", "authorName", "author.name", "author.username"),
    "created_at": ("created_at", "createdAt", "created"), "created_at_raw": ("created_at_raw", "createdRaw"), "updated_at": ("updated_at", "updatedAt", "updated"), "score": ("score", "upvotes", "likes"),
    "comment_count": ("comment_count", "comments_count", "num_comments"), "views": ("views", "view_count"), "url": ("url", "permalink"), "source": ("source",), "filter": ("filter",), "listing_rank": ("listing_rank", "rank"), "scrape_ts": ("scrape_ts",),
}
COMMENT_FIELDS = {
    "id": ("id", "comment_id", "uuid"), "post_id": ("post_id", "postId"), "parent_id": ("parent_id", "parentId"), "body": ("body", "content", "text"), "author_id": ("author_id", "authorId", "author.id"),
    "author_name": ("author_name", "authorName", "author.name", "author.username"), "created_at": ("created_at", "createdAt", "created"), "created_at_raw": ("created_at_raw", "createdRaw"), "score": ("score", "upvotes", "likes"),
    "depth": ("depth",), "thread_path": ("thread_path",), "scrape_ts": ("scrape_ts",),
}
NUMBERS = {"score", "comment_count", "views", "listing_rank", "depth"}


def jsonl(spark: SparkSession, path: str, objects_only: bool = False) -> DataFrame:
    """``line`` and ``r`` (VARIANT): blank and malformed lines are skipped, a missing path is empty."""
    try:
        lines = spark.read.text(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        lines = spark.createDataFrame([], "value string")
    rows = lines.select(F.col("value").alias("line"), F.try_parse_json("value").alias("r")).where("trim(line) <> '' and r is not null")
    return rows.where(F.schema_of_variant("r").startswith("OBJECT")) if objects_only else rows


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parquet_columns(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """These columns only; those a file lacks are null of the given type."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in columns.items()])


def found_posts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """``posts.parquet`` of a folder, else its ``posts.jsonl``, else no rows."""
    for name, read in (("posts.parquet", spark.read.schema(schema).parquet), ("posts.jsonl", spark.read.schema(schema).option("mode", "DROPMALFORMED").json)):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return read(path.toString())
    return spark.createDataFrame([], schema)


def aligned(meta: DataFrame, vectors: DataFrame, position: str) -> DataFrame:
    """Meta rows with the vector at their position; rows past the last vector go."""
    return meta.join(vectors, position)


def csv(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", infer).csv(path)


def edge_list(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """src, dst, weight of a CSV of edges; rows without an end are dropped."""
    return csv(spark, path).select(F.col(source).alias("src"), F.col(target).alias("dst")).dropna().groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def field(r: Column, *names: str) -> Column:
    """The first of these paths that is there, as text."""
    return F.coalesce(*[F.try_variant_get(r, f"$.{n}", "string") for n in names])


def filled(r: Column, *names: str) -> Column:
    """Like ``field``, with empty text as missing."""
    return F.coalesce(*[F.nullif(F.try_variant_get(r, f"$.{n}", "string"), F.lit("")) for n in names])


def community(r: Column, default: str | None = None) -> Column:
    """A community that is a struct with a name, or just a name."""
    name = F.coalesce(F.try_variant_get(r, "$.submolt.name", "string"), F.when(~F.schema_of_variant(F.variant_get(r, "$.submolt", "variant")).startswith("OBJECT"), F.try_variant_get(r, "$.submolt", "string")), F.try_variant_get(r, "$.community", "string"))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def _typed(r: Column, fields: dict[str, tuple[str, ...]]) -> list[Column]:
    return [(field(r, *names).try_cast("long") if k in NUMBERS else field(r, *names)).alias(k) for k, names in fields.items()]


def posts(raw: DataFrame) -> DataFrame:
    r = F.col("r")
    return raw.select(*_typed(r, POST_FIELDS), community(r).alias("community"), F.coalesce(F.try_variant_get(r, "$.tags", "array<string>"), F.array().cast("array<string>")).alias("tags"), F.to_json("r").alias("raw"))


def comments(raw: DataFrame, post_id: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Comments; one without a post takes that of the page it was listed on, which the column ``post_id`` of ``raw`` names."""
    named = [] if post_id is None else [F.col(post_id).alias("__page_post")]
    found = raw.select(*keep, *named, *_typed(F.col("r"), COMMENT_FIELDS), F.to_json("r").alias("raw"))
    return found if post_id is None else found.withColumn("post_id", F.coalesce("post_id", "__page_post")).drop("__page_post")


def payload_items(pages: DataFrame, payload: str) -> DataFrame:
    """One row (VARIANT ``r``) per item of a page: a list, or the list under the first known key that has one."""
    p = F.try_parse_json(payload)
    lists = [F.try_variant_get(p, "$", "array<variant>"), *[F.try_variant_get(p, f"$.{k}", "array<variant>") for k in LIST_KEYS]]
    return pages.select("*", F.explode(F.coalesce(*lists)).alias("r"))


def parsed_time(text: Column) -> Column:
    """ISO text, with Z or an offset, or seconds since 1970; null where neither."""
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_seconds(text.try_cast("double")))


def messages(raw: DataFrame, record_type: str | None = None) -> DataFrame:
    """Canonical messages: record type, community, post, message, comment, reply, author, time, text, language."""
    r = F.col("r")
    reply, post, own = filled(r, "reply_to_id", "parent_id", "in_reply_to"), filled(r, "post_id", "thread_id", "id"), filled(r, "comment_id", "id")
    has = lambda n: F.variant_get(r, f"$.{n}", "variant").isNotNull() & ~F.is_variant_null(F.variant_get(r, f"$.{n}", "variant"))
    inferred = F.when(reply.isNotNull() | has("parent_id"), "comment").when(has("replies") & has("post_id"), "comment").when(~has("post_id") & post.isNotNull(), "post").when(has("post_id"), "comment").otherwise("post")
    kind = F.lit(record_type) if record_type else F.coalesce(field(r, "record_type"), inferred)
    out = raw.select(
        kind.alias("record_type"), F.coalesce(filled(r, "community_id", "submolt.name", "community", "submolt"), F.lit("unknown")).alias("community_id"), F.coalesce(F.when(kind == "comment", filled(r, "post_id")), post, F.lit("")).alias("post_id"),
        F.when(kind == "comment", F.coalesce(own, F.lit(""))).otherwise(F.coalesce(post, F.lit(""))).alias("message_id"), reply.alias("reply_to_id"), F.coalesce(filled(r, "author_id", "author.id", "user_id"), F.lit("unknown")).alias("author_id"),
        parsed_time(filled(r, "timestamp", "created_at", "createdAt")).alias("timestamp"), F.coalesce(filled(r, "text", "content", "body"), F.lit("")).alias("text"), filled(r, "language", "lang").alias("language"),
    )
    return out.withColumn("comment_id", F.when(F.col("record_type") == "comment", F.col("message_id")))


def doc_text(title: Column, body: Column) -> Column:
    """Title and body as lines, stripped; one that is missing leaves nothing."""
    return T.strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))))


def documents_of(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts (id, title, body, ...) and comments (id, body, ...) as documents; those without a readable time go."""
    shared = ["author_name", "community", "created_at"]
    p = posts.select(F.lit("post").alias("doc_type"), F.col("id").alias("doc_id"), *shared, doc_text(F.col("title"), F.col("body")).alias("text"))
    c = comments.select(F.lit("comment").alias("doc_type"), F.col("id").alias("doc_id"), *shared, T.strip(F.coalesce("body", F.lit(""))).alias("text"))
    return p.unionByName(c).withColumn("created_at", parsed_time(F.col("created_at"))).where("created_at is not null")


def safe_float(text: Column, default: float = 0.0) -> Column:
    """The number that a text says, else ``default``; a number that isn't finite is none."""
    v = text.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(F.coalesce(v, F.lit(default)))


def safe_int(text: Column, default: int = 0) -> Column:
    """Like ``safe_float``, cut towards zero."""
    return safe_float(text, float(default)).cast("long")


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by an explicit order; copies are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("f")).select(*keys, *[F.col(f"f.{c}").alias(c) for c in rest])


def schema_summary(rows: DataFrame) -> DataFrame:
    """Counters over canonical messages."""
    return rows.agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("record_type") == "post").alias("posts"), F.count_if(F.col("record_type") == "comment").alias("comments"), F.count_if(F.col("timestamp").isNull()).alias("missing_timestamp"),
        F.count_if(F.col("text") == "").alias("missing_text"), F.count_if(F.col("author_id") == "unknown").alias("missing_author"),
    )


def relative_time(text: Column, now: Column) -> Column:
    """"14h ago" and the like, before ``now``; months count 30 days and years 365."""
    t = F.regexp_replace(F.lower(F.trim(text)), "mins|min", "m")
    n, unit = F.regexp_extract(t, r"(\d+)\s*(mo|m|h|d|w|y)\s*ago", 1).try_cast("double"), F.regexp_extract(t, r"(\d+)\s*(mo|m|h|d|w|y)\s*ago", 2)
    seconds = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800).when(unit == "mo", 2592000).when(unit == "y", 31536000)
    return F.when(t.isin("just now", "now"), now).when(unit != "", F.timestamp_micros(F.unix_micros(now) - (n * seconds * 1_000_000).cast("long")))
