"""How listings spread over runs, and whether their times keep their contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_time(run_id: Column, fallback: Column) -> Column:
    """The time in a run id like 20240131T120000Z, else the fallback."""
    return F.coalesce(F.try_to_timestamp(run_id, F.lit("yyyyMMdd'T'HHmmss'Z'")), fallback)


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(3.6e9)


def by_post_and_run(listings: DataFrame) -> DataFrame:
    """From (post_id, run_id, community, score, comments, rank, seen, ord): one row per post and run."""
    timed = listings.withColumn("run_time", run_time(F.col("run_id"), F.min("seen").over(Window.partitionBy("run_id"))))
    return timed.groupBy("post_id", "run_id").agg(
        F.min_by("community", F.when(F.col("community").isNotNull(), F.col("ord"))).alias("community"), F.max("score").alias("score"), F.max("comments").alias("comments"), F.min("rank").alias("rank"), F.min("run_time").alias("run_time")
    )


def posts(grouped: DataFrame) -> DataFrame:
    """Trajectory of each post: first, last, deltas, velocities, peak, ranks."""
    first = lambda c: F.min_by(c, F.struct("run_time", "run_id"))
    last = lambda c: F.max_by(c, F.struct("run_time", "run_id"))
    later = F.struct(F.coalesce("score", F.lit(-1.0)).alias("s"), (-F.unix_micros("run_time")).alias("t"))
    out = grouped.groupBy("post_id").agg(
        first("community").alias("community"), first("run_id").alias("first_run"), last("run_id").alias("last_run"), F.count(F.lit(1)).alias("runs_seen"),
        first("score").alias("score_first"), last("score").alias("score_last"), first("comments").alias("comment_first"), last("comments").alias("comment_last"),
        F.min("run_time").alias("t0"), F.max("run_time").alias("t1"), F.max_by("score", later).alias("peak_score"), F.max_by("run_id", later).alias("peak_run"), F.min("rank").alias("best_rank"), F.avg("rank").alias("mean_rank"),
    )
    out = out.withColumn("span", F.greatest(hours_between(F.col("t0"), F.col("t1")), F.lit(1e-6)))
    out = out.withColumn("score_delta", F.col("score_last") - F.col("score_first")).withColumn("comment_delta", F.col("comment_last") - F.col("comment_first"))
    return out.select("*", F.round("span", 3).alias("hours_span"), (F.col("score_delta") / F.col("span")).alias("score_velocity"), (F.col("comment_delta") / F.col("span")).alias("comment_velocity")).drop("t0", "t1", "span")


def runs(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("run_id", "community").agg(F.min("run_time").alias("run_time"), F.count_distinct("post_id").alias("posts_seen"), F.avg("score").alias("mean_score"), F.avg("comments").alias("mean_comments"))


def communities(per_run: DataFrame) -> DataFrame:
    """Means of means, as each run counts once."""
    return per_run.groupBy("community").agg(F.count_distinct("run_id").alias("runs_seen"), F.sum("posts_seen").alias("posts_seen_total"), F.avg("mean_score").alias("mean_score"), F.avg("mean_comments").alias("mean_comments"))


def temporal_checks(created: DataFrame, listings: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """Seven checks (id, status, value) from created(created), listings(run_id, run_time) and lineage(time_axis)."""
    c = created.agg(F.min("created").alias("c0"), F.max("created").alias("c1"), F.count_if(F.col("created").isNull()).alias("missing"), F.count(F.lit(1)).alias("docs"))
    per_run = listings.where("run_id is not null and run_time is not null").groupBy("run_id").agg(F.min("run_time").alias("t"), F.count_distinct("run_time").alias("times"))
    drift = F.abs(F.unix_micros("t") - F.unix_micros(F.try_to_timestamp("run_id", F.lit("yyyyMMdd'T'HHmmss'Z'")))) / 1e6
    r = per_run.agg(F.min("t").alias("r0"), F.max("t").alias("r1"), F.count_if(F.col("times") > 1).alias("bad"), F.max(drift).alias("drift"))
    both = c.crossJoin(F.broadcast(r))  # one row each
    days = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 8.64e10
    cd, rd, rate = days(F.col("c0"), F.col("c1")), days(F.col("r0"), F.col("r1")), F.when(F.col("docs") > 0, F.col("missing") / F.col("docs"))
    said = F.lit("WARN")
    if lineage is not None:
        n = lineage.agg(F.count_if(F.coalesce("time_axis", F.lit("unknown")).isin("unknown", "ambiguous")).alias("vague"))
        both = both.crossJoin(F.broadcast(n))
        said = F.when(F.col("vague") > 0, "WARN").otherwise("PASS")
    checks = [
        ("CHK-001", F.when(cd >= 0, "PASS").otherwise("FAIL"), cd), ("CHK-002", F.when(rd >= 0, "PASS").otherwise("FAIL"), rd), ("CHK-003", F.when(cd >= rd, "PASS").otherwise("WARN"), cd - rd),
        ("CHK-004", F.when(rate.isNull(), "WARN").when(rate == 0, "PASS").when(rate <= 0.01, "WARN").otherwise("FAIL"), rate), ("CHK-005", F.when(F.col("bad") > 0, "FAIL").otherwise("PASS"), F.col("bad")),
        ("CHK-006", F.when(F.col("drift").isNull(), "WARN").when(F.col("drift") <= 300, "PASS").when(F.col("drift") <= 900, "WARN").otherwise("FAIL"), F.col("drift")), ("CHK-007", said, F.lit(None)),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("id"), s.alias("status"), v.cast("double").alias("value")) for k, s, v in checks])
    return both.select(F.explode(rows).alias("x")).select("x.*")


def temporal_summary(created: DataFrame, listings: DataFrame) -> DataFrame:
    """One row: both windows in days, their ratio, the cadence of runs in hours, and the checks to act on."""
    gaps, c = cadence(listings), F.col("created")
    days = lambda a, b: F.round(hours_between(a, b) / 24, 4)
    a = created.agg(days(F.min(c), F.max(c)).alias("created_days"), F.round(F.avg(c.isNull().cast("double")), 6).alias("missing_rate"))
    b = gaps.agg(days(F.min("run_time"), F.max("run_time")).alias("run_days"), F.count(F.lit(1)).alias("runs"), *[F.round(f("gap_hours"), 3).alias(f"gap_{k}") for k, f in (("median", F.median), ("max", F.max), ("min", F.min))])
    open_checks = temporal_checks(created, listings).where("status <> 'PASS'").agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("recommended"))  # of seven checks
    both = a.join(F.broadcast(b)).join(F.broadcast(open_checks))  # one row each
    return both.withColumn("ratio", F.when(F.col("run_days") > 0, F.round(F.col("created_days") / F.col("run_days"), 4)))


def cadence(listings: DataFrame) -> DataFrame:
    """run_id, run_time and hours since the run before; a row per run."""
    per_run = listings.groupBy("run_id").agg(F.min("run_time").alias("run_time"))
    return per_run.withColumn("gap_hours", hours_between(F.lag("run_time").over(Window.partitionBy(F.lit(0)).orderBy("run_time", "run_id")), F.col("run_time")))
