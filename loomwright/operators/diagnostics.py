"""What the windows of communities say: profiles, rankings, alerts, concerns and structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.pragmatics import clip01
from loomwright.operators.stats import entropy

MEANS = ("mean_conflict_index", "mean_coordination_index", "mean_rigidity_score", "dominance_vs_reciprocity", "identity_vs_task_orientation")


def mean_distribution(rows: DataFrame, by: list[str], distribution: str) -> DataFrame:
    """by, key, share: the mean of maps over all rows of a group; a key that a map lacks counts as 0 there."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    sums = rows.select(*by, F.explode(distribution).alias("key", "v")).groupBy(*by, "key").agg(F.sum("v").alias("v"))
    return sums.join(sizes, by).select(*by, "key", (F.col("v") / F.col("__n")).alias("share"))


def structural_entropy(illocutions: Column, stance_std: Column, concerns: Column) -> Column:
    """From shares of illocutions and concerns, and the spread of the stances."""
    return clip01((entropy(illocutions) / 2.0 + stance_std + entropy(concerns) / 2.5) / 3.0)


def report(windows: DataFrame, concerns: DataFrame, community: str, alerts: list[str], top: int = 3) -> DataFrame:
    """One row per community: profile of its last window, windows with an alert and what triggered it, its top concerns.

    ``windows`` has window_start, window_end, the ``MEANS`` and boolean alert_* columns; ``concerns`` has key and share.
    Communities are ranked in one task, as a row each.
    """
    fired = F.filter(F.array(*[F.when(F.col(f"alert_{m}"), F.lit(m)) for m in alerts]), lambda m: m.isNotNull())
    marked = windows.withColumn("fired", fired)
    per = marked.groupBy(community).agg(
        F.max_by(F.struct("window_start", *MEANS), "window_start").alias("last"), F.count_if(F.size("fired") > 0).alias("alerts_count"),
        F.array_sort(F.collect_list(F.when(F.size("fired") > 0, F.struct("window_start", "window_end", F.array_join("fired", "+").alias("metrics"))))).alias("alerts"),
    )
    first = Window.partitionBy(community).orderBy(F.desc("share"), "key")
    best = concerns.withColumn("k", F.row_number().over(first)).where(F.col("k") <= top).groupBy(community).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "key"))), lambda x: x["key"]).alias("top_concerns"))
    last = lambda m: F.col(f"last.{m}")
    rank = lambda m: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(last(m)), community))
    two_sided = lambda m: 2 * last(m) - 1
    return per.join(best, community, "left").select(
        community, last("window_start").alias("window_start"), (last("mean_conflict_index") - last("mean_coordination_index")).alias("conflict_vs_coordination"),
        two_sided("mean_rigidity_score").alias("rigidity_vs_plasticity"), two_sided("dominance_vs_reciprocity").alias("profile_dominance"), two_sided("identity_vs_task_orientation").alias("profile_identity"),
        *[last(m).alias(m) for m in MEANS[:3]], rank("mean_conflict_index").alias("conflict_rank"), rank("mean_coordination_index").alias("coordination_rank"),
        F.coalesce("top_concerns", F.array().cast("array<string>")).alias("top_concerns"), "alerts", "alerts_count",
    )


def summary(report_rows: DataFrame) -> DataFrame:
    return report_rows.agg(F.count(F.lit(1)).alias("community_count"), F.coalesce(F.sum("alerts_count"), F.lit(0)).alias("alerts_count"))
