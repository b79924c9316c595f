"""Coverage, outer-joined statistics, concentration and evaluation: small aggregates over large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(docs: DataFrame, id_col: str, type_col: str, created_col: str) -> DataFrame:
    """Per type: rows, distinct ids, duplicates and their share, missing times, first and last time."""
    out = docs.groupBy(type_col).agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct(id_col).alias("unique_ids"), F.count_if(F.col(created_col).isNull()).alias("missing_created"), F.min(created_col).alias("created_min"), F.max(created_col).alias("created_max")
    )
    return out.withColumn("duplicates", F.col("total") - F.col("unique_ids")).withColumn("duplicate_ratio", F.col("duplicates") / F.col("total"))


def null_safe_full_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join in which null keys meet; missing numbers become 0."""
    right = right.withColumnRenamed(key, "__key")
    joined = left.join(right, F.col(key).eqNullSafe(F.col("__key")), "full")
    # A null key on the left side is a match too, so either column may speak for the row.
    return joined.withColumn(key, F.coalesce(F.col(key), F.col("__key"))).drop("__key").fillna(0)


def gini_and_shares(values: DataFrame, value_col: str, tops: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row: n, total, gini, share of the largest ones. Non-negative finite values count.

    Equal values are first counted, so ranks come from a running sum over distinct values, not over rows.
    """
    v = values.where((F.col(value_col) >= 0) & ~F.isnan(value_col) & (F.col(value_col) < float("inf"))).select(F.col(value_col).cast("double").alias("v"))
    counts = v.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("below", F.coalesce(F.sum("n").over(up), F.lit(0))).withColumn("above", F.coalesce(F.sum("n").over(down), F.lit(0)))
    weighted = F.sum(F.col("v") * (F.col("n") * F.col("below") + F.col("n") * (F.col("n") + 1) / 2))
    n, total = F.sum("n"), F.sum(F.col("v") * F.col("n"))
    shares = [(F.sum(F.col("v") * F.greatest(F.lit(0), F.least(F.col("n"), k - F.col("above")))) / total).alias(f"top{k}_share") for k in tops]
    gini = F.when(total > 0, 2 * weighted / (n * total) - (n + 1) / n).otherwise(0.0)
    return ranked.agg(n.alias("n"), total.alias("total"), gini.alias("gini"), *shares)


def lorenz(values: DataFrame, value_col: str, steps: int = 20) -> DataFrame:
    """step, population share, cumulative share of the value at equal population steps from the smallest up."""
    counts = values.groupBy(F.col(value_col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(0))
    cum = counts.withColumn("p", F.sum("n").over(upto)).withColumn("s", F.sum(F.col("v") * F.col("n")).over(upto)).withColumn("rows", F.sum("n").over(everything)).withColumn("total", F.sum(F.col("v") * F.col("n")).over(everything))
    # The population at step k lies inside the run of one value: that run's start plus the part taken of it.
    at = F.floor(F.col("rows") * F.col("step") / steps)
    grid = cum.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("at", at).where((F.col("at") <= F.col("p")) & (F.col("at") > F.col("p") - F.col("n")))
    return grid.select("step", (F.col("at") / F.col("rows")).alias("population"), ((F.col("s") - F.col("v") * (F.col("p") - F.col("at"))) / F.col("total")).alias("share"))


def entropy(counts: Column) -> Column:
    """Natural-log entropy of an array of non-negative counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, v: a + v)
    return F.aggregate(F.filter(counts, lambda v: v > 0), F.lit(0.0), lambda a, v: a - v / total * F.ln(v / total))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def label_scores(matrix: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 from a confusion table."""
    rows = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit("t").alias("side")), F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side")))).alias("x"), "truth", "predicted", "n")
    by = rows.groupBy(F.col("x.label").alias("label")).agg(
        F.sum(F.when(F.col("x.side") == "t", F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("x.side") == "p", F.col("n")).otherwise(0)).alias("guessed"),
        F.sum(F.when((F.col("x.side") == "t") & (F.col("truth") == F.col("predicted")), F.col("n")).otherwise(0)).alias("hit"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    by = by.withColumn("precision", share(F.col("hit"), F.col("guessed"))).withColumn("recall", share(F.col("hit"), F.col("support")))
    return by.select("label", "support", "precision", "recall", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def auc(scores: DataFrame, score_col: str, positive_col: str) -> DataFrame:
    """One row: exact Mann-Whitney area. Equal scores are counted together, so ties share their rank."""
    counts = scores.groupBy(F.col(score_col).alias("s")).agg(F.count_if(F.col(positive_col)).alias("p"), F.count_if(~F.col(positive_col)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(F.lit(0)).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = counts.withColumn("w", F.col("p") * (below + F.col("q") / 2))
    return won.agg(F.when((F.sum("p") > 0) & (F.sum("q") > 0), F.sum("w") / (F.sum("p") * F.sum("q"))).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
