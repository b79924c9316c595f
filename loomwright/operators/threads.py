"""Threads of messages: parents, ancestors, context, adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reply_edges(messages: DataFrame) -> DataFrame:
    """From (post_id, id, parent_id, author): each reply with its parent's author (null where the parent is a post)."""
    parents = messages.select(F.col("id").alias("p_id"), F.col("author").alias("parent_author"))
    return messages.where("parent_id is not null").join(parents, F.col("parent_id") == F.col("p_id"), "left").select("post_id", "id", "parent_id", "author", "parent_author")


def adjacent_pairs(messages: DataFrame, thread: str, order: str, value: str) -> DataFrame:
    """Each message of a thread and the one after it."""
    line = Window.partitionBy(thread).orderBy(order)
    pairs = messages.select(thread, F.col(order).alias("source"), F.lead(order).over(line).alias("target"), F.col(value).alias("source_value"), F.lead(value).over(line).alias("target_value"))
    return pairs.where("target is not null")


def ancestors(messages: DataFrame, most: int = 3) -> DataFrame:
    """From (id, parent_id, text): ``chain``, up to ``most`` ancestors with text, nearest first.

    One self-join per step; a step over a blank text goes on, a cycle stops because an id seen is not followed.
    """
    base = messages.select("id", F.col("parent_id").alias("at"), F.array("id").alias("seen"), F.array().cast("array<string>").alias("chain"))
    nodes = messages.select(F.col("id").alias("n_id"), F.col("parent_id").alias("n_parent"), F.trim(F.coalesce("text", F.lit(""))).alias("n_text"))
    for _ in range(2 * most):
        step = base.join(nodes, (F.col("at") == F.col("n_id")) & (F.size("chain") < most) & ~F.array_contains("seen", F.col("n_id")), "left")
        chain = F.when(F.coalesce(F.col("n_text"), F.lit("")) != "", F.concat("chain", F.array("n_text"))).otherwise(F.col("chain"))
        base = step.select("id", F.col("n_parent").alias("at"), F.when(F.col("n_id").isNotNull(), F.concat("seen", F.array("n_id"))).otherwise(F.col("seen")).alias("seen"), chain.alias("chain"))
    return base.select("id", "chain")


def top_comments(comments: DataFrame, post: str, score: str, order: str, n: int = 3) -> DataFrame:
    """The best n comments of a post, earlier ones winning ties."""
    return comments.withColumn("place", F.row_number().over(Window.partitionBy(post).orderBy(F.desc(score), order))).where(F.col("place") <= n)


def post_context(posts: DataFrame, comments: DataFrame, post: str = "post_id", n: int = 3) -> DataFrame:
    """Post text followed by its top comments, one paragraph each."""
    best = top_comments(comments, post, "score", "ord", n)
    lines = best.groupBy(post).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("c"))  # at most n per post
    joined = posts.join(lines, post, "left")
    return joined.select(post, F.concat_ws("\n\n", "text", F.array_join(F.transform("c", lambda x: x["text"]), "\n\n")).alias("context_text"))
