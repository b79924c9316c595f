"""Per-document feature tables, and their totals by scope and by community."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T


def with_features(docs: DataFrame, features: dict[str, Column]) -> DataFrame:
    return docs.select("*", *[c.alias(k) for k, c in features.items()])


def staged(docs: DataFrame, keep: list[str], raw: dict[str, Column], derive: Callable[[dict[str, Column]], dict[str, Column]]) -> DataFrame:
    """``keep`` and what ``derive`` makes of ``raw``, which is a projection of its own: the optimizer keeps costly columns
    that are used several times apart, so each is computed once."""
    held = docs.select("*", *[c.alias(f"raw_{k}") for k, c in raw.items()])
    return held.select(*keep, *[c.alias(k) for k, c in derive({k: F.col(f"raw_{k}") for k in raw}).items()])


def normalized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``normal``, computed once for all lexicons."""
    return docs.withColumn("normal", T.normalize_text(F.col(text_col)))


def rates_by_scope(features: DataFrame, names: list[str], scope_col: str) -> DataFrame:
    """scope, feature, total, rate_per_doc for all documents and for each scope, in one pass (grouping sets)."""
    sums = [F.sum(n).cast("double").alias(n) for n in names]
    wide = features.rollup(scope_col).agg(F.grouping(scope_col).alias("g"), F.count(F.lit(1)).alias("docs"), *sums)
    scope = F.when(F.col("g") == 1, "all").otherwise(F.coalesce(F.col(scope_col), F.lit("unknown")))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("total")) for n in names]))
    return wide.select(scope.alias("scope"), "docs", pairs.alias("p")).select("scope", F.col("p.feature").alias("feature"), F.col("p.total").alias("total"), (F.col("p.total") / F.col("docs")).alias("rate_per_doc"))


def community_features(features: DataFrame, names: list[str], community_col: str) -> DataFrame:
    """Documents, sums and rates per community."""
    out = features.groupBy(community_col).agg(F.count(F.lit(1)).alias("doc_count"), *[F.sum(n).cast("double").alias(n) for n in names])
    return out.select("*", *[(F.col(n) / F.col("doc_count")).alias(f"{n}_rate") for n in names])


def averages_by_scope(features: DataFrame, names: list[str], scope_col: str) -> DataFrame:
    wide = features.rollup(scope_col).agg(F.grouping(scope_col).alias("g"), F.count(F.lit(1)).alias("docs"), *[F.avg(n).alias(f"avg_{n}") for n in names])
    return wide.withColumn("scope", F.when(F.col("g") == 1, "all").otherwise(F.coalesce(F.col(scope_col), F.lit("unknown")))).drop("g", scope_col)


def top(df: DataFrame, n: int, score: str, *ties: str) -> DataFrame:
    """The n largest; earlier ids win ties. Spark keeps n rows per task."""
    return df.orderBy(F.desc(score), *ties).limit(n)


def concept_lists(docs: DataFrame, concepts: list[str], stopwords: list[str], text_col: str = "text") -> DataFrame:
    """Add ``concepts``: the distinct known concepts of each text, sorted."""
    words = T.tokens(T.clean_text(F.col(text_col)))
    fit = F.filter(words, lambda t: (F.char_length(t) >= 3) & t.rlike(r"^\p{L}+$") & ~t.isin(stopwords))
    return docs.withColumn("concepts", F.array_sort(F.array_intersect(fit, F.array(*[F.lit(c) for c in concepts]))))


def concept_shares(listed: DataFrame, n: int) -> DataFrame:
    """concept, doc_count and share of all documents."""
    total = listed.agg(F.count(F.lit(1)).alias("docs"))
    counts = listed.select(F.explode("concepts").alias("concept")).groupBy("concept").agg(F.count(F.lit(1)).alias("doc_count"))
    # One row of totals meets at most as many rows as there are concepts.
    return counts.join(F.broadcast(total)).select("concept", "doc_count", (F.col("doc_count") / F.col("docs")).alias("share")).orderBy(F.desc("doc_count"), "concept").limit(n)


def concept_pairs(listed: DataFrame, n: int) -> DataFrame:
    """Pairs a < b inside each document's own list, counted."""
    pairs = listed.select(F.posexplode("concepts").alias("i", "concept_a"), "concepts").select("concept_a", F.explode(F.expr("slice(concepts, i + 2, size(concepts))")).alias("concept_b"))
    return pairs.groupBy("concept_a", "concept_b").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "concept_a", "concept_b").limit(n)
