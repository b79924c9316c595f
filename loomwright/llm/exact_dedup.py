"""Exact deduplication by 128-bit content hash, with bytes compared inside each hash group.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one space. Rows are
grouped by (128-bit hash, normalised text): the grouping compares the bytes of the texts that share a
hash, so a collision makes two groups. Copies are combined before the shuffle, so a group that holds a
third of all rows arrives as one row per map task. What goes back to the rows is joined on
(hash, SHA-256); Spark splits its skewed partitions.

Defined results: a null text is empty; a null id sorts after all others; ties can't occur, as equal ids
with equal texts are the same document (repeated rows are all reported with the same result; the
filter ``drop_copies`` leaves one); rows that share an id but not a text are grouped each by its own text;
an empty table gives no rows; further columns are ignored by
``exact_groups`` and kept by ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import columns_of, one_of_each, written


def normalised(text: Column) -> Column:
    """Each run of white space as one space; only the runs that differ from one space are rewritten."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _groups(docs: DataFrame, id_col: str, text_col: str, hasher: Callable[[Column], Column]) -> DataFrame:
    """One row per distinct normalised text: hash, SHA-256, smallest id, number of rows."""
    norm = columns_of(docs, id_col, text_col).select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return (
        norm.groupBy(hasher(F.col("norm")).alias("h"), "norm")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    rows = columns_of(docs, id_col, text_col).select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.select("id", hasher(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256"))
    return rows.join(_groups(docs, id_col, text_col, hasher), ["h", "text_sha256"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: of equal texts one row, that with the smallest id (null last), of
    rows with that id the one with the smallest text before normalisation. Rows that share an id but not a text all count."""
    keep = written(_groups(docs, id_col, text_col, hash128).select(F.col("keep_id").alias("__keep"), F.col("text_sha256").alias("__sha")), "kept")
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    plain, odd = docs.where(own.isNotNull()), docs.where(own.isNull())
    repeated = plain.groupBy(own.alias("__id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id")
    if repeated.limit(1).count():  # an id alone doesn't name these rows' texts
        odd = odd.unionByName(plain.join(repeated, own == F.col("__id"), "left_semi"))
        plain = plain.join(repeated, own == F.col("__id"), "left_anti")
    odd = odd.withColumn("__own", F.sha2(normalised(text), 256))
    odd = odd.join(keep, own.eqNullSafe(F.col("__keep")) & (F.col("__own") == F.col("__sha")), "left_semi")
    return plain.join(keep.where("__keep is not null"), own == F.col("__keep"), "left_semi").unionByName(one_of_each(odd, [own, F.col("__own")], text).drop("__own"))
