"""Tables of similar pairs for readers, look-ups by id, and merges of records that come more than once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T

#: Fixed pattern of token-minting templates.
TEMPLATE = r"mbc-20|mbc20\.xyz|\"p\"\s*:\s*\"mbc-20\"|\"op\"\s*:\s*\"(mint|link|transfer)\""


def top_candidates(matches: DataFrame, seen: list[str], low: float, high: float | None, n: int, drop_unknown: bool = True) -> DataFrame:
    """The n best of (a, b, score, lang) in the score band, the last seen first among equals. Spark keeps n rows per task."""
    lang = F.when(F.trim(F.coalesce("lang", F.lit(""))) == "", "unknown").otherwise(F.trim("lang"))
    rows = matches.withColumn("lang", lang).where((F.col("score") >= low) & F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    if high is not None:
        rows = rows.where(F.col("score") <= high)
    if drop_unknown:
        rows = rows.where("lang <> 'unknown'")
    return rows.orderBy(F.desc("score"), *[F.desc(c) for c in seen]).limit(n)


def described_pairs(candidates: DataFrame, docs: DataFrame, min_alnum: int, dropped: list[str]) -> DataFrame:
    """Candidates with community and excerpt of both sides, without those that say nothing to a reader.

    ``candidates`` is a top-n list, so it is what is broadcast; ``docs`` (id, community, excerpt) isn't moved.
    """
    out = candidates
    for side in "ab":
        own = docs.select(F.col("id").alias(side), F.col("community").alias(f"{side}_community"), F.col("excerpt").alias(f"{side}_excerpt"))
        out = own.join(F.broadcast(out), side)
        text = F.col(f"{side}_excerpt")
        out = out.where(~F.coalesce(F.col(f"{side}_community"), F.lit("")).isin(dropped) & (T.alnum_count(text) >= min_alnum) & ~T.looks_like_template(text, TEMPLATE))
        out = out.withColumn(f"{side}_plain", F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "))
    return out.where("a_plain <> b_plain")


def greedy_pairs(described: DataFrame, seen: list[str], n_out: int, most: int) -> DataFrame:
    """Pairs across communities first, then by score; each left document, unordered pair and pair of texts once; the first n_out.

    What is taken depends on what was taken before, so at most ``most`` rows are looked at in order in one task.
    """
    cross = ~F.col("a_community").eqNullSafe(F.col("b_community"))
    keys = {
        "pair": F.concat_ws("\t", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string")),
        "texts": F.concat_ws("\t", F.least("a_plain", "b_plain"), F.greatest("a_plain", "b_plain")),
    }
    rows = described.select("a", "b", "score", "lang", "a_community", "b_community", "a_excerpt", "b_excerpt", cross.alias("crossing"), *[c.alias(k) for k, c in keys.items()], *[F.col(c).alias(f"seen{k}") for k, c in enumerate(seen)])
    order = ["crossing", "score", *[f"seen{k}" for k in range(len(seen))]]
    kept = ["a", "b", "score", "lang", "a_community", "b_community", "a_excerpt", "b_excerpt"]
    rows = rows.orderBy(*[F.desc(c) for c in order]).limit(most).coalesce(1)

    def take(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if not held:
            return
        rows = pd.concat(held).sort_values(order, ascending=False)
        used, pairs, texts, out = set(), set(), set(), []
        for k, row in enumerate(rows.itertuples(index=False)):
            if row.a in used or row.pair in pairs or row.texts in texts:
                continue
            out.append(k)
            used.add(row.a)
            pairs.add(row.pair)
            texts.add(row.texts)
            if len(out) == n_out:
                break
        yield rows.iloc[out][kept]

    return rows.mapInPandas(take, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields))


def looked_up(wanted: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(id, doc_type, text) of the wanted (id, kind): of that kind, or where the kind is null of a post, else of a comment.

    An id that is wanted both as a post and as a comment gives the comment, as later records replace earlier ones.
    """
    kinds = wanted.groupBy("id").agg(F.bool_or(F.col("kind").eqNullSafe("post")).alias("post"), F.bool_or(F.col("kind").eqNullSafe("comment")).alias("comment"), F.bool_or(F.col("kind").isNull()).alias("any"))
    found = posts.select("id", F.lit("post").alias("doc_type"), "text").unionByName(comments.select("id", F.lit("comment").alias("doc_type"), "text"))
    rows = found.join(kinds, "id").where(F.when(F.col("doc_type") == "post", F.col("post") | F.col("any")).otherwise(F.col("comment") | F.col("any")))
    first = F.when((F.col("doc_type") == "comment") & F.col("comment"), 0).when(F.col("doc_type") == "post", 1).otherwise(2)
    return rows.groupBy("id").agg(F.min(F.struct(first.alias("k"), "doc_type", "text")).alias("b")).select("id", "b.doc_type", "b.text")


def merged(rows: DataFrame, key: str, order: str, values: list[str], lists: dict[str, str], lowest: list[str]) -> DataFrame:
    """One record per key: each value is the first that isn't blank; lists hold distinct values as first seen; the lowest ranks."""
    filled = [F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order))).alias(c) for c in values]
    out = rows.groupBy(key).agg(*filled, *[F.min(c).alias(c) for c in lowest])
    for source, name in lists.items():
        seen = rows.where(F.col(source).isNotNull() & (F.col(source) != "")).groupBy(key, source).agg(F.min(order).alias("o"))
        held = seen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col(source).alias("v")))), lambda x: x["v"]).alias(name))
        out = out.join(held, key, "left")
    return out


def last_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last record of each key."""
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), order).alias("r"))
    return best.select(*key, "r.*")


def flattened_replies(threads: DataFrame, post: str, comments: str) -> DataFrame:
    """(post_id, id, parent_id, depth, thread_path, position) of comments given as JSON with nested ``replies``, in reading order."""
    import json

    kind = threads.schema[post].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for post_id, text in zip(part["p"], part["c"], strict=True):
                root = "" if post_id is None else str(post_id)
                todo = [(c, None, 0, root) for c in reversed(json.loads(text or "[]"))]
                place = 0
                while todo:
                    comment, parent, depth, base = todo.pop()
                    if not isinstance(comment, dict):
                        continue
                    own = comment.get("id")
                    path = comment.get("thread_path") or "/".join(x for x in (base, own or "") if x)
                    out.append((post_id, own, comment.get("parent_id") or parent, comment.get("depth", depth), path, place))
                    place += 1
                    replies = comment.get("replies")
                    todo += [(c, own or parent, depth + 1, path or base) for c in reversed(replies if isinstance(replies, list) else [])]
            yield pd.DataFrame(out, columns=["post_id", "id", "parent_id", "depth", "thread_path", "position"])

    rows = threads.select(F.col(post).cast("string").alias("p"), F.col(comments).alias("c")).mapInPandas(run, "post_id string, id string, parent_id string, depth long, thread_path string, position long")
    return rows.withColumn("post_id", F.col("post_id").cast(kind))


def popularity(score: Column, comments: Column) -> dict[str, Column]:
    return {"popularity": 1 + score + F.lit(0.3) * comments, "engagement": score + comments}
