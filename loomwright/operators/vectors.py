"""Similarity: exact top-k neighbours by blocks, TF-IDF, pair tables and their thresholds."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: F.lit(0.0)))


def _blocks(df: DataFrame, part: str, other_blocks: dict, own_blocks: dict, side: int) -> DataFrame:
    """Rows dealt to blocks, once for each block of the other side."""
    n = lambda blocks: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in blocks.items() for x in (str(k), v)]), F.col(part).cast("string")), F.lit(0)) if blocks else F.lit(0)
    rows = df.withColumn("mine", F.pmod(F.xxhash64("id"), F.greatest(n(own_blocks), F.lit(1)))).where(n(other_blocks) > 0)
    return rows.withColumn("its", F.explode(F.sequence(F.lit(0), (n(other_blocks) - 1).cast("int")))).withColumn("side", F.lit(side))


def nearest(left: DataFrame, right: DataFrame, k: int, part: str, floor: float = 1e-12, width: int | None = None) -> DataFrame:
    """The k right rows most similar to each left row of the same ``part``: left_id, right_id, score.

    Rows are (id, part, vector), or (id, part, index, value) for sparse unit vectors of ``width``. Scores are
    cosines; equal ids never match, ties go to the smaller id. Each pair of blocks is one matrix product that
    returns k rows per left row, so no group holds more than two blocks and no pair table is made. Scores are
    rounded to 12 digits, so that the order of sums can't decide a tie.
    """
    sizes = lambda df: {r[part]: -(-r["count"] // BLOCK) for r in df.groupBy(part).count().collect()}
    left_blocks, right_blocks = sizes(left), sizes(right)
    cols = ["id", part, "mine", "its", "side", *(["index", "value"] if width else ["vector"])]
    a = _blocks(left, part, right_blocks, left_blocks, 0).select(*cols)
    swap = {"mine": "its", "its": "mine"}
    b = _blocks(right, part, left_blocks, right_blocks, 1).select(*[F.col(swap.get(c, c)).alias(c) for c in cols])
    kind = left.schema["id"].dataType.simpleString()

    def dense(t: pa.Table) -> np.ndarray:
        if not width:
            x = np.stack(t.column("vector").to_numpy()).astype(float)
            size = np.sqrt((x * x).sum(1, keepdims=True))
            return np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        x = np.zeros((t.num_rows, width))
        index, value = (t.column(c).combine_chunks() for c in ("index", "value"))
        x[np.repeat(np.arange(t.num_rows), index.value_lengths().to_numpy()), index.flatten().to_numpy()] = value.flatten().to_numpy()
        return x

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        p, q = t.take(pa.array(np.flatnonzero(side == 0))), t.take(pa.array(np.flatnonzero(side == 1)))
        kinds = [("left_id", t.schema.field("id").type), ("right_id", t.schema.field("id").type), ("score", pa.float64())]
        if not p.num_rows or not q.num_rows:
            return pa.schema(kinds).empty_table()
        scores = np.round(dense(p) @ dense(q).T, 12)
        left_ids, right_ids = p.column("id").to_numpy(), q.column("id").to_numpy()
        scores[left_ids[:, None] == right_ids[None, :]] = -np.inf
        least = np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, max(0, scores.shape[1] - k)]
        row, col = np.nonzero((scores >= least[:, None]) & (scores > floor))  # the k best of each row, and ties with the last
        order = np.lexsort((right_ids[col], -scores[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < k], col[place < k]
        return pa.table([pa.array(left_ids[row], kinds[0][1]), pa.array(right_ids[col], kinds[1][1]), pa.array(scores[row, col])], names=[n for n, _ in kinds])

    per_block = a.unionByName(b).groupBy(part, "mine", "its").applyInArrow(run, f"left_id {kind}, right_id {kind}, score double")
    place = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id"))
    return per_block.withColumn("place", place).where(F.col("place") <= k)


def tfidf(counts: DataFrame, id_col: str, docs: int, min_df: int, max_share: float, features: int) -> tuple[DataFrame, DataFrame]:
    """From (id, term, tf): unit sparse vectors (id, index, value) with smoothed idf + 1, and the vocabulary.

    The vocabulary is the ``features`` most frequent terms within the bounds, so it may be sent everywhere.
    """
    terms = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_share * docs))
    top = terms.orderBy(F.desc("total"), "term").limit(features)
    vocabulary = top.select("term", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1).alias("index"), (F.ln((1 + docs) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = counts.join(F.broadcast(vocabulary), "term").select(id_col, "index", "term", (F.col("tf") * F.col("idf")).alias("w"))
    rows = weighed.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("index", "w", "term"))).alias("l"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return rows.select(id_col, F.transform("l", lambda x: x["index"]).alias("index"), F.transform("l", lambda x: x["w"] / F.col("size")).alias("value"), F.transform("l", lambda x: x["term"]).alias("terms")), vocabulary


def match_summary(matches: DataFrame) -> DataFrame:
    """One row from (score, lang, left_community, right_community): pairs, mean, median, languages, same-community share."""
    same = (F.col("left_community") == F.col("right_community")).cast("double")
    return matches.agg(F.count(F.lit(1)).alias("pairs"), F.avg("score").alias("mean_score"), F.percentile("score", 0.5).alias("median_score"), F.count_distinct("lang").alias("langs"), F.avg(F.coalesce(same, F.lit(0.0))).alias("same_community_rate"))


def threshold_grid(matches: DataFrame, thresholds: list[float]) -> DataFrame:
    """Pairs and same-community share at or above each threshold.

    A pair is counted once, at the highest threshold it reaches; running sums do the rest.
    """
    level = sum(((F.col("score") >= t).cast("int") for t in thresholds), F.lit(0))
    same = (F.col("left_community") == F.col("right_community")).cast("int")
    per = matches.select(level.alias("level"), F.coalesce(same, F.lit(0)).alias("same")).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("same").alias("s"))
    grid = matches.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(thresholds)], "level int, threshold double")
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = grid.join(per, "level", "left").select("threshold", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("pair_count"), F.coalesce(F.sum("s").over(down), F.lit(0)).alias("same"))
    return both.select("threshold", "pair_count", F.when(F.col("pair_count") > 0, F.col("same") / F.col("pair_count")).otherwise(0.0).alias("same_community_share"))


def histogram(matches: DataFrame, bins: int = 100) -> DataFrame:
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("score") * bins).cast("int")))
    counts = matches.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return matches.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def knee(grid: DataFrame) -> DataFrame:
    """The threshold with the largest relative drop from the one before; the first on ties."""
    before = F.lag("pair_count").over(Window.partitionBy(F.lit(0)).orderBy("threshold"))
    drops = grid.withColumn("drop", F.when(before > 0, 1 - F.col("pair_count") / before)).where("drop is not null")
    return drops.orderBy(F.desc("drop"), "threshold").limit(1).select("threshold", "drop")


def principal_components(rows: DataFrame, id_col: str, names: list[str], k: int = 2) -> DataFrame:
    """id and the first k coordinates of z-scored features; the largest loading of each axis is positive.

    One aggregate gives means, deviations and the covariance (its size is that of the feature list); numpy
    finds the axes; projecting is one more expression.
    """
    moments = rows.agg(*[f(F.col(n)).alias(f"{p}_{n}") for n in names for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    used = [n for n in names if (moments[f"s_{n}"] or 0) > 1e-12]
    z = {n: (F.col(n) - moments[f"m_{n}"]) / moments[f"s_{n}"] for n in used}
    pairs = rows.agg(*[F.covar_samp(z[a], z[b]).alias(f"{i}_{j}") for i, a in enumerate(used) for j, b in enumerate(used) if i <= j]).first()
    cov = np.array([[pairs[f"{min(i, j)}_{max(i, j)}"] for j in range(len(used))] for i in range(len(used))])
    values, axes = np.linalg.eigh(cov)
    axes = axes[:, np.argsort(-values)][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])
    share = sorted(values, reverse=True)[:k] / values.sum()
    points = [sum((z[n] * float(axes[i, c]) for i, n in enumerate(used)), F.lit(0.0)).alias(f"pc{c + 1}") for c in range(axes.shape[1])]
    return rows.select(id_col, *points, *[F.lit(float(s)).alias(f"explained{c + 1}") for c, s in enumerate(share)])
