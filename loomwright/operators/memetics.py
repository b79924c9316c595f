"""Time series of phrases and tags: counts, bursts, adoption, survival, self-excitation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T

DECAYS = (0.2, 0.4, 0.6, 0.8, 0.9)
LAGS = 24


def ngram_series(docs: DataFrame, text_col: str, time_col: str, n: int = 2, weight_col: str | None = None) -> DataFrame:
    """date, ngram, count (weighted): n-grams of the cleaned tokens per day."""
    weight = F.lit(1.0) if weight_col is None else F.when(F.coalesce(F.col(weight_col), F.lit(0)) == 0, 1.0).otherwise(F.col(weight_col).cast("double"))
    # The tokens are a column of their own, so that they aren't made again for each n-gram.
    rows = docs.where(F.col(time_col).isNotNull()).select(F.to_date(time_col).alias("date"), weight.alias("w"), T.tokens(T.clean_text(F.col(text_col))).alias("words"))
    rows = rows.select("date", "w", F.explode(T.ngrams(F.col("words"), n)).alias("ngram"))
    return rows.groupBy("date", "ngram").agg(F.sum("w").alias("count"))


def burst_scores(series: DataFrame) -> DataFrame:
    """ngram, burst (largest z-score over all days seen, absent days as 0), mean, std, max_day.

    The z-score is linear in the count, so the largest count decides and no pivot is needed.
    """
    days = series.agg(F.count_distinct("date").alias("d"), F.min("date").alias("first"))
    by = series.groupBy("ngram").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"), F.max(F.struct("count", (-F.unix_date("date")).alias("o"))).alias("m"), F.count(F.lit(1)).alias("k"))
    both = by.join(F.broadcast(days))  # one row
    mean = F.col("s") / F.col("d")
    var = F.when(F.col("d") > 1, F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * mean) / (F.col("d") - 1)))
    std = F.when(F.sqrt(var) > 1e-12, F.sqrt(var))
    burst = F.coalesce((F.col("m.count") - mean) / std, F.lit(0.0))
    day = F.when(std.isNull(), F.col("first")).otherwise(F.date_from_unix_date((-F.col("m.o")).cast("int")))
    return both.select("ngram", F.greatest(burst, F.lit(0.0)).alias("burst"), mean.alias("mean"), std.alias("std"), day.cast("string").alias("max_day"))


def hourly_series(rows: DataFrame, meme: str, time_col: str, author: str, scope: list[str] | None = None) -> DataFrame:
    """Per hour and meme (and community): count and distinct authors."""
    return rows.groupBy(F.date_trunc("hour", F.col(time_col)).alias("hour"), meme, *(scope or [])).agg(F.count(F.lit(1)).alias("count"), F.count_distinct(author).alias("unique_authors"))


def token_memes(docs: DataFrame, tokens: Column, kind: str, time_col: str, author: str, community: str) -> DataFrame:
    """Per hour and token, over all communities and in each: occurrences and distinct authors. Missing names are "unknown"."""
    rows = docs.select(
        F.date_trunc("hour", F.col(time_col)).alias("hour"), F.explode(tokens).alias("meme"), F.coalesce(F.col(author).cast("string"), F.lit("unknown")).alias("author"),
        F.coalesce(F.col(community).cast("string"), F.lit("unknown")).alias("community"),
    )
    hour, meme, place = F.col("hour"), F.col("meme"), F.col("community")
    wide = rows.groupingSets([[hour, meme], [hour, meme, place]], hour, meme, place).agg(F.count(F.lit(1)).alias("count"), F.count_distinct("author").alias("unique_authors"), F.grouping("community").alias("g"))
    return wide.select("hour", "meme", F.lit(kind).alias("meme_type"), "count", "unique_authors", F.when(F.col("g") == 1, "global").otherwise("submolt").alias("scope"), "community")


def lifetimes(rows: DataFrame, meme: str, time_col: str, community: str) -> DataFrame:
    """meme, lifetime in hours, entropy over communities, communities touched."""
    per = rows.groupBy(meme, community).agg(F.count(F.lit(1)).alias("n"), F.min(F.date_trunc("hour", F.col(time_col))).alias("a"), F.max(F.date_trunc("hour", F.col(time_col))).alias("b"))
    total = F.sum("n").over(Window.partitionBy(meme))
    per = per.withColumn("h", -F.col("n") / total * F.ln(F.col("n") / total))
    return per.groupBy(meme).agg(((F.unix_micros(F.max("b")) - F.unix_micros(F.min("a"))) / 3.6e9).alias("lifetime_hours"), F.sum("h").alias("community_entropy"), F.count(F.lit(1)).alias("communities_touched"))


def classify_memes(metrics: DataFrame) -> DataFrame:
    """From lifetime_hours, burst_score, community_entropy, communities_touched: class. Later rules override."""
    cut = metrics.agg(F.percentile("burst_score", 0.8).alias("cut"))
    m = metrics.join(F.broadcast(cut))  # one row
    life, burst, ent, n = (F.coalesce(c, F.lit(0)) for c in ("lifetime_hours", "burst_score", "community_entropy", "communities_touched"))
    first = F.when((life <= 48) & (burst >= F.col("cut")), "flash").when((life >= 168) & (burst < F.col("cut")), "persistent").otherwise("unknown")
    return m.withColumn("class", F.when((n <= 2) | (ent < 0.5), "local").when((n >= 5) & (ent > 1.5), "cross_community").otherwise(first)).drop("cut")


def adoption(rows: DataFrame, meme: str, author: str, time_col: str) -> DataFrame:
    """meme, mean_rt, peak_rt, adopters, hours: new authors among those active in an hour."""
    active = rows.select(meme, F.coalesce(F.col(author).cast("string"), F.lit("unknown")).alias("who"), F.date_trunc("hour", F.col(time_col)).alias("hour")).distinct()
    first = active.groupBy(meme, "who").agg(F.min("hour").alias("first"))
    per = active.join(first, [meme, "who"]).groupBy(meme, "hour").agg(F.count(F.lit(1)).alias("infected"), F.count_if(F.col("hour") == F.col("first")).alias("new"))
    return per.groupBy(meme).agg(F.avg(F.col("new") / F.col("infected")).alias("mean_rt"), F.max(F.col("new") / F.col("infected")).alias("peak_rt"), F.sum("new").alias("adopters"), F.count(F.lit(1)).alias("hours"))


def survival(durations: DataFrame, duration_col: str) -> DataFrame:
    """Kaplan-Meier survival and Nelson-Aalen hazard of positive durations, all of them ended."""
    d = durations.where(F.col(duration_col) > 0).groupBy(F.col(duration_col).alias("hours")).agg(F.count(F.lit(1)).alias("events"))
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("hours")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = Window.partitionBy(F.lit(0)).orderBy("hours").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("at_risk", F.sum("events").over(later))
    log = F.sum(F.when(F.col("events") < F.col("at_risk"), F.ln(1 - F.col("events") / F.col("at_risk")))).over(upto)
    # Of n at risk, d ended one after another: the steps of the hazard are 1/n + 1/(n-1) + ...
    step = F.aggregate(F.sequence(F.lit(0), (F.col("events") - 1).cast("int")), F.lit(0.0), lambda a, i: a + 1 / (F.col("at_risk") - i))
    return d.select("hours", "events", "at_risk", F.when(F.col("events") == F.col("at_risk"), 0.0).otherwise(F.exp(log)).alias("survival"), F.sum(step).over(upto).alias("hazard"))


def densified(series: DataFrame, meme: str) -> DataFrame:
    """One row per hour between a meme's first and last, absent hours as 0. From (meme, hour, count)."""
    span = series.groupBy(meme).agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(meme, F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return span.join(series.select(meme, "hour", "count"), [meme, "hour"], "left").select(meme, "hour", F.coalesce("count", F.lit(0)).alias("count"))


def excitation(dense: DataFrame, meme: str, decay: float, lags: int = LAGS) -> DataFrame:
    """Add ``x``: the decayed sum of the counts of the last hours."""
    back = Window.partitionBy(meme).orderBy("hour").rowsBetween(-lags, -1)
    past = F.collect_list("count").over(back)  # at most ``lags`` values
    return dense.withColumn("x", F.aggregate(past, F.lit(0.0), lambda a, c: a * decay + c))


def hawkes(dense: DataFrame, meme: str) -> DataFrame:
    """Best decay and non-negative (mu, alpha) of a discrete self-exciting series, by log-likelihood.

    Two-variable non-negative least squares has a closed form over sums, so the fit is one aggregate per
    decay; the likelihood is a second one.
    """
    fits = None
    for decay in DECAYS:
        rows = excitation(dense, meme, decay)
        s = rows.groupBy(meme).agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("sy"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("count")).alias("sxy"))
        det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
        mu, alpha = F.when(F.abs(det) > 1e-12, (F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / det), F.when(F.abs(det) > 1e-12, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det)
        one, other = F.col("sy") / F.col("n"), F.when(F.col("sxx") > 0, F.greatest(F.lit(0.0), F.col("sxy") / F.col("sxx"))).otherwise(0.0)
        # At a border one of them is 0: the better single fit explains more of the squares.
        gain_mu, gain_alpha = F.col("sy") * F.col("sy") / F.col("n"), F.when((F.col("sxx") > 0) & (F.col("sxy") > 0), F.col("sxy") * F.col("sxy") / F.col("sxx")).otherwise(0.0)
        inside = (mu >= 0) & (alpha >= 0)
        p = s.select(meme, "n", "sy", F.when(inside, mu).when(gain_mu >= gain_alpha, one).otherwise(0.0).alias("mu"), F.when(inside, alpha).when(gain_mu >= gain_alpha, 0.0).otherwise(other).alias("alpha"))
        lam = F.greatest(F.col("mu") + F.col("alpha") * F.col("x"), F.lit(1e-8))
        log_factorial = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("count").cast("int"))), F.lit(0.0), lambda a, i: a + F.ln(i))
        ll = rows.join(p, meme).groupBy(meme).agg(F.sum(F.col("count") * F.ln(lam) - lam - log_factorial).alias("loglik"), F.first("mu").alias("mu"), F.first("alpha").alias("alpha"), F.first("n").alias("hours"), F.first("sy").alias("total_events"))
        one_fit = ll.withColumn("decay", F.lit(decay)).withColumn("branching_ratio", F.col("alpha") / max(1e-6, 1 - decay))
        fits = one_fit if fits is None else fits.unionByName(one_fit)
    best = fits.where("hours > 2").groupBy(meme).agg(F.max_by(F.struct("mu", "alpha", "decay", "loglik", "branching_ratio", "hours", "total_events"), F.struct(F.round("loglik", 9), (-F.col("decay")).alias("d"))).alias("b"))
    return best.select(meme, "b.*")


def kleinberg(counts: np.ndarray, s: float = 2.0, gamma: float = 1.0) -> list[tuple[int, int, int]]:
    """Bursts (start, end, level) of a count series: the cheapest path over Poisson rate levels, moves cost gamma a level.

    A burst has the level of its first step.
    """
    counts = np.asarray(counts, float)
    if not len(counts) or counts.sum() == 0:
        return []
    base = counts.mean()
    top = max(1, int(math.log(counts.max() / base + 1e-9, s)) + 1)
    rates = base * s ** np.arange(top + 1)
    logs = np.array([math.lgamma(c + 1) for c in counts])
    cost = rates[None, :] - counts[:, None] * np.log(rates + 1e-12)[None, :] + logs[:, None]
    move = gamma * np.abs(np.arange(top + 1)[:, None] - np.arange(top + 1)[None, :])
    best, came = cost[0], np.zeros((len(counts), top + 1), int)
    for t in range(1, len(counts)):
        via = best[None, :] + move
        came[t] = via.argmin(1)
        best = via.min(1) + cost[t]
    path = [int(best.argmin())]
    for t in range(len(counts) - 1, 0, -1):
        path.append(int(came[t, path[-1]]))
    path = path[::-1]
    found, start = [], None
    for t, level in enumerate([*path, 0]):
        if level and start is None:
            start = t
        elif not level and start is not None:
            found.append((start, t - 1, path[start]))
            start = None
    return found


def kleinberg_bursts(dense: DataFrame, meme: str) -> DataFrame:
    """meme, start, end (hours), level; a group is one meme's hours, which its lifetime bounds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hour")
        hours, name = pdf["hour"].to_numpy(), pdf[meme].iloc[0]
        return pd.DataFrame([(name, hours[a], hours[b], level) for a, b, level in kleinberg(pdf["count"].to_numpy())], columns=[meme, "start", "end", "level"])

    kind = dense.schema[meme].dataType.simpleString()
    return dense.select(meme, "hour", "count").groupBy(meme).applyInPandas(run, f"{meme} {kind}, start timestamp, end timestamp, level int")


def burst_score(bursts: DataFrame, meme: str) -> DataFrame:
    length = (F.unix_micros("end") - F.unix_micros("start")) / 3.6e9 + 1
    return bursts.groupBy(meme).agg(F.sum(F.col("level") * length).alias("burst_score"))


def term_counts(docs: DataFrame, id_col: str, text_col: str, low: int, high: int, stop: list[str], token: str = r"(?U)\b\w\w+\b") -> DataFrame:
    """id, term, tf: counts of the low- to high-grams of words that aren't stop words."""
    words = F.filter(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(token), F.lit(0)), F.lower), lambda t: ~t.isin(stop) if stop else F.lit(True))
    listed = docs.select(id_col, words.alias("w"))
    grams = F.concat(*[T.ngrams(F.col("w"), n) for n in range(low, high + 1)])
    return listed.select(id_col, F.explode(grams).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def top_terms(counts: DataFrame, id_col: str, min_df: int, n: int) -> DataFrame:
    """The n terms with the most occurrences among those in ``min_df`` documents or more."""
    return counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(n)


def cooccurrence(counts: DataFrame, id_col: str, terms: DataFrame) -> DataFrame:
    """term_a < term_b and the sum of their products, for a bounded list of terms."""
    kept = counts.join(F.broadcast(terms.select("term")), "term")  # ``terms`` is a top-n list
    lists = kept.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("l"))
    pairs = lists.select(F.posexplode("l").alias("i", "a"), "l").select("a", F.explode(F.expr("slice(l, i + 2, size(l))")).alias("b"))
    return pairs.groupBy(F.col("a.term").alias("term_a"), F.col("b.term").alias("term_b")).agg(F.sum(F.col("a.tf") * F.col("b.tf")).alias("weight"))
