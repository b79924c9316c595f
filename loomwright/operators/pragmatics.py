"""Message scoring against prompts, interaction edges, post aggregates, community windows and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import lexicons as L
from loomwright.operators.memetics import term_counts

WORD = r"(?U)\b\w\w+\b"


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def prompt_table(messages: DataFrame) -> DataFrame:
    """(prompt, kind, name, text) of all fixed prompts; about a hundred rows."""
    rows = [("label", k, t) for k, ts in L.ILLOCUTION_PROMPTS.items() for t in ts]
    rows += [(pole, k, t) for k, (hi, lo) in L.ANCHORS.items() for pole, ts in (("high", hi), ("low", lo)) for t in ts]
    rows += [("concern", k, t) for k, ts in L.CONCERNS.items() for t in ts]
    return messages.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "prompt int, kind string, name string, text string")


def unit_terms(counts: DataFrame, id_col: str, idf: DataFrame) -> DataFrame:
    """id, term, w: TF-IDF weights of unit length over a fixed vocabulary."""
    w = counts.join(F.broadcast(idf), "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))  # a top-n vocabulary
    return w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col))))


def fitted(messages: DataFrame, id_col: str, text_col: str, features: int = 8000, min_df: int = 5) -> tuple[DataFrame, DataFrame]:
    """(unit terms of the messages, idf table): words and pairs of words."""
    counts = term_counts(messages, id_col, text_col, 1, 2, [], WORD)
    n = messages.count()
    top = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(features)
    idf = top.select("term", (F.ln((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    return unit_terms(counts, id_col, idf), idf


def prompt_means(messages: DataFrame, terms: DataFrame, idf: DataFrame, id_col: str) -> DataFrame:
    """id and ``means``: map from kind/name to the mean similarity with its prompts, 0 where nothing is shared."""
    prompts = prompt_table(messages)
    own = unit_terms(term_counts(prompts, "prompt", "text", 1, 2, [], WORD), "prompt", idf).withColumnRenamed("w", "pw")
    sizes = prompts.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("size"))
    weights = own.join(prompts.select("prompt", "kind", "name"), "prompt").groupBy("kind", "name", "term").agg(F.sum("pw").alias("pw")).join(sizes, ["kind", "name"])
    # The mean over a group of prompts is one product with their summed vectors.
    met = terms.join(F.broadcast(weights), "term").groupBy(id_col, F.concat_ws("/", "kind", "name").alias("k")).agg(F.sum(F.col("w") * F.col("pw") / F.col("size")).alias("v"))
    maps = met.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("means"))  # at most one entry per group of prompts
    return messages.select(id_col).join(maps, id_col, "left")


def scored(messages: DataFrame, id_col: str = "id", text_col: str = "text", features: int = 8000, min_df: int = 5) -> tuple[DataFrame, DataFrame]:
    """(id, label, confidence, six dimensions and their confidences, distribution, concern means; unit terms)."""
    terms, idf = fitted(messages, id_col, text_col, features, min_df)
    m = prompt_means(messages, terms, idf, id_col)
    value = lambda kind, name: F.coalesce(F.element_at("means", F.lit(f"{kind}/{name}")), F.lit(0.0))
    labels = [value("label", k) for k in L.ILLOCUTIONS]
    m = m.withColumn("labels", F.array(*labels))
    best = F.element_at(F.array(*[F.lit(k) for k in L.ILLOCUTIONS]), F.array_position("labels", F.array_max("labels")).cast("int"))
    powers = F.transform("labels", lambda x: F.exp(x - F.array_max("labels")))
    m = m.withColumn("powers", powers).withColumn("mass", F.aggregate("powers", F.lit(0.0), lambda a, x: a + x))
    out = [best.alias("label"), clip01(F.array_max("powers") / F.col("mass")).alias("confidence")]
    out += [(F.element_at("powers", i + 1) / F.col("mass")).alias(f"p_{k.lower()}") for i, k in enumerate(L.ILLOCUTIONS)]
    for d in L.DIMENSIONS:
        raw = value("high", d) - value("low", d)
        out += [clip01(1 / (1 + F.exp(-raw * 5.0))).alias(d), clip01(F.abs(raw) * 3.0).alias(f"{d}_confidence")]
    out += [value("concern", k).alias(f"c_{k}") for k in L.CONCERNS]
    return m.select(id_col, *out), terms


def interactions(messages: DataFrame, scores: DataFrame, terms: DataFrame) -> DataFrame:
    """From (post_id, id, parent_id, ord): reply edges inside a post, or neighbours where a post has no replies."""
    linked = messages.withColumn("has_replies", F.max(F.col("parent_id").isNotNull()).over(Window.partitionBy("post_id"))).withColumn("before", F.lag("id").over(Window.partitionBy("post_id").orderBy("ord", "id")))
    pairs = linked.select("post_id", F.when(F.col("has_replies"), F.col("parent_id")).otherwise(F.col("before")).alias("source"), F.col("id").alias("target"), (~F.col("has_replies")).alias("weak_structure")).where("source is not null")
    pairs = pairs.join(messages.select(F.col("id").alias("source"), F.col("post_id").alias("p")), "source").where("p = post_id").drop("p")
    a = scores.select(F.col("id").alias("source"), F.col("label").alias("a_label"), *[F.col(d).alias(f"a_{d}") for d in L.DIMENSIONS])
    b = scores.select(F.col("id").alias("target"), F.col("label").alias("b_label"), *[F.col(d).alias(f"b_{d}") for d in L.DIMENSIONS])
    dots = pairs.select("source", "target").join(terms.select(F.col("id").alias("source"), "term", F.col("w").alias("aw")), "source").join(terms.select(F.col("id").alias("target"), "term", F.col("w").alias("bw")), ["target", "term"])
    dots = dots.groupBy("source", "target").agg(F.sum(F.col("aw") * F.col("bw")).alias("cos"))
    e = pairs.join(a, "source").join(b, "target").join(dots, ["source", "target"], "left")
    shift = {d: F.col(f"b_{d}") - F.col(f"a_{d}") for d in L.DIMENSIONS}
    up = lambda c: F.greatest(F.lit(0.0), c)
    escalation = clip01(0.5 + 0.25 * up(shift["dominance"]) + 0.2 * up(-shift["politeness"]) + 0.2 * up(-shift["affect_valence"]) + 0.1 * up(shift["certainty"]))
    distance = sum((F.abs(c) for c in shift.values()), F.lit(0.0)) / len(shift)
    alignment = clip01(0.6 * (F.coalesce("cos", F.lit(0.0)) + 1) / 2 + 0.4 * clip01(1 - distance))
    expected = F.create_map(*[x for k, v in L.UPTAKE.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    uptake = F.array_contains(F.element_at(expected, F.col("a_label")), F.col("b_label")).cast("double")
    return e.select("post_id", "source", "target", "weak_structure", *[c.alias(f"shift_{d}") for d, c in shift.items()], escalation.alias("escalation"), alignment.alias("alignment"), uptake.alias("uptake"))


def posts(messages: DataFrame, scores: DataFrame, edges: DataFrame) -> DataFrame:
    """Per post: message count, label shares, means and variances, indices, and the softmax over concerns."""
    m = messages.join(scores, "id")
    by = m.groupBy("post_id").agg(
        F.count(F.lit(1)).alias("message_count"), *[F.avg((F.col("label") == k).cast("double")).alias(f"share_{k.lower()}") for k in L.ILLOCUTIONS], *[F.avg(d).alias(f"mean_{d}") for d in L.DIMENSIONS],
        *[F.var_pop(d).alias(f"var_{d}") for d in L.DIMENSIONS], *[F.avg(f"c_{k}").alias(f"c_{k}") for k in L.CONCERNS],
    )
    e = edges.groupBy("post_id").agg(F.avg("escalation").alias("escal"), F.avg("uptake").alias("upt"))
    p = by.join(e, "post_id", "left").withColumn("escal", F.coalesce("escal", F.lit(0.0))).withColumn("upt", F.coalesce("upt", F.lit(0.5)))
    c = lambda d: F.col(f"mean_{d}")
    spread = sum((F.col(f"var_{d}") for d in L.DIMENSIONS), F.lit(0.0)) / len(L.DIMENSIONS)
    top = F.greatest(*[F.col(f"c_{k}") for k in L.CONCERNS])
    mass = sum((F.exp(F.col(f"c_{k}") - top) for k in L.CONCERNS), F.lit(0.0))
    concerns = {f"concern_{k}": F.exp(F.col(f"c_{k}") - top) / mass for k in L.CONCERNS}
    first = F.array_sort(F.array(*[F.struct(F.round(-v, 12).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(concerns.items())]))
    return p.select(
        "post_id", "message_count", *[f"share_{k.lower()}" for k in L.ILLOCUTIONS], *[f"mean_{d}" for d in L.DIMENSIONS], *[f"var_{d}" for d in L.DIMENSIONS], *[v.alias(k) for k, v in concerns.items()],
        clip01(0.35 * c("dominance") + 0.25 * (1 - c("politeness")) + 0.2 * (1 - c("affect_valence")) + 0.2 * F.col("escal")).alias("conflict_index"), clip01(0.6 * c("coordination_intent") + 0.4 * F.col("upt")).alias("coordination_index"),
        clip01(0.5 * c("certainty") + 0.3 * c("dominance") + 0.2 * (1 - spread * 4)).alias("rigidity_score"), clip01(c("irony")).alias("irony_density"), clip01(0.5 + (c("dominance") - c("politeness")) * 0.5).alias("dominance_vs_reciprocity"),
        clip01(0.5 + ((1 - c("coordination_intent")) + c("irony") - c("certainty")) * 0.25).alias("identity_vs_task_orientation"), F.transform(F.slice(first, 1, 3), lambda x: F.substring(x["k"], 9, 40)).alias("top_concerns"),
    )


def windows(rows: DataFrame, community: str, time_col: str, width_days: int = 30, step_days: int = 7) -> DataFrame:
    """Each row in every window that holds it: windows start every ``step_days`` from the community's first row.

    A row names its windows itself, so that no range join is needed; a window nobody is in doesn't exist.
    """
    start = rows.groupBy(community).agg(F.min(time_col).alias("__start"))
    step, width = step_days * 86_400_000_000, width_days * 86_400_000_000
    offset = F.unix_micros(time_col) - F.unix_micros("__start")
    joined = rows.join(start, community).withColumn("__k", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((offset - width) / step) + 1), F.floor(offset / step))))
    return joined.withColumn("window_start", F.timestamp_micros(F.unix_micros("__start") + F.col("__k") * step)).drop("__start", "__k")


def deltas(per_window: DataFrame, community: str, metrics: list[str]) -> DataFrame:
    line = Window.partitionBy(community).orderBy("window_start")
    return per_window.select("*", *[F.coalesce(F.col(m) - F.lag(m).over(line), F.lit(0.0)).alias(f"delta_{m}") for m in metrics])


def mad_alert(value: Column, past: Column, threshold: float = 3.5) -> Column:
    """Whether a value is far from the median of the values before it, in median absolute deviations."""
    median = lambda a: (F.element_at(F.array_sort(a), F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(F.array_sort(a), F.floor(F.size(a) / 2 + 1).cast("int"))) / 2
    mid = F.when(F.size(past) > 0, median(past))
    mad = F.when(F.size(past) > 0, median(F.transform(past, lambda x: F.abs(x - mid))))
    return F.coalesce((mad >= 1e-9) & (F.abs(value - mid) / (1.4826 * mad) >= threshold), F.lit(False))


def alerts(per_window: DataFrame, community: str, metrics: list[str], threshold: float = 3.5) -> DataFrame:
    """alert_* per metric on the community's expanding history of windows."""
    past = Window.partitionBy(community).orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    listed = per_window.select("*", *[F.collect_list(m).over(past).alias(f"__{m}") for m in metrics])
    return listed.select(*per_window.columns, *[mad_alert(F.col(m), F.col(f"__{m}"), threshold).alias(f"alert_{m}") for m in metrics])
