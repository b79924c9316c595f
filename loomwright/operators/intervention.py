"""Repeated messages that look steered: document scores, groups by signature, events and their robustness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import lexicons as L
from loomwright.functions import text as T
from loomwright.operators.lineage import cut


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def scored(docs: DataFrame, penalty: float = 0.5, ascii: bool = False) -> DataFrame:
    """From (doc_id, author, community, created, text): all signals, doc_score, canonical text and fingerprint.

    ``penalty`` is taken from the score of noisy texts without semantic interference. Words, digits and white space
    are Unicode's, or with ``ascii`` those of RE2.
    """
    text, clean = F.col("text"), F.col("clean")
    first = {"normal": T.ascii_normal(text), "clean": T.ascii_clean(text), "seen": T.ascii_text(text)} if ascii else {"normal": T.normalize_text(text), "clean": T.clean_text(text), "seen": text}
    in_text = T.ascii_present if ascii else T.patterns_present
    d = docs.where("text is not null and text <> ''").withColumns(first)
    d = d.withColumns({"clean_seen": T.ascii_text(clean), "head": T.ascii_head(clean)} if ascii else {"clean_seen": clean})
    d = d.withColumns({"lower": T.any_case(F.col("seen")), "clean_lower": T.any_case(F.col("clean_seen"))})
    found = T.incidence_hits(F.col("normal")) | T.interference_hits(F.col("clean_seen"), F.col("clean_lower"), in_text)
    canonical = T.ascii_canonical(clean, F.col("head")) if ascii else T.canonical_signature(clean)[0]
    d = d.select("*", canonical.alias("canonical"), *[c.alias(f"raw_{k}") for k, c in found.items()])  # computed once, as they are used several times
    raw = {k: F.col(f"raw_{k}") for k in found}
    inc, inter = T.human_incidence(text, F.col("normal"), raw), T.interference(text, clean, raw)
    present = {k: in_text(F.col("seen"), p, F.col("lower")) for k, p in {"promo_hits": L.PROMO, "cta_hits": L.CALL_TO_ACTION, "human_signal_hits": L.HUMAN_SIGNAL}.items()}
    d = d.select(
        "doc_id", "author", "community", "created", *[c.alias(k) for k, c in inc.items()], inter["score_semantic"].alias("semantic"), inter["noise_score"].alias("noise"), *[c.alias(k) for k, c in present.items()],
        F.lower("text").rlike("</?think>").alias("think"), F.contains("text", F.lit("```")).alias("code"), "canonical", T.fingerprint(F.col("canonical")).alias("fingerprint"),
    )
    score = F.col("human_incidence_score") * 0.70 + F.col("score_human") * 0.35 + F.col("score_prompt") * 0.35 + F.col("semantic") * 0.90 + F.col("promo_hits") * F.lit(1.25) + F.col("cta_hits") * F.lit(0.70) + F.col("human_signal_hits") * F.lit(0.80)
    if penalty:
        score -= F.when((F.col("noise") >= 1.5) & (F.col("semantic") <= 0), F.lit(float(penalty))).otherwise(0.0)
    return d.withColumn("doc_score", F.greatest(F.lit(0.0), score))


def candidates(rows: DataFrame, least: float = 2.0) -> DataFrame:
    rows = cut(rows)  # the signals are costly and read several times below
    keep = (F.col("doc_score") >= least) | (F.col("human_refs") >= 1) | (F.col("promo_hits") >= 2) | (F.col("cta_hits") >= 2) | (F.col("human_signal_hits") >= 1) | (F.col("semantic") >= 1.5)
    return rows.where(keep & (F.col("fingerprint") != ""))


def _spread(rows: DataFrame, by: str, name: str, missing: str | None) -> DataFrame:
    """Per fingerprint: distinct values of ``by``, share of the largest, normalised entropy. Nulls are one value: ``missing``, or one of their own."""
    counts = rows.groupBy("fingerprint", F.coalesce(F.col(by).cast("string"), F.lit(missing)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("fingerprint"))
    per = counts.withColumn("p", p).groupBy("fingerprint").agg(F.count(F.lit(1)).alias(f"unique_{name}"), F.max("p").alias(f"{name}_top"), F.sum(-F.col("p") * F.log2("p")).alias("h"))
    k = F.col(f"unique_{name}")
    return per.withColumn(f"{name}_entropy", F.when(k > 1, F.col("h") / F.log2(k)).otherwise(0.0)).drop("h")


def groups(rows: DataFrame, missing: str | None = "unknown") -> DataFrame:
    """One row per fingerprint: counts, rates, means, bonuses, scores, likely source, evidence.

    Authors and communities that are null count as ``missing``; if that is None, as a value of their own.
    """
    any_of = lambda c: F.avg((F.col(c) > 0).cast("double"))
    g = rows.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("repeat_count"), F.avg("doc_score").alias("avg_doc_score"), F.max("doc_score").alias("max_doc_score"), F.avg("human_incidence_score").alias("avg_incidence"), F.avg("semantic").alias("avg_semantic"),
        F.avg("human_refs").alias("avg_human_refs"), F.avg("prompt_refs").alias("avg_prompt_refs"), F.avg("tooling_refs").alias("avg_tooling_refs"), F.avg("narrative_refs").alias("avg_narrative_refs"),
        any_of("promo_hits").alias("promo_rate"), any_of("cta_hits").alias("cta_rate"), any_of("human_signal_hits").alias("human_signal_rate"), F.avg(F.col("think").cast("double")).alias("think_rate"), F.avg(F.col("code").cast("double")).alias("code_rate"),
        F.min("created").alias("first_created"), F.max("created").alias("last_created"), F.max_by("doc_id", F.struct("doc_score", "doc_id")).alias("top_doc_id"), F.min("doc_id").alias("first_doc_id"),
    )
    kinds = rows.groupBy("fingerprint", "evidence_type").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    mode = kinds.groupBy("fingerprint").agg(F.max_by("evidence_type", F.struct("n", (-F.col("first")).alias("f"))).alias("dominant_evidence"))
    # The first five documents of a group: ranked inside it, but only by its candidates.
    firsts = rows.select("fingerprint", "doc_id", F.row_number().over(Window.partitionBy("fingerprint").orderBy("doc_id")).alias("k")).where("k <= 5")
    firsts = firsts.groupBy("fingerprint").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), "|").alias("evidence_doc_ids"))
    for other in (_spread(rows, "author", "authors", missing), _spread(rows, "community", "communities", missing), mode, firsts):
        g = g.join(other, "fingerprint")
    n, authors, places = F.col("repeat_count"), F.col("unique_authors"), F.col("unique_communities")
    span = (F.unix_micros("last_created") - F.unix_micros("first_created")) / 3.6e9
    burst = F.when(n >= 3, F.when(span <= 6, 1.8).when(span <= 24, 1.1).when(span <= 72, 0.4)).otherwise(F.lit(None))
    coordination = clip(
        F.least(F.lit(1.0), F.log1p(n) / F.ln(F.lit(50.0))) * 0.32 + clip((authors - 1) / 12.0, 0.0, 1.0) * 0.24 + clip((places - 1) / 60.0, 0.0, 1.0) * 0.16
        + (1 - F.col("authors_top")) * 0.1 + (1 - F.col("communities_top")) * 0.08 + clip((F.col("promo_rate") + F.col("cta_rate")) / 2, 0.0, 1.0) * 0.1, 0.0, 1.0,
    )
    score = (
        F.col("avg_doc_score") * 0.8 + F.col("max_doc_score") * 0.4 + F.log1p(n - 1) * 1.4 + F.least(F.lit(4.0), (authors - 1) * F.lit(0.65)) + F.least(F.lit(3.0), (places - 1) * F.lit(0.2))
        + F.coalesce(burst, F.lit(0.0)) + F.col("promo_rate") * 1.4 + F.col("cta_rate") * 0.8 + F.col("avg_semantic") * 0.25
    )
    g = g.withColumns({"span_hours": span, "coordination_index": coordination, "event_score": score})
    c = F.col
    source = F.when((n >= 5) & (c("promo_rate") >= 0.25) & (c("cta_rate") >= 0.2), "campana_promocional").when((c("avg_prompt_refs") >= 1.2) & (c("avg_tooling_refs") >= 1.2), "prompt_tooling")
    source = source.when((c("avg_semantic") >= 1.5) & (c("avg_prompt_refs") >= 0.8), "interferencia_semantica")
    source = source.when((c("avg_human_refs") >= 2.0) | (c("human_signal_rate") >= 0.45) & (c("avg_prompt_refs") <= 4.0), "humano_explicito")
    source = source.when((n >= 5) & (c("coordination_index") >= 0.55) & ((c("avg_prompt_refs") >= 0.8) | (c("avg_tooling_refs") >= 3.0)), "coordinacion_hibrida")
    source = source.when((n <= 8) & (c("avg_narrative_refs") >= 1.5) & (c("promo_rate") < 0.2), "narrativa_situada").otherwise("mixto")
    g = g.withColumn("likely_source", source)
    sure = F.when(c("likely_source").isin("campana_promocional", "prompt_tooling", "interferencia_semantica"), 0.05).otherwise(0.0)
    return g.withColumn("confidence", clip(0.2 + c("coordination_index") * 0.5 + clip(c("event_score") / 25.0, 0.0, 1.0) * 0.3 + sure, 0.05, 0.99))


def events(grouped: DataFrame, min_group: int = 2, min_score: float = 3.5) -> DataFrame:
    return grouped.where((F.col("repeat_count") >= min_group) & (F.col("event_score") >= min_score))


def strict(found: DataFrame, score: float = 12.0, coordination: float = 0.5, repeat: int = 8, promo: float = 0.2, cta: float = 0.2, human: float = 1.2, signal: float = 0.25) -> DataFrame:
    """Events above three bounds that have one of four reasons, which are listed."""
    reasons = F.concat_ws("|", F.when(F.col("promo_rate") >= promo, "promo"), F.when(F.col("cta_rate") >= cta, "cta"), F.when(F.col("avg_human_refs") >= human, "human_refs"), F.when(F.col("human_signal_rate") >= signal, "human_signal"))
    high = (F.col("event_score") >= score) & (F.col("coordination_index") >= coordination) & (F.col("repeat_count") >= repeat)
    return found.where(high).withColumn("strict_reason", reasons).where("strict_reason <> ''")


def robustness(grouped: DataFrame, sizes: list[int], scores: list[float], top_k: int = 100, baseline: tuple[int, float] = (2, 3.5)) -> DataFrame:
    """Per setting: events, size of its top list, and its Jaccard similarity with the baseline's top list.

    The grid is a literal list of settings; a top list is at most ``top_k`` ids.
    """
    grid = F.array(*[F.struct(F.lit(s).alias("min_group"), F.lit(float(e)).alias("min_score")) for s, e in dict.fromkeys([*[(s, e) for s in sizes for e in scores], baseline])])
    rows = grouped.select("fingerprint", "event_score", "repeat_count", F.explode(grid).alias("g")).where("repeat_count >= g.min_group and event_score >= g.min_score")
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("event_score"), "fingerprint"))
    per = rows.withColumn("place", place).groupBy("g").agg(F.count(F.lit(1)).alias("event_count"), F.collect_set(F.when(F.col("place") <= top_k, F.col("fingerprint"))).alias("top"))
    base = per.where((F.col("g.min_group") == baseline[0]) & (F.col("g.min_score") == baseline[1])).select(F.col("top").alias("b"))
    both = per.crossJoin(F.broadcast(base))  # one row
    jaccard = F.size(F.array_intersect("top", "b")) / F.size(F.array_union("top", "b"))
    wanted = F.col("g.min_group").isin(sizes) & F.col("g.min_score").isin([float(x) for x in scores])
    return both.where(wanted).select("g.min_group", "g.min_score", "event_count", F.size("top").alias("top_k_size"), F.when(F.size(F.array_union("top", "b")) > 0, F.round(jaccard, 6)).otherwise(1.0).alias("jaccard"))


def presence(grouped: DataFrame, sizes: list[int], scores: list[float], least: float = 0.7) -> DataFrame:
    """Events that at least that share of all settings select."""
    reached = sum(((F.col("repeat_count") >= s) & (F.col("event_score") >= e)).cast("int") for s in sizes for e in scores)
    share = reached / (len(sizes) * len(scores))
    return grouped.select("fingerprint", "event_score", F.round(share, 6).alias("presence_share")).where(F.col("presence_share") >= least)
