"""Readings of a community corpus: entropies, rates by orientation, indices, checks, gates and hypotheses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Name patterns, lemmas, labels, thresholds and key translations that results must agree with.
TECHNICAL = "agent|ai|build|tech|crypto|usdc|dev|code|api|llm|tool|automation|model|infra|data"
REFLEXIVE = "philosophy|pondering|conscious|ethic|culture|socio|meaning|mind|humanit|thought|metaphys|spiritual|reflect"
LEMMAS = {
    "agents": "agent", "humans": "human", "tokens": "token", "models": "model", "tools": "tool", "prompts": "prompt",
    "policies": "policy", "memes": "meme", "modelo": "model", "lenguaje": "language", "ontologia": "ontology", "etica": "ethics",
}
NOISE_NODE = r"(?i)^(w|www|w-|-|\\|_+|[^\w]+)$"
API_LIKE = r"(?i)(api|curl|agentmarket|jq|discover|v1|mbc20|xyz|0x)"
GATES = {
    "G1_data_integrity": ["Linaje de datos", "Cobertura temporal", "Sociologia y redes"],
    "G2_method_validity": ["Claims e inferencia", "Memetica", "Ontologia del lenguaje", "Interferencia", "Incidencia humana", "Transmision entre agentes"],
    "G3_reproducibility": ["Reproducibilidad", "Ingenieria y mantenibilidad"],
    "G4_public_safety": ["Seguridad y compliance", "Operacion deploy", "Producto publico"],
}
METHOD_DOMAINS = ["Claims e inferencia", "Memetica", "Ontologia del lenguaje", "Transmision entre agentes"]
ACTS_ES = {
    "request": "peticion", "offer": "oferta", "promise": "promesa", "declaration": "declaracion", "judgment": "juicio",
    "assertion": "afirmacion", "acceptance": "aceptacion", "rejection": "rechazo", "clarification": "aclaracion", "unknown": "otro",
}
CONCERNS_ES = {
    "recognition": "reconocimiento", "power": "poder", "belonging": "pertenencia", "status": "estatus", "truth": "verdad",
    "justice": "justicia", "coordination": "coordinacion", "validation": "validacion", "humor": "humor", "moral_positioning": "posicion_moral",
}
METRICS_ES = {
    "mean_conflict_index": "indice_conflicto_promedio", "mean_coordination_index": "indice_coordinacion_promedio", "mean_rigidity_score": "indice_rigidez_promedio",
    "dominance_vs_reciprocity": "dominancia_vs_reciprocidad", "identity_vs_task_orientation": "identidad_vs_orientacion_tarea",
    "diversity_of_inquietudes": "diversidad_inquietudes", "structural_entropy": "entropia_estructural",
}


def mapped(key: Column, table: dict[str, str]) -> Column:
    """The entry of a key, null where there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def normalized_entropy(values: list[Column]) -> Column:
    """Entropy of non-negative amounts over ln of their number, zeros counted; null without any amount."""
    clean = [F.greatest(F.coalesce(v.cast("double"), F.lit(0.0)), F.lit(0.0)) for v in values]
    total = reduce(lambda a, b: a + b, clean)
    bits = reduce(lambda a, b: a + b, [F.when(v > 0, -(v / total) * F.ln(v / total)).otherwise(0.0) for v in clean])
    scale = F.ln(F.lit(float(len(values))))
    return F.when(total > 0, bits / scale if len(values) > 1 else F.lit(0.0))


def orientation(name: Column) -> Column:
    label = F.lower(F.coalesce(name, F.lit("")))
    technical, reflexive = label.rlike(TECHNICAL), label.rlike(REFLEXIVE)
    return F.when(technical & ~reflexive, "technical").when(reflexive & ~technical, "reflexive").otherwise("other")


def concentration_regime(gini: Column) -> Column:
    return F.when(gini.isNull() | F.isnan(gini), "sin dato").when(gini >= 0.8, "Muy alta (oligárquica)").when(gini >= 0.65, "Alta").when(gini >= 0.45, "Media").otherwise("Baja")


def weighted_rates(rows: DataFrame, group: str, weight: str, rates: list[str]) -> DataFrame:
    """Means of rates by group, weighted; null where the weights sum to nothing."""
    total = F.sum(weight)
    return rows.groupBy(group).agg(total.cast("double").alias(weight), *[(F.sum(F.col(r) * F.col(weight)) / F.nullif(total, F.lit(0))).alias(r) for r in rates])


def drift(posts: Column, comments: Column, sub_posts: Column, sub_comments: Column) -> dict[str, Column]:
    """How far two sources of totals are apart, relative to the first."""
    p, c = F.abs(posts - sub_posts), F.abs(comments - sub_comments)
    rel = [(d / F.greatest(F.lit(1), base)).cast("double") for d, base in ((p, posts), (c, comments))]
    return {"posts_delta": p, "comments_delta": c, "posts_rel": rel[0], "comments_rel": rel[1], "max_rel": F.greatest(*rel)}


def distance_ratio(points: DataFrame, size: str, tie: str, x: str, y: str, most: int = 250, least: int = 12) -> DataFrame:
    """p90 over p50 of the distances from the centroid of the largest communities; null for fewer than ``least``."""
    top = points.orderBy(F.desc(size), tie).limit(most)
    centre = top.agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    far = top.join(F.broadcast(centre)).select(F.sqrt((F.col(x) - F.col("cx")) ** 2 + (F.col(y) - F.col("cy")) ** 2).alias("d"))  # one row
    q = far.agg(F.percentile("d", F.array(F.lit(0.5), F.lit(0.9))).alias("q"), F.count(F.lit(1)).alias("communities"))
    return q.select(F.when((F.col("communities") >= least) & (F.col("q")[0] > 0), F.col("q")[1] / F.col("q")[0]).alias("p90_p50"), "communities")


def lemma(concept: Column) -> Column:
    plain = F.lower(F.trim(concept))
    return F.coalesce(mapped(plain, LEMMAS), plain)


def without_variants(pairs: DataFrame, a: str = "concept_a", b: str = "concept_b") -> DataFrame:
    return pairs.where(lemma(F.col(a)) != lemma(F.col(b)))


def transmission_pool(rows: DataFrame, text: str, created: str, least: int = 40) -> DataFrame:
    """Rows with a text of ``least`` characters, all rows if there are none such, with the policy that was used."""
    fit = F.coalesce(F.char_length(F.trim(text)), F.lit(0)) >= least
    policy = rows.agg(F.when(F.max(fit), "non-trivial recency").otherwise("fallback raw").alias("policy"))
    both = rows.join(F.broadcast(policy))  # one row
    return both.where(fit | (F.col("policy") == "fallback raw")).orderBy(F.desc(created))


def indexed(days: DataFrame, day: str, value: str, name: str) -> DataFrame:
    """Percent of the first positive value; null where there is none or the value isn't positive. ``days`` has a row per day."""
    base = days.where(F.col(value) > 0).agg(F.min_by(value, day).alias("base"))
    return days.join(F.broadcast(base)).withColumn(name, F.when(F.col(value) > 0, F.col(value) / F.col("base") * 100)).drop("base")  # one row


def gates(findings: DataFrame) -> DataFrame:
    """Per gate: fail if a P0 or P1 of its domains isn't mitigated. ``findings`` has domain, severity, status."""
    severe = (F.col("status") != "mitigated") & F.col("severity").isin("P0", "P1")
    flags = [F.coalesce(F.bool_or(severe & F.col("domain").isin(d)), F.lit(False)).alias(g) for g, d in GATES.items()]
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.when(F.col(g), "fail").otherwise("pass").alias("status")) for g in GATES]))
    return findings.agg(*flags).select(rows.alias("r")).select("r.*")


def severity_counts(findings: DataFrame) -> DataFrame:
    """P0 to P3, zeros too: findings that aren't mitigated."""
    names = ["P0", "P1", "P2", "P3"]
    counts = findings.agg(*[F.count_if((F.col("status") != "mitigated") & (F.col("severity") == n)).alias(n) for n in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("severity"), F.col(n).alias("open")) for n in names])).alias("r")).select("r.*")


def backlog(findings: DataFrame) -> DataFrame:
    """A task for each finding that isn't mitigated."""
    kind = F.when(F.col("domain").isin(METHOD_DOMAINS), "metodologico").otherwise("tecnico")
    effort = F.when(F.col("severity").isin("P0", "P1"), "M").otherwise("S")
    open_ = findings.where("status <> 'mitigated'")
    return open_.select(F.concat(F.lit("TASK-"), "finding_id").alias("task_id"), "severity", F.col("domain").alias("component"), kind.alias("fix_type"), effort.alias("effort_estimate"), F.split("evidence_ref", r"\|")[0].alias("dependency"))


def label_key(label: Column) -> Column:
    """The English key of a label in either language; null if unknown to both."""
    plain = F.translate(F.lower(F.trim(label)), "áéíóúüñ", "aeiouun")
    back = {v: k for k, v in ACTS_ES.items()}
    return F.coalesce(mapped(plain, back), F.when(plain.isin(list(ACTS_ES)), plain), F.when(plain.isin("other", "none", "n/a"), "unknown"))


def translated(name: Column, table: dict[str, str]) -> Column:
    """The translated key, the key itself where there is none."""
    return F.coalesce(mapped(name, table), name)


def hypotheses(facts: DataFrame) -> DataFrame:
    """Readings of four hypotheses from one row of facts; null facts leave a reading open."""
    c = F.col
    h1 = F.when(c("volume_diversity_corr") <= -0.15, "Soportada").when(c("volume_diversity_corr") > 0.05, "No soportada").otherwise("Inconclusa")
    delta = c("technical_touches") - c("cultural_touches")
    h2 = F.when((c("technical_rows") >= 20) & (c("cultural_rows") >= 20) & (delta > 3), "Soportada").when(delta < -1, "No soportada").otherwise("Inconclusa")
    known = c("technical_hedge").isNotNull() & c("reflexive_hedge").isNotNull() & c("technical_assertion").isNotNull() & c("reflexive_assertion").isNotNull()
    h3 = F.when(known & (c("technical_hedge") < c("reflexive_hedge")) & (c("technical_assertion") > c("reflexive_assertion")), "Soportada")
    h3 = h3.when(known & (c("technical_hedge") >= c("reflexive_hedge")), "No soportada").otherwise("Inconclusa")
    risk = F.when((c("lexical_corr") >= 0.75) & (c("lexical_lift") >= 0.08) & (c("cross_rate") < 0.12), "Riesgo alto HB")
    risk = risk.when((c("lexical_corr") <= 0.6) & (c("cross_rate") >= 0.18), "Riesgo acotado HB").otherwise("Competencia abierta")
    h4 = F.when(c("lexical_corr").isNull() | c("lexical_lift").isNull() | c("cross_rate").isNull(), "Inconclusa").otherwise(risk)
    both = F.array(*[F.struct(F.lit(n).alias("hypothesis"), s.alias("status")) for n, s in (("H1", h1), ("H2", h2), ("H3", h3), ("H4", h4))])
    return facts.select(F.explode(both).alias("r")).select("r.*")


def sample_by(rows: DataFrame, groups: list[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group by a seeded hash of the id, with their place; the same at every run."""
    draw = F.md5(F.concat(F.lit(f"{seed}/"), F.col(id_col).cast("string")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(draw, id_col))).where(F.col("place") <= n)


def concentration(degrees: DataFrame, value: str, share: float) -> DataFrame:
    """nodes, top_share (of the total, by the top ``share`` of nodes), gini. Windows run over distinct values, not over nodes."""
    by = degrees.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    up = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = by.select("v", "c", F.coalesce(F.sum("c").over(up), F.lit(0)).alias("below"), F.coalesce(F.sum("c").over(down), F.lit(0)).alias("above"), F.sum("c").over(everything).alias("n"), F.sum(F.col("v") * F.col("c")).over(everything).alias("total"))
    most = F.greatest(F.lit(1), F.ceil(share * F.col("n")))
    taken = F.least(F.col("c"), F.greatest(F.lit(0), most - F.col("above"))) * F.col("v")
    ranks = F.col("v") * (F.col("c") * F.col("below") + F.col("c") * (F.col("c") + 1) / 2)
    n, total = F.first("n"), F.first("total")
    return rows.agg(n.alias("nodes"), (F.sum(taken) / total).alias("top_share"), (2 * F.sum(ranks) / (n * total) - (n + 1) / n).alias("gini"))


def metric_vector(parts: list[DataFrame]) -> DataFrame:
    """One row of all metrics: parts of one row each, with columns of different names, put side by side without a join."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
