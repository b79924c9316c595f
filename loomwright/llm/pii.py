"""Personal data by weak supervision, with DataFrame functions only.

Candidates are all matches of the base patterns, also those that fail their test, and of looser patterns
(phone numbers without a plus, card-like numbers with dots, e-mail addresses spelled with "at" and "dot").
Six labelers vote on each: strict pattern, checksum or range, gazetteer (top-level domains, country
codes, issuer digits), words before it that name its kind, words before it that speak against it, and
its edges. Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is; a logistic span classifier is then trained on the posteriors, over votes and shape features.
Candidates of the looser patterns that pass their test, score ``LEAST_SCORE`` or more and overlap no base
span are added; base spans stay, and base matches that fail their test are training examples only.

The corpus reaches the driver only as counts of (votes, features): their number is bounded by the
product of their values, whatever the number of documents. Reading and applying are two map-only passes.

Positions come from a split at the matches: the lengths of the pieces between and of the matches add up,
in blocks of ``RUN`` so that a text with very many matches stays cheap. They count code points.

Defined results: a null or empty text has no spans (the hash is that of an empty string); equal starts
are ordered by kind; repeated rows get equal results; an empty table gives no rows; further columns don't
matter; patterns are written so that very long texts can't make them backtrack or recurse.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, possessive and tied to the start of a run: same matches, linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9.-])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9.-])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.-])|(?<![0-9+().-])00[1-9][0-9](?:[\x20-]?[0-9]){7,12}(?![0-9.-])",
}
#: Fixed lists of the gazetteer and context labelers.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "eu", "de", "fr", "es", "uk", "us", "ca", "it", "nl", "ch", "at", "pt", "br", "mx", "ar")
COUNTRY_CODES = ("1", "33", "34", "39", "41", "43", "44", "49", "351", "52", "54", "55")
NAMES_KIND = {
    "email": r"(?i)\b(e-?mail|mail|contact|courriel|correo|kontakt)\b",
    "ip": r"(?i)\b(ip|address|host|server|adresse|dirección)\b",
    "card": r"(?i)\b(card|visa|mastercard|credit|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(phone|tel|call|fax|mobile|cell|telefon|téléphone|teléfono|móvil)\b",
}
SPEAKS_AGAINST = r"(?i)(?<![\p{L}\p{N}_])(version|release|license|token|secret|hash|key|isbn|order|invoice|id|v)\s*[:=#\"]*\s*$"
RUN = 256
BEFORE, AFTER = 32, 8
LEAST_SCORE = 0.9
ROUNDS, EPOCHS, RATE = 30, 120, 0.5

VOTES = ("strict", "check", "gazetteer", "context", "against", "edges")


def sql_text(value: str) -> str:
    """A raw SQL string literal."""
    return "r'" + value.replace("'", "\\u0027") + "'"


def _matches(kind: str, pattern: str, base: bool) -> str:
    """SQL for all matches in ``text`` with their place and surroundings; evaluated once per text."""
    regex = sql_text(pattern)
    both = f"struct(split(text, {regex}, -1) AS g, regexp_extract_all(text, {regex}, 0) AS m)"
    steps = "transform(s.m, (x, i) -> char_length(s.g[i]) + IF(i > 0, char_length(s.m[i - 1]), 0))"
    sums = f"transform(sequence(0, size(l) div {RUN}), b -> aggregate(slice(l, b * {RUN} + 1, {RUN}), 0, (a, v) -> a + v))"
    start = f"aggregate(slice(w.r, 1, i div {RUN}), 0, (a, v) -> a + v) + aggregate(slice(w.l, (i div {RUN}) * {RUN} + 1, i % {RUN} + 1), 0, (a, v) -> a + v)"
    rows = (
        f"transform(s.m, (x, i) -> transform(array({start}), p -> struct('{kind}' AS kind, {KINDS.index(kind)} AS k, {str(base).lower()} AS strict, p AS b, p + char_length(x) AS e, "
        f"x AS txt, right(s.g[i], {BEFORE}) AS before, left(s.g[i + 1], {AFTER}) AS after))[0])"
    )
    body = f"flatten(transform(array({both}), s -> flatten(transform(array({steps}), l -> flatten(transform(array(struct(l AS l, {sums} AS r)), w -> {rows}))))))"
    return body


def _judged(candidates: str) -> str:
    """SQL that adds digits, the test of the base contract, votes and features to each candidate."""
    digits = r"regexp_replace(c.txt, r'[^0-9]', '')"
    luhn = "aggregate(sequence(1, length(d)), 0, (a, i) -> a + transform(array(cast(substr(d, length(d) + 1 - i, 1) AS int)), v -> IF(i % 2 = 0, v * 2 - IF(v > 4, 9, 0), v))[0]) % 10 = 0"
    small = "forall(split(c.txt, r'\\.'), p -> length(trim(LEADING '0' FROM p)) <= 3 AND coalesce(try_cast(nullif(trim(LEADING '0' FROM p), '') AS int), 0) <= 255)"
    test = f"CASE c.kind WHEN 'email' THEN true WHEN 'ip' THEN {small} WHEN 'card' THEN IF(length(d) BETWEEN 14 AND 19, {luhn}, false) ELSE length(d) BETWEEN 10 AND 15 END"
    domain = "lower(regexp_extract(c.txt, r'([A-Za-z0-9]+)$', 1)) IN (" + ", ".join(f"'{x}'" for x in DOMAINS) + ")"
    country = "(" + " OR ".join(f"startswith(d, '{x}')" for x in COUNTRY_CODES) + ")"
    gazetteer = f"CASE c.kind WHEN 'email' THEN IF({domain}, 1, -1) WHEN 'card' THEN IF(d RLIKE r'^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)', 1, -1) WHEN 'phone' THEN IF(startswith(c.txt, '+'), IF({country}, 1, -1), 0) ELSE IF(c.txt RLIKE r'^(0|127|255)\\.', -1, 1) END"
    context = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN IF(c.before RLIKE {sql_text(v)}, 1, 0)" for k, v in NAMES_KIND.items()) + " ELSE 0 END"
    against = f"IF(c.before RLIKE {sql_text(SPEAKS_AGAINST)}, -1, 0)"
    edges = r"IF(c.before RLIKE r'[\p{L}\p{N}_.=/-]$' OR c.after RLIKE r'^[\p{L}\p{N}_=/]', -1, 1)"
    spaced = r"cast(c.txt RLIKE r'[\x20().-]' AS int)"
    return (
        f"flatten(transform({candidates}, c -> transform(array({digits}), d -> transform(array({test}), t -> struct(c.kind AS kind, c.k AS k, c.b AS b, c.e AS e, c.strict AND t AS base, "
        f"struct(IF(c.strict, 1, -1) AS strict, IF(t, 1, -1) AS check, {gazetteer} AS gazetteer, {context} AS context, {against} AS against, {edges} AS edges) AS votes, "
        f"cast(least(length(d), 20) AS int) AS digits, {spaced} AS spaced))[0])))"
    )


def _with_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and ``found``: the judged candidates of each text. Texts without @ or digit are only looked at once."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    parts = [_matches(k, p, True) for k, p in BASE.items()] + [_matches(k, p, False) for k, p in LOOSE.items()]
    found = _judged(f"concat({', '.join(parts)})")
    trigger = r"text RLIKE r'[@0-9]|[\[(]\x20?at\x20?[\])]'"
    return rows.select("id", F.expr(f"IF({trigger}, {found}, NULL)").alias("found"))


def _reliability(table: list[tuple[tuple[int, ...], float]]) -> list[float]:
    """Two-class expectation-maximisation over vote patterns and their counts; the posterior of each pattern."""
    width = len(VOTES)
    right, wrong, prior = [0.8] * width, [0.3] * width, 0.5
    post = [0.5] * len(table)
    for _ in range(ROUNDS):
        for r, (votes, _) in enumerate(table):
            yes, no = math.log(prior), math.log(1 - prior)
            for j, v in enumerate(votes):
                if v:
                    yes += math.log(right[j] if v > 0 else 1 - right[j])
                    no += math.log(wrong[j] if v > 0 else 1 - wrong[j])
            post[r] = 1 / (1 + math.exp(max(-500.0, min(500.0, no - yes))))
        total = sum(n for _, n in table)
        prior = min(0.99, max(0.01, (1 + sum(p * n for p, (_, n) in zip(post, table, strict=True))) / (2 + total)))
        for j in range(width):
            # Beta(8, 2) and Beta(3, 7) priors keep a rarely voting labeler near its start.
            up = sum(p * n for p, (v, n) in zip(post, table, strict=True) if v[j] > 0)
            down = sum(p * n for p, (v, n) in zip(post, table, strict=True) if v[j] < 0)
            right[j] = (8 + up) / (10 + up + down)
            up = sum((1 - p) * n for p, (v, n) in zip(post, table, strict=True) if v[j] > 0)
            down = sum((1 - p) * n for p, (v, n) in zip(post, table, strict=True) if v[j] < 0)
            wrong[j] = (3 + up) / (10 + up + down)
    return post


def _features(row: dict) -> list[tuple[str, int]]:
    """Name and value of each indicator feature of a candidate."""
    return [("kind", row["k"]), ("digits", row["digits"]), ("spaced", row["spaced"]), *[(v, row["votes"][v]) for v in VOTES]]


def train(found: DataFrame) -> tuple[float, dict[tuple[str, int], float]]:
    """Bias and indicator weights of the span classifier, from all candidates of the corpus."""
    spans = found.select(F.explode("found").alias("c")).select("c.k", "c.digits", "c.spaced", "c.votes")
    # Bounded: 4 kinds, 21 digit counts, 2 shapes and at most 3 values for each of 6 votes.
    rows = [r.asDict(True) for r in spans.groupBy("k", "digits", "spaced", "votes").count().collect()]
    rows.sort(key=lambda r: (r["k"], r["digits"], r["spaced"], [r["votes"][v] for v in VOTES]))
    patterns: dict[tuple[int, ...], float] = {}
    for r in rows:
        key = tuple(r["votes"][v] for v in VOTES)
        patterns[key] = patterns.get(key, 0) + r["count"]
    table = sorted(patterns.items())
    post = dict(zip([k for k, _ in table], _reliability(table), strict=True))
    examples = [(_features(r), post[tuple(r["votes"][v] for v in VOTES)], math.log1p(r["count"])) for r in rows]
    weights: dict[tuple[str, int], float] = {f: 0.0 for fs, _, _ in examples for f in fs}
    bias, mass = 0.0, sum(n for _, _, n in examples) or 1.0
    for _ in range(EPOCHS):
        step, shift = dict.fromkeys(weights, 0.0), 0.0
        for fs, target, n in examples:
            z = bias + sum(weights[f] for f in fs)
            error = (1 / (1 + math.exp(max(-500.0, min(500.0, -z)))) - target) * n / mass
            shift += error
            for f in fs:
                step[f] += error
        bias -= RATE * 4 * shift
        for f, g in step.items():
            weights[f] -= RATE * 4 * (g + 1e-4 * weights[f])
    return bias, weights


def _score(model: tuple[float, dict[tuple[str, int], float]]) -> str:
    """SQL for the classifier's logit of candidate ``c``."""
    bias, weights = model
    terms = [f"{bias!r}D"]
    for name in ("kind", "digits", "spaced", *VOTES):
        of = {"kind": "c.k", "digits": "c.digits", "spaced": "c.spaced"}.get(name, f"c.votes.{name}")
        own = " ".join(f"WHEN {v} THEN {w!r}D" for (n, v), w in sorted(weights.items()) if n == name)
        if own:
            terms.append(f"(CASE {of} {own} ELSE 0D END)")
    return " + ".join(terms)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    model = train(_with_candidates(docs, id_col, text_col))
    logit = math.log(LEAST_SCORE / (1 - LEAST_SCORE))
    found = _with_candidates(docs, id_col, text_col)
    place = "array_sort(transform({0}, c -> struct(c.b AS b, c.k AS k, concat_ws(':', c.kind, cast(c.b AS string), cast(c.e AS string)) AS txt)))"
    listed = "coalesce(array_join(transform({0}, c -> c.txt), ','), '')"
    split = (
        "transform(array(found), f -> transform(array(filter(f, c -> c.base)), base -> struct(base AS base, array_distinct(filter(f, c -> c.votes.strict < 0 AND c.votes.check > 0 AND "
        f"({_score(model)}) >= {logit!r}D AND NOT exists(base, o -> o.b < c.e AND c.b < o.e))) AS added))[0])[0]"
    )
    rows = found.select("id", F.expr(split).alias("s"))
    counts = [F.expr(f"cast(coalesce(size(filter(s.base, c -> c.kind = '{k}')), 0) AS long)").alias(f"n_{k}") for k in KINDS]
    placed = rows.select("id", *counts, F.expr(place.format("s.base")).alias("base"), F.expr(place.format("concat(s.base, s.added)")).alias("every"), F.expr("cast(coalesce(size(s.added), 0) AS long)").alias("n_added"))
    fix = [F.when(F.col(f"n_{k}") < 0, 0).otherwise(F.col(f"n_{k}")).cast("long").alias(f"n_{k}") for k in KINDS]
    return placed.select(F.col("id").alias(id_col), *fix, F.sha2(F.expr(listed.format("base")), 256).alias("base_sha256"), F.expr(listed.format("every")).alias("spans"), F.greatest("n_added", F.lit(0)).cast("long").alias("n_added"))
