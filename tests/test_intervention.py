"""Intervention queries on noisy texts equal their SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import intervention
from loomwright.plans import pragmatic, registry
from loomwright.plans.texts import CLEAN, NORMAL
from tests.oracle import compare


@pytest.fixture(scope="module")
def noisy(spark, tmp_path_factory):
    """Pairs of texts: one has a long base64 part, the other is plain."""
    texts = ["api token endpoint base64," + "QUJD" * 40, "my human and the user asked for a prompt"]
    folder = tmp_path_factory.mktemp("noisy")
    rows = [(2 * i + k, t, "ab"[k], "st"[k], len(t)) for i, t in enumerate(texts) for k in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["intervention_candidates", "intervention_events", "intervention_groups", "intervention_robustness", "robust_events", "strict_events"])
def test_noisy_texts_equal_sql(spark, noisy, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{noisy}/documents.parquet/*.parquet'")
    compare(registry.queries()[name](spark, noisy), registry.oracle_sql()[name], duck)


def test_penalty_is_the_operators_default(spark, noisy):
    docs = pragmatic._docs(spark, noisy)
    count = lambda **x: intervention.candidates(intervention.scored(docs, **x), pragmatic.LEAST).count()
    assert (count(), count(penalty=0.0)) == (2, 4)


@pytest.fixture(scope="module")
def nameless(spark, tmp_path_factory):
    """Pairs of equal texts: of one the language is missing and "unknown", of the other the source."""
    folder = tmp_path_factory.mktemp("nameless")
    rows = [(0, "api one", None, "s"), (1, "api one", "unknown", "s"), (2, "api two", "en", None), (3, "api two", "en", "unknown")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["intervention_groups", "intervention_events", "intervention_robustness", "robust_events", "strict_events"])
def test_missing_names_equal_sql(spark, nameless, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{nameless}/documents.parquet/*.parquet'")
    compare(registry.queries()[name](spark, nameless), registry.oracle_sql()[name], duck)


def test_missing_names_are_unknown_by_default(spark, nameless):
    rows = intervention.candidates(intervention.scored(pragmatic._docs(spark, nameless)), pragmatic.LEAST)
    count = lambda **x: sorted((r.unique_authors, r.unique_communities) for r in intervention.groups(rows, **x).collect())
    assert (count(), count(missing=None)) == ([(1, 1), (1, 1)], [(1, 2), (2, 1)])


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    """64 equal texts whose coordination index is 0.5103125: a half in the seventh digit."""
    folder = tmp_path_factory.mktemp("halves")
    langs = [lang for lang, n in zip("abcdefg", [19, 8, 8, 8, 7, 7, 7], strict=True) for _ in range(n)]
    rows = [(i, "api one", lang, "s") for i, lang in enumerate(langs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["intervention_groups", "intervention_events", "strict_events"])
def test_halves_are_rounded_as_in_sql(spark, halves, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{halves}/documents.parquet/*.parquet'")
    compare(registry.queries()[name](spark, halves), registry.oracle_sql()[name], duck)


#: Letters, digits, marks and white space that aren't ASCII (the last two marks are newer than Java 17), s and k among them whatever the case, and the vertical tab.
OTHERS = ["\u0436", "\u00e9", "e\u0301", "\u00df", "\u1e9e", "\u0130", "\u0131", "\u017f", "\u212a", "\u0663", "\u00b2", "\u00aa", "\u4e2d", "\u20dd", "\u00a0", "\u2003", "\x0b", "\x1f", "\x85", "\u1ac6", "\U0001cf2b"]


@pytest.fixture(scope="module")
def others(spark, tmp_path_factory):
    """Pairs of equal texts with such characters beside, inside and between words of the lexicons, and two rows without an id."""
    folder = tmp_path_factory.mktemp("others")
    forms = ["the user{0} api", "{0}follow bob", "api 12{0} token 7", "fir{0}t 10{0}followers", "www.a{0}secret api", "today to{0}ken {0}prompt", "api @bob{0} act a{0} my{0}human", "dm{0} brea{0}ing"]
    texts = [f.format(x) for f in forms for x in OTHERS]
    rows = [(2 * i + k, t, "ab"[k], "st"[k]) for i, t in enumerate(texts) for k in range(2)] + [(None, "api one", lang, "s") for lang in "ab"]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["strict_events", "intervention_candidates"])
def test_words_end_as_in_sql(spark, others, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{others}/documents.parquet/*.parquet'")
    compare(registry.queries()[name](spark, others), registry.oracle_sql()[name], duck)


def test_every_character_is_folded_as_in_sql(spark, tmp_path):
    codes = [c for c in (*range(1, 0xD800), *range(0xE000, 0x20000)) if c != 0x0B]
    spark.createDataFrame([(c, f"a{chr(c)}b") for c in codes], "code int, text string").write.parquet(f"{tmp_path}/t")
    rest = r"[^\x00-\x7F]+"
    sql = f"SELECT code, regexp_replace({NORMAL}, '{rest}', chr(1), 'g') AS n, regexp_replace({CLEAN}, '{rest}', chr(1), 'g') AS c FROM '{tmp_path}/t/*.parquet' ORDER BY code"
    got = spark.read.parquet(f"{tmp_path}/t").select("code", T.ascii_normal(F.col("text")), F.regexp_replace(T.ascii_clean(F.col("text")), rest, "\x01")).orderBy("code").collect()
    assert [tuple(r) for r in got] == duckdb.sql(sql).fetchall()


def test_words_are_unicodes_by_default(spark):
    docs = spark.createDataFrame([(0, "a", "s", "the user\u0436 api")], "doc_id long, author string, community string, text string").withColumn("created", F.current_timestamp())
    refs = lambda **x: intervention.scored(docs, **x).first()["human_refs"]
    assert (refs(), refs(ascii=True)) == (0.0, 1.0)
