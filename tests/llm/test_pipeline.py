"""The pipeline against brute force, stage by stage, and its stages on odd tables."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwright.llm import mixing
from tests.conftest import DATA
from tests.llm.test_llm import WORD, linked, norm, shingles

pytest.importorskip("public_tokenizers")
SF = f"{DATA}/sf0.001"


def table(df):
    return [r.asDict() for r in df.collect()]


def test_stages_take_each_other(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "ngram_join", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90001, "12 34 !!", "en", "src0", 8), (90002, None, "en", None, 0), (90003, "", None, "src1", 0)], docs.schema)
    docs = docs.unionByName(odd)
    before = table(docs)

    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns
    rows = table(kept)
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in before if re.search(r"[^\W\d_]", r["text"] or ""))

    once = stages["exact_dedup"](spark, kept, SF)
    first = {}
    for r in rows:
        first[norm(r["text"])] = min(r["doc_id"], first.get(norm(r["text"]), r["doc_id"]))
    assert once.columns == docs.columns and sorted(r["doc_id"] for r in table(once)) == sorted(first.values())

    rows = sorted(table(once), key=lambda r: r["doc_id"])
    roots = linked([shingles(r["text"], 5) for r in rows], 4, 5)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min(r["doc_id"], least.get(root, r["doc_id"]))
    near = stages["ngram_join"](spark, once, SF)
    assert near.columns == docs.columns and sorted(r["doc_id"] for r in table(near)) == sorted(least.values())

    rows = {r["doc_id"]: r for r in table(near)}
    counts = {r["doc_id"]: r["taken"] for r in table(mixing.mix_counts(near))}
    mixed = stages["mixing"](spark, near, SF)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in table(mixed):
        own = WORD.findall(rows[r["doc_id"]]["text"])
        got = WORD.findall(r["text"])
        assert got == own[: len(got)] and (r["text"] == rows[r["doc_id"]]["text"]) == (len(got) == len(own) and r["n_chars"] == rows[r["doc_id"]]["n_chars"])
        words[r["doc_id"]] += len(got)
    assert {k: v for k, v in counts.items() if v} == dict(words)

    packed = table(stages["packing"](spark, mixed, SF))
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in table(mixed))
    full = Counter()
    for r in packed:
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 4096 and len(full) <= -(-sum(full.values()) // 4096) + 1


def test_run_is_the_stages(spark):
    rows = table(corpus_pipeline.run(spark, SF))
    assert rows and set(rows[0]) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") < -1)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
