"""The corpus pipeline: each stage reads what its predecessor kept and returns what it keeps itself.

Stages before the last return the columns of ``documents``. Between stages the rows are written as
Parquet to the shared folder and read again, which cuts the lineage.

Defined results: null and blank texts go in the first stage; rows without an id stay where no other row has their
text or nearly it; of rows that share an id, each text counts; repeated rows and ties leave one row in the second
and third stage, the one with the smallest id; an empty table gives no rows; further columns, whatever their names,
go along until the last stage.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from loomwright.llm.common import written
from loomwright.llm.exact_dedup import drop_copies
from loomwright.llm.langid import COVERED, keep_identified
from loomwright.llm.mixing import mix_documents
from loomwright.llm.ngram_join import keep_one_of_each
from loomwright.llm.packing import packed
from loomwright.llm.queries import TOKENIZER, tokenizer_file


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learnt language go (no letters, or almost no n-gram of any); the others get theirs where they name none."""
    return keep_identified(docs, least=COVERED)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return drop_copies(docs)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard similarity 0.8 on five-word shingles one document stays."""
    return keep_one_of_each(docs, 5, Fraction(4, 5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in the training sequences."""
    return packed(docs, tokenizer_file(TOKENIZER))


STAGES = [("language_id", identify), ("exact_dedup", deduplicate), ("ngram_join", near_deduplicate), ("mixing", mix), ("packing", pack)]

#: Learnt languages and tokens have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
