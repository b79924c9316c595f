"""Places for a user's own code: token functions, embedding backends and scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from loomwright.functions import lexicons as L
from loomwright.functions import text as T

#: What a token function is: it turns a text column into an array of tokens.
TokenFunction = Callable[[Column], Column]


def token_series(docs: DataFrame, text_col: str, time_col: str, token_fn: TokenFunction) -> DataFrame:
    """hour, token, count, of whatever tokens the function finds (UDF-01)."""
    rows = docs.select(F.date_trunc("hour", F.col(time_col)).alias("hour"), F.explode(token_fn(F.col(text_col))).alias("token"))
    return rows.groupBy("hour", "token").agg(F.count(F.lit(1)).alias("count"))


class EmbeddingBackend(Protocol):
    """Adds a column ``embedding`` of array<float> (UDF-02)."""

    def encode(self, docs: DataFrame, text_col: str) -> DataFrame: ...


class HashedTerms:
    """Offline default: counts of hashed tokens, of unit length, all in the JVM."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, docs: DataFrame, text_col: str) -> DataFrame:
        held = docs.withColumn("__slots", F.transform(T.tokens(T.clean_text(F.coalesce(F.col(text_col), F.lit("")))), lambda t: F.pmod(F.xxhash64(t), F.lit(self.size)).cast("int")))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda k: F.size(F.filter("__slots", lambda s: s == k)).cast("double"))
        held = held.withColumn("__counts", counts).drop("__slots")
        norm = F.sqrt(F.aggregate("__counts", F.lit(0.0), lambda a, v: a + v * v))
        return held.withColumn("embedding", F.transform("__counts", lambda v: F.when(norm > 0, v / norm).otherwise(0.0).cast("float"))).drop("__counts")


class Encoder:
    """A model given as a function from texts to vectors; it runs in batches, with a prefix, and empty texts get zeros (ML-02, ML-06)."""

    def __init__(self, encode: Callable[[list[str]], list[list[float]]], size: int, prefix: str = "passage: ", batch: int = 64):
        self.function, self.size, self.prefix, self.batch = encode, size, prefix, batch

    def encode(self, docs: DataFrame, text_col: str) -> DataFrame:
        function, size, prefix, batch = self.function, self.size, self.prefix, self.batch

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                texts = [("" if t is None else t).strip() for t in part]
                out = [[0.0] * size for _ in texts]
                full = [k for k, t in enumerate(texts) if t]
                for i in range(0, len(full), batch):
                    for k, vector in zip(full[i : i + batch], function([prefix + texts[k] for k in full[i : i + batch]]), strict=True):
                        out[k] = [float(v) for v in vector]
                yield pd.Series(out)

        run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return docs.withColumn("embedding", F.pandas_udf(run, ArrayType(FloatType()))(F.col(text_col)))


def select_backend(name: str = "hashed", **options) -> EmbeddingBackend:
    return {"hashed": HashedTerms, "encoder": Encoder}[name](**options)


Scorer = Callable[[Column], Column]


def constant_scorer(_: Column) -> Column:
    """Stands in for a language model that isn't there: the same scores for every text (ML-04)."""
    return F.create_map(*[x for d in L.DIMENSIONS for x in (F.lit(d), F.lit(0.5))])


def select_scorer(name: str, scorers: dict[str, Scorer]) -> Scorer:
    """The scorer of that name, the constant one for ``none`` (UDF-03)."""
    return constant_scorer if name == "none" else scorers[name]


def apply_to_groups(rows: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of each group's rows, for what no aggregate says (UDF-05); a group must fit in a task."""
    return rows.groupBy(*keys).applyInPandas(function, schema)


__all__ = ["EmbeddingBackend", "Encoder", "HashedTerms", "Scorer", "TokenFunction", "apply_to_groups", "constant_scorer", "select_backend", "select_scorer", "token_series"]
