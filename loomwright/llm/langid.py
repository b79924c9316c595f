"""Language identification with language-bitmask n-gram filters.

Each language's common character n-grams (UTF-8 bytes of the lower-cased text) go into one bit-sliced
Bloom filter: slot i holds a mask with one bit per language, and inserting an n-gram sets the language's
bit in ``HASHES`` slots. Looking up an n-gram ANDs its slots and so returns all languages that contain
it at once. A text's answer counts, per language, the looked-up n-grams that bear its bit (popcounts of
the mask columns), takes off the false positives that the filter's fill predicts, and picks the largest.

The filter is learnt from at most about ``PER_LANGUAGE`` labelled rows of each language, chosen by a
hash of the id; prediction reads every whole text. The filter has a fixed size (``SLOTS`` masks of 64
languages a word), which bounds what is sent to the executors.

Defined results: a null text, or one without letters, gives ``und`` with score 0; ties go to the language
first in code point order; rows with null labels are never learnt from; with no labelled row at all every
row is ``und``; repeated rows get equal answers; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import U64, WHITE, Texts, columns_of, mix64, text_chunks

NGRAM = 4
SLOTS = 1 << 20
HASHES = 3
#: Expected number of labelled rows of a language that the filter is fitted on.
PER_LANGUAGE = 1500
#: Occurrences of an n-gram among a million of its language from which the language is said to contain it.
PER_MILLION = 30.0
UNKNOWN = "und"
#: A share of a text's n-grams to ask of its language in the filter, and bytes from which it is asked for.
COVERED, SHORT = 0.1, 20
SLICE_ROWS = 128


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def _framed(column: pa.Array) -> pa.Array:
    """Lower case, with a space at either end, so that short texts have n-grams too."""
    empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(empty, pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), empty, space)


def _grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text as integers, with text numbers. White space counts as one space each."""
    data = np.where(WHITE[texts.data], np.uint8(32), texts.data)
    if len(data) < NGRAM:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    n = len(data) - NGRAM + 1
    gram = np.zeros(n, np.uint32)
    for k in range(NGRAM):
        gram = (gram << np.uint32(8)) | data[k : k + n]
    lengths = np.maximum(np.diff(texts.offsets) - NGRAM + 1, 0)
    of = np.repeat(np.arange(texts.n), lengths)
    first = np.repeat(texts.offsets[:-1] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return gram[np.arange(len(of)) + first].astype(U64), of


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (language, n-gram)."""
    for batch in slices(batches):
        lower = _framed(batch.column("text"))
        languages = batch.column("lang").dictionary_encode()
        codes, names = np.asarray(languages.indices), languages.dictionary
        for texts in text_chunks(lower):
            gram, of = _grams(texts)
            key, count = np.unique((codes[texts.first + of].astype(U64) << U64(32)) | gram, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array((key >> U64(32)).astype(np.int64))).cast(pa.string()), pa.array((key & U64(0xFFFFFFFF)).astype(np.int64)), pa.array(count.astype(np.int64))], ["lang", "gram", "n"]
            )


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shorter batches, as lowering copies a batch's texts several times."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(k, SLICE_ROWS)


class MaskFilter:
    """A bit-sliced Bloom filter: ``masks[slot, word]`` has a bit for each language."""

    def __init__(self, names: list[str]):
        self.names = names
        self.masks = np.zeros((SLOTS, max(1, -(-len(names) // 64))), U64)

    @staticmethod
    def slots(gram: np.ndarray) -> list[np.ndarray]:
        h = mix64(gram + U64(0x1234567))
        return [((h >> U64(20 * k)) & U64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]

    def insert(self, gram: np.ndarray, language: int) -> None:
        for at in self.slots(gram):
            self.masks[at, language // 64] |= U64(1 << (language % 64))

    def false_positives(self) -> np.ndarray:
        """For each language, how often an n-gram that it lacks seems to be there."""
        return np.array([np.mean((self.masks[:, k // 64] >> U64(k % 64)) & U64(1)) ** HASHES for k in range(len(self.names))])

    def lookup(self, gram: np.ndarray) -> np.ndarray:
        first, *rest = self.slots(gram)
        found = self.masks[first]
        for at in rest:
            found &= self.masks[at]
        return found


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> MaskFilter:
    """A filter from a bounded sample of the labelled rows of ``docs``."""
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{id_col}`").alias("id")).where("lang is not null")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return MaskFilter([])
    share = F.lit(0.0)
    for name, n in sorted(totals.items()):
        share = F.when(F.col("lang") == name, min(1.0, PER_LANGUAGE / n)).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) < share * 1_000_000).select("text", "lang")
    counts = chosen.mapInArrow(_learn, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    all_grams = {r["lang"]: r["t"] for r in chosen.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("t")).collect()}
    least = F.lit(None)
    for name, n in all_grams.items():
        least = F.when(F.col("lang") == name, max(2.0, (n or 0) * PER_MILLION / 1e6)).otherwise(least)
    # An n-gram needs 30 occurrences in a million, so a language has at most 33,334 of them.
    table = counts.where(F.col("n") >= least).select("lang", "gram").toArrow()
    found = MaskFilter(sorted(totals))
    names, grams = np.array(table["lang"].to_pylist(), object), table["gram"].to_numpy().astype(U64)
    for k, name in enumerate(found.names):
        found.insert(grams[names == name], k)
    return found


def _predict_texts(column: pa.Array, model: MaskFilter, fp: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its share of all corrected hits, and the share of the n-grams that it contains."""
    lower = _framed(column)
    letters = np.asarray(pc.match_substring_regex(lower, r"\pL"))
    names = model.names
    labels, scores, covers = [UNKNOWN] * len(lower), np.zeros(len(lower)), np.zeros(len(lower))
    if not names:
        return labels, scores, covers
    for texts in text_chunks(lower):
        gram, of = _grams(texts)
        found = model.lookup(gram)
        size = np.bincount(of, minlength=texts.n).astype(float)
        bits = [np.bincount(of[((found[:, k // 64] >> U64(k % 64)) & U64(1)).astype(bool)], minlength=texts.n) for k in range(len(names))]
        hits = np.maximum((np.stack(bits, 1) - size[:, None] * fp) / (1 - fp), 0)
        total, best = hits.sum(1), hits.argmax(1)
        for k in range(texts.n):
            row = texts.first + k
            if letters[row]:
                labels[row] = names[best[k]]
                scores[row] = hits[k, best[k]] / total[k] if total[k] > 0 else 0.0
                covers[row] = min(1.0, hits[k, best[k]] / size[k]) if size[k] else 0.0
    return labels, scores, covers


def predict(docs: DataFrame, model: MaskFilter, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all) with lang_pred, score and coverage. Only the text is an input of the prediction."""
    names = docs.columns if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        fp = model.false_positives()
        for batch in slices(batches):
            labels, scores, covers = _predict_texts(batch.column(0), model, fp)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(covers, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score", "coverage"])

    kept = [f"{rows.schema[f'c{k}'].name} {rows.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(names))]
    out = rows.mapInArrow(run, ", ".join([*kept, "lang_pred string", "score double", "coverage double"]))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], F.col("lang_pred"), F.col("score"), F.col("coverage"))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents not held out, then predict all: id, held_out, lang_pred, score, coverage."""
    docs = columns_of(docs, id_col, text_col, lang_col)
    model = fit(docs.where(~held_out(F.col(id_col)) | F.col(id_col).isNull()), text_col, lang_col, id_col)
    return predict(docs, model, text_col, [id_col]).select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "lang_pred", "score", "coverage")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.0) -> DataFrame:
    """The documents in a learnt language, with the predicted one where they name none. A map-only pass after the fit.

    Null texts and those without letters go, and so do texts of ``SHORT`` bytes or more of whose n-grams the best language
    contains less than the share ``least``. Where no row names a language, all texts with letters stay as they are.
    """
    model = fit(docs, text_col, lang_col, id_col)
    if not model.names:  # nothing to tell languages by, so ``und`` says nothing about a text
        return docs.where(F.col(f"`{text_col}`").rlike(r"\p{L}"))
    at = {c: f"d{k}" for k, c in enumerate(docs.columns)}
    found = predict(docs.withColumnsRenamed(at), model, at[text_col])
    kept = found.where((F.col("lang_pred") != UNKNOWN) & ((F.col("coverage") >= least) | (F.octet_length(at[text_col]) < SHORT)))
    return kept.select(*[(F.coalesce(F.col(d), F.col("lang_pred")) if c == lang_col else F.col(d)).alias(c) for c, d in at.items()])
