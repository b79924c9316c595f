"""Unit tf-idf vectors of whole texts, with one pass over the texts and without a row per word.

Python's ``re`` reads the words, as its C code takes about a twentieth of the time of Java's patterns, lists and explosion
here. Patterns have ASCII's white space, as RE2 has it. The words of rows that share an id count as one text's.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import lexicons as L
from loomwright.operators.neighbours import discard, release, written

_CODE, _TOKEN = re.compile(L.CODE_BLOCK), re.compile(L.TOKEN)
_URL = re.compile(L.URL.replace(r"\S", r"[^ \t\n\f\r]"))
#: Distinct words that a task holds before it passes their sums on, and texts of an Arrow batch.
HELD, BATCH = 400_000, 2000
_NONE = np.zeros(0, np.int64)


def words(text: str | None) -> list[str]:
    """Tokens in lower case, without those of fenced code and URLs."""
    if not text:
        return []
    if "```" in text:
        text = _CODE.sub(" ", text)
    if "http" in text or "www." in text:
        text = _URL.sub(" ", text)
    found = _TOKEN.findall(text)
    return " ".join(found).lower().split(" ") if found else found


_COUNTS = pa.schema([("id", pa.int64()), ("words", pa.string()), ("n", pa.binary()), ("df", pa.binary())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts sorted by id: words and counts of each id, and sums over ids (``df`` isn't null there)."""
    rows: list[tuple] = []
    place: dict[str, int] = defaultdict(count().__next__)
    at, n = [_NONE], [_NONE]

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _COUNTS, strict=True)], schema=_COUNTS)
        rows.clear()
        return batch

    def sums() -> None:
        terms, where = list(place), np.concatenate(at)
        totals, texts = np.bincount(where, np.concatenate(n), len(terms)).astype("<i8"), np.bincount(where, minlength=len(terms)).astype("<i8")
        rows.extend((None, " ".join(terms[s : s + 50_000]), totals[s : s + 50_000].tobytes(), texts[s : s + 50_000].tobytes()) for s in range(0, len(terms), 50_000))
        place.clear()
        place.default_factory = count().__next__
        del at[1:], n[1:]

    def close(key: int | None, own: Counter) -> None:
        if not own:
            return
        at.append(np.fromiter(map(place.__getitem__, own), np.int64, len(own)))
        n.append(np.fromiter(own.values(), np.int64, len(own)))
        if key is not None:
            rows.append((key, " ".join(own), n[-1].astype("<u4").tobytes(), None))

    last, own = None, Counter()
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != last:
                close(last, own)
                last, own = key, Counter()
                if len(place) > HELD or len(at) > HELD // 20:
                    sums()
                if len(rows) >= BATCH:
                    yield out()
            own.update(words(text))
    close(last, own)
    if place:
        sums()
    if rows:
        yield out()


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for joined, n, df in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(joined.split(" "), pa.string()), pa.array(np.frombuffer(n, "<i8")), pa.array(np.frombuffer(df, "<i8"))], ["term", "total", "df"])


def packed_tfidf(docs: DataFrame, min_df: int, max_share: float, features: int) -> DataFrame:
    """From (id, text), ``packed_rows`` of unit vectors with smoothed idf + 1 over the ``features`` most frequent terms within the bounds."""
    total = docs.count()
    docs = docs.select(F.col("id").cast("long"), "text")
    counts, path = written(docs.repartition("id").sortWithinPartitions("id").mapInArrow(_counted, "id long, words string, n binary, df binary"), "words")
    release(docs.sparkSession)
    terms = counts.where("df is not null").select("words", "n", "df").mapInArrow(_terms, "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    top = terms.where((F.col("df") >= min_df) & (F.col("df") <= max_share * total)).orderBy(F.desc("total"), "term").limit(features).collect()
    top = sorted((r["term"], r["df"]) for r in top)
    place, idf = {w: i for i, (w, _) in enumerate(top)}, np.array([np.log((1 + total) / (1 + df)) + 1 for _, df in top])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, joined, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                terms = joined.split(" ")
                index = np.fromiter(map(place.get, terms, repeat(-1)), np.int64, len(terms))
                order = np.argsort(index)
                order = order[np.searchsorted(index, 0, sorter=order) :]
                if not len(order):
                    continue
                index = index[order]
                weight = np.frombuffer(n, "<u4")[order] * idf[index]
                ix, v = index.astype("<u4").tobytes(), (weight / np.sqrt((weight * weight).sum())).astype("<f8").tobytes()
                rows.append((key, blake2b(ix + v, digest_size=16).digest(), ix, v))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["id", "digest", "ix", "v"])

    packed, _ = written(counts.where("df is null").select("id", "words", "n").mapInArrow(pack, "id long, digest binary, ix binary, v binary"), "packed")
    discard(docs.sparkSession, path)
    return packed
