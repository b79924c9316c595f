"""Substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash at a byte depends on the 32 bytes that end there. A text is cut after the byte with the least
hash of every ``LONGEST`` consecutive ones (the last of equal ones), so that an insertion moves the cuts near
it only and chunks of a shared passage are the same wherever the passage stands. Chunks are deduplicated by a
128-bit BLAKE2 digest of the chunk and the 32 bytes before it: a digest found in two documents or more is a repeat,
and stays in the document with the smallest id. Adjacent repeats form spans; spans of ``SHORTEST_SPAN`` bytes
or more count.

No passage of ``SHORTEST_SPAN`` + 2 ``LONGEST`` - 2 = 190 bytes or more is lost: the first and the last
``LONGEST`` hashes inside it give the same cuts in all documents, and what lies between them and the 32 bytes
before is a span that is long enough. Shorter passages may be lost, unless a smaller ``longest`` is given: every passage of
``shortest`` + 2 ``longest`` - 2 bytes is found, so with 1 each one of ``shortest`` bytes, for about 49 / (``longest`` + 1) times the chunks.
Where a text repeats a short pattern, as in
a run of one letter, hashes are equal and chunks are as short as the pattern.

Digests are counted with partial aggregation, so a chunk that a third of all documents share arrives as
one row per map task; in the join that brings the verdicts back, the most frequent digests are dealt over
many tasks.

Defined results: null and empty texts have no chunks; rows with a null id are left out, as nothing could
name them; repeats within one document, or within rows of one id, don't count; ties on the smallest id
can't occur; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import SALTS, U64, Texts, byte_values, release, text_chunks, written

WINDOW = 32
LONGEST = 48
SHORTEST_SPAN = 96
#: Most digests that are dealt over many tasks.
FREQUENT = 256

GEAR = (byte_values(10) >> U64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, by doubling: 32 bytes in five steps."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def _inside(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a range."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def _least_places(texts: Texts, longest: int = LONGEST) -> np.ndarray:
    """The places with the least hash of ``longest`` consecutive ones of a text; hashes that reach before the text don't count."""
    n, first, after = len(texts.data), texts.offsets[:-1], texts.offsets[1:]
    if n < longest:
        return np.zeros(0, np.int64)
    h = gear_hashes(texts.data)
    h[_inside(first, np.minimum(first + WINDOW - 1, after), n)] = 0xFFFFFFFF
    least = (h.astype(U64) << U64(32)) | np.arange(n, dtype=np.uint32)[::-1].astype(U64)
    width = 1
    while width < longest:
        step = min(width, longest - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    whole = ~_inside(np.maximum(first, after - longest + 1), after, n)[: len(least)]
    places = n - 1 - (least[whole] & U64(0xFFFFFFFF)).astype(np.int64)
    return places[np.diff(places, prepend=-1) > 0]


def cut_points(texts: Texts, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every chunk."""
    ends = np.union1d(_least_places(texts, longest) + 1, texts.offsets[1:][np.diff(texts.offsets) > 0])
    if not len(ends):
        return ends, ends, ends
    of = np.searchsorted(texts.offsets, ends, "left") - 1
    return np.maximum(np.concatenate(([0], ends[:-1])), texts.offsets[of]), ends, of


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """One row per chunk: id, start and length in bytes, and the digest of it and the 32 bytes before as two longs."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_chunks(batch.column(1)):
                start, end, of = cut_points(texts, longest)
                begin = np.maximum(start - WINDOW, texts.offsets[of])
                raw = texts.data.tobytes()
                digests = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
                d1, d2 = np.frombuffer(digests, "<i8").reshape(-1, 2).T
                ids = batch.column(0).take(pa.array(texts.first + of))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array((start - texts.offsets[of]).astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(np.ascontiguousarray(d1)), pa.array(np.ascontiguousarray(d2))],
                    ["id", "start", "length", "d1", "d2"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, start int, length int, d1 long, d2 long")


def _frequent(docs: DataFrame, id_col: str, text_col: str, longest: int) -> DataFrame:
    """At most ``FREQUENT`` digests that are most frequent in a 64th of the documents. They only say what is dealt over many tasks."""
    some = docs.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(64)) == 0)
    counts = chunks(some, id_col, text_col, longest).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n >= 16")
    return written(counts.orderBy(F.desc("n"), "d1", "d2").limit(FREQUENT).select(F.col("d1").alias("h1"), F.col("d2").alias("h2")), "frequent")


def _dealt(rows: DataFrame, frequent: DataFrame, salts: Column) -> DataFrame:
    """Rows with a frequent digest get its last bits changed by each of the salts."""
    marked = rows.join(F.broadcast(frequent), (F.col("d1") == F.col("h1")) & (F.col("d2") == F.col("h2")), "left")
    salt = F.explode(F.when(F.col("h1").isNull(), F.array(F.lit(0))).otherwise(salts))
    return marked.select(*rows.columns, salt.alias("salt")).withColumn("d2", F.col("d2").bitwiseXOR(F.col("salt").cast("long"))).drop("salt")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST_SPAN, longest: int = LONGEST) -> DataFrame:
    """One row per span of ``shortest`` bytes or more that other documents have too: id, start, length (bytes), n_chunks, first_doc_id, removed_bytes."""
    table = chunks(docs, id_col, text_col, longest)
    shared = table.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("d1", "d2", "first")
    shared = written(shared, "shared")  # so that the shuffle of all digests can go before the next one
    frequent = _frequent(docs, id_col, text_col, longest)
    release(docs.sparkSession)
    place = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("length").cast("long"))
    own = _dealt(table.select("id", place.alias("place"), "d1", "d2"), frequent, F.array(F.pmod(F.xxhash64("id", "place"), F.lit(SALTS)).cast("int")))
    shared = _dealt(shared, frequent, F.sequence(F.lit(0), F.lit(SALTS - 1)))
    start = F.shiftright("place", 32).cast("int")
    found = own.join(shared, ["d1", "d2"]).select("id", start.alias("start"), (start + F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("end"), "first").withColumn("removed", F.col("id") != F.col("first"))
    line = Window.partitionBy("id").orderBy("start", "end")
    begin, before = F.greatest(F.col("start") - WINDOW, F.lit(0)), F.lag("end").over(line)
    found = found.withColumn("new", F.when(before >= begin, 0).otherwise(1)).withColumn("begin", F.least(F.greatest(begin, before), "end"))  # what no chunk before it covers
    found = found.withColumn("span", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = found.groupBy("id", "span").agg(
        F.min("begin").cast("long").alias("start"), (F.max("end") - F.min("begin")).cast("long").alias("length"),
        F.count(F.lit(1)).alias("n_chunks"), F.min("first").alias("first_doc_id"), F.sum(F.when(F.col("removed"), F.col("end") - F.col("begin")).otherwise(0)).alias("removed_bytes"),
    )
    return spans.where(F.col("length") >= shortest).drop("span").withColumnRenamed("id", id_col)


def repeated_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST_SPAN, longest: int = LONGEST) -> DataFrame:
    """The documents with repeated spans: id, n_spans, n_chunks, repeated_bytes, removed_bytes, first_doc_id."""
    return repeated_spans(docs, id_col, text_col, shortest, longest).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum("n_chunks").alias("n_chunks"), F.sum("length").alias("repeated_bytes"), F.sum("removed_bytes").alias("removed_bytes"), F.min("first_doc_id").alias("first_doc_id")
    )
