"""N-gram Jaccard self-join by vertical partitioning.

A document's set is its distinct shingles of ``n`` words, as 64-bit hashes; hash order is the global
n-gram order. Cutting that order into fragments cuts every set into segments.

Candidates. Two sets with Jaccard similarity t or more differ in at most D = (1-t)/(1+t)(|a|+|b|)
shingles. Sizes are taken in overlapping windows, so that a pair shares a window and with it the number F of
fragments. F is so large that D + J fragments are occupied; a differing shingle changes one segment, so the
two sets have J segments at least in common among the first D + J of each (segments in order of a hash, with
D for the set's own size). Only these are signatures: about a fifth of the shingles at t = 0.9 and a third at
0.8. A set that shares fewer than J signatures with others in a window can't have a link there and goes, which
leaves out documents that have no more than some passages in common with others. Frequent shingles do no harm,
as a segment holds several of them.

Links. Sets with equal signatures aren't paired with each other: the one whose segments are shared most is
paired with the others (a star), and later rounds pair only sets that are still in different components, with
leaders drawn by a hash that are sixteen times as many each round, until every set has been one. So no link
between components is lost and a group of n copies costs about n pairs. Where two sets share many signatures,
the pair is made at the smallest of those that both have among their first ``FIRST`` (at the star, at each
signature that has that leader). A pair must pass the size bound and a bound from parity sketches of 512 bits,
and of 4096 bits where both sets are long (each differing shingle changes one bit); these bounds are exact.
Then partial overlaps are counted fragment by fragment, and summed per pair.

Sets are told apart by their size and two sums of 64 bits over their shingles; a row has a number of its own,
so ids may be of any type, missing or repeated. Signatures meet in partially aggregated groups and joins that
Spark splits where a key is hot; a set that more than a thousandth of all rows have is dealt over many tasks.

Defined results: null, empty and blank texts have empty sets, are linked with nothing and are their own
component; equal sets, copies and repeated rows included, share a component, named by the smallest id in it;
rows that share an id but not a set are linked each by its own set; rows with a null id link like others, but
can't name a component (null if none of its rows has an id); an empty table gives no rows; further columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil, exp, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import U64, Texts, bucketed, columns_of, discard, join_spread, mix64, new_path, one_of_each, release, reread, text_chunks, written
from loomwright.llm.components import components

#: Ratio of the lower ends of neighbouring size windows.
STEP = 1.3
#: Fragments in which the overlaps of a pair are counted.
PARTS = 4
#: 64-bit words of the sketch of every set, and of the further one of a set of ``LONG`` shingles or more.
SKETCH_WORDS = 8
LONG_WORDS, LONG = 64, 800
#: Of D, how many segments more than D are signatures: the least number that a linked pair shares.
SPARE = 8
#: Smallest signatures that a set has with it, so that a pair that shares many is made once.
FIRST = 16
#: Parts in which the signatures are counted one after another, so that less of them is on disk at a time.
SLICES = 2
#: The last bits of a signature tell a set's windows apart.
WINDOW_BITS = 4


def most_different(total: int, similarity: Fraction) -> int:
    """The most shingles in which two sets of together ``total`` differ at that similarity."""
    return floor(total * (1 - similarity) / (1 + similarity))


class Windows:
    """Windows of set sizes: first size, last size, D, J (``needed``), number of fragments. Sizes up to ``largest_size`` have all their windows."""

    def __init__(self, similarity: Fraction, largest: int):
        lows = [1]
        while lows[-1] <= largest:
            lows.append(max(lows[-1] + 1, ceil(lows[-1] * STEP)))
        self.similarity = similarity
        self.low = np.array(lows[:-1], np.int64)
        top = [x - 1 for x in lows[1:]]
        self.largest_size = top[-1]
        self.high = np.array([floor(x / similarity) for x in top], np.int64)
        self.differ = np.array([most_different(x + floor(x / similarity), similarity) for x in top], np.int64)
        self.needed = np.maximum(self.differ // SPARE, 1)
        self.fragments = np.array([self._fragments(int(lo), int(d)) for lo, d in zip(self.low, self.differ + self.needed, strict=True)], np.int64)

    @staticmethod
    def _fragments(size: int, wanted: int) -> int:
        """Enough that the smallest set of the window is expected to occupy as many as wanted, if it can."""
        n = wanted
        while n < 4 * wanted and n * (1 - exp(-size / n)) < wanted:
            n += 1 + n // 50
        return n

    def of(self, size: int) -> list[tuple[int, int]]:
        """The windows of a set of this size, and the most shingles in which another set of each differs from it."""
        inside = np.flatnonzero((self.low <= size) & (size <= self.high) & (self.differ > 0)).tolist()
        return [(w, most_different(size + min(floor(size / self.similarity), int(self.high[w])), self.similarity)) for w in inside]


def shingle_sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after another, and where each text's start."""
    start, end, of = texts.words()
    h = texts.hashes(start, end, 5, lower=True)
    per_text = np.bincount(of, minlength=texts.n)
    before = np.cumsum(per_text) - per_text
    place = np.arange(len(h)) - before[of]
    full = np.minimum(per_text, n)[of]
    shingle = np.zeros(len(h), U64)
    for k in range(n):
        ok = k < full
        at = np.minimum(np.arange(len(h)) + k, max(0, len(h) - 1))
        shingle = np.where(ok, mix64(shingle + h[at] * U64(2 * k + 3)), shingle)
    keep = place <= per_text[of] - full
    shingle, of = mix64(shingle[keep] + full[keep].astype(U64)), of[keep]
    order = np.lexsort((shingle, of))
    shingle, of = shingle[order], of[order]
    if len(shingle):
        first = np.ones(len(shingle), bool)
        first[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
        shingle, of = shingle[first], of[first]
    return shingle, np.searchsorted(of, np.arange(texts.n + 1))


def segment_signatures(own: np.ndarray, window: int, fragments: int, wanted: int) -> np.ndarray:
    """Signatures of as many segments as wanted, by a hash; of empty ones too where too few are occupied."""
    fragment = ((own >> U64(32)) * U64(fragments)) >> U64(32)
    edge = np.flatnonzero(np.diff(fragment)) + 1
    heads = np.concatenate(([0], edge))
    sums = np.add.reduceat(mix64(own), heads)
    count = np.diff(np.concatenate((heads, [len(own)]))).astype(U64)
    tag = U64(window * 0x9E3779B97F4A7C15 % (1 << 64))
    signature = np.sort(mix64(mix64(sums + count) + mix64(fragment[heads] + tag)) >> U64(WINDOW_BITS))[:wanted]
    if len(heads) < wanted:
        empty = np.setdiff1d(np.arange(fragments, dtype=np.int64), fragment[heads].astype(np.int64)).astype(U64)
        empty = np.sort(mix64(mix64(empty + tag) + U64(1)) >> U64(WINDOW_BITS))
        signature = np.concatenate((signature, empty[: wanted - len(heads)]))
    return (signature << U64(WINDOW_BITS)) | U64(window % (1 << WINDOW_BITS))


def parity_sketch(own: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Bit i is the parity of the shingles that hash to it; a differing shingle changes one bit."""
    at = (mix64(own + U64(99)) & U64(64 * words - 1)).astype(np.int64)
    bits = (np.bincount(at, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def set_keys(shingles: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two sums of 64 bits over the shingles of each set, which name it together with its size."""
    sums = [np.concatenate((np.zeros(1, U64), np.cumsum(mix64(shingles + U64(k))))) for k in (1, 2)]
    return [(s[starts[1:]] - s[starts[:-1]]).view(np.int64) for s in sums]


def described(docs: DataFrame, n: int, similarity: Fraction, id_col: str, text_col: str) -> DataFrame:
    """Per row: its number, id, size and key of its set (k1, k2); once per set and task also sketches, signatures, and how
    many of them it must share in each window. Row numbers are settled once this is written."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, seen = Windows(similarity, 1 << 10), set()
        for batch in batches:
            for texts in text_chunks(batch.column(2)):
                shingles, starts = shingle_sets(texts, n)
                size = np.diff(starts)
                if len(size) and size.max() > windows.largest_size:
                    windows = Windows(similarity, int(size.max()) * 2)
                # Windows of smaller sizes are the same however large the largest.
                k1, k2 = set_keys(shingles, starts)
                found = []
                for k in range(texts.n):
                    own = shingles[starts[k] : starts[k + 1]]
                    key = (int(k1[k]), int(k2[k]), len(own))
                    if key in seen or not len(own):
                        found.append((None,) * 4)
                        continue
                    seen.add(key)
                    signatures, needs = [], [0] * (1 << WINDOW_BITS)
                    for w, differ in windows.of(len(own)):
                        need = int(windows.needed[w])
                        signatures.append(segment_signatures(own, w, int(windows.fragments[w]), differ + need))
                        needs[w % len(needs)] = need
                    found.append((parity_sketch(own), parity_sketch(own, LONG_WORDS) if len(own) >= LONG else None, np.concatenate(signatures).view(np.int64) if signatures else None, needs))
                columns = [list(c) for c in zip(*found, strict=True)]
                ids = [c.slice(texts.first, texts.n) for c in batch.columns[:2]]
                arrays = [*ids, pa.array(size), pa.array(k1), pa.array(k2), *[pa.array(c, pa.list_(t)) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "id", "size", "k1", "k2", "sketch", "longer", "signatures", "needs"])

    return rows.mapInArrow(run, f"row long, id {kind}, size long, k1 long, k2 long, sketch array<long>, longer array<long>, signatures array<long>, needs array<int>")


def segments(texts: DataFrame, n: int) -> DataFrame:
    """Per text: the key of its set (once per task) and ``segments``, its shingles in each fragment of the global order."""
    bounds = np.array([(k << 64) // PARTS for k in range(1, PARTS)], U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for texts in text_chunks(batch.column(0)):
                shingles, starts = shingle_sets(texts, n)
                k1, k2 = set_keys(shingles, starts)
                keys = list(zip(k1.tolist(), k2.tolist(), strict=True))
                rows = [k for k, key in enumerate(keys) if starts[k] < starts[k + 1] and key not in seen and not seen.add(key)]
                found = [[x.view(np.int64) for x in np.split(own, np.searchsorted(own, bounds))] for own in (shingles[starts[k] : starts[k + 1]] for k in rows)]
                yield pa.RecordBatch.from_arrays([pa.array(k1[rows]), pa.array(k2[rows]), pa.array(found, pa.list_(pa.list_(pa.int64())))], ["k1", "k2", "segments"])

    return texts.mapInArrow(run, "k1 long, k2 long, segments array<array<long>>")


def _may_link(similarity: Fraction) -> Column:
    """Exact bounds on a pair: sizes, and the bits in which the sketches differ; the longer ones only where both have them."""
    num, den = similarity.numerator, similarity.denominator
    sizes = [F.col("a_size"), F.col("b_size")]
    short = sum((F.bit_count(F.col("a_sketch")[k].bitwiseXOR(F.col("b_sketch")[k])) for k in range(SKETCH_WORDS)), F.lit(0))
    long = F.expr("aggregate(zip_with(a_longer, b_longer, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v)")
    fits = lambda bits: bits * (num + den) <= (sizes[0] + sizes[1]) * (den - num)
    return (den * F.least(*sizes) >= num * F.greatest(*sizes)) & fits(short) & (F.col("a_longer").isNull() | F.col("b_longer").isNull() | fits(long))


def _side(rows: DataFrame, side: str, *more: str | Column) -> DataFrame:
    """The facts of one side of a pair, named after it."""
    return rows.select(*more, F.col("row").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("size", "k1", "k2", "sketch", "longer")])


def _verified(pairs: DataFrame, parts: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs (a, b) with enough in common: partial overlaps per fragment, summed per pair."""
    num, den = similarity.numerator, similarity.denominator
    both = pairs
    for side, name in (("a", "s"), ("b", "r")):
        own = parts.select(F.col("k1").alias(f"{side}_k1"), F.col("k2").alias(f"{side}_k2"), F.col("segments").alias(name))
        both = both.join(own, [f"{side}_k1", f"{side}_k2"])
    both = both.withColumn("n", sum((F.size(F.array_intersect(F.col("s")[k], F.col("r")[k])) for k in range(PARTS)), F.lit(0)))
    return both.where(den * F.col("n") >= num * (F.col("a_size") + F.col("b_size") - F.col("n"))).select("a", "b")


def signature_groups(shared: DataFrame) -> DataFrame:
    """One ``sig`` of those with the same rows, with their number n (two or more) and ``weight``, the number of such signatures.

    The rows are told apart by sums of their numbers' hashes, in halves that can't overflow.
    """
    h = F.xxhash64("row")
    high, low = F.sum(F.shiftright(h, 32)).alias("high"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")
    groups = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), high, low).where("n > 1")
    return groups.groupBy("n", "high", "low").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("weight"))


def _candidates(signed: DataFrame) -> DataFrame:
    """(row, sig, weight, members): the shared signatures of sets that share as many as a link needs, one of each group."""
    spark = signed.sparkSession
    path = new_path(spark, "shared")
    for k in range(SLICES):
        own = F.filter("signatures", lambda x: F.pmod(F.shiftright(x, WINDOW_BITS), F.lit(SLICES)) == k)  # noqa: B023
        rows = signed.select("row", F.explode(own).alias("sig"))
        often = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig")
        window = F.col("sig").bitwiseAND(F.lit((1 << WINDOW_BITS) - 1)).cast("int")
        rows.join(often, "sig").select("row", "sig", window.alias("window")).write.mode("append").parquet(path)
        release(spark)
    shared = reread(spark, "row long, sig long, window int", path)
    counts = shared.groupBy("row", "window").agg(F.count(F.lit(1)).alias("n"))
    enough = counts.join(signed.select("row", "needs"), "row").where(F.col("n") >= F.col("needs")[F.col("window")]).select("row", "window")
    left = written(shared.join(enough, ["row", "window"], "left_semi").select("row", "sig"), "left")
    discard(shared)
    release(spark)
    groups = signature_groups(left).withColumnRenamed("n", "members")
    members = written(left.join(groups.select("sig", "weight", "members"), "sig"), "members")
    discard(left)
    release(spark)
    return members


def _chosen_texts(docs: DataFrame, facts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts of the rows that ``facts`` names by their ids, and of those without an id."""
    own = F.col(f"`{id_col}`")
    ids = facts.where("id is not null").select(F.col("id").alias("__id")).distinct()
    named = docs.where(own.isNotNull()).join(ids, own == F.col("__id"), "left_semi")
    return named.select(F.col(f"`{text_col}`").alias("text")).union(docs.where(own.isNull()).select(F.col(f"`{text_col}`")))


def labelled(docs: DataFrame, n: int, similarity: Fraction, id_col: str, text_col: str) -> DataFrame:
    """Per row: row, id, size, k1, k2, ``label`` (the component's smallest row number; null for an empty set) and component_id."""
    spark = docs.sparkSession
    docs = columns_of(docs, id_col, text_col)
    table = written(described(docs, n, similarity, id_col, text_col), "sets")
    rows = table.select("row", "id", "size", "k1", "k2")
    by_set = ["k1", "k2", "size"]
    sets = written(rows.where("size > 0").groupBy(*by_set).agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    total = sets.agg(F.sum("n").alias("t")).first()["t"] or 0
    signed = table.where("signatures is not null")
    members = _candidates(signed)
    score = members.groupBy("row").agg(F.sum(F.col("weight") * F.col("members")).alias("score"), F.slice(F.array_sort(F.collect_list("sig")), 1, FIRST).alias("first"))
    facts = facts_table = written(signed.select("row", "id", *by_set, "sketch", "longer").join(score, "row"), "candidates")
    largest = members.agg(F.max("members").alias("m")).first()["m"]
    release(spark)
    labels = None
    if largest:
        # A level for each set; sixteen times as many have the next lower one.
        level = F.lit(0)
        for k in range(1, 16):
            level = level + F.when(F.pmod(F.xxhash64(F.lit("level"), "row"), F.lit(1 << (4 * k))) == 0, 1).otherwise(0)
        top = 0
        while 16 ** (top + 1) < largest:
            top += 1
        facts = facts.withColumn("level", F.least(level, F.lit(top)))
        parts = segments(_chosen_texts(docs, facts, id_col, text_col), n)
        parts = bucketed(parts.join(facts.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), "segments", "k1", "k2")
        release(spark)
        # A set that several tasks have signed is one node.
        links_path = new_path(spark, "links")
        facts.select("row", *by_set).join(sets, by_set).where("row <> node").select(F.col("row").alias("a"), F.col("node").alias("b")).write.parquet(links_path)
        known = members.select("row", "sig").join(facts, "row")
        for step in range(-1, top + 1):
            placed = None
            if step < 0:
                best = known.groupBy("sig").agg(F.max(F.struct("score", (-F.col("row")).alias("minus"))).alias("best"))
                leaders = best.select("sig", (-F.col("best.minus")).alias("a"))
                leaders = leaders.join(_side(facts, "a"), "a")
                others = _side(known, "b", "sig")
                pairs = leaders.join(others, "sig").where((F.col("a") != F.col("b")) & _may_link(similarity))
            else:
                placed = known.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("component", "row"))
                mixed = placed.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("sig")
                placed = written(placed.join(mixed, "sig").select("sig", "row", *by_set, "sketch", "longer", "level", "label", "first"), "unsettled")
                leaders = _side(placed.where(F.col("level") == top - step), "a", "sig", F.col("label").alias("a_label"), F.col("first").alias("a_first"))
                others = _side(placed.where(F.col("level") <= top - step), "b", "sig", F.col("label").alias("b_label"), F.col("first").alias("b_first"))
                # Both meet at every signature that both have, if they meet at all.
                once = F.coalesce(F.array_min(F.array_intersect("a_first", "b_first")) >= F.col("sig"), F.lit(True))
                pairs = leaders.join(others, "sig").where((F.col("a_label") != F.col("b_label")) & _may_link(similarity) & once)
            pairs = pairs.select("a", "b", *[f"{x}_{c}" for x in "ab" for c in by_set]).distinct()
            _verified(pairs, parts, similarity).write.mode("append").parquet(links_path)
            release(spark)
            labels = components(spark.read.schema("a long, b long").parquet(links_path), "a", "b")
            discard(placed)
            release(spark)
        discard(parts)
    discard(members, facts_table)
    if labels is not None:
        found = written(sets.join(labels.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_")).select(*by_set, "component", "least"), "found")
        names = found.groupBy("component").agg(F.min("least").alias("name"))
        found = found.join(names, "component").select(*by_set, "component", "name")
        sets = sets.join(found, by_set, "left")
    else:
        sets = sets.withColumn("component", F.lit(None).cast("long")).withColumn("name", F.lit(None).cast(sets.schema["least"].dataType))
    sets = sets.select(*by_set, F.coalesce("component", "node").alias("label"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("name")).alias("component_id"), F.col("n").alias("__n"))
    full = join_spread(rows.where("size > 0"), sets, by_set, "__n", total).select("row", "id", *by_set, "label", "component_id")
    return full.unionByName(rows.where("size = 0").select("*", F.lit(None).cast("long").alias("label"), F.col("id").alias("component_id")))


def jaccard_components(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links)."""
    found = labelled(docs, n, similarity, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def _keyed(docs: DataFrame, n: int, text_col: str) -> DataFrame:
    """All columns, and the key of each row's set (__k1, __k2, __size)."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_chunks(batch.column(names.index(text_col))):
                shingles, starts = shingle_sets(texts, n)
                keys = [pa.array(k) for k in (*set_keys(shingles, starts), np.diff(starts))]
                yield pa.RecordBatch.from_arrays([*[c.slice(texts.first, texts.n) for c in batch.columns], *keys], [*batch.schema.names, "__k1", "__k2", "__size"])

    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(rows.schema.fields))
    return rows.mapInArrow(run, f"{kinds}, __k1 long, __k2 long, __size long").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "__k1", "__k2", "__size")


def keep_one_of_each(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that with the smallest id (null last), of such the one with the
    smallest set key, of such the one with the smallest text. Of rows with empty sets, one of each id stays, and all without an id."""
    own = F.col(f"`{id_col}`")
    rows = written(labelled(docs, n, similarity, id_col, text_col), "labelled")
    group = ["label", F.when(F.col("size") == 0, F.col("id")).alias("blank")]
    best = rows.where("size > 0 or id is not null").groupBy(*group).agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "k1", "k2", "size")).alias("best")).select("best.*")
    best = written(best.select(F.col("id").alias("__id"), F.col("k1").alias("__b1"), F.col("k2").alias("__b2"), F.col("size").alias("__bsize")), "kept")
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").select(F.col("id").alias("__rid"))
    if not repeated.limit(1).count():
        return docs.join(best, own == F.col("__id"), "left_semi")
    # Rows that share an id or lack one are told apart by their sets.
    odd = docs.where(own.isNull()).unionByName(docs.where(own.isNotNull()).join(repeated.where("__rid is not null"), own == F.col("__rid"), "left_semi"))
    odd = _keyed(odd, n, text_col)
    blank = odd.where(own.isNull() & (F.col("__size") == 0))
    held = odd.join(best, own.eqNullSafe(F.col("__id")) & (F.col("__k1") == F.col("__b1")) & (F.col("__k2") == F.col("__b2")) & (F.col("__size") == F.col("__bsize")), "left_semi")
    held = one_of_each(held, [own, F.col("__k1"), F.col("__k2"), F.col("__size")], F.col(f"`{text_col}`")).unionByName(blank).drop("__k1", "__k2", "__size")
    plain = docs.where(own.isNotNull()).join(repeated.where("__rid is not null"), own == F.col("__rid"), "left_anti")
    return plain.join(best, own == F.col("__id"), "left_semi").unionByName(held)
