"""Best-fit packing of tokenised documents by minimum bin slack.

Documents become pieces of at most ``CAPACITY`` tokens. Only the number of pieces of each length matters
for a plan, and there are at most ``CAPACITY`` lengths, so the plan is made from that bounded table: a
bin starts with the longest length left, and a bitset subset-sum over the lengths that are left finds the
fullest completion. The bin found is repeated as often as the counts allow and then removed, which uses
up one length at least: there are at most ``CAPACITY`` different bins, whatever the number of documents.

Pieces get their place from their rank among the pieces of their length. Ranks are counted per input
partition and shifted by the counts of the partitions before, so a length that most pieces share isn't
sorted in one task.

Defined results: a null or empty text is one piece that holds the end token alone; equal lengths are
taken in the order of partition, id and piece; repeated rows are packed as often as they come; an empty
table gives no rows; further columns don't matter. Texts are tokenised word by word (white space
``[\\x20\\x09-\\x0D]`` always ends a token), and each distinct word once per cache, in which words are found by a
hash and compared byte by byte.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import FIRST_BYTES, LOWER, U64, Texts, text_chunks, written

CAPACITY = 4096
END_ID = 1
#: Distinct words whose tokens a worker keeps.
CACHED_WORDS = 1_500_000


#: Punctuation that, after a letter or digit, begins a token of its own whatever follows in the word.
TAIL = np.zeros(256, bool)
TAIL[list(b".,;:!?")] = True
#: Words of these letters alone are one run of letters to the tokenizer, before and after its normalisation.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Words that are tokenised in one text.
TOGETHER = 500


def split_tails(data: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with punctuation after their last letter or digit become two, where that can't change the tokens."""
    cut = end.copy()
    for _ in range(4):
        cut -= (cut > start) & TAIL[data[np.maximum(cut - 1, 0)]]
    last, before = data[np.maximum(cut - 1, 0)], data[np.maximum(cut - 2, 0)]
    ascii_letter = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 48) & (last <= 57)
    latin_letter = (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (cut - 1 > start)
    tail = (cut > start) & (cut < end) & ~TAIL[last] & (ascii_letter | latin_letter)
    if not tail.any():
        return start, end, of
    copies = 1 + tail
    at = np.cumsum(copies) - copies
    start2, end2 = np.repeat(start, copies), np.repeat(end, copies)
    end2[at[tail]] = cut[tail]
    start2[at[tail] + 1] = cut[tail]
    return start2, end2, np.repeat(of, copies)


class WordTokens:
    """The token ids of words, each distinct one tokenised once until the cache is full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known, self.at = np.zeros(0, U64), np.zeros(0, np.int32)  # sorted hashes, and where their words stand
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.counts, self.words = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0
        self.bytes, self.bytes_used = np.zeros(1 << 18, np.uint8), 0  # the words' own bytes, which a hit is compared with
        self.begins, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _keep_bytes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, places: np.ndarray) -> None:
        size = end - start
        before = np.cumsum(size) - size
        own = LOWER[data[np.repeat(start - before, size) + np.arange(int(size.sum()))]]
        while self.bytes_used + len(own) + 16 > len(self.bytes):
            self.bytes = np.concatenate((self.bytes, np.zeros_like(self.bytes)))
        while self.words > len(self.begins):
            self.begins, self.lengths = np.concatenate((self.begins, np.zeros_like(self.begins))), np.concatenate((self.lengths, np.zeros_like(self.lengths)))
        self.bytes[self.bytes_used : self.bytes_used + len(own)] = own
        self.begins[places], self.lengths[places] = self.bytes_used + before, size
        self.bytes_used += len(own)

    def _are(self, texts: Texts, start: np.ndarray, end: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which words have the bytes of the kept words at these places."""
        here, kept = texts.lanes(lower=True), np.ndarray(len(self.bytes) - 8, "<u8", self.bytes, strides=(1,))
        equal = self.lengths[places] == end - start
        rows, k = np.flatnonzero(equal), 0
        while len(rows):
            left = end[rows] - start[rows] - k
            differ = (here[start[rows] + k] ^ kept[self.begins[places[rows]] + k]) & FIRST_BYTES[np.minimum(left, 8)]
            equal[rows[differ != 0]] = False
            k += 8
            rows = rows[(left > 8) & (differ == 0)]
        return equal

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keep the ids of some words, one after another; where these words stand."""
        n, stop = self.words, self.words + len(sizes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while stop > len(self.starts):
            self.starts, self.counts = np.concatenate((self.starts, np.zeros_like(self.starts))), np.concatenate((self.counts, np.zeros_like(self.counts)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.counts[n:stop] = sizes
        self.starts[n:stop] = self.used + np.cumsum(sizes) - sizes
        self.used, self.words = self.used + len(ids), stop
        return np.arange(n, stop)

    def _add(self, words: list[str]) -> np.ndarray:
        """Where each of these words stands from now on.

        Plain words go many to a text: each ends with the one token that closes a word.
        """
        place = np.zeros(len(words), np.int32)
        plain = [k for k, w in enumerate(words) if PLAIN.fullmatch(w)]
        rest = sorted(set(range(len(words))).difference(plain))
        texts = [" ".join(words[k] for k in plain[i : i + TOGETHER]) for i in range(0, len(plain), TOGETHER)]
        for i, found in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            own = plain[i * TOGETHER : (i + 1) * TOGETHER]
            ids = np.array(found.ids, np.uint32)
            closed = np.flatnonzero(self.ends[ids]) + 1
            if len(closed) == len(own) and closed[-1] == len(ids):
                place[own] = self._store(ids, np.diff(closed, prepend=0))
            else:
                rest += own
        found = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        place[rest] = self._store(np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes)
        return place

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of the texts, one after another, and where each text's ids start."""
        start, end, of = split_tails(texts.data, *texts.words())
        distinct, first, which = texts.distinct(start, end, 7, lower=True)  # the tokenizer lowers letters itself
        if len(self.known) + len(distinct) > CACHED_WORDS:
            self.clear()
        slot = np.searchsorted(self.known, distinct)
        hit = slot < len(self.known)
        hit[hit] = self.known[slot[hit]] == distinct[hit]
        place = np.zeros(len(distinct), np.int64)
        place[hit] = self.at[slot[hit]]
        fine = hit.copy()
        fine[hit] = self._are(texts, start[first[hit]], end[first[hit]], place[hit])
        new = np.flatnonzero(~fine)
        raw = texts.data.tobytes()
        for k in range(0, len(new), 4096):
            own = first[new[k : k + 4096]]
            place[new[k : k + 4096]] = self._add([raw[start[i] : end[i]].decode("utf-8", "replace") for i in own])
            self._keep_bytes(texts.data, start[own], end[own], place[new[k : k + 4096]])
        unknown = np.flatnonzero(~hit)  # a word with another's hash isn't remembered
        if len(unknown):
            self.at = np.insert(self.at, slot[unknown], place[unknown])
            self.known = np.insert(self.known, slot[unknown], distinct[unknown])
        index = place[which]
        sizes = self.counts[index].astype(np.int64)
        before = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(self.starts[index] - before, sizes) + np.arange(int(sizes.sum()))]
        per_text = np.bincount(of, weights=sizes, minlength=texts.n).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_text)))


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for each Python worker, which keeps its words from task to task."""
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and the ids)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokens(tokenizer_path)
        for batch in batches:
            for texts in text_chunks(batch.column(1)):
                ids, starts = coder.encode(texts)
                of, piece, at, length, crc, lists = [], [], [], [], [], []
                for k in range(texts.n):
                    own = np.append(ids[starts[k] : starts[k + 1]], np.uint32(END_ID)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), CAPACITY)):
                        part = own[s : s + CAPACITY]
                        of.append(texts.first + k)
                        piece.append(p)
                        at.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            lists.append(part.astype(np.int32))
                out = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(lists, pa.list_(pa.int32()))] if with_ids else out, [*names, "ids"] if with_ids else names)

    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fullest(counts: Counter, room: int) -> list[int]:
    """Lengths whose sum is the largest that fits in ``room``, by bitset subset-sum."""
    reach, mask, items = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            copies = min(copies, left)
            added = (reach << (length * copies)) & mask & ~reach
            if added:
                items.append((length, copies, added))
                reach |= added
            left, copies = left - copies, copies * 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, []
    for length, copies, added in reversed(items):
        if added >> at & 1:
            taken += [length] * copies
            at -= length * copies
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, times), minimum slack first, until all pieces are used."""
    left, bins = Counter({k: v for k, v in counts.items() if v}), []
    while left:
        seed = max(left)
        left[seed] -= 1
        rest = fullest(left, capacity - seed) if capacity > seed else []
        left[seed] += 1
        own = Counter([seed, *rest])
        times = min(left[x] // n for x, n in own.items())
        bins.append(([seed, *rest], times))
        for x, n in own.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return bins


def _places(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (key of the first rank, ranks a bin, first bin, offset), sorted; a key is length and rank."""
    used: Counter = Counter()
    rows, first_bin = [], 0
    for lengths, times in bins:
        offset = 0
        for length, n in sorted(Counter(lengths).items(), reverse=True):
            rows.append(((length << 44) + used[length], n, first_bin, offset))
            used[length] += n * times
            offset += length * n
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    table = written(pieces(docs, tokenizer_path, id_col, text_col).withColumn("part", F.spark_partition_id()), "pieces")
    per_part = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most CAPACITY rows
    shared = docs.sparkSession.sparkContext.broadcast(_places(plan(counts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = table.withColumn("rank", F.row_number().over(Window.partitionBy("part", "length").orderBy("id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(shift, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = places[np.searchsorted(places[:, 0], (length << 44) + rank, "right") - 1]
            into = (length << 44) + rank - own[:, 0]
            out = [pa.array(own[:, 2] + into // own[:, 1]), pa.array(own[:, 3] + into % own[:, 1] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *out], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = table.schema["id"].dataType.simpleString()
    done = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return done.withColumnRenamed("id", id_col)
