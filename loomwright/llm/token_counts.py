"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form one trie; pieces that begin with a space start a word and all others go on
from a second root. Every node knows where to go on when no edge fits (its failure link) and how many
pieces are then complete (its pops). A word is read once, byte by byte, and the pops on the way add up to
the number of pieces of greedy longest-match-first splitting; the pieces are never built.

A word is ``[^\\x20\\x09-\\x0D]+`` with one space before it. Where all single bytes are pieces, every word
can be split; a text with a word that the vocabulary can't split has no count (null). The automaton's size is
that of the vocabulary. Distinct words are counted once per cache, which knows them by their bytes.

Defined results: a null or empty text has no words and no tokens; repeated rows get equal counts; an
empty table gives no rows; further columns don't matter; a very long word is still read once.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import text_chunks

#: Distinct words that a task keeps, and the longest one it keeps.
CACHED_WORDS, CACHED_BYTES = 500_000, 200


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a rank file: base64 and rank on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """Trie with failure links and popped-piece counts. Node 0 starts a word, node 1 goes on in it."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.edges: dict[int, int] = {}
        parents, ends = [(-1, 0), (-1, 0)], set()
        for piece in vocabulary:
            node = 0 if piece[:1] == b" " else 1
            for byte in piece:
                nxt = self.edges.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.edges[node << 8 | byte] = len(parents)
                    parents.append((node, byte))
                node = nxt
            if piece:
                ends.add(node)
        children: list[list[int]] = [[] for _ in parents]
        for node in range(2, len(parents)):
            children[parents[node][0]].append(node)
        self.fail, self.pops = [-1] * len(parents), [0] * len(parents)
        queue = deque([*children[0], *children[1]])
        while queue:
            node = queue.popleft()
            queue.extend(children[node])
            if node in ends:
                self.fail[node], self.pops[node] = 1, 1
                continue
            parent, byte = parents[node]
            at, n = self.fail[parent], self.pops[parent]
            while at >= 0 and at << 8 | byte not in self.edges:
                at, n = self.fail[at], n + self.pops[at]
            if at >= 0:
                self.fail[node], self.pops[node] = self.edges[at << 8 | byte], n

    def count(self, word: bytes) -> int:
        """Pieces of a word (which begins with a space); -1 if the vocabulary can't split it."""
        edges, fail, pops, node, n = self.edges, self.fail, self.pops, 0, 0
        for byte in word:
            nxt = edges.get(node << 8 | byte)
            while nxt is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
                nxt = edges.get(node << 8 | byte)
            node = nxt
        while node != 1:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return -1
        return n


def token_counts(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_tokens."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(LongestMatch(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = shared.value, {}
        for batch in batches:
            words, tokens, split = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
            for texts in text_chunks(batch.column(1)):
                start, end, of = texts.words()
                _, first, which = texts.distinct(start, end, 8)
                if len(known) + len(first) > CACHED_WORDS:
                    known.clear()
                raw, counts = texts.data.tobytes(), np.zeros(len(first), np.int64)
                for k, (a, b) in enumerate(zip(start[first].tolist(), end[first].tolist(), strict=True)):
                    word = raw[a:b]
                    n = known.get(word)
                    if n is None:
                        n = automaton.count(b" " + word)
                        if b - a <= CACHED_BYTES:
                            known[word] = n
                    counts[k] = n
                count = counts[which]
                own = slice(texts.first, texts.first + texts.n)
                words[own] = np.bincount(of, minlength=texts.n)
                tokens[own] = np.bincount(of, weights=np.maximum(count, 0), minlength=texts.n)
                split[own] &= np.bincount(of, weights=count < 0, minlength=texts.n) == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens, mask=~split)], ["id", "n_words", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
