"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one kept per group.

Equal vectors are one class from the start. Centroids are fitted on at most about ``SAMPLE`` classes chosen
by a hash, then every class is assigned to the ``NEAREST`` cells whose centroids are closest, so that a near
pair on either side of a border still shares a cell; the smallest common cell counts it. A cell is cut
into blocks of about ``BLOCK`` classes and every pair of blocks is a group of its own: one matrix product
in double precision, with bounded memory however many vectors a cell holds. A block pair returns a row per
linked class (its links, and the smallest id its links lead to), never the pairs.

The number of cells grows with the classes up to ``MOST_CELLS``, which bounds the centroids that are sent
out; beyond that the work in a cell grows with its size. Recall against brute force is measured in tests.

With ``exact`` no link is lost: a class goes to its nearest cell p and to every cell q that may be the nearest of a
vector v linked with it. As v is no nearer to p than to q, a class x at a chord d or less from v has
x (p - q) <= d |p - q|; cells beyond that are left out. A pair is counted in the smaller of its two nearest cells, where
both are. Where vectors aren't clustered, few cells can be left out, and the work is that of all pairs, in blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; so do vectors of different lengths; equal vectors (repeated rows too) link with each other; a
null id can't name a group; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import columns_of, written
from loomwright.llm.components import components

SAMPLE = 20_000
PER_CELL = 500
MOST_CELLS = 4096
NEAREST = 5
BLOCK = 1536
#: Rows of a batch that goes out.
COPIES = 10_000
ROUNDS = 8


def unit_rows(column: pa.ListArray) -> np.ndarray:
    """The vectors of a batch (all of one length) as unit rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    # Scaled by the largest component first, so that squares can't overflow or vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids. Starts from evenly spaced rows; empty cells restart at the row that fits worst."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = x @ centres.T
        cell, fit = near.argmax(1), near.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        size = np.sqrt((sums * sums).sum(1))
        lost = np.flatnonzero(size < 1e-12)
        if len(lost):
            sums[lost] = x[np.argsort(fit)[: len(lost)]]
            size[lost] = 1.0
        centres = sums / size[:, None]
    return centres


def near_cells(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest cells of each unit row, in ascending order."""
    return np.sort(np.argsort(-(x @ centres.T), axis=1)[:, : min(NEAREST, len(centres))], axis=1)


def possible_cells(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest cell of each unit row; then (row, cell) for all cells that may be the nearest of a row linked with it."""
    fit = x @ centres.T
    home = fit.argmax(1)
    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * centres @ centres.T))
    chord = np.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-7
    row, cell = np.nonzero(fit[np.arange(len(x)), home][:, None] - fit <= chord * apart[home] + 1e-7)
    return home, row, cell


def _assigned(classes: DataFrame, centres: dict[int, np.ndarray], threshold: float, exact: bool) -> DataFrame:
    """A row per class and cell: cell (length and number), node, n, embedding, and the class's cells (with ``exact`` the nearest one only)."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)
    schema = classes.schema
    kinds = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in ("node", "n", "embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            vectors = batch.column("embedding")
            lengths = np.diff(vectors.offsets.to_numpy())
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                part = batch.take(pa.array(rows))
                own = centres.get(int(length))
                x = None if own is None else unit_rows(part.column("embedding"))
                if own is None:
                    lists = np.zeros((len(rows), 1), np.int64)
                    row, cell = np.arange(len(rows)), lists[:, 0]
                elif exact:
                    home, row, cell = possible_cells(x, own, threshold)
                    lists = home[:, None]
                else:
                    lists = near_cells(x, own)
                    row, cell = np.repeat(np.arange(len(rows)), lists.shape[1]), lists.ravel()
                for k in range(0, len(row), COPIES):  # a row may go to many cells
                    copies = part.take(pa.array(row[k : k + COPIES]))
                    cells = pa.array(list(lists[row[k : k + COPIES]].astype(np.int32)), pa.list_(pa.int32()))
                    arrays = [pa.array(np.full(copies.num_rows, length, np.int32)), pa.array(cell[k : k + COPIES].astype(np.int32)), *[copies.column(c) for c in ("node", "n", "embedding")], cells]
                    yield pa.RecordBatch.from_arrays(arrays, ["dim", "cell", "node", "n", "embedding", "cells"])

    return classes.select("node", "n", "embedding").mapInArrow(run, f"dim int, cell int, {kinds}, cells array<int>")


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest cell in both of each pair of lists."""
    found = np.full(len(a), np.iinfo(np.int32).max, np.int32)
    for k in range(a.shape[1]):
        hit = (a[:, k : k + 1] == b).any(1)
        found = np.where(hit, np.minimum(found, a[:, k]), found)
    return found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack(column.to_numpy())


def block_links(table: pa.Table, threshold: float, exact: bool = False) -> pa.Table:
    """The links between the two blocks of a group (or in its one block): node, links, least."""
    own = table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
    side = table.column("side").to_numpy()
    node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
    x = unit_rows(table.column("embedding").combine_chunks())
    cells, cell = _matrix(table.column("cells")), table.column("cell")[0].as_py()
    a, b = (np.arange(len(node)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    i, j = np.nonzero(x[a] @ x[b].T >= threshold)
    i, j = a[i], b[j]
    if own:
        i, j = i[i < j], j[i < j]
    links = np.zeros(len(node), np.int64)
    for k in range(0, len(i), 1 << 18):
        p, q = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
        here = (np.minimum(cells[p, 0], cells[q, 0]) if exact else _first_common(cells[p], cells[q])) == cell
        np.add.at(links, p[here], n[q[here]])
        np.add.at(links, q[here], n[p[here]])
    least = node.copy()
    while len(i):
        before = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        if (before == least).all():
            break
    keep = (links > 0) | (least != node)
    return pa.table({"node": node[keep], "links": links[keep], "least": least[keep]})


def near_groups(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept. With ``exact`` no link is missed, at a price that depends on the vectors."""
    rows = columns_of(vectors, id_col, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.coalesce((F.size("embedding") > 0) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(fine)
    classes = written(good.groupBy("embedding").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "classes")
    named = classes.where("node is not null")
    sizes = {r["d"]: r["n"] for r in named.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    centres = {}
    for length, n in sizes.items():
        k = min(MOST_CELLS, n // PER_CELL)
        if k > 1:
            share = min(1.0, max(SAMPLE, 8 * k) / n)
            sample = named.where((F.size("embedding") == length) & (F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < share * 1_000_000)).orderBy(F.xxhash64("node"), "node")
            centres[length] = spherical_kmeans(unit_rows(sample.select("embedding").toArrow().column(0).combine_chunks()), k)
    placed = written(_assigned(named, centres, threshold, exact), "cells")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cut = placed.join(F.broadcast(sizes), ["dim", "cell"])  # a row per cell: at most MOST_CELLS for each length of vectors
    cut = cut.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    cut = cut.select("dim", "cell", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "n", "embedding", "cells")
    found = written(cut.groupBy("dim", "cell", "bi", "bj").applyInArrow(lambda t: block_links(t, threshold, exact), "node long, links long, least long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select("node", "least"), "node", "least")
    per_class = classes.join(links, "node", "left").join(labels, "node", "left").select(
        F.col("embedding").alias("e"), "node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component")
    )
    done = rows.withColumn("key", F.when(fine, F.col("embedding"))).join(per_class, F.col("key") == F.col("e"), "left")
    component = F.coalesce("component", "id")
    return done.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
