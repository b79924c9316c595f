"""Exact neighbours of sparse vectors, and the query on them, against brute force."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from loomwright.operators import lineage, neighbours


def _sparse(rng, n: int, width: int) -> np.ndarray:
    """Three languages with columns of their own and some in common; exact and near copies, and rows of one column."""
    x = np.zeros((n, width))
    for i in range(n):
        part = np.r_[np.arange(i % 3 * width // 4, (i % 3 + 1) * width // 4), np.arange(3 * width // 4, width)]
        cols = rng.choice(part, rng.integers(1, 12), replace=False)
        x[i, cols] = rng.integers(1, 5, len(cols))
    x[10:40] = x[10]
    x[40:60] = x[40]
    x[np.arange(40, 60), rng.integers(0, width, 20)] += 0.001
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _wanted(x: np.ndarray, ids: list[int], k: int) -> dict[tuple[int, int], tuple[int, float]]:
    score = np.round(x @ x.T, 12)
    out = {}
    for i, a in enumerate(ids):
        near = sorted((-score[i, j], b) for j, b in enumerate(ids) if b != a and score[i, j] > 1e-12)[:k]
        out |= {(a, p + 1): (b, -s) for p, (s, b) in enumerate(near)}
    return out


@pytest.mark.parametrize(("chunk", "tile"), [(65536, 2048), (60, 16)])
def test_sparse_neighbours_by_brute_force(spark, monkeypatch, chunk, tile):
    """several rounds give what one gives, equal vectors among them, and what stays in the shared folder doesn't grow with rounds."""
    x = _sparse(np.random.default_rng(5), 400, 48)
    ids = [7 * i % 1009 + 1 for i in range(len(x))]
    rows = spark.createDataFrame([(a, np.flatnonzero(v).tolist(), v[v > 0].tolist()) for a, v in zip(ids, x, strict=True)] + [(None, [0], [1.0])], "id long, index array<int>, value array<double>")
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    size = lambda: sum(p.stat().st_size for p in Path(lineage.shared_folder(spark).removeprefix("file://")).rglob("*.parquet"))
    before = size()
    found = neighbours.nearest_sparse(rows, 3, 48)
    assert size() - before < 600_000
    got, want = {(r["left_id"], r["place"]): (r["right_id"], r["score"]) for r in found.collect()}, _wanted(x, ids, 3)
    assert got.keys() == want.keys()
    assert all(abs(got[q][1] - want[q][1]) < 1e-9 for q in want)
    assert np.mean([got[q][0] == want[q][0] for q in want]) > 0.99  # the last digit of a sum may decide a tie
    monkeypatch.setattr(neighbours, "TILE", tile)
    _, _, to = neighbours._directions(x)
    table = neighbours.pa.table({"id": ids, "grp": [0] * len(x), "ix": [np.flatnonzero(v).astype("<u4").tobytes() for v in x], "v": [v[v > 0].tobytes() for v in x], "near": [np.append(v @ to, np.sqrt(max(0, 1 - ((v @ to) ** 2).sum()) + 1e-12)).astype("<f4").tobytes() for v in x]})
    a = neighbours.Rows(table)
    none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    row, score, _ = neighbours.search(a, np.arange(len(x)), a, 4, 48, none)
    best = -np.sort(-np.round(x @ x.T, 12), axis=1)[:, :4]
    assert np.array_equal(np.bincount(row, minlength=len(x)), np.full(len(x), 4)) and np.abs(score.reshape(-1, 4) - best).max() < 1e-9


def test_no_rows_have_no_neighbours(spark):
    assert neighbours.nearest_sparse(spark.createDataFrame([], "id long, index array<int>, value array<double>"), 3, 8).collect() == []


def test_sets_bound_all_pairs_and_pass_few():
    """the bound by sets of columns never falls below a product, and passes few pairs where texts have rare words."""
    rng = np.random.default_rng(3)
    x = np.zeros((600, 500))
    for v in x:
        cols = np.unique(np.minimum(rng.zipf(1.3, 60), 500) - 1)
        v[cols] = rng.integers(1, 4, len(cols)) * (1 + np.log(cols + 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    none = [0] * len(x)
    places = neighbours._places(x, np.array(none), np.array([0]))
    table = neighbours.pa.table({"id": range(len(x)), "grp": none, "ix": [np.flatnonzero(v).astype("<u4").tobytes() for v in x], "v": [v[v > 0].tobytes() for v in x], "near": [np.ones(1, "<f4").tobytes()] * len(x)})
    sets = neighbours.Rows(table).bounded(np.arange(len(x)), places[0])
    assert sets.shape[1] < 400
    score, bound = x @ x.T, sets @ sets.T
    assert (bound >= score - 1e-5).all()
    low = -np.partition(-score, 4, axis=1)[:, 4]
    assert (bound >= low[:, None]).mean() < 0.1


def test_texts_by_their_words(spark, tmp_path):
    """the query on missing and repeated ids, missing and empty texts, and odd white space and letters in URLs, by its SQL."""
    import duckdb

    from loomwright.plans import vectors

    rng = np.random.default_rng(4)
    some = ["the", "Cat", "É'tude", "NIÑO", "x_1", "a", "ÀB", "Kab", "http", "www", "ſun", "dog#2", "@me", "ou", "le"]
    odd = ["http://a.b cat dog", "www.x the cat", "```the\ncat``` dog", "https://é.f\x0bcat le", "``` open cat", "İx cat"]
    rows = [(i if i % 11 else (None if i % 2 else 5), None if i % 17 == 3 else " ".join(rng.choice(some, rng.integers(0, 9))) + rng.choice(["", *odd])) for i in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    order = lambda r: (r[0], r[2])
    got = sorted((tuple(r) for r in vectors.tfidf_knn(spark, str(tmp_path)).collect()), key=order)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    from loomwright.plans import registry

    want = sorted(con.execute(registry.oracle_sql()["tfidf_knn"]).fetchall(), key=order)
    assert len(want) > 400 and [(r[0], r[2]) for r in got] == [(r[0], r[2]) for r in want]
    assert max(abs(g[1] - w[1]) for g, w in zip(got, want, strict=True)) < 2e-6
