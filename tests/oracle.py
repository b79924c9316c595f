"""Compare a query with its SQL in DuckDB, values only, whatever the order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    """Numbers as floats, nulls as a mark, lists as tuples, all else as text."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, str):
        return v
    try:
        return float(v)
    except (TypeError, ValueError):
        return str(v).replace("+00:00", "")


def rows(records: list[dict]) -> list[tuple]:
    """Sorted by what is exact first, then by the numbers."""
    flat = [tuple(_plain(r[k]) for k in sorted(r)) for r in records]
    whole = lambda v: not isinstance(v, float) or v == int(v) and abs(v) < 1e15
    return sorted(flat, key=lambda r: (tuple(str(v) for v in r if whole(v)), tuple(f"{v:.4g}" for v in r if not whole(v))))


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def compare(df, sql: str, c: duckdb.DuckDBPyConnection) -> None:
    got = [r.asDict(True) for r in df.collect()]
    result = c.execute(sql)
    names = [d[0] for d in result.description]
    want = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if not same(a, b)]
    assert not wrong, wrong[:3]
