"""Operators against numpy, exhaustive search or small fixed cases."""

from __future__ import annotations

import json
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import diffusion, graphs, intervention, memetics, pragmatics, sampling, stats, threads, vectors

EDGES = [("a", "b", 2.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "d", 4.0), ("a", "a", 1.0), ("e", "c", 1.0), ("d", "f", 1.0)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, weight double")


def test_pagerank_is_numpys(edges):
    got = {r["node"]: r["rank"] for r in graphs.pagerank(edges).collect()}
    names = sorted({x for e in EDGES for x in e[:2]})
    m = np.zeros((6, 6))
    for a, b, w in EDGES:
        m[names.index(a), names.index(b)] += w
    out = m.sum(1)
    r = np.full(6, 1 / 6)
    for _ in range(200):
        flow = (r[:, None] * np.divide(m, out[:, None], out=np.zeros_like(m), where=out[:, None] > 0)).sum(0)
        r = 0.85 * (flow + r[out == 0].sum() / 6) + 0.15 / 6
    assert sum(got.values()) == pytest.approx(1)
    assert [got[n] for n in names] == pytest.approx(r, abs=1e-5)


def test_betweenness_counts_shortest_paths(edges):
    got = {r["node"]: r["betweenness"] for r in graphs.betweenness(edges).collect()}
    names = sorted(got)
    dist = {(a, b): (0.0 if a == b else math.inf) for a in names for b in names}
    for a, b, w in EDGES:
        dist[a, b] = min(dist[a, b], w) if a != b else 0.0
    for k, a, b in itertools.product(names, repeat=3):
        dist[a, b] = min(dist[a, b], dist[a, k] + dist[k, b])
    # In this graph shortest paths are unique.
    want = {v: sum(a != v != b and a != b and dist[a, b] < math.inf and dist[a, v] + dist[v, b] == dist[a, b] for a in names for b in names) / 20 for v in names}
    assert got == pytest.approx(want)


def test_reciprocity_and_degrees(edges):
    r = graphs.reciprocity(edges).first()
    assert (r["edges"], r["nodes"]) == (6, 6) and r["reciprocity"] == pytest.approx(2 / 6)
    d = {x["node"]: (x["in_degree"], x["out_degree"]) for x in graphs.degrees(edges).collect()}
    assert d["a"] == (2.0, 3.0) and d["f"] == (1.0, 0.0)


def test_communities_split_two_cliques(spark):
    rows = [(a, b, 1.0) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("a", "w", 1.0)]
    got = {r["node"]: r["community"] for r in graphs.communities(spark.createDataFrame(rows, "src string, dst string, weight double")).collect()}
    assert len({got[x] for x in "abcd"}) == len({got[x] for x in "wxyz"}) == 1 and got["a"] != got["w"]


def test_kleinberg_is_the_cheapest_path():
    rng = np.random.default_rng(5)
    for _ in range(20):
        c = rng.poisson([1, 1, 6, 6, 1, 1])
        if not c.sum():
            continue
        base = c.mean()
        k = max(1, int(math.log(c.max() / base + 1e-9, 2)) + 1)
        rates = [base * 2**i for i in range(k + 1)]
        cost = lambda p: sum(rates[i] - x * math.log(rates[i] + 1e-12) + math.lgamma(x + 1) for i, x in zip(p, c, strict=True)) + sum(abs(a - b) for a, b in itertools.pairwise(p))  # noqa: B023, E731
        best = min(itertools.product(range(k + 1), repeat=6), key=cost)
        spans, start = [], None
        for t, level in enumerate([*best, 0]):
            if level and start is None:
                start = t
            elif not level and start is not None:
                spans.append((start, t - 1, best[start]))
                start = None
        assert memetics.kleinberg(c) == spans
    assert memetics.kleinberg(np.zeros(4)) == [] and memetics.kleinberg(np.array([])) == []


def test_hawkes_is_nnls(spark):
    rng = np.random.default_rng(2)
    counts = rng.poisson(3, 60)
    df = spark.createDataFrame([("m", i, int(c)) for i, c in enumerate(counts)], "meme string, h int, count int").select("meme", F.timestamp_seconds(F.col("h") * 3600).alias("hour"), "count")
    got = memetics.hawkes(df, "meme").first()
    best = None
    for decay in memetics.DECAYS:
        x = np.array([sum(decay ** (k - 1) * counts[t - k] for k in range(1, min(24, t) + 1)) for t in range(60)])
        fits = [(counts.mean(), 0.0), (0.0, max(0.0, (x @ counts) / (x @ x)))]
        full = np.linalg.lstsq(np.c_[np.ones(60), x], counts, rcond=None)[0]
        mu, alpha = full if (full >= 0).all() else min(fits, key=lambda f: ((f[0] + f[1] * x - counts) ** 2).sum())  # noqa: B023
        lam = np.maximum(mu + alpha * x, 1e-8)
        ll = sum(c * math.log(y) - y - math.lgamma(c + 1) for c, y in zip(counts, lam, strict=True))
        if best is None or ll > best[0]:
            best = (ll, mu, alpha, decay)
    assert (got["loglik"], got["mu"], got["alpha"], got["decay"]) == pytest.approx(best)


def test_survival(spark):
    rows = {r["hours"]: (r["survival"], r["hazard"]) for r in memetics.survival(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,), (0.0,)], "d double"), "d").collect()}
    assert rows[1.0] == pytest.approx((0.75, 0.25)) and rows[2.0] == pytest.approx((0.25, 0.25 + 1 / 3 + 1 / 2)) and rows[5.0][0] == 0.0


def test_burst_of_a_step_and_a_constant(spark):
    rows = [("2024-01-01", "flat", 2.0), ("2024-01-02", "flat", 2.0), ("2024-01-03", "flat", 2.0), ("2024-01-02", "step", 9.0)]
    s = spark.createDataFrame(rows, "date string, ngram string, count double").withColumn("date", F.to_date("date"))
    got = {r["ngram"]: r for r in memetics.burst_scores(s).collect()}
    assert got["flat"]["burst"] == 0 and got["flat"]["std"] is None and got["flat"]["max_day"] == "2024-01-01"
    assert got["step"]["burst"] == pytest.approx(6 / np.std([0, 9, 0], ddof=1)) and got["step"]["max_day"] == "2024-01-02"


def test_principal_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)) @ np.array([[2, 1, 0], [0, 1, 0], [0, 0, 0.1]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    got = np.array([(r["pc1"], r["pc2"]) for r in vectors.principal_components(df, "id", ["a", "b", "c"]).orderBy("id").collect()])
    z = (x - x.mean(0)) / x.std(0)
    values, axes = np.linalg.eigh(np.cov(z.T))
    want = z @ axes[:, np.argsort(-values)[:2]]
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-8)


def test_nearest_with_zero_and_equal_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, [0.0, 0.0]), (4, 0, [0.6, 0.8]), (5, 1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, part int, vector array<double>")
    got = {(r["left_id"], r["place"]): (r["right_id"], r["score"]) for r in vectors.nearest(df, df, 2, "part").collect()}
    assert got[1, 1] == (2, 1.0) and got[1, 2] == (4, 0.6) and (3, 1) not in got and (5, 1) not in got
    assert got[4, 1] == (1, 0.6) and got[4, 2] == (2, 0.6)


def test_auc(spark):
    rng = np.random.default_rng(3)
    rows = [(float(s), bool(p)) for s, p in zip(rng.integers(0, 6, 80), rng.integers(0, 2, 80), strict=True)]
    got = stats.auc(spark.createDataFrame(rows, "s double, p boolean"), "s", "p").first()["auc"]
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    assert got == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
    same = [(float(s), p) for s in range(5) for p in (True, False)]
    assert stats.auc(spark.createDataFrame(same, "s double, p boolean"), "s", "p").first()["auc"] == 0.5


def test_gini(spark):
    values = [0.0, 1.0, 1.0, 4.0, 10.0]
    r = stats.gini_and_shares(spark.createDataFrame([(v,) for v in values], "v double"), "v", (1, 2)).first()
    want = 2 * sum((i + 1) * v for i, v in enumerate(values)) / (5 * 16) - 6 / 5
    assert (r["gini"], r["top1_share"], r["top2_share"]) == pytest.approx((want, 10 / 16, 14 / 16))


def test_null_keys_meet_in_the_outer_join(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, p int")
    b = spark.createDataFrame([(None, 5), ("y", 6)], "k string, q int")
    assert sorted([tuple(r) for r in stats.null_safe_full_join(a, b, "k").collect()], key=str) == sorted([("x", 1, 0), (None, 2, 5), ("y", 0, 6)], key=str)


def test_ancestors_stop_on_cycles_and_skip_blanks(spark):
    rows = [("a", None, "A"), ("b", "a", " "), ("c", "b", "C"), ("d", "c", "D"), ("x", "y", "X"), ("y", "x", "Y")]
    got = {r["id"]: r["chain"] for r in threads.ancestors(spark.createDataFrame(rows, "id string, parent_id string, text string"), 2).collect()}
    assert got == {"a": [], "b": ["A"], "c": ["A"], "d": ["C", "A"], "x": ["Y"], "y": ["X"]}


def test_mad_alerts(spark):
    rows = [("c", i, v) for i, v in enumerate([1.0, 1.1, 0.9, 1.0, 1.05, 9.0])] + [("f", i, 2.0) for i in range(3)] + [("f", 3, 9.0)]
    df = spark.createDataFrame(rows, "community string, i int, m double").withColumn("window_start", F.timestamp_seconds("i"))
    got = [(r["community"], r["i"]) for r in pragmatics.alerts(df, "community", ["m"]).where("alert_m").collect()]
    assert got == [("c", 5)]


def test_windows_are_anchored_and_first_delta_is_zero(spark):
    days = [0, 6, 7, 40, 45]
    df = spark.createDataFrame([("c", d) for d in days], "community string, d int").withColumn("ts", F.timestamp_seconds(F.lit(1704103200) + F.col("d") * 86400))
    got = [(r["k"], r["n"]) for r in pragmatics.windows(df, "community", "ts").groupBy(((F.unix_seconds("window_start") - 1704103200) / 86400).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect()]
    want = [(k, sum(k <= d < k + 30 for d in days)) for k in range(0, 46, 7)]
    assert got == [w for w in want if w[1]]


def test_run_times_and_drift(spark):
    rows = [("20240101T000000Z", 301), ("20240102T000000Z", 86400 + 5), ("bad", 10)]
    df = spark.createDataFrame(rows, "run_id string, s int").select("run_id", F.timestamp_seconds(F.lit(1704067200) + F.col("s")).alias("run_time"))
    created = spark.createDataFrame([(0,), (9_000_000,)], "s int").select(F.timestamp_seconds(F.lit(1704067200) + F.col("s")).alias("created"))
    got = {r["id"]: r["status"] for r in diffusion.temporal_checks(created, df).collect()}
    assert got == {"CHK-001": "PASS", "CHK-002": "PASS", "CHK-003": "PASS", "CHK-004": "PASS", "CHK-005": "PASS", "CHK-006": "WARN", "CHK-007": "WARN"}


def test_positions_cover_the_order(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.col("id") * 7919, F.lit(1000)))
    got = sampling.global_positions(df, [F.asc("v")]).select("v", "position").collect()
    assert sorted((r["v"], r["position"]) for r in got) == [(i, i) for i in range(1000)]
    assert sampling.evenly_spaced(df, [F.asc("v")], 11).count() == 11


def test_events_and_strict_reasons(spark):
    text = "follow @star now, first 100 followers get it. limited, the user asked my human"
    rows = [(i, f"a{i % 5}", f"c{i % 3}", text) for i in range(9)] + [(20, "z", "c0", "nothing here at all")]
    docs = spark.createDataFrame(rows, "doc_id long, author string, community string, text string").withColumn("created", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60))
    found = intervention.groups(intervention.candidates(intervention.scored(docs)))
    r = found.first()
    assert found.count() == 1 and (r["repeat_count"], r["unique_authors"], r["unique_communities"], r["likely_source"]) == (9, 5, 3, "campana_promocional")
    assert r["evidence_doc_ids"] == "0|1|2|3|4" and r["dominant_evidence"] == "humano_explicito"
    assert intervention.strict(found, coordination=0.4).first()["strict_reason"] == "promo|cta|human_refs|human_signal"


def test_pragmatic_scores_in_range_and_repeatable(spark):
    texts = ["please do this now", "I promise we commit", "this is true evidence shows", "thank you great love this", "maybe not sure please"] * 3
    df = spark.createDataFrame([(f"m{i}", "p1", None if i == 0 else f"m{i - 1}", i, t) for i, t in enumerate(texts)], "id string, post_id string, parent_id string, ord int, text string")
    a, terms = pragmatics.scored(df, min_df=1)
    b, _ = pragmatics.scored(df, min_df=1)
    assert sorted(a.collect()) == sorted(b.collect())
    for r in a.collect():
        assert all(0 <= r[d] <= 1 for d in ("certainty", "politeness", "irony", "confidence"))
    e = pragmatics.interactions(df, a, terms)
    assert e.count() == 14 and not e.where("weak_structure").count()
    p = pragmatics.posts(df, a, e).first()
    assert p["message_count"] == 15 and len(p["top_concerns"]) == 3


def test_hooks(spark):
    from loomwright.operators import hooks

    df = spark.createDataFrame([(1, "Alpha beta beta", "2024-01-01 10:20:00"), (2, "", "2024-01-01 10:50:00"), (3, None, None)], "id long, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    series = hooks.token_series(df, "text", "at", lambda t: F.split(F.lower(t), " ")).where("token = 'beta'").collect()
    assert [(str(r["hour"]), r["count"]) for r in series] == [("2024-01-01 10:00:00", 2)]
    hashed = {r["id"]: r["embedding"] for r in hooks.select_backend("hashed", size=8).encode(df, "text").collect()}
    assert abs(sum(v * v for v in hashed[1]) - 1) < 1e-6 and hashed[2] == hashed[3] == [0.0] * 8
    coded = {r["id"]: r["embedding"] for r in hooks.select_backend("encoder", encode=lambda ts: [[float(len(t)), 1.0] for t in ts], size=2).encode(df, "text").collect()}
    assert coded == {1: [24.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    scores = df.select(hooks.select_scorer("none", {})(F.col("text")).alias("s")).first()["s"]
    assert set(scores.values()) == {0.5} and hooks.select_scorer("own", {"own": F.length}) is F.length
    sizes = hooks.apply_to_groups(df, ["id"], lambda g: g[["id"]].assign(n=len(g)), "id long, n long")
    assert sizes.count() == 3


def test_flattened_replies(spark):
    from loomwright.operators import pairs

    nested = [{"id": "a", "replies": [{"id": "b", "replies": [{"id": "c"}]}, {"id": "d", "depth": 7, "thread_path": "x/y", "replies": [{"id": "e"}]}, "odd"]}, {"replies": [{"id": "f"}]}, {"id": "g", "parent_id": "z", "replies": None}]
    df = spark.createDataFrame([(9, json.dumps(nested)), (8, None), (None, json.dumps([{"id": "h"}]))], "post long, c string")
    got = {r["id"]: (r["post_id"], r["parent_id"], r["depth"], r["thread_path"]) for r in pairs.flattened_replies(df, "post", "c").collect()}
    assert got == {"a": (9, None, 0, "9/a"), "b": (9, "a", 1, "9/a/b"), "c": (9, "b", 2, "9/a/b/c"), "d": (9, "a", 7, "x/y"), "e": (9, "d", 2, "x/y/e"), None: (9, None, 0, "9"), "f": (9, None, 1, "9/f"), "g": (9, "z", 0, "9/g"), "h": (None, None, 0, "h")}


def test_greedy_pairs(spark):
    from loomwright.operators import pairs

    docs = spark.createDataFrame([(1, "s", "one text here"), (2, "s", "two texts here"), (3, "t", "three texts"), (4, "t", "One  text here"), (5, "u", "dropped place"), (6, "t", "x")], "id long, community string, excerpt string")
    rows = [(1, 2, 0.9, "en", 1), (2, 1, 0.9, "en", 1), (1, 3, 0.5, "en", 2), (4, 2, 0.95, "en", 1), (1, 4, 0.99, "en", 3), (3, 5, 0.8, "en", 1), (3, 6, 0.8, "en", 2), (2, 2, 1.0, "en", 4), (2, 3, 0.4, " ", 5), (3, 1, 0.5, "en", 3)]
    matches = spark.createDataFrame(rows, "a long, b long, score double, lang string, place int")
    best = pairs.top_candidates(matches, ["a", "place"], 0.1, 0.995, 100)
    assert [(r["a"], r["b"]) for r in best.collect()][:3] == [(1, 4), (4, 2), (2, 1)]
    described = pairs.described_pairs(best, docs, 5, ["u"])
    got = {(r["a"], r["b"]) for r in pairs.greedy_pairs(described, ["a", "place"], 10, 100).collect()}
    assert got == {(4, 2), (3, 1)}  # (1, 4) has one text twice; (1, 2) and (2, 1) have the texts of (4, 2); (1, 3) is (3, 1)
