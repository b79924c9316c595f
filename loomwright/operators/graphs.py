"""Weighted directed graphs as edge tables (src, dst, weight)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.lineage import cut

#: Betweenness needs the whole adjacency in a task; larger graphs are refused.
MOST_EDGES = 2_000_000


def weighted(edges: DataFrame, least: float = 0) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight")).where(F.col("weight") >= least)


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree (weighted)."""
    both = edges.select(F.col("src").alias("node"), F.lit(0.0).alias("i"), F.col("weight").alias("o")).union(edges.select("dst", "weight", F.lit(0.0)))
    return both.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and the share of edges (loops aside) whose reverse is there too."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("s"), F.col("src").alias("d"))
    hit = e.join(back, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left")
    r = hit.agg(F.count(F.lit(1)).alias("edges"), F.avg(F.col("s").isNotNull().cast("double")).alias("reciprocity"))
    n = edges.select("src").union(edges.select("dst")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    return r.crossJoin(F.broadcast(n))  # one row each


def pagerank(edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """node, rank: power iteration with weights; the mass of nodes without exits is spread evenly.

    Stops when the summed change is below tolerance times the number of nodes; the lineage is cut every
    few rounds.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    steps = cut(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    n = nodes.count()
    base = cut(nodes.join(total.select(F.col("src").alias("node"), F.lit(False).alias("dangles")), "node", "left").select("node", F.coalesce("dangles", F.lit(True)).alias("dangles")))
    ranks = base.select("node", F.lit(1.0 / n).alias("rank")) if n else base.select("node", F.lit(0.0).alias("rank"))
    for k in range(rounds if n else 0):
        lost = base.join(ranks, "node").agg(F.coalesce(F.sum(F.when(F.col("dangles"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        flow = steps.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("flow"))
        fresh = base.join(flow, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(lost))  # one row
        fresh = fresh.select("node", (alpha * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n).alias("rank"))
        if k % 5 == 4:
            fresh = cut(fresh)
            change = fresh.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).first()["d"]
            if change < n * tolerance:
                return fresh
        ranks = fresh
    return ranks


def betweenness(edges: DataFrame, sources: int = 200, seed: int = 42) -> DataFrame:
    """node, betweenness from a seeded sample of sources; weights are lengths. Sources are dealt to tasks."""
    spark = edges.sparkSession
    if edges.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        raise ValueError(f"betweenness takes at most {MOST_EDGES} edges")
    rows = edges.select("src", "dst", "weight").collect()  # bounded just above
    out: dict = defaultdict(list)
    for r in rows:
        out[r["src"]].append((r["dst"], r["weight"]))
    nodes = sorted({r["src"] for r in rows} | {r["dst"] for r in rows})
    shared = spark.sparkContext.broadcast((dict(out), nodes))
    kind = edges.schema["src"].dataType.simpleString()
    chosen = spark.createDataFrame([(x,) for x in nodes], f"node {kind}").orderBy(F.xxhash64(F.lit(seed), "node")).limit(sources)
    k = min(sources, len(nodes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq

        adjacency, names = shared.value
        score = dict.fromkeys(names, 0.0)
        for batch in batches:
            for s in batch["node"]:
                dist, paths, before, order, heap, seen = {}, defaultdict(float), defaultdict(list), [], [(0.0, 0, s, s)], {s: 0.0}
                paths[s], tick = 1.0, 0
                while heap:
                    d, _, via, v = heapq.heappop(heap)
                    if v in dist:
                        continue
                    paths[v] += paths[via] if v != s else 0.0
                    dist[v] = d
                    order.append(v)
                    for w, length in adjacency.get(v, ()):
                        new = d + length
                        if w not in dist and (w not in seen or new < seen[w]):
                            seen[w], before[w], paths[w] = new, [v], 0.0
                            tick += 1
                            heapq.heappush(heap, (new, tick, v, w))
                        elif w not in dist and new == seen[w]:
                            paths[w] += paths[v]
                            before[w].append(v)
                push = defaultdict(float)
                for v in reversed(order):
                    for u in before[v]:
                        push[u] += paths[u] / paths[v] * (1 + push[v])
                    if v != s:
                        score[v] += push[v]
        yield pd.DataFrame({"node": list(score), "b": list(score.values())})

    n = len(nodes)
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 and k else 1.0
    return chosen.mapInPandas(run, f"node {kind}, b double").groupBy("node").agg((F.sum("b") * scale).alias("betweenness"))


def modularity_groups(edges: list[tuple], nodes: list) -> dict:
    """Greedy modularity merging (the pair with the largest gain first, smaller names on ties): node to group number."""
    weight: dict = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        if a != b:
            weight[a][b] += w
            weight[b][a] += w
    m2 = sum(sum(x.values()) for x in weight.values()) or 1.0
    share = {v: sum(weight[v].values()) / m2 for v in nodes}
    members = {v: [v] for v in nodes}
    while True:
        best = max(((2 * (w / m2 - share[a] * share[b]), b, a) for a in sorted(weight) for b, w in weight[a].items() if a < b), default=(0, None, None), key=lambda x: (x[0], [-ord(c) for c in f"{x[2]}/{x[1]}"]))
        if best[0] <= 1e-15:
            break
        _, b, a = best
        for c, w in list(weight.pop(b).items()):
            weight[c].pop(b, None)
            if c != a:
                weight[a][c] += w
                weight[c][a] += w
        share[a] += share.pop(b)
        members[a] += members.pop(b)
    ordered = sorted(members.values(), key=lambda g: (-len(g), min(g)))
    return {v: i for i, g in enumerate(ordered) for v in g}


def communities(edges: DataFrame, top_nodes: int = 5000) -> DataFrame:
    """node, community for the ``top_nodes`` nodes with the most weight: a bounded graph, in one task."""
    top = degrees(edges).orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "node").limit(top_nodes).select("node")
    kept = edges.join(F.broadcast(top.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(top.withColumnRenamed("node", "dst")), "dst", "left_semi")
    kind = edges.schema["src"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["src"]) | set(pdf["dst"]))
        found = modularity_groups(list(pdf[["src", "dst", "weight"]].itertuples(index=False, name=None)), nodes)
        return pd.DataFrame({"node": list(found), "community": list(found.values())})

    return kept.select("src", "dst", "weight").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, f"node {kind}, community int")


def centrality(edges: DataFrame, sources: int = 200) -> DataFrame:
    return degrees(edges).join(pagerank(edges), "node", "left").join(betweenness(edges, sources), "node", "left").fillna(0.0)
