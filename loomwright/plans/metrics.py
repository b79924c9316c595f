"""The sociology metrics in one row, from the queries that say what each of them is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import sociology as S
from loomwright.operators import stats
from loomwright.plans import audits, graphs, memetic, relational, texts, vectors  # noqa: F401  (their queries are named below)
from loomwright.plans.registry import _QUERIES, _SQL, query, table

_FIRST = ("max_by({0}, struct({1}, {0}))", "arg_max({0}, ({1}, {0}))")


def _top(name: str, by: str) -> tuple[str, str]:
    """The name with the largest value, the last name among equals, in both dialects."""
    return tuple(f.format(name, by) for f in _FIRST)


def _hours(a: str, b: str) -> tuple[str, str]:
    return f"greatest(0.0D, (unix_micros(cast({b} AS timestamp)) - unix_micros(cast({a} AS timestamp))) / 3.6e9)", f"greatest(0, (epoch_us({b}) - epoch_us({a})) / 3.6e9)"


_OF = lambda kind, column: f"max({column}) FILTER (WHERE doc_type = '{kind}')"
_RATE = lambda feature: f"max(rate_per_doc) FILTER (WHERE scope = 'all' AND feature = '{feature}')"
_EDGE = lambda f: (f"{f}_by(pair_count, threshold)", f"arg_{f}(pair_count, threshold)")
_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _time(c: str) -> tuple[str, str]:
    return f"date_format({c}, 'yyyy-MM-dd HH:mm:ss')", _TIME.format(c)


#: Query, and what of it is a metric: aggregates, one text where both dialects agree.
PARTS: list[tuple[str, dict[str, str | tuple[str, str]]]] = [
    ("coverage_quality", {
        "posts_total": _OF("document", "total"), "comments_total": _OF("event", "total"), "comments_min": _time("min(created_min)"), "comments_max": _time("max(created_max)"), "comments_window_hours": _hours("min(created_min)", "max(created_max)"),
    }),
    ("post_window", {"posts_min": _time("min(first)"), "posts_max": _time("max(last)"), "posts_window_hours": _hours("min(first)", "max(last)")}),
    ("gini_topshare", {"submolts_total": "max(n)", "top5_share": "max(top5_share)", "gini_submolt": "max(gini)"}),
    ("volume_concentration", {"top2_share": "max(top_share)"}),
    ("author_concentration", {"authors_total": "max(n)", "top10_authors_share": "max(top10_share)", "gini_authors": "max(gini)"}),
    ("run_snapshots", {"runs_total": "count(DISTINCT run_id)"}),
    ("lang_distribution", {"top_post_lang": _top("lang", "share"), "top_post_lang_share": "max(share)"}),
    ("speaker_distribution", {"top_comment_lang": _top("role", "share"), "top_comment_lang_share": "max(share)"}),
    ("meme_classes", {
        "top_meme_life": _top("meme", "lifetime_hours"), "top_meme_life_hours": "max(lifetime_hours)", "top_meme_burst": _top("meme", "burst_score"), "top_meme_burst_score": "max(burst_score)",
        "top_meme_dispersion": _top("meme", "communities_touched"), "top_meme_dispersion_submolts": "max(communities_touched)",
        "infra_share": ("sum(if(meme LIKE 'error%', burst_score, 0)) / sum(burst_score)", "sum(CASE WHEN meme LIKE 'error%' THEN burst_score ELSE 0 END) / sum(burst_score)"),
        "narrative_share": ("sum(if(meme LIKE 'error%', 0, burst_score)) / sum(burst_score)", "sum(CASE WHEN meme LIKE 'error%' THEN 0 ELSE burst_score END) / sum(burst_score)"),
    }),
    ("speech_act_rates_by_scope", {"act_assertion_rate": _RATE("act_assertion"), "act_question_rate": _RATE("act_question_mark")}),
    ("mood_epistemic_by_community", {f"epistemic_{k}_rate": f"sum(epistemic_{k}) / sum(doc_count)" for k in ("evidence", "hedge", "certainty")}),
    ("concept_cooccurrence", {"top_pair_a": _top("concept_a", "count"), "top_pair_b": _top("concept_b", "count"), "top_pair_count": "max(count)"}),
    ("embedding_distance_ratio", {"pca_ratio_p90_p50": "max(p90_p50)", "pca_rows": "max(communities)"}),
    ("match_summary", {"emb_post_post_mean": "max(mean_score)", "emb_post_post_cross": "max(1 - same_community_rate)"}),
    ("cross_knn", {"emb_post_comment_mean": "avg(score)", "emb_post_comment_cross": ("avg(if(left_id % 7 = right_id % 7, 0, 1))", "avg(CASE WHEN left_id % 7 = right_id % 7 THEN 0 ELSE 1 END)")}),
    ("threshold_sensitivity", {"threshold_low": "min(threshold)", "threshold_high": "max(threshold)", "threshold_low_pairs": _EDGE("min"), "threshold_high_pairs": _EDGE("max")}),
    ("threshold_knee", {"threshold_knee": "max(threshold)", "threshold_knee_drop": "max(`drop`)"}),
    ("lexical_baseline_auc", {"vsm_auc": "max(auc)"}),
    ("pair_correlation", {"vsm_corr": "max(r)"}),
    ("score_bin_sample", {"transmission_sample_count": "count(*)"}),
    ("graph_reciprocity", {"reply_nodes": "max(nodes)", "reply_edges": "max(edges)", "reply_reciprocity": "max(reciprocity)"}),
    ("network_concentration", {"reply_top2_share": "max(top_share)", "reply_gini": "max(gini)"}),
]

_VOLUMES = "WITH v AS (SELECT count(*)::DOUBLE AS v FROM {0} GROUP BY {1}), k AS (SELECT v, row_number() OVER (ORDER BY v) AS i, row_number() OVER (ORDER BY v DESC) AS j, count(*) OVER () AS n, sum(v) OVER () AS total FROM v) "


@query(_VOLUMES.format("orders", "o_custkey") + "SELECT any_value(n) AS nodes, sum(v) FILTER (j <= greatest(1, ceil(0.02 * n))) / any_value(total) AS top_share, 2 * sum(i * v) / (any_value(n) * any_value(total)) - (any_value(n) + 1) / any_value(n) AS gini FROM k")
def volume_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-47: the share that the top 2 % of communities (customers) have."""
    return S.concentration(table(spark, sf_dir, "orders").groupBy("o_custkey").count(), "count", 0.02)


@query(_VOLUMES.format("lineitem", "l_suppkey") + "SELECT any_value(n) AS n, any_value(total) AS total, 2 * sum(i * v) / (any_value(n) * any_value(total)) - (any_value(n) + 1) / any_value(n) AS gini, sum(v) FILTER (j <= 5) / any_value(total) AS top5_share, sum(v) FILTER (j <= 10) / any_value(total) AS top10_share FROM k")
def author_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-46, AGG-47: suppliers as authors."""
    return stats.gini_and_shares(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").count(), "count")


@query("SELECT min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) AS posts FROM orders")
def post_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-06: first and last time of posts (orders)."""
    return table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("posts"))


@query("SELECT role, count(*) AS turns, count(*) / (SELECT count(*) FROM conversations WHERE turn > 0) AS share FROM conversations WHERE turn > 0 GROUP BY 1")
def speaker_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-37 for comments, whose role stands in for their language."""
    rows = table(spark, sf_dir, "conversations").where("turn > 0").groupBy("role").agg(F.count(F.lit(1)).alias("turns"))
    return rows.join(F.broadcast(rows.agg(F.sum("turns").alias("all"))), how="cross").select("role", "turns", (F.col("turns") / F.col("all")).alias("share"))  # one row


def _sql() -> str:
    parts = [f"(SELECT {', '.join(f'{x if isinstance(x, str) else x[1]} AS {k}' for k, x in metrics.items())} FROM ({_SQL[name]}))".replace("`", '"').replace("max(count)", 'max("count")') for name, metrics in PARTS]
    return "SELECT * FROM " + ", ".join(parts)


@query(_sql())
def sociology_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-58: what the readings are made from, in one row. Tables that the driver doesn't have are stood in for as in the queries named."""
    parts = [_QUERIES[name](spark, sf_dir).agg(*[F.expr(x if isinstance(x, str) else x[0]).alias(k) for k, x in metrics.items()]) for name, metrics in PARTS]
    return S.metric_vector(parts)
