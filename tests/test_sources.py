"""Sources, sinks and streams on small files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomwright.sources import html, pages, records, sinks
from loomwright.streaming import incremental

LINES = [
    '{"id": "p1", "title": "T", "content": "C", "submolt": {"name": "alpha"}, "author": {"id": "u1", "name": "bob"}, "score": "3", "tags": ["x"]}',
    '{"id": "p2", "name": "N", "text": "", "submolt": "beta", "createdAt": "2024-01-01T00:00:00Z"}', "not json", "", "[1, 2]",
    '{"id": "c1", "post_id": "p1", "parent_id": "c0", "content": "hi", "timestamp": 1704067200}', '{"id": "c1", "post_id": "p1", "parent_id": "c0", "content": "again"}',
]


def write(path, lines):
    path.write_text("\n".join(lines))
    return str(path)


def test_tolerant_and_strict_lines(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", LINES)
    assert records.jsonl(spark, path).count() == 5 and records.jsonl(spark, path, True).count() == 4
    assert records.jsonl(spark, str(tmp_path / "missing.jsonl")).count() == 0
    try:
        records.jsonl_strict(spark, path, "id string").collect()
    except Exception as error:
        assert "MALFORMED" in str(error).upper()
    else:
        raise AssertionError("a malformed line must fail the strict read")


def test_posts_take_aliases(spark, tmp_path):
    raw = records.jsonl(spark, write(tmp_path / "a.jsonl", LINES), True)
    got = {r["id"]: r for r in records.posts(raw).collect()}
    assert (got["p1"]["title"], got["p1"]["body"], got["p1"]["author_id"], got["p1"]["author_name"], got["p1"]["community"], got["p1"]["score"], got["p1"]["tags"]) == ("T", "C", "u1", "bob", "alpha", 3, ["x"])
    assert (got["p2"]["title"], got["p2"]["community"], got["p2"]["created_at"], got["p2"]["tags"]) == ("N", "beta", "2024-01-01T00:00:00Z", [])


def test_messages_are_typed_and_first_wins(spark, tmp_path):
    raw = records.jsonl(spark, write(tmp_path / "a.jsonl", LINES), True).withColumn("ord", F.monotonically_increasing_id())
    rows = records.messages(raw)
    assert {(r["record_type"], r["message_id"], r["reply_to_id"]) for r in rows.collect()} == {("post", "p1", None), ("post", "p2", None), ("comment", "c1", "c0")}
    ordered = rows.withColumn("ord", F.when(F.col("text") == "hi", 0).otherwise(1))
    first = records.first_wins(ordered, ["record_type", "message_id"], "ord")
    assert first.count() == 3 and first.where("message_id = 'c1'").first()["text"] == "hi"
    s = records.schema_summary(rows).first()
    assert (s["messages"], s["posts"], s["comments"], s["missing_text"]) == (4, 2, 2, 1)


def test_payloads_and_backfilled_posts(spark):
    df = spark.createDataFrame([("p9", json.dumps({"results": [{"id": "c1", "content": "x"}, {"id": "c2", "post_id": "p3"}]})), ("p8", "[]"), ("p7", "oops")], "page_post string, payload string")
    items = records.payload_items(df, "payload")
    got = items.select(records.field(F.col("r"), "id").alias("id"), F.coalesce(records.field(F.col("r"), "post_id"), "page_post").alias("post_id")).collect()
    assert {tuple(r) for r in got} == {("c1", "p9"), ("c2", "p3")}


def test_relative_times(spark):
    df = spark.createDataFrame([("14h ago",), ("2 mo ago",), ("5 mins ago",), ("just now",), ("soon",)], "t string").withColumn("now", F.timestamp_seconds(F.lit(1_700_000_000)))
    got = [r[0] for r in df.select((F.unix_seconds("now") - F.unix_seconds(records.relative_time(F.col("t"), F.col("now")))).alias("s")).collect()]
    assert got == [14 * 3600, 60 * 86400, 300, 0, None]


PAGES = {
    "json": '<html><script type="application/json">{"a": {"posts": [{"id": 1, "title": "x", "body": "y"}, {"id": 1, "title": "again", "body": "z"}]}}</script></html>',
    "anchor": '<a href="/post/77"><div><span>5</span></div><h3>Head</h3><p>Body <b>bold</b></p><span>m/general</span><span>14h ago</span><span>12</span><span>comments</span></a><a href="/other">no</a>',
    "article": '<article data-post-id="a9"><h2>Title</h2><div class="post content">Long</div></article><article><h2>ignored</h2></article>',
    "bare": '<article id="b1"><h1>One</h1><p>P</p></article>', "none": "<p>nothing", "broken": "<a href='/post/1'><h3>open",
}


def test_posts_from_html(spark):
    df = spark.createDataFrame([*PAGES.items(), ("null", None)], "page_id string, html string")
    got = {(r["page_id"], r["post_id"], r["title"], r["body"], r["way"]) for r in html.posts_from_pages(df).collect()}
    assert got == {("json", "1", "x", "y", "json"), ("anchor", "77", "Head", "Body bold", "anchor"), ("article", "a9", "Title", "Long", "article"), ("bare", "b1", "One", "P", "article"), ("broken", "1", "open", None, "anchor")}
    row = html.parse_posts(PAGES["anchor"])[0]
    assert (row["community"], row["created_at_raw"], row["comment_count"]) == ("m/general", "14h ago", 12)
    assert [r["path"] for r in html.page_paths(df, "/post/").collect()] == ["/post/77", "/post/1"]


def fetch(page, options):
    return {"items": [{"id": f"{options['name']}{page}"}]} if page < 3 else []


def test_paged_source(spark):
    spark.dataSource.register(pages.PagesDataSource)
    df = spark.read.format("pages").option("fetch", "tests.test_sources:fetch").option("name", "n").option("pages", 6).option("step", 2).load()
    got = [r["id"] for r in records.payload_items(df, "payload").select(records.field(F.col("r"), "id").alias("id")).collect()]
    assert sorted(got) == ["n0", "n1", "n2"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None)], "x int, t string, n string")
    sinks.write_csv(df, str(tmp_path / "c"), ["t", "missing", "x"])
    assert [tuple(r) for r in records.csv(spark, str(tmp_path / "c")).collect()] == [('a "q", b', None, "1")]
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.write_jsonl(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert sinks.document(df) == {"x": 1, "t": 'a "q", b', "n": None}
    assert sinks.markdown_table(df).splitlines()[2] == '| 1 | a "q", b |  |'
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert records.parquet_columns(spark, str(tmp_path / "p"), {"x": "int", "y": "double"}).first().asDict() == {"x": 1, "y": None}
    assert sinks.publish(spark, str(tmp_path), str(tmp_path / "out"), ["p"], ["j", "none"]) == ["p", "j"]
    assert spark.read.parquet(str(tmp_path / "out" / "p")).count() == 1
    fixed = sinks.repaired(spark.createDataFrame([("a", ""), ("b", "old")], "k string, v string"), spark.createDataFrame([("a", "new"), ("b", "x")], "k string, v string"), "k", ["v"])
    assert sorted(map(tuple, fixed.collect())) == [("a", "new"), ("b", "old")]
    assert sinks.file_hashes(spark, str(tmp_path / "p")).count() >= 1


def test_streams_resume_and_drop_repeats(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = lambda i, t: json.dumps({"post_id": f"p{i}", "run_id": "r", "score": i, "rank": 1, "observed": f"2024-01-0{t}T00:00:00"})
    schema = "post_id string, run_id string, score double, rank long, observed timestamp"
    run = lambda: incremental.sink(incremental.unseen(incremental.file_stream(spark, str(source), schema), ["post_id"], "observed"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (source / "1.json").write_text("\n".join([row(1, 1), row(2, 1), row(1, 1)]))
    run()
    (source / "2.json").write_text("\n".join([row(2, 2), row(3, 2)]))
    run()
    assert sorted(r["post_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["p1", "p2", "p3"]
    seen = []
    incremental.each_batch(incremental.snapshots(incremental.file_stream(spark, str(source), schema)), lambda df, n: seen.append((n, df.count())), str(tmp_path / "ck2"), "complete").awaitTermination()
    assert seen[-1][1] == 3


def test_labelling_sheet_progress_and_found_posts(spark, tmp_path):
    sample = spark.createDataFrame([("m1", " text, \"x\" ", "Assert", 0.5)], "message_id string, text string, illocution string, warmth double")
    sinks.write_labelling_sheet(sample, str(tmp_path / "sheet"), ["illocution", "warmth"], ["illocution", "warmth"])
    row = records.csv(spark, str(tmp_path / "sheet" / "csv")).first().asDict()
    assert row == {"message_id": "m1", "text": ' text, "x" ', "pred_illocution": "Assert", "pred_warmth": "0.5", "human_illocution": None, "human_warmth": None}
    assert spark.read.json(str(tmp_path / "sheet" / "json")).first()["human_warmth"] == ""
    assert sinks.write_progress(spark, str(tmp_path / "progress"), "score", "posts", 1, 4) == "[progress] score: posts (1/4, 25.00%)"
    assert spark.read.json(str(tmp_path / "progress")).first()["total"] == 4
    schema = "id string, score long"
    assert records.found_posts(spark, str(tmp_path), schema).count() == 0
    write(tmp_path / "posts.jsonl", ['{"id": "a", "score": 1}', "oops", '{"id": "b"}'])
    assert records.found_posts(spark, str(tmp_path), schema).where("id is not null").count() == 2
    spark.createDataFrame([("p", 3)], schema).write.parquet(str(tmp_path / "posts.parquet"))
    assert [tuple(r) for r in records.found_posts(spark, str(tmp_path), schema).collect()] == [("p", 3)]


def test_temporal_recommendations_and_numbers(spark):
    from loomwright.operators import diffusion

    created = spark.createDataFrame([("2024-01-01 00:00:00",), (None,)], "t string").select(F.to_timestamp("t").alias("created"))
    runs = spark.createDataFrame([("20240101T000000Z", "2024-01-01 00:00:00"), ("20240103T000000Z", "2024-01-03 00:00:00")], "run_id string, t string").select("run_id", F.to_timestamp("t").alias("run_time"))
    got = diffusion.temporal_summary(created, runs).first()
    assert (got["created_days"], got["run_days"], got["ratio"], got["gap_median"], got["missing_rate"]) == (0.0, 2.0, 0.0, 48.0, 0.5)
    assert {"CHK-003", "CHK-004"} <= set(got["recommended"].split("|"))
    texts = spark.createDataFrame([("3.9",), ("-3.9",), ("x",), (None,), ("NaN",), ("inf",)], "t string")
    assert [tuple(r) for r in texts.select(records.safe_float(F.col("t")), records.safe_int(F.col("t"))).collect()] == [(3.9, 3), (-3.9, -3), (0.0, 0), (0.0, 0), (0.0, 0), (0.0, 0)]


def test_state_needs_a_shared_folder_on_a_cluster():
    from loomwright.operators import lineage

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

    try:
        lineage.shared_folder(Session)
    except ValueError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError("a folder of one machine must not be used on a cluster")
