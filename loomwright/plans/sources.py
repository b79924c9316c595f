"""HTML queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.plans.registry import query, table
from loomwright.sources import html


@query()
def html_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17..20: tests hold the parser against fixed pages."""
    return html.posts_from_pages(table(spark, sf_dir, "pages").select("page_id", "html"))


@query("""SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a [^>]*?href=["''](/[^"'']*)["'']', 1))) AS path FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-22."""
    return html.page_paths(table(spark, sf_dir, "pages").select("page_id", "html"), "/")


@query(r"SELECT page_id, TRY_CAST(regexp_replace(regexp_extract(url, '[?&]page=([0-9,]+)', 1), '[^0-9]', '', 'g') AS BIGINT) AS page_number, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-21: numbers inside text."""
    return table(spark, sf_dir, "pages").select("page_id", html.number_in("url", r"[?&]page=([0-9,]+)").alias("page_number"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))
