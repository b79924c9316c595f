"""Posts and links from HTML pages, with the standard library's parser."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POST_KEYS = (("title", "name"), ("body", "content", "text"), ("author", "author_name", "authorId", "author_id"), ("created_at", "createdAt", "created"))
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SCRIPT_IDS = {"__NEXT_DATA__", "__NUXT__", "__APP_DATA__"}


class Node:
    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.parts = tag, attributes, []

    def nodes(self) -> Iterator[Node]:
        for part in self.parts:
            if isinstance(part, Node):
                yield part
                yield from part.nodes()

    def text(self) -> str:
        return " ".join(" ".join(p if isinstance(p, str) else p.text() for p in self.parts).split())

    def first(self, *tags: str, css: str = "") -> Node | None:
        return next((n for n in self.nodes() if n.tag in tags and css in n.attributes.get("class", "")), None)


class Tree(HTMLParser):
    """A forgiving tree: an end tag closes up to its start, if that is open."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def like_post(item: dict) -> bool:
    return sum(any(k in item for k in keys) if i else sum(k in item for k in keys) for i, keys in enumerate(POST_KEYS)) >= 2


def post_lists(value: object) -> Iterator[dict]:
    """Items of every list of objects at least half of which look like posts, however deep."""
    if isinstance(value, list):
        if value and all(isinstance(x, dict) for x in value) and sum(map(like_post, value)) >= max(1, len(value) // 2):
            yield from value
        for x in value:
            yield from post_lists(x)
    elif isinstance(value, dict):
        for x in value.values():
            yield from post_lists(x)


def _embedded(root: Node) -> list[dict]:
    found = []
    for node in root.nodes():
        if node.tag == "script" and (node.attributes.get("id") in SCRIPT_IDS or node.attributes.get("type") == "application/json"):
            try:
                found += post_lists(json.loads("".join(p for p in node.parts if isinstance(p, str))))
            except ValueError:
                continue
    return [{"id": x.get("id"), "title": x.get("title") or x.get("name"), "body": x.get("body") or x.get("content") or x.get("text"), "way": "json"} for x in found]


def _anchors(root: Node) -> list[dict]:
    found = []
    for a in root.nodes():
        href = a.attributes.get("href", "")
        if a.tag == "a" and href.startswith("/post/"):
            spans = [n.text() for n in a.nodes() if n.tag == "span"]
            counts = [spans[k - 1] for k, s in enumerate(spans) if k and s.lower().startswith("comment") and spans[k - 1].isdigit()]
            title, body = a.first("h3"), a.first("p")
            found.append({
                "id": href.split("/post/")[-1], "title": title and title.text(), "body": body and body.text(), "community": next((s for s in spans if s.startswith("m/")), None),
                "created_at_raw": next((s for s in spans if "ago" in s), None), "comment_count": int(counts[0]) if counts else None, "way": "anchor",
            })
    return found


def _articles(root: Node) -> list[dict]:
    nodes = [n for n in root.nodes() if n.tag in ("article", "div") and "data-post-id" in n.attributes] or [n for n in root.nodes() if n.tag == "article"]
    found = []
    for n in nodes:
        title, body = n.first("h1", "h2", "h3"), n.first("div", css="content") or n.first("p")
        found.append({"id": n.attributes.get("data-post-id") or n.attributes.get("id"), "title": title and title.text(), "body": body and body.text(), "way": "article"})
    return found


def parse_posts(html: str) -> list[dict]:
    """Embedded JSON, else links to posts, else article elements; the first of equal ids (or texts) stays."""
    root = Tree(html).root
    rows = _embedded(root) or _anchors(root)
    if not rows:
        return _articles(root)
    seen: dict = {}
    for r in rows:
        seen.setdefault(r.get("id") or (r.get("title"), str(r.get("body"))), r)
    return list(seen.values())


def posts_from_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id of the page, and each post: post_id, title, body, community, created_at_raw, comment_count, way."""
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["id", "title", "body", "community", "created_at_raw", "comment_count", "way"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *[None if r.get(n) is None else str(r[n]) if n != "comment_count" else r[n] for n in names]) for p, html in zip(batch["p"], batch["html"], strict=True) for r in parse_posts(html or "")]
            frame = pd.DataFrame(rows, columns=["p", *names])
            frame["comment_count"] = frame["comment_count"].astype("Int64")
            yield frame

    rows = pages.select(F.col(id_col).alias("p"), F.col(html_col).alias("html"))
    out = rows.mapInPandas(run, f"p {kind}, id string, title string, body string, community string, created_at_raw string, comment_count long, way string")
    return out.withColumnsRenamed({"p": id_col, "id": "post_id"})


def page_paths(pages: DataFrame, prefix: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Distinct link paths with a prefix, per page."""
    found = F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(r"""<a [^>]*?href=["'](""" + prefix + r"""[^"']*)["']"""), F.lit(1)))
    return pages.select(id_col, F.explode(F.array_sort(found)).alias("path"))


def number_in(text_col: str, pattern: str) -> Column:
    """The digits of the first match's group, as a number."""
    return F.regexp_replace(F.regexp_extract(F.col(text_col), pattern, 1), "[^0-9]", "").try_cast("long")


def html_folder(spark: SparkSession, path: str) -> DataFrame:
    """url and html of every file in a folder."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
