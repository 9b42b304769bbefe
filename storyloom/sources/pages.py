"""Decisions over fetched pages, and their metadata."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_to_text

BLOCKED = (401, 403, 429, 451)
ARTICLE_TYPES = ("Article", "NewsArticle", "ReportageNewsArticle", "BlogPosting")
MOST_CHARS, THIN = 6000, 300


def enrichment_status(policy: Column, code: Column, kind: Column, chars: Column, thin: int = THIN) -> Column:
    """What became of a page under its policy; the first that applies."""
    return (
        F.when(policy.isNull() | (policy == "disabled"), "not_permitted").when(code.isin(*BLOCKED), "blocked").when((code != 200) | ~F.contains(kind, F.lit("html")), "failed")
        .when(policy == "metadata_only", "metadata_only").when(F.coalesce(chars, F.lit(0)) < thin, "too_thin").otherwise("extracted")
    )


def canonical_url(html: Column) -> Column:
    """The canonical link, or the page's own url as it states it."""
    link = F.regexp_extract(html, r'(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1)
    return F.coalesce(F.nullif(link, F.lit("")), F.nullif(F.regexp_extract(html, r'(?i)<meta[^>]*property="og:url"[^>]*content="([^"]*)"', 1), F.lit("")))


def own_text(html: Column) -> Column:
    """The text of a page's article, without scripts, styles and markup; empty where it marks none."""
    return html_to_text(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, canonical, body, status) of pages (page_id, html): the body is the page's own text, or else the longest
    article body of its JSON-LD, up to a fixed number of characters; the url is that of its links, or of the JSON-LD."""

    def found(node) -> list[dict]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                kinds = x.get("@type")
                if set(kinds if isinstance(kinds, list) else [kinds]) & set(ARTICLE_TYPES):
                    out.append(x)
            stack.extend(reversed(list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bodies, urls = [], []
            for blocks in frame["blocks"]:
                nodes: list[dict] = []
                for b in blocks if blocks is not None else ():
                    try:
                        nodes += found(json.loads(b))
                    except (ValueError, RecursionError):
                        continue
                bodies.append(max((n["articleBody"].strip() for n in nodes if isinstance(n.get("articleBody"), str)), key=len, default=""))
                urls.append(next((n["url"] for n in nodes if isinstance(n.get("url"), str)), None))
            yield pd.DataFrame({"page_id": frame["page_id"], "link": frame["link"], "own": frame["own"], "body": bodies, "url": urls})

    blocks = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    read = pages.select(F.col("page_id").cast("string").alias("page_id"), canonical_url(F.col("html")).alias("link"), own_text(F.col("html")).alias("own"), blocks.alias("blocks"))
    read = read.mapInPandas(run, "page_id string, link string, own string, body string, url string")
    body = F.rtrim(F.substring(F.coalesce(F.nullif("own", F.lit("")), "body"), 1, MOST_CHARS))
    out = read.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("link", "url").alias("canonical"), body.alias("body"))
    return out.withColumn("status", F.when(F.length("body") < THIN, "too_thin").otherwise("extracted"))
