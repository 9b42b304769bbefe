"""Parsers of landed payloads: feeds, quote files and JSON documents."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_feeds(docs: DataFrame) -> DataFrame:
    """(feed_id, pos, title, url, summary, feed_content, published, error) of feed documents (feed_id, xml): entries of RSS,
    RDF or Atom, or one row with an error. Entries without a title or url are left out."""
    local = lambda x: x.tag.rsplit("}", 1)[-1] if isinstance(x.tag, str) else ""

    def text(node, *names) -> str:
        for name in names:
            for c in node:
                if local(c) == name:
                    t = " ".join("".join(c.itertext()).split())
                    if t:
                        return t
        return ""

    def link(node) -> str:
        for c in node:
            if local(c) == "link":
                return (c.get("href") or c.text or "").strip()
        return ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["feed_id", "pos", "title", "url", "summary", "feed_content", "published", "error"]
        for frame in frames:
            rows = []
            for feed, xml in zip(frame["feed_id"], frame["xml"], strict=True):
                try:
                    root = ET.fromstring(xml or "")
                except ET.ParseError:
                    rows.append((feed, None, None, None, None, None, None, "malformed"))
                    continue
                if local(root) not in ("rss", "feed", "RDF"):
                    rows.append((feed, None, None, None, None, None, None, "not a feed"))
                    continue
                entries = [x for x in root.iter() if local(x) == "item"] or [x for x in root.iter() if local(x) == "entry"]
                for pos, e in enumerate(entries):
                    title, url = text(e, "title"), link(e)
                    if title and url:
                        bodies = [b for b in (text(e, n) for n in ("encoded", "content", "description", "summary")) if b and b != title]
                        rows.append((feed, pos, title, url, text(e, "description", "summary"), max(bodies, key=len, default=""), text(e, "pubDate", "published", "updated", "date"), None))
            yield pd.DataFrame(rows, columns=cols)

    return docs.select("feed_id", "xml").mapInPandas(run, "feed_id bigint, pos int, title string, url string, summary string, feed_content string, published string, error string")


def quotes_from_csv(lines: Column) -> Column:
    """A quote line Symbol,Date,Time,Open,High,Low,Close,Volume as a struct; N/D is null and the previous price is the
    opening one."""
    p = F.split(lines, ",")
    cell = lambda i: F.when(p[i] != "N/D", p[i])
    return F.struct(p[0].alias("symbol"), cell(1).alias("day"), cell(3).try_cast("double").alias("previous"), cell(6).try_cast("double").alias("latest"), cell(7).try_cast("bigint").alias("volume"))


def quote_from_chart(json: Column) -> Column:
    """A chart document as a struct: the last close that is not null, the previous close by its fallbacks, the change."""
    doc = F.from_json(json, "meta struct<previousClose double, chartPreviousClose double>, close array<double>")
    closes = F.filter(doc["close"], lambda x: x.isNotNull())
    n = F.size(closes)
    last = F.when(n > 0, F.element_at(closes, -1))
    before = F.coalesce(doc["meta"]["previousClose"], doc["meta"]["chartPreviousClose"], F.when(n > 1, F.get(closes, n - 2)))
    change = F.when(before.isNotNull() & (before != 0), (last - before) / before * 100)
    return F.struct(last.alias("latest"), before.alias("previous"), change.alias("change"))


def benchmark_violations(rows: DataFrame, tickers) -> DataFrame:
    """(ticker, day, url, reason) of rows (ticker, day, url, text) that an import refuses; the first reason that applies."""
    twice = rows.groupBy("ticker", "day", "url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("twice", F.lit(True))
    j = rows.join(twice, ["ticker", "day", "url"], "left")
    reason = (
        F.when(~F.col("ticker").isin(*tickers), "ticker").when(~F.startswith("url", F.lit("https://")), "url").when(F.trim(F.coalesce("text", F.lit(""))) == "", "text")
        .when(F.try_to_date("day", "yyyy-MM-dd").isNull(), "day").when(F.col("twice"), "repeated")
    )
    return j.withColumn("reason", reason).where("reason is not null").select("ticker", "day", "url", "reason")


def read_rejections(spark: SparkSession, root: str, last_day: str, days: int) -> DataFrame:
    """(source, n): rejections by source in the dated folders (day=YYYY-MM-DD) of JSON lines below ``root``, those of the
    ``days`` calendar days up to the last. Days are pruned by the folders' names; lines that do not parse, and blank
    sources, are left out."""
    lines = spark.read.schema("value string, day date").text(root)
    end = F.lit(last_day).cast("date")
    recent = lines.where((F.col("day") <= end) & (F.col("day") > F.date_sub(end, days)))
    source = F.trim(F.from_json("value", "source string").getField("source"))
    return recent.select(source.alias("source")).where("source <> ''").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
