"""Articles as they come in: sources, policies of hosts, enriched versions, routes and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut

#: Most bytes of a list that is broadcast, at so many for a row; beyond that it is joined by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 256


def bounded(rows: DataFrame) -> DataFrame:
    """A small table, written down and marked for broadcast where its counted size allows it."""
    table = cut(rows, "list")
    return F.broadcast(table) if table.count() * ROW_BYTES <= BROADCAST_BYTES else table


def attributed_source(feed: Column, source: Column, aggregator: str = "Google News") -> Column:
    """The feed's name, unless an aggregator's entry names its own source."""
    return F.when(F.startswith(feed, F.lit(aggregator)) & (T.nonnull(source) != ""), source).otherwise(feed)


def within_hours(articles: DataFrame, at: str, as_of: int, hours: int) -> DataFrame:
    """Articles of the last hours."""
    return articles.where(F.col(at) >= as_of - hours * 60)


def _domains(pages: DataFrame, key: str, url: str) -> DataFrame:
    return pages.select(key, F.explode(T.host_suffixes(T.host(F.col(url)))).alias("domain"))


def without_hosts(pages: DataFrame, domains: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Pages whose host is none of the ``domains`` (domain) nor below one, by equality on the host's parent domains."""
    hit = _domains(pages, key, url).join(bounded(domains.select("domain").distinct()), "domain", "left_semi").select(key).distinct()
    return pages.join(hit, key, "left_anti")


def host_policy(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, policy): the first rule (n, domain, policy) whose domain is the page's host or one of its parents, or none."""
    best = _domains(pages, key, url).join(bounded(rules.select("n", "domain", "policy")), "domain", "left").groupBy(key).agg(F.min_by("policy", "n").alias("policy"))
    return best.select(key, F.coalesce("policy", F.lit("none")).alias("policy"))


def merge_enriched(articles: DataFrame, enriched: DataFrame, key: str = "url") -> DataFrame:
    """Articles with the fields of their enriched version (one row of each key): a field that this lacks, or has empty,
    keeps the article's own value. Articles without one stay as they are."""
    fields = [c for c in enriched.columns if c != key and c in articles.columns]
    better = enriched.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in fields])
    joined = articles.join(better, F.col(key) == F.col("__key"), "left")

    def merged(c: str) -> Column:
        new = F.col(f"__{c}")
        return F.coalesce(F.when(new.cast("string") != "", new), F.col(c)).alias(c)

    return joined.select(*[merged(c) if c in fields else F.col(c) for c in articles.columns])


def route_discovery(articles: DataFrame, routes: DataFrame) -> DataFrame:
    """(ticker, url, first_key): articles (key, url) reach the tickers of routes (ticker, key), each url once, through the
    least key."""
    hit = articles.select("key", T.url_canonical(F.col("url")).alias("url")).join(bounded(routes.select("ticker", "key").distinct()), "key")
    return hit.groupBy("ticker", "url").agg(F.min("key").alias("first_key"))


def without_filing_urls(articles: DataFrame, filings: DataFrame) -> DataFrame:
    """Articles whose url, but for closing slashes, is no filing's (url)."""
    bare = F.regexp_replace("url", "/+$", "")
    return articles.withColumn("__u", bare).join(filings.select(bare.alias("__u")).distinct(), "__u", "left_anti").drop("__u")


def pending_reviews(items: DataFrame, reviews: DataFrame, key: str, first: Column, second: Column, needs_second: Column) -> DataFrame:
    """Items that lack the first kind of review, or that need the second kind and lack it. ``first`` and ``second`` tell a
    review's kind."""
    have = reviews.groupBy(F.col(key).alias("__k")).agg(F.count_if(first).alias("__a"), F.count_if(second).alias("__b"))
    joined = items.join(have, F.col(key) == F.col("__k"), "left")
    open_ = (F.coalesce("__a", F.lit(0)) == 0) | (needs_second & (F.coalesce("__b", F.lit(0)) == 0))
    return joined.where(open_).drop("__k", "__a", "__b")


def match_examples(examples: DataFrame, candidates: DataFrame) -> DataFrame:
    """(item_id, article_id): examples (item_id, day, hashes) and candidates (article_id, day, hash) of one day that share
    a hash of a url."""
    each = examples.select("item_id", "day", F.explode("hashes").alias("hash"))
    return each.join(candidates, ["hash", "day"]).select("item_id", "article_id").distinct()


def source_counts(articles: DataFrame, by: str) -> DataFrame:
    """(by, label, most): the sources of a group with their numbers of articles, by name, and the greatest number."""
    n = articles.groupBy(by, "source").agg(F.count(F.lit(1)).alias("n"))
    each = F.array_sort(F.collect_list(F.struct("source", "n")))
    label = F.array_join(F.transform(each, lambda r: F.concat(r["source"], F.lit(": "), r["n"].cast("string"))), ", ")
    return n.groupBy(by).agg(label.alias("label"), F.max("n").alias("most"))


def counts_by_tag(articles: DataFrame, tags, by: list[str] | None = None) -> DataFrame:
    """(by, category, n) for every tag of the list, zero where no article has it; an article counts for each of its tags."""
    by = by or []
    n = articles.select(*by, F.explode("tags").alias("category")).groupBy(*by, "category").agg(F.count(F.lit(1)).alias("n"))
    groups = articles.select(*by).distinct() if by else articles.sparkSession.range(1).select()
    every = groups.select(*by, F.explode(T.words_in(tags)).alias("category"))
    return every.join(n, [*by, "category"], "left").select(*by, "category", F.coalesce("n", F.lit(0)).alias("n"))
