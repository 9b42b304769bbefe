"""Quotes, market moves and their attribution to articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percent_change
from ..session import cut
from .articles import bounded


def close_pairs(quotes: DataFrame) -> DataFrame:
    """Quotes (symbol, day, close) with the close of the symbol's day before, ``before``."""
    return quotes.withColumn("before", F.lag("close").over(Window.partitionBy("symbol").orderBy("day")))


def asof_quote(quotes: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (symbol, session) the quote (symbol, day, close, rank) of that very session from the provider of
    least rank; sessions without one keep a null close."""
    best = quotes.groupBy("symbol", F.col("day").alias("session")).agg(F.min_by("close", F.struct("rank", "close")).alias("close"))
    return wanted.join(best, ["symbol", "session"], "left")


def fresh_quotes(universe: DataFrame, cached: DataFrame, fetched: DataFrame, day: str) -> DataFrame:
    """(symbol, latest, previous, from_cache) of the assets (symbol, provider_symbol): the cached quote (symbol, day, latest,
    previous) of that very day, else the one fetched now (provider_symbol, latest, previous); assets with neither are left
    out. A cache that holds a symbol twice counts by the greater price."""
    kept = cached.where(F.col("day") == F.lit(day).cast("date")).groupBy("symbol").agg(F.max(F.struct("latest", "previous")).alias("__c"))
    new = fetched.groupBy("provider_symbol").agg(F.max(F.struct("latest", "previous")).alias("__f"))
    both = universe.select("symbol", "provider_symbol").join(kept, "symbol", "left").join(new, "provider_symbol", "left")
    quote = F.coalesce("__c", "__f")
    return both.where(quote.isNotNull()).select("symbol", quote["latest"].alias("latest"), quote["previous"].alias("previous"), F.col("__c").isNotNull().alias("from_cache"))


def detect_movers(pairs: DataFrame, assets: DataFrame, thresholds: Column) -> DataFrame:
    """Assets whose change reaches their threshold, with ``change`` and ``excess`` (the change over the threshold)."""
    change = percent_change(F.col("close"), F.col("before"))
    moved = pairs.join(assets, "symbol").withColumn("change", change).withColumn("threshold", thresholds)
    return moved.where(F.abs("change") >= F.col("threshold")).withColumn("excess", F.abs("change") / F.col("threshold"))


def keep_movers(movers: DataFrame, confidence: Column, watched: Column) -> DataFrame:
    """Movers that are explained, large, or watched."""
    return movers.where((confidence != "low") | (F.col("excess") >= 1.5) | watched)


def order_movers(movers: DataFrame, importance: Column, watched: Column, confidence: Column) -> DataFrame:
    """Adds ``place`` within ``day``: size of the move, importance, watched ones, surely explained ones, then symbol."""
    order = Window.partitionBy("day").orderBy(F.abs("change").desc(), importance.desc(), watched.desc(), (confidence == "high").desc(), "symbol")
    return movers.withColumn("place", F.row_number().over(order))


def explain_movers(movers: DataFrame, articles: DataFrame, causal: Column, hours: int = 48) -> DataFrame:
    """For each mover (mover_id, term, minute) the articles (article_id, source, tokens, minute, reputation) that hold its
    term and are at most ``hours`` old: how many, from how many causal sources, the best one, and the confidence.

    No mover meets an article. Only tokens that are some mover's term are kept, and summed by term and minute first, so what
    follows has a row for each of a term's minutes at most. An article counts from its minute until it is too old, and a
    source from each of its articles until that is too old or its next one comes: running sums of these changes give both
    numbers at any minute. Of blocks of the window's length, the best since the block began and the best until it ends give
    the best of any window, which ends in one block and begins in the same or the one before.
    """
    span = 60 * hours
    asked = cut(movers.select("term", "minute").distinct(), "asked")
    a = articles.select("article_id", "source", "reputation", F.col("minute").alias("at"), F.explode(F.array_distinct("tokens")).alias("term"), causal.alias("causal"))
    a = a.join(bounded(asked.select("term").distinct()), "term")
    value = F.struct("causal", "reputation", (-F.col("article_id")).alias("id"))
    seen = cut(a.groupBy("term", "at", "source").agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("best"), F.max(F.col("causal") > 0).alias("causal")), "seen")
    following = F.lead("at").over(Window.partitionBy("term", "source").orderBy("at"))
    sources = seen.where("causal").select("term", "at", F.least(F.col("at") + span + 1, F.coalesce(following, F.col("at") + span + 1)).alias("gone"))
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def change(rows: DataFrame, at: Column, articles: Column, sources: Column, ask: bool = False) -> DataFrame:
        return rows.select("term", at.alias("at"), articles.alias("articles"), sources.alias("sources"), F.lit(ask).alias("ask"))

    at = F.col("at")
    changes = change(seen, at, F.col("n"), none).union(change(seen, at + span + 1, -F.col("n"), none)).union(change(sources, at, none, one)).union(change(sources, F.col("gone"), none, -one))
    line = changes.union(change(asked, F.col("minute"), none, none, True)).groupBy("term", "at").agg(F.sum("articles").alias("articles"), F.sum("sources").alias("sources"), F.max("ask").alias("ask"))
    upto = Window.partitionBy("term").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = line.select("term", "at", "ask", F.sum("articles").over(upto).alias("articles"), F.sum("sources").over(upto).alias("sources")).where("ask")
    minutes = seen.groupBy("term", "at").agg(F.max("best").alias("best"))

    def running(shift: int, ahead: bool) -> DataFrame:
        """(term, minute, best) of the block of ``minute - shift``, up to that place or from it on."""
        block = F.floor(F.col("at") / (span + 1)).alias("block")
        asks = asked.select("term", (F.col("minute") - shift).alias("at"), F.lit(None).cast(minutes.schema["best"].dataType).alias("best"), F.col("minute").alias("minute"))
        both = minutes.select("term", "at", "best", F.lit(None).cast("bigint").alias("minute")).union(asks).select("*", block)
        order = Window.partitionBy("term", "block").orderBy(F.col("at") if not ahead else -F.col("at"), F.col("minute").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return both.withColumn("best", F.max("best").over(order)).where("minute IS NOT NULL").select("term", "minute", "best")

    ends = running(0, False).union(running(span, True)).groupBy("term", "minute").agg(F.max("best").alias("best"))
    found = counted.withColumnRenamed("at", "minute").join(ends, ["term", "minute"]).select("term", "minute", "articles", "sources", (-F.col("best.id")).alias("best"))
    out = movers.select("mover_id", "term", "minute").join(found, ["term", "minute"], "left")
    s = F.coalesce("sources", F.lit(0))
    confidence = F.when(s >= 2, "high").when(s == 1, "medium").otherwise("low")
    return out.select("mover_id", F.coalesce("articles", F.lit(0)).alias("articles"), s.alias("sources"), "best", confidence.alias("confidence"))


# Words that make a story an alert.
TRIGGERS = ("emergency", "fed", "war", "missile", "invasion", "supreme court", "indictment", "ai", "antitrust", "acquisition")
# End of fixed values.


def alert_id(*parts: Column) -> Column:
    """Sixteen digits of a hash: the same alert has the same id on every run."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def tenths(x: Column) -> Column:
    """One decimal, rounded by the exact binary value as numbers are printed elsewhere, halves to even."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def market_alerts(movers: DataFrame, limits: Column) -> DataFrame:
    """Movers beyond the limit of their type, with an alert id of symbol and change to a tenth."""
    hit = movers.where(F.abs("change") >= limits)
    return hit.withColumn("alert_id", alert_id(F.lit("market"), F.col("symbol").cast("string"), tenths(F.col("change"))))


def story_alerts(stories: DataFrame, least: int = 5) -> DataFrame:
    """Stories (key, title, text, sources) of at least two sources that have ``least`` of them or a trigger word, with
    ``alert_id`` and ``confidence``."""
    low = F.lower(F.concat_ws(" ", "title", "text"))
    hit = stories.where((F.col("sources") >= 2) & ((F.col("sources") >= least) | F.rlike(low, F.lit("|".join(TRIGGERS)))))
    return hit.withColumn("alert_id", alert_id(F.lit("story"), F.col("key").cast("string"), F.col("title"))).withColumn("confidence", F.when(F.col("sources") >= least, "high").otherwise("medium"))


def large_moves(pairs: DataFrame, reviewed: DataFrame, percent: float = 3.0, most: int = 20) -> DataFrame:
    """The largest unreviewed moves, a report of ``most`` rows."""
    change = percent_change(F.col("close"), F.col("before"))
    moves = pairs.withColumn("change", change).where(F.abs("change") >= percent).join(reviewed, ["symbol", "day"], "left_anti")
    return moves.orderBy(F.abs("change").desc(), "symbol", "day").limit(most)
