"""Content-quality gate and evidence scores of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Patterns and words of the soft heuristics.
TEASER = (
    r"(\?\s*$|\bwhat('?s| is| to) (know|new)\b|\bwhat you need to know\b|\beverything you need to know\b|\bwhat we know\b|\bwhat it means\b|"
    r"\bwhat that means\b|\bexplained\b|\bhow to\b|\bhere'?s what\b|\bhere'?s how\b|\bhere'?s why\b)"
)
STOCK_TIP = r"(\btop\s+\d*\s*stocks?\s+to\s+(buy|watch|sell)\b|\b\d+\s+stocks?\s+to\s+(buy|watch|sell)\b|\bstocks?\s+to\s+watch\b|\bbest\s+stocks?\s+to\s+buy\b)"
CATALYSTS = (
    "earnings", "guidance", "merger", "acquisition", "acquire", "ipo", "buyback", "dividend", "stock split", "upgrade", "downgrade", "outlook", "forecast",
    "lawsuit", "recall", "bankruptcy", "layoff", "fda", "sec filing", "price target",
)
SOURCE_HINTS = (
    ("ap", 1.0), ("associated press", 1.0), ("bbc", 0.95), ("bloomberg", 1.0), ("cnbc", 0.9), ("financial times", 1.0), ("ft", 1.0), ("npr", 0.9), ("nytimes", 0.95),
    ("new york times", 0.95), ("reuters", 1.0), ("the wall street journal", 0.95), ("wall street journal", 0.95), ("washington post", 0.9), ("wsj", 0.95),
)
# End of fixed values.


def _likeness(title: Column, text: Column) -> Column:
    """Jaccard similarity of two texts' words, each text's words taken once, as the one element of an array."""
    both = F.struct(T.tokenize(title).alias("a"), T.tokenize(text).alias("b"))
    return F.transform(F.array(both), lambda t: T.jaccard(t["a"], t["b"]))[0]


def hard_reject_reason(title: Column, text: Column, threshold: float = 0.85) -> Column:
    """Why an article is almost surely junk, or null."""
    bare = F.trim(T.nonnull(text))
    same = F.lower(F.trim(T.nonnull(title))) == F.lower(bare)
    return F.when(bare == "", "empty_summary").when(same | (_likeness(title, text) > threshold), "summary_duplicates_title")


def quality_triggers(title: Column, text: Column, thin: int = 80) -> Column:
    """Names of the soft heuristics that an article trips, in a fixed order."""
    bare, low = F.trim(T.nonnull(text)), F.lower(F.concat_ws(" ", title, text))
    tip = F.rlike(F.lower(T.nonnull(title)), F.lit(STOCK_TIP)) & ~F.rlike(low, F.lit("|".join(CATALYSTS)))
    return F.array_compact(F.array(
        F.when((bare != "") & (F.length(bare) < thin), "thin_summary"),
        F.when(F.rlike(F.lower(T.nonnull(title)), F.lit(TEASER)), "teaser_title"),
        F.when(tip, "catalystless_stock_tip"),
    ))


def quality_penalty(triggers: Column, ambiguous: float = 0.4, bad: float = 1.5, most: float = 2.5) -> Column:
    n = F.size(triggers)
    return F.least(F.when(n == 0, 0.0).when(n == 1, ambiguous).otherwise(bad), F.lit(most))


def quality_gate(articles: DataFrame) -> DataFrame:
    """Adds ``reason`` (null for survivors), ``triggers``, ``penalty`` and ``ambiguous`` (exactly one trigger)."""
    title, text = F.col("title"), F.col("summary")
    out = articles.withColumn("reason", hard_reject_reason(title, text)).withColumn("triggers", quality_triggers(title, text))
    return out.withColumn("penalty", quality_penalty(F.col("triggers"))).withColumn("ambiguous", F.col("reason").isNull() & (F.size("triggers") == 1))


def apply_quality_verdicts(gated: DataFrame, verdicts: DataFrame, bad: float = 1.5) -> DataFrame:
    """Verdicts (url, verdict) on ambiguous articles: good clears the penalty, junk raises it, others change nothing."""
    one = verdicts.groupBy("url").agg(F.max("verdict").alias("verdict"))
    changed = F.when(F.col("ambiguous") & (F.col("verdict") == "good"), 0.0).when(F.col("ambiguous") & (F.col("verdict") == "junk"), bad)
    return gated.join(one, "url", "left").withColumn("penalty", F.coalesce(changed, F.col("penalty"))).drop("verdict")


def evidence_score(title: Column, text: Column, status: Column, reputation: Column, penalty: Column) -> Column:
    """How much an article has to say: length, numbers, sentences, source and extraction, less likeness to the title."""
    t = F.trim(T.nonnull(text))
    extracted = F.when(status == "extracted", 1.0).otherwise(0.0)
    rich = F.when((status == "feed_content") & (F.length(t) >= 300), 0.45).otherwise(0.0)
    score = (
        F.least(F.length(t), F.lit(1200)) / 300 + F.least(F.lit(3), T.count_matches(t, T.NUMBER)) * 0.35 + F.least(F.lit(4), T.count_matches(t, T.SENTENCE_END)) * 0.20
        + reputation + extracted + rich - _likeness(title, t) * 2.0 - penalty
    )
    return F.when(t == "", 0.0).otherwise(F.greatest(F.lit(0.0), score))


def rank_evidence(scored: DataFrame, by: str) -> DataFrame:
    """Adds ``place`` within ``by``: evidence, reputation and length of text, all descending, then seq."""
    order = Window.partitionBy(by).orderBy(F.desc("evidence"), F.desc("reputation"), F.desc(F.length("summary")), "seq")
    return scored.withColumn("place", F.row_number().over(order))


def source_quality(source: Column, fallback: Column) -> Column:
    """The score of the first hint in the source's name."""
    low = F.lower(T.nonnull(source))
    out = F.when(F.contains(low, F.lit(SOURCE_HINTS[0][0])), SOURCE_HINTS[0][1])
    for hint, score in SOURCE_HINTS[1:]:
        out = out.when(F.contains(low, F.lit(hint)), score)
    return out.otherwise(fallback)


def source_balance(sources: Column, quality: Column) -> Column:
    return F.when(sources >= 4, 1.0).when(sources >= 2, 0.6).when(quality >= 0.9, 0.2).otherwise(-0.5)
