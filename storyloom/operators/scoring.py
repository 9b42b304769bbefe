"""Story scores, votes and gates. Stories are rows of articles with a ``story_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .quality import source_balance, source_quality


def story_table(members: DataFrame) -> DataFrame:
    """One row for each story of articles (story_id, seq, source, reputation, minute, summary, evidence, penalty):
    counts, means, the latest minute, the greatest evidence, and the text of its first five articles by evidence."""
    quality = F.greatest(F.col("reputation"), source_quality(F.col("source"), F.col("reputation")))
    order = Window.partitionBy("story_id").orderBy(F.desc("evidence"), "seq")
    placed = members.withColumn("__place", F.row_number().over(order))
    first = F.array_sort(F.collect_list(F.when(F.col("__place") <= 5, F.struct("__place", "summary"))))
    return placed.groupBy("story_id").agg(
        F.count(F.lit(1)).alias("articles"), F.count_distinct("source").alias("sources"), F.avg("reputation").alias("reputation"), F.avg(quality).alias("quality"),
        F.avg("penalty").alias("penalty"), F.max("minute").alias("latest"), F.max("evidence").alias("evidence"), F.array_join(F.transform(first, lambda r: r["summary"]), " ").alias("text"),
    )


def watchlist_score(weights: Column, corroborated: Column) -> Column:
    """A sum of matched weights as a score; without corroboration it counts for little."""
    raw = F.least(F.lit(2.0), 0.35 * weights)
    return F.when(corroborated, raw).otherwise(F.least(F.lit(0.1), raw))


def score_stories(stories: DataFrame, as_of_minute: int, broad_terms, forward_terms, weights: Column | None = None) -> DataFrame:
    """Adds the parts of the total score and ``total``."""
    n = F.col("sources")
    out = stories.withColumn("balance", source_balance(n, F.col("quality")))
    out = out.withColumn("frequency", F.least(F.lit(4.0), F.log2(n + 1) * 1.7))
    age = F.greatest((F.lit(as_of_minute) - F.col("latest")) / 60, F.lit(0.0))
    out = out.withColumn("recency", F.greatest(F.lit(0.2), 2.0 - age / 18.0))
    broad = sum((T.term_hits(F.col("text"), terms) for terms in broad_terms), F.lit(0))
    out = out.withColumn("impact", F.least(F.lit(5.0), 1.0 + broad * 0.55 + T.term_hits(F.col("text"), forward_terms) * 0.35))
    corroborated = (n >= 2) | (F.col("impact") >= 3.0) | (F.col("quality") >= 0.8)
    out = out.withColumn("watch", watchlist_score(F.lit(0.0) if weights is None else weights, corroborated))
    base = (
        F.col("frequency") * 2.0 + F.col("impact") * 2.4 + F.col("recency") + F.col("reputation") + F.col("quality") + F.col("balance") + F.col("watch")
        + F.least(F.lit(2.0), F.col("evidence") * 0.4) - F.col("penalty")
    )
    return out.withColumn("total", base + F.when(n >= 2, 1.25).when(F.col("impact") < 3.0, -1.5).otherwise(0.0))


def vote_category(members: DataFrame, categories, by: str = "story_id") -> DataFrame:
    """The category most of a story's article tags name; ties go to the earlier category of the list."""
    rank = F.array_position(T.words_in(categories), F.col("tag"))
    votes = members.select(by, F.explode("tags").alias("tag")).groupBy(by, "tag").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy(by).agg(F.max_by("tag", F.struct("votes", -rank)).alias("category"), F.max("votes").alias("votes"))


def skip_reason(existing: Column, selected: Column, penalty: Column, quality: Column, sources: Column, impact: Column, low: float = 1.0) -> Column:
    """Why a story was not selected; the first that applies."""
    return (
        F.when(T.nonnull(existing) != "", existing).when(selected, "").when(penalty >= low, "low content quality").when((quality < 0.55) & (sources <= 1), "low source quality")
        .when((sources <= 1) & (impact < 3.0), "no confirmation").otherwise("category full")
    )


def review_stratum(selected: Column, rejected: Column, score: Column, target: int) -> Column:
    near = max(1.0, 0.2 * target)
    return F.when(selected, "selected").when(rejected, "hard_reject").when(score >= near, "near_miss").when(score >= 0, "mid").otherwise("deep_filtered")


def stock_mentions(articles: DataFrame, most: int = 5) -> DataFrame:
    """(symbol, n, headlines, sources, place) of articles (seq, title, source, symbols): how many name a symbol, the first
    headlines, the first sources by name, and the place by mentions, sources and symbol, all descending."""
    each = articles.select("seq", "title", "source", F.explode("symbols").alias("symbol"))
    first = F.row_number().over(Window.partitionBy("symbol").orderBy("seq"))
    shown = F.array_sort(F.collect_list(F.when(F.col("__r") <= most, F.struct("seq", "title"))))
    m = each.withColumn("__r", first).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.transform(shown, lambda r: r["title"]).alias("headlines"), F.slice(F.sort_array(F.collect_set("source")), 1, most).alias("sources")
    )
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.size("sources").desc(), F.desc("symbol"))))


def feed_health(articles: DataFrame, least: int = 5, share: float = 0.6, evidence: float = 1.2, rich: int = 300) -> DataFrame:
    """(source, n, nonempty, nonduplicate, evident, valid, permitted, rich, healthy) of recent articles (source, article_id,
    title, summary, evidence, valid, permitted): enough of them, most with a text that is not the title and tells
    something, all with valid times and permitted urls, and the best with a rich text."""
    text = F.trim("summary")
    n = F.count(F.lit(1)).cast("double")
    best = F.max_by(F.length("summary") >= rich, F.struct("evidence", -F.col("article_id")))
    h = articles.groupBy("source").agg(
        n.alias("n"), (F.count_if(text != "") / n).alias("nonempty"), (F.count_if((text != "") & (F.lower(text) != F.lower(F.trim("title")))) / n).alias("nonduplicate"),
        (F.count_if(F.col("evidence") >= evidence) / n).alias("evident"), F.bool_and("valid").alias("valid"), F.bool_and("permitted").alias("permitted"), best.alias("rich"),
    )
    enough = (F.col("n") >= least) & (F.col("nonempty") >= share) & (F.col("nonduplicate") >= share) & (F.col("evident") >= share)
    return h.withColumn("healthy", enough & F.col("valid") & F.col("permitted") & F.col("rich"))
