"""Queries of the quality gate, evidence, scores, similarity and selection, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import facts as X
from ..functions import text as T
from ..operators import articles as A
from ..operators import quality as Q
from ..operators import scoring as S
from ..operators import selection as Sel
from ..session import fresh_path
from ..sinks import dated_logs as D
from .adapters import CATEGORIES, articles, table, with_articles
from .text_queries import SQL_NUMBERS, SQL_SENTENCES, sql_ascii, sql_hits, sql_jaccard, sql_list, sql_tokens

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


GATED = f"""gated AS (
 SELECT *, CASE WHEN trim(summary) = '' THEN 'empty_summary' WHEN lower(trim(title)) = lower(trim(summary)) OR {sql_jaccard('tt', 'ts')} > 0.85 THEN 'summary_duplicates_title' END AS reason,
  list_filter([CASE WHEN trim(summary) <> '' AND length(trim(summary)) < 80 THEN 'thin_summary' END, CASE WHEN regexp_matches(lower(title), '{Q.TEASER.replace("'", "''")}') THEN 'teaser_title' END,
   CASE WHEN regexp_matches(lower(title), '{Q.STOCK_TIP}') AND NOT regexp_matches(lower(title || ' ' || summary), '{'|'.join(Q.CATALYSTS)}') THEN 'catalystless_stock_tip' END], lambda x: x IS NOT NULL) AS triggers
 FROM (SELECT *, {sql_tokens('title')} AS tt, {sql_tokens('summary')} AS ts FROM articles)),
penalised AS (SELECT *, CASE len(triggers) WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 1.5::DOUBLE END AS penalty, reason IS NULL AND len(triggers) = 1 AS ambiguous FROM gated)"""


def gate_sql(sql: str) -> str:
    return with_articles("").rstrip() + ",\n" + GATED + "\n" + sql


def gated(spark, sf_dir):
    return Q.quality_gate(articles(spark, sf_dir))


@register("quality_hard_reject", gate_sql("SELECT article_id, coalesce(reason, '') AS reason FROM penalised"))
def quality_hard_reject(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("article_id", F.coalesce(Q.hard_reject_reason(F.col("title"), F.col("summary")), F.lit("")).alias("reason"))


@register("quality_triggers", gate_sql("SELECT article_id, array_to_string(triggers, ',') AS triggers FROM penalised"))
def quality_triggers(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", F.array_join(Q.quality_triggers(F.col("title"), F.col("summary")), ",").alias("triggers"))


@register("quality_gate", gate_sql("SELECT run_id, count(*) AS articles, count(reason) AS rejected, count(*) FILTER (ambiguous) AS ambiguous, round(sum(penalty), 6) AS penalty FROM penalised GROUP BY run_id"))
def quality_gate(spark, sf_dir):
    return gated(spark, sf_dir).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("articles"), F.count("reason").alias("rejected"), F.count_if("ambiguous").alias("ambiguous"), F.round(F.sum("penalty"), 6).alias("penalty")
    )


@register("apply_quality_verdicts", gate_sql("""SELECT article_id, CASE WHEN ambiguous AND quality = 1 THEN 0.0::DOUBLE WHEN ambiguous AND quality = 0 THEN 1.5::DOUBLE ELSE penalty END AS penalty
 FROM penalised LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) ON doc_id = article_id"""))
def apply_quality_verdicts(spark, sf_dir):
    """Quality labels as verdicts."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    a = gated(spark, sf_dir)
    verdicts = a.join(labels, F.col("article_id") == F.col("doc_id")).select("url", F.when(F.col("q") == 1, "good").when(F.col("q") == 0, "junk").alias("verdict"))
    return Q.apply_quality_verdicts(a, verdicts).select("article_id", "penalty")


EVIDENCE = f"""evidence AS (SELECT *, CASE WHEN trim(summary) = '' THEN 0.0 ELSE greatest(0.0, least(length(trim(summary)), 1200) / 300.0::DOUBLE + {SQL_NUMBERS} * 0.35::DOUBLE + {SQL_SENTENCES} * 0.2::DOUBLE + reputation
 + CASE WHEN article_id % 3 = 0 THEN 1.0 ELSE 0.0 END + CASE WHEN article_id % 3 = 1 AND length(trim(summary)) >= 300 THEN 0.45::DOUBLE ELSE 0.0 END - {sql_jaccard('tt', 'ts')} * 2.0 - penalty) END AS ev
 FROM (SELECT *, {sql_ascii('trim(summary)')} AS summary_ascii FROM penalised))"""


def evidence_sql(sql: str) -> str:
    return gate_sql(", " + EVIDENCE + "\n" + sql)


def evidence(spark, sf_dir):
    """Gated articles with ``evidence``; a third counts as extracted, a third as feed content."""
    status = F.when(F.col("article_id") % 3 == 0, "extracted").when(F.col("article_id") % 3 == 1, "feed_content").otherwise("metadata_only")
    g = gated(spark, sf_dir)
    return g.withColumn("evidence", Q.evidence_score(F.col("title"), F.col("summary"), status, F.col("reputation"), F.col("penalty")))


@register("evidence_score", evidence_sql("SELECT article_id, round(ev, 6) AS evidence FROM evidence"))
def evidence_score(spark, sf_dir):
    return evidence(spark, sf_dir).select("article_id", F.round("evidence", 6).alias("evidence"))


@register("rank_evidence", evidence_sql("""SELECT source, article_id, place FROM (SELECT source, article_id, row_number() OVER (PARTITION BY source ORDER BY round(ev, 6) DESC, reputation DESC, length(summary) DESC, seq) AS place FROM evidence)"""))
def rank_evidence(spark, sf_dir):
    e = evidence(spark, sf_dir).withColumn("evidence", F.round("evidence", 6))
    return Q.rank_evidence(e, "source").select("source", "article_id", F.col("place").cast("long").alias("place"))


@register("evidence_gate", evidence_sql("SELECT run_id, count(*) FILTER (ev < 1.2) AS skipped, count(*) FILTER (ev >= 1.2) AS passed FROM evidence GROUP BY run_id"))
def evidence_gate(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy("run_id").agg(F.count_if(F.col("evidence") < 1.2).alias("skipped"), F.count_if(F.col("evidence") >= 1.2).alias("passed"))


HINTS = " ".join(f"WHEN contains(lower(s), '{h}') THEN {v}" for h, v in Q.SOURCE_HINTS)


@register("source_quality", with_articles(f"SELECT article_id, CAST(CASE {HINTS} ELSE reputation END AS DOUBLE) AS quality FROM (SELECT article_id, reputation, CASE article_id % 4 WHEN 0 THEN 'Reuters ' || source WHEN 1 THEN 'BBC ' || source ELSE source END AS s FROM articles)"))
def source_quality(spark, sf_dir):
    named = F.when(F.col("article_id") % 4 == 0, F.concat(F.lit("Reuters "), "source")).when(F.col("article_id") % 4 == 1, F.concat(F.lit("BBC "), "source")).otherwise(F.col("source"))
    return articles(spark, sf_dir).select("article_id", Q.source_quality(named, F.col("reputation")).alias("quality"))


@register("source_distribution", with_articles("SELECT run_id, string_agg(source || ': ' || n, ', ' ORDER BY source) AS label, max(n) AS most FROM (SELECT run_id, source, count(*) AS n FROM articles GROUP BY ALL) GROUP BY run_id"))
def source_distribution(spark, sf_dir):
    return A.source_counts(articles(spark, sf_dir), "run_id")


#: Stories of the score queries: an edition's articles with the same number modulo 40.
STORY = "run_id * 40 + article_id % 40"
WORDS_A, WORDS_B = ("the", "der", "que"), ("and", "und", "les")
SCORES = evidence_sql(f""", members AS (SELECT *, {STORY} AS story_id, row_number() OVER (PARTITION BY {STORY} ORDER BY round(ev, 6) DESC, seq) AS p,
  greatest(reputation, reputation) AS q FROM evidence),
 stories AS (SELECT story_id, count(*) AS articles, count(DISTINCT source) AS sources, avg(reputation) AS reputation, avg(q) AS quality, avg(penalty) AS penalty, max(minute) AS latest, max(round(ev, 6)) AS evidence,
  string_agg(summary, ' ' ORDER BY p) FILTER (p <= 5) AS text FROM members GROUP BY story_id),
 parts AS (SELECT *, CASE WHEN sources >= 4 THEN 1.0 WHEN sources >= 2 THEN 0.6 WHEN quality >= 0.9 THEN 0.2 ELSE -0.5 END::DOUBLE AS balance, least(4.0, log2(sources + 1) * 1.7) AS frequency,
  greatest(0.2, 2.0 - (4320 - latest) / 60.0::DOUBLE / 18.0) AS recency, least(5.0, 1.0 + ({sql_hits('text', WORDS_A)}) * 0.55::DOUBLE + {sql_hits('text', WORDS_B)} * 0.35::DOUBLE) AS impact FROM stories)
 SELECT story_id, sources, round(impact, 6) AS impact, round(frequency * 2 + impact * 2.4 + recency + reputation + quality + balance + least(2.0, evidence * 0.4) - penalty
  + CASE WHEN sources >= 2 THEN 1.25 WHEN impact < 3 THEN -1.5 ELSE 0 END, 4) AS total FROM parts""")


def stories(spark, sf_dir):
    e = evidence(spark, sf_dir).withColumn("evidence", F.round("evidence", 6)).withColumn("story_id", F.expr(STORY))
    return S.score_stories(S.story_table(e), 4320, (WORDS_A,), WORDS_B)


@register("score_stories", SCORES)
def score_stories(spark, sf_dir):
    return stories(spark, sf_dir).select("story_id", "sources", F.round("impact", 6).alias("impact"), F.round("total", 4).alias("total"))


@register("source_balance", with_articles("""SELECT story_id, CASE WHEN n >= 4 THEN 1.0 WHEN n >= 2 THEN 0.6 WHEN q >= 0.9 THEN 0.2 ELSE -0.5 END::DOUBLE AS balance
 FROM (SELECT run_id * 90 + article_id % 90 AS story_id, count(DISTINCT source) AS n, avg(reputation) AS q FROM articles GROUP BY 1)"""))
def source_balance(spark, sf_dir):
    s = articles(spark, sf_dir).withColumn("story_id", F.expr("run_id * 90 + article_id % 90")).groupBy("story_id").agg(F.count_distinct("source").alias("n"), F.avg("reputation").alias("q"))
    return s.select("story_id", Q.source_balance(F.col("n"), F.col("q")).alias("balance"))


CAT = sql_list(CATEGORIES)


@register("vote_category", with_articles(f"""SELECT story_id, category, votes FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY votes DESC, list_position({CAT}, category)) AS r
 FROM (SELECT {STORY} AS story_id, unnest(tags) AS category, count(*) AS votes FROM articles GROUP BY 1, 2)) WHERE r = 1"""))
def vote_category(spark, sf_dir):
    return S.vote_category(articles(spark, sf_dir).withColumn("story_id", F.expr(STORY)), CATEGORIES).select("story_id", "category", "votes")


# The categories that a source's type prefers among those with equal votes.
PREFERENCES = {"business": ("business_tech",), "tech": ("business_tech",), "domestic": ("domestic",), "global": ("global",), "culture": ("culture",), "finance": ("finance",), "mixed_tech_culture": ("business_tech", "culture")}
# End of fixed values.
TYPES = (*PREFERENCES, "wire")


@register("vote_by_source_type", with_articles(f"""SELECT story_id, category FROM (SELECT story_id, category, votes, said, row_number() OVER (PARTITION BY story_id ORDER BY votes DESC, said DESC, list_position({CAT}, category)) AS r FROM
 (SELECT v.story_id, v.category, votes, coalesce(said, 0) AS said FROM (SELECT {STORY} AS story_id, unnest(tags) AS category, count(*) AS votes FROM articles GROUP BY 1, 2) v LEFT JOIN
 (SELECT {STORY} AS story_id, category, count(*) AS said FROM articles JOIN (VALUES {', '.join(f"('{t}', '{c}')" for t, cs in PREFERENCES.items() for c in cs)}) p(t, category) ON t = {sql_list(TYPES)}[article_id * 5 % 8 + 1] GROUP BY 1, 2) s ON s.story_id = v.story_id AND s.category = v.category)) WHERE r = 1"""))
def vote_by_source_type(spark, sf_dir):
    """Categories by votes, ties by what the types of a story's sources prefer, then by the list's order."""
    a = articles(spark, sf_dir).withColumn("story_id", F.expr(STORY))
    votes = a.select("story_id", F.explode("tags").alias("tag")).groupBy("story_id", "tag").agg(F.count(F.lit(1)).alias("votes"))
    types = a.select("story_id", F.element_at(T.words_in(TYPES), (F.col("article_id") * 5 % 8 + 1).cast("int")).alias("source_type"))
    left = Sel.prefer_by_source_type(votes, types, PREFERENCES, ["story_id"])
    rank = F.array_position(T.words_in(CATEGORIES), F.col("tag"))
    return left.groupBy("story_id").agg(F.min_by("tag", rank).alias("category"))


@register("hint_counts", with_articles(f"SELECT c AS category, coalesce(n, 0) AS articles FROM (SELECT unnest({sql_list(CATEGORIES + ('unclassified',))}) AS c) LEFT JOIN (SELECT unnest(tags) AS t, count(*) AS n FROM articles GROUP BY 1) ON c = t"))
def hint_counts(spark, sf_dir):
    return A.counts_by_tag(articles(spark, sf_dir), CATEGORIES + ("unclassified",)).withColumnRenamed("n", "articles")


@register("importance_summary", f"""WITH o AS (SELECT o_orderpriority AS category, o_totalprice AS x FROM orders)
 SELECT category, count(*) AS n, round(min(x), 2) AS least, round(median(x), 2) AS middle, round(max(x), 2) AS most FROM o GROUP BY category""")
def importance_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("o_totalprice"), 2).alias("least"), F.round(F.median("o_totalprice"), 2).alias("middle"), F.round(F.max("o_totalprice"), 2).alias("most")
    )


@register("skipped_stories", SCORES.replace("SELECT story_id, sources, round(impact, 6) AS impact, round(", "SELECT story_id, CASE WHEN story_id % 11 = 0 THEN 'stale' WHEN story_id % 7 = 0 THEN '' WHEN penalty >= 1.0 THEN 'low content quality' WHEN quality < 0.55 AND sources <= 1 THEN 'low source quality' WHEN sources <= 1 AND impact < 3 THEN 'no confirmation' ELSE 'category full' END AS reason, round(").split(", round(frequency")[0] + " FROM parts")
def skipped_stories(spark, sf_dir):
    existing = F.when(F.col("story_id") % 11 == 0, "stale")
    reason = S.skip_reason(existing, F.col("story_id") % 7 == 0, F.col("penalty"), F.col("quality"), F.col("sources"), F.col("impact"))
    return stories(spark, sf_dir).select("story_id", reason.alias("reason"))


@register("review_stratum", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'selected' WHEN o_orderkey % 10 = 0 THEN 'hard_reject' WHEN s >= 5 THEN 'near_miss' WHEN s >= 0 THEN 'mid' ELSE 'deep_filtered' END AS stratum
 FROM (SELECT o_orderkey, o_totalprice / 10000 - 12 AS s FROM orders)""")
def review_stratum(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.review_stratum(k % 9 == 0, k % 10 == 0, F.col("o_totalprice") / 10000 - 12, 25).alias("stratum"))


_NAMED = "CASE article_id % 6 WHEN 0 THEN ['AAA'] WHEN 1 THEN ['BRK-B'] WHEN 2 THEN ['AAPL', 'XYZ'] WHEN 3 THEN ['AAA'] ELSE [] END"


@register("stock_mentions", with_articles(f"""SELECT symbol, count(*) AS n, array_to_string(list_slice(list(title ORDER BY seq), 1, 5), '|') AS headlines, array_to_string(list_slice(list_sort(list_distinct(list(source))), 1, 5), ',') AS sources,
 row_number() OVER (ORDER BY count(*) DESC, least(count(DISTINCT source), 5) DESC, symbol DESC) AS place FROM (SELECT seq, source, 'note ' || article_id AS title, unnest({_NAMED}) AS symbol FROM articles) GROUP BY symbol"""))
def stock_mentions(spark, sf_dir):
    notes = F.array(*[F.lit(n) for n in ("up ($AAA)", "NYSE: BRK.B climbs", "Apple and XYZ stock fall", "AAA shares", "the CEO (CEO)", "none")])
    a = articles(spark, sf_dir).select("seq", "source", F.concat(F.lit("note "), F.col("article_id").cast("string")).alias("title"), F.get(notes, (F.col("article_id") % 6).cast("int")).alias("headline"))
    m = S.stock_mentions(a.withColumn("symbols", X.headline_tickers(F.col("headline"))))
    return m.select("symbol", "n", F.array_join("headlines", "|").alias("headlines"), F.array_join("sources", ",").alias("sources"), F.col("place").cast("long").alias("place"))


@register("feed_health", evidence_sql("""SELECT source, n, round(a / n, 3) AS nonempty, round(b / n, 3) AS nonduplicate, round(c / n, 3) AS evident, valid, n >= 5 AND a / n >= 0.6 AND b / n >= 0.6 AND c / n >= 0.6 AND valid AND policy AND rich AS healthy
 FROM (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (trim(summary) <> '') AS a, count(*) FILTER (trim(summary) <> '' AND lower(trim(summary)) <> lower(trim(title))) AS b, count(*) FILTER (ev >= 1.2) AS c,
 bool_and(article_id % 997 <> 5) AS valid, bool_and(url LIKE 'https://%') AS policy, arg_max(length(summary) >= 300, (round(ev, 6), -article_id)) AS rich FROM evidence WHERE minute >= 1000 GROUP BY source)"""))
def feed_health(spark, sf_dir):
    e = evidence(spark, sf_dir).withColumn("evidence", F.round("evidence", 6)).where("minute >= 1000")
    e = e.withColumn("valid", F.col("article_id") % 997 != 5).withColumn("permitted", F.startswith("url", F.lit("https://")))
    return S.feed_health(e).select("source", "n", *[F.round(c, 3).alias(c) for c in ("nonempty", "nonduplicate", "evident")], "valid", "healthy")


_LOG_DAY = "DATE '2024-03-01' + CAST(article_id % 9 AS INT)"


@register("write_logs", gate_sql(f"""SELECT 'rejections' AS kind, {_LOG_DAY} AS day, url, reason, CAST(NULL AS DOUBLE) AS score, CAST(1 AS BIGINT) AS parts, true AS whole FROM penalised WHERE reason IS NOT NULL
 UNION ALL SELECT 'skipped', {_LOG_DAY}, url, CASE WHEN article_id % 3 = 0 THEN 'stale' ELSE 'category full' END, round(length(summary) / 7.0, 2), len(tags), true FROM articles WHERE article_id % 3 < 2 AND article_id % 9 <> 4
 UNION ALL SELECT 'audit', {_LOG_DAY}, url, CASE WHEN article_id % 5 = 0 THEN 'failed' WHEN article_id % 4 = 0 THEN 'warning' WHEN article_id % 5 < 3 THEN 'passed' ELSE 'not_run' END, round(least(1.0, length(summary) / 1000.0), 6), CAST(1 AS BIGINT), true FROM articles"""))
def write_logs(spark, sf_dir):
    """Three logs in dated folders, each written by a first run, of other reasons and one day more, and by the run that
    counts, then read back beside what the manifest says of their days."""
    a = articles(spark, sf_dir).withColumn("day", F.date_add(F.lit("2024-03-01").cast("date"), (F.col("article_id") % 9).cast("int")))
    k, root = F.col("article_id"), fresh_path(spark, "logs")
    days = a.select("day").distinct()
    refused = a.withColumn("reason", Q.hard_reject_reason(F.col("title"), F.col("summary"))).where("reason IS NOT NULL")
    passed = a.select("day", k.cast("string").alias("story_id"), "title", F.col("tags")[0].alias("category"), (F.length("summary") / 7).alias("total"), F.lit(1.0).alias("importance"), F.when(k % 3 == 0, "stale").when(k % 3 == 1, "category full").otherwise("").alias("reason"),
        F.array("source").alias("sources"), F.array("url").alias("urls"), F.col("tags").alias("matches"))
    story = k.cast("string").alias("story_id")
    ratio = F.least(F.lit(1.0), F.length("summary") / 1000).alias("ratio")
    status = F.when(k % 5 == 0, "kept_original_guard_failed").when(k % 5 < 3, "compressed").otherwise("skipped_short")
    cuts = a.select("day", story, F.col("tags")[0].alias("category"), F.col("summary").alias("full"), F.substring("summary", 1, 400).alias("delivered"), status.alias("status"), ratio)
    evidence = a.select(story, "seq", "source", "url", F.lit("").alias("canonical_url"), F.lit("feed").alias("status"))
    now = {
        "rejections": D.rejection_rows(refused),
        "skipped": D.skipped_rows(passed.where(F.dayofmonth("day") != 5)),
        "audit": D.audit_rows(cuts, evidence, a.where(k % 4 == 0).select(story)),
    }
    first = {"rejections": D.rejection_rows(a.withColumn("reason", F.lit("draft"))), "skipped": D.skipped_rows(passed.withColumn("reason", F.lit("draft"))), "audit": now["audit"].withColumn("guard_result", F.lit("draft"))}
    for rows in (first, now):
        for kind, log in rows.items():
            D.write_log(log, root, kind, days)
    found = {
        "rejections": D.read_log(spark, root, "rejections", "url string, reason string").select("day", "url", "reason", F.lit(None).cast("double").alias("score"), F.lit(1).cast("bigint").alias("parts")),
        "skipped": D.read_log(spark, root, "skipped", "url string, reason_skipped string, score double, watchlist_match array<string>").select("day", "url", F.col("reason_skipped").alias("reason"), "score", F.size("watchlist_match").cast("bigint").alias("parts")),
        "audit": D.read_log(spark, root, "audit", "guard_result string, compression_ratio double, evidence array<struct<url string>>").select("day", F.col("evidence")[0]["url"].alias("url"), F.col("guard_result").alias("reason"), F.round("compression_ratio", 6).alias("score"), F.size("evidence").cast("bigint").alias("parts")),
    }
    out = [rows.join(D.verify(spark, root, kind).select("day", "whole"), "day").select(F.lit(kind).alias("kind"), "day", "url", "reason", "score", "parts", "whole") for kind, rows in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])
