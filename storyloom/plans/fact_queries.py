"""Queries of sentences, figures, anchors, tickers and filing events, and of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts as X
from ..functions import text as T
from ..operators import selection as Sel
from ..operators import stories as So
from ..session import cut, fresh_path
from ..sources import reference_data as Ref
from ..streaming import cache, leaders
from ..streaming import state as stream
from .adapters import CATEGORIES, articles, table, with_articles
from .text_queries import sql_ascii, sql_list, sql_names

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


@register("explode_sentences")
def explode_sentences(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", F.posexplode(X.split_sentences(F.col("summary"))).alias("pos", "sentence"))


@register("extractive_summary")
def extractive_summary(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("article_id", X.extractive_summary(F.col("title"), F.col("summary")).alias("paragraph"), X.headline(F.col("summary")).alias("headline"))


_FACTS = " It rose +5.50% to $1,200.00 million, by 30 basis points, or 40 euros and 7 pounds, on Monday in 2024; €3.10 billion, £ 4, − 2.5 percentage points, −£7 and 6\u00a0bps"
_VALUE = "replace(regexp_extract(lower(m), '([0-9][0-9,.]*)', 1), ',', '')"
_MONEY = "CASE WHEN contains(m, '$') THEN 'usd' WHEN contains(m, '€') THEN 'eur' WHEN contains(m, '£') THEN 'gbp' WHEN contains(lower(m), 'dollar') THEN 'usd' WHEN contains(lower(m), 'euro') THEN 'eur' WHEN contains(lower(m), 'pound') THEN 'gbp' END"
_UNIT = "CASE WHEN contains(lower(m), 'percentage') THEN 'percentage_points' WHEN regexp_matches(lower(m), '%|percent') THEN '%' WHEN regexp_matches(lower(m), 'basis|bps') THEN 'basis_points' END"
_NORMAL = f"""concat_ws(':', coalesce({_MONEY}, 'num'), regexp_extract(lower(m), '([+-])', 1) || CASE WHEN contains({_VALUE}, '.') THEN regexp_replace(regexp_replace({_VALUE}, '0+$', ''), '\\.$', '') ELSE {_VALUE} END,
  nullif(regexp_extract(lower(m), '(thousand|million|billion|trillion)', 1), ''), CASE WHEN {_MONEY} IS NULL THEN {_UNIT} END)"""


@register("protected_facts", f"""SELECT doc_id, array_to_string(list_sort(list_concat(list_transform(regexp_extract_all(plain, '{X.FIGURE}'), lambda m: {_NORMAL}), list_transform(regexp_extract_all(lower(t), '\\b({'|'.join(X.DATES)})\\b'), lambda d: 'date:' || d))), '|') AS facts
 FROM (SELECT doc_id, replace(x, '−', '-') AS plain, {sql_ascii("x")} AS t FROM (SELECT doc_id, coalesce(text, '') || '{_FACTS}' AS x FROM documents))""")
def protected_facts(spark, sf_dir):
    """Documents with a closing sentence that holds figures of each kind, and dates."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(_FACTS))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.sort_array(X.figures(text)), "|").alias("facts"))


_KINDS = (("negation", X.NEGATIONS), ("modality", X.MODALS), ("attribution", X.ATTRIBUTIONS), ("causal", X.CAUSES))
ANCHORS = "list_concat(" + ", ".join(f"list_transform(regexp_extract_all(t, '\\b({'|'.join(w).replace(chr(39), chr(39) * 2)})\\b'), lambda m: '{k}:' || regexp_replace(m, '\\s+', ' ', 'g'))" for k, w in _KINDS) + ")"


@register("semantic_anchors", "SELECT doc_id, array_to_string(list_sort(" + ANCHORS + "), '|') AS anchors FROM (SELECT doc_id, lower(" + sql_ascii("coalesce(text, '') || ' They said it was not, according  to plans, due to what might come'") + ") AS t FROM documents)")
def semantic_anchors(spark, sf_dir):
    """Documents with a closing sentence that holds an anchor of each kind."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" They said it was not, according  to plans, due to what might come"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.sort_array(X.anchors(text)), "|").alias("anchors"))


_NAMES = " Übung in Zürich: José O''Neil, Señor Łódź and Müller-Lüdenscheidt met A.B1 of X9"


@register("capitalized_words", f"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct({sql_names('t')}), lambda w: NOT list_contains({sql_list(X.ENTITY_WORDS)}, w))), ' ') AS words FROM (SELECT doc_id, coalesce(text, '') || '{_NAMES}' AS t FROM documents)")
def capitalized_words(spark, sf_dir):
    """Documents with a closing sentence of accented names."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(_NAMES.replace("''", "'")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.sort_array(X.capitalized(text)), " ").alias("words"))


#: Sentences that real texts are put between, by id, so that patterns meet them among other words.
_NOTES = ("Deal lifts $ABC as US waits", "NYSE: BRK.B climbs", "Apple and XYZ stock fall", "The CEO (CEO) spoke", "(TSLA) and NASDAQ QQQ", "nothing here")


def noted(spark, sf_dir):
    k = F.col("doc_id")
    notes = F.array(*[F.lit(n) for n in _NOTES])
    # the text around the note is real prose without capitals, which alone can make a symbol
    prose = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select(k, F.concat(prose, F.lit(" ; "), F.get(notes, (k % len(_NOTES)).cast("int")), F.lit(" ; "), prose).alias("t"))


@register("headline_tickers", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(named, list_filter([{', '.join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '(^|[^a-z0-9_]){a}([^a-z0-9_]|$)') THEN '{v}' END" for a, v in X.ALIASES.items())}], lambda v: v IS NOT NULL)))), ',') AS tickers
 FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS text, CASE doc_id % 6 WHEN 0 THEN ['ABC'] WHEN 1 THEN ['BRK-B'] WHEN 2 THEN ['AAPL', 'XYZ'] WHEN 4 THEN ['TSLA'] ELSE [] END AS named FROM documents)""")
def headline_tickers(spark, sf_dir):
    return noted(spark, sf_dir).select("doc_id", F.array_join(F.sort_array(X.headline_tickers(F.col("t"))), ",").alias("tickers"))


@register("explicit_tickers", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'ABC' WHEN 1 THEN 'BRK-B' WHEN 3 THEN 'CEO' WHEN 4 THEN 'QQQ,TSLA' ELSE '' END AS tickers FROM documents")
def explicit_tickers(spark, sf_dir):
    return noted(spark, sf_dir).select("doc_id", F.array_join(F.sort_array(X.explicit_tickers(F.col("t"))), ",").alias("tickers"))


_EVENT_CASES = " ".join(f"WHEN regexp_matches(t, '{'|'.join(terms)}') THEN '{name}'" for terms, name in X.EVENTS)


@register("filing_event", f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) || CASE doc_id % 7 WHEN 0 THEN ' q2 2024 sales, guidance raised' WHEN 1 THEN ' new guidance' WHEN 2 THEN ' a share buyback' WHEN 3 THEN ' the new ceo of it' WHEN 4 THEN ' dividend up' ELSE '' END AS t,
  CASE WHEN doc_id % 7 = 5 THEN 'new_plant_opened' ELSE 'company_update' END AS other FROM documents), r AS (SELECT *, regexp_matches(t, '\\bq[1-4]\\s+20[0-9]{{2}}\\b|financial results|quarterly results|financial report|earnings') AS results, regexp_matches(t, 'outlook|guidance') AS outlook FROM d)
 SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'financial_results' WHEN results AND outlook THEN 'financial_results_outlook' WHEN results THEN 'financial_results' WHEN outlook THEN 'financial_outlook' {_EVENT_CASES} ELSE other END AS event_key FROM r""")
def filing_event(spark, sf_dir):
    """Whole documents as filings, some of them with a sentence about an event."""
    k = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    for i, t in enumerate((" Q2 2024 sales, guidance raised", " New guidance", " a share buyback", " the new ceo of it", " Dividend up")):
        text = F.when(k % 7 == i, F.concat(F.coalesce("text", F.lit("")), F.lit(t))).otherwise(text)
    description = F.when(k % 7 == 5, "New plant: opened.").otherwise("Form 8-K")
    return table(spark, sf_dir, "documents").select(k, X.filing_event(F.lit("8-K"), F.when(k % 9 == 0, F.array(F.lit("2.02"))).otherwise(F.array(F.lit("8.01"))), text, description).alias("event_key"))


_HEADS = (" Q2 2024 results: raised guidance; adjusted sales growth rose by 4.5 % and adjusted operating profit increased by 7%", " outlook cut, earnings of 2023", " earnings", " Q3 2022 quarterly results", " new guidance", " a share buyback", "")
_UPDATES = " ".join(f"WHEN regexp_matches(low, '{'|'.join(terms)}') THEN '{X.HEADLINES[name]}'" for terms, name in X.EVENTS)
_FOUND = "nullif(regexp_extract(t, '(?i){}', 1), '')".format


@register("filing_headline", f"""WITH d AS (SELECT doc_id, coalesce(text, '') || {sql_list(_HEADS)}[doc_id % 7 + 1] AS t, 'Firm ' || doc_id AS who, CASE doc_id % 5 WHEN 0 THEN '2.02' ELSE '8.01' END AS item, doc_id % 11 = 0 AS empty, CASE doc_id % 4 WHEN 0 THEN '10-Q' WHEN 1 THEN '20-F' ELSE '8-K' END AS form FROM documents),
 e AS (SELECT * REPLACE (CASE WHEN empty THEN '' ELSE t END AS t), lower(CASE WHEN empty THEN '' ELSE t END) AS low FROM d),
 r AS (SELECT *, regexp_matches(low, '\\bq[1-4]\\s+20[0-9]{{2}}\\b|financial results|quarterly results|financial report|earnings') AS results, regexp_matches(low, 'outlook|guidance') AS outlook, {_FOUND('\\b(q[1-4])\\s+20[0-9]{2}\\b')} AS q, {_FOUND('\\bq[1-4]\\s+(20[0-9]{2})\\b')} AS qy, {_FOUND('\\b(20[0-9]{2})\\b')} AS y,
  {_FOUND('adjusted sales(?: growth)?\\s+(?:increased|rose)\\s+by\\s+([0-9]+(?:\\.[0-9]+)?)\\s*%')} AS sales, {_FOUND('adjusted operating profit(?: growth)?\\s+(?:increased|rose)\\s+by\\s+([0-9]+(?:\\.[0-9]+)?)\\s*%')} AS profit FROM e)
 SELECT doc_id, coalesce(who || ' ' || CASE WHEN item = '2.02' THEN 'reported financial results' WHEN form IN ('10-Q', '20-F') AND trim(t) = '' THEN 'filed its ' || CASE form WHEN '10-Q' THEN 'quarterly' ELSE 'annual' END || ' financial report'
   WHEN results AND outlook THEN CASE WHEN regexp_matches(t, '(?i)\\b(?:raise[sd]?|improved)\\b') THEN 'raised' WHEN regexp_matches(t, '(?i)\\b(?:lower(?:ed|s)?|cut|reduced)\\b') THEN 'lowered' ELSE 'updated' END || ' its' || coalesce(' ' || coalesce(qy, y), '') || ' sales and profit outlook' || coalesce(' after adjusted ' || upper(q) || ' sales rose ' || sales || '% and adjusted profit rose ' || profit || '%', ' after reporting quarterly results')
   WHEN results THEN 'reported' || coalesce(' ' || upper(q) || ' ' || qy, '') || ' financial results' WHEN outlook THEN '{X.HEADLINES["financial_outlook"]}' {_UPDATES} END, CASE WHEN doc_id % 3 = 0 THEN who || ': New plant' ELSE who || ' filed an important company update' END) || '.' AS headline FROM r""")
def filing_headline(spark, sf_dir):
    """Whole documents as filings, most with a sentence about results or an outlook, some empty, of issuers of each legal form."""
    k = F.col("doc_id")
    forms = F.array(*[F.lit(x) for x in (" A/S", " Inc.", " Corporation", " corp", " Ltd", " Limited", " PLC", "")])
    text = F.when(k % 11 == 0, "").otherwise(F.concat(F.coalesce("text", F.lit("")), F.get(T.words_in(_HEADS), (k % 7).cast("int"))))
    form = F.when(k % 4 == 0, "10-Q").when(k % 4 == 1, "20-F/A").otherwise("8-K")
    items = F.when(k % 5 == 0, F.array(F.lit("2.02"))).otherwise(F.array(F.lit("8.01")))
    issuer = F.concat(F.lit(" Firm "), k.cast("string"), F.get(forms, (k % 8).cast("int")))
    return table(spark, sf_dir, "documents").select(k, X.filing_headline(form, items, text, F.when(k % 3 == 0, "New plant.").otherwise("Form 8-K"), issuer).alias("headline"))


@register("vote_lane", with_articles(f"""SELECT story_id, lane FROM (SELECT run_id * 40 + article_id % 40 AS story_id, unnest(tags) AS lane, count(*) AS n FROM articles GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY n DESC, list_position({sql_list(CATEGORIES[::-1])}, lane)) = 1"""))
def vote_lane(spark, sf_dir):
    from ..operators.scoring import vote_category

    a = articles(spark, sf_dir).withColumn("story_id", F.expr("run_id * 40 + article_id % 40"))
    return vote_category(a, CATEGORIES[::-1]).select("story_id", F.col("category").alias("lane"))


@register("classification_pool")
def classification_pool(spark, sf_dir):
    """The best thirty of an edition, then ten of each category in turn."""
    a = articles(spark, sf_dir).select("run_id", F.col("article_id").alias("id"), (-F.col("minute")).alias("rank"), "tags")
    return Sel.global_first(a, CATEGORIES, 30, 10, 80)


def landed(spark, sf_dir):
    """Events as a folder that a stream can read."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("alert_id"), "event_type", F.col("ts").cast("timestamp").alias("at"))
    return cut(e, "landed")


def drained(frame, label: str):
    """What a stream writes until its input is used up."""
    spark = frame.sparkSession
    out, marks = fresh_path(spark, label), fresh_path(spark, f"{label}-checkpoint")
    frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def stream_of(frame):
    root = frame.inputFiles()[0].rsplit("/", 1)[0]
    return frame.sparkSession.readStream.schema(frame.schema).parquet(root)


@register("stream_alerts")
def stream_alerts(spark, sf_dir):
    """Alerts sent under the cooldown, as a stream with state for each alert."""
    sent = stream.cooldown(stream_of(landed(spark, sf_dir)).select("alert_id", "at"))
    return drained(sent, "alerts").select("alert_id", F.unix_micros("at").alias("at_us"))


@register("stream_suppress")
def stream_suppress(spark, sf_dir):
    """How many events of a key a stream lets pass, and when the first and the last of them were."""
    first = stream.suppress_repeats(stream_of(landed(spark, sf_dir)), ["alert_id", "event_type"], "at")
    us = F.unix_micros("at")
    return drained(first, "suppressed").groupBy("alert_id", "event_type").agg(F.count(F.lit(1)).alias("passed"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


@register("stream_leaders")
def stream_leaders(spark, sf_dir):
    """Stories of each source by the sequential rule, over articles that come in four lots of neighbouring ids; the stream is
    started anew from its checkpoint for every lot."""
    own = cut(So.with_sets(articles(spark, sf_dir)).select("source", "article_id", "seq", "minute", "tokens", "entities", "events"), "articles")
    root, out, marks = (fresh_path(spark, x) for x in ("arriving", "leaders", "leaders-checkpoint"))
    bounds = [-1, *own.approxQuantile("seq", [0.25, 0.5, 0.75], 0.01), None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        lot = own.where(F.col("seq") > low) if high is None else own.where((F.col("seq") > low) & (F.col("seq") <= high))
        lot.write.mode("append").parquet(root)
        stories = leaders.stream_leaders(spark.readStream.schema(own.schema).parquet(root), "source")
        stories.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stories.schema).parquet(out)


@register("stream_daily_cache", """WITH f AS (SELECT event_id AS fetch_id, user_id % 40 AS source_id, event_type AS discovery_key, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events WHERE event_id % 3 > 0)
 SELECT source_id, discovery_key, CAST(day AS BIGINT) AS day, min(fetch_id) AS fetch_id FROM f GROUP BY ALL""")
def stream_daily_cache(spark, sf_dir):
    """Events as fetches of sources, a third of which fail; day after day they come, and each day comes twice."""
    e = table(spark, sf_dir, "events")
    f = e.select((F.col("user_id") % 40).alias("source_id"), F.col("event_type").alias("discovery_key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("fetch_id"), (F.col("event_id") % 3 > 0).alias("ok"), F.col("props").alias("body"))
    f = cut(f, "fetches")
    day = F.floor(F.unix_millis("at") / cache.DAY_MS)
    low, high = f.agg(F.min(day), F.max(day)).first()
    step = max(1, -(-(high - low + 1) // 4))
    root, out, marks = (fresh_path(spark, x) for x in ("fetched", "cache", "cache-checkpoint"))
    for k in range(8):
        first = low + k // 2 * step
        lot = f.where(day.between(first, first + step - 1))
        (lot if k % 2 == 0 else lot.withColumn("fetch_id", F.col("fetch_id") + 10**9)).write.mode("append").parquet(root)
        kept = cache.once_a_day(spark.readStream.schema(f.schema).parquet(root), days=step)
        kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(out).select("source_id", "discovery_key", "day", "fetch_id")


@register("enrichment_select")
def enrichment_select(spark, sf_dir):
    """Stories worth fetching pages for: the best twenty, then each category in turn up to eight, sixty of an edition."""
    a = articles(spark, sf_dir).select("run_id", F.col("article_id").alias("id"), (-F.length("summary")).alias("rank"), "tags")
    return Sel.global_first(a, CATEGORIES, 20, 8, 60)


def votes(spark, sf_dir):
    a = articles(spark, sf_dir).select("run_id", F.expr("run_id * 40 + article_id % 40").alias("id"), F.explode("tags").alias("tag"))
    return a.groupBy("run_id", "id", "tag").agg(F.count(F.lit(1)).alias("votes"))


@register("vote_category_balanced")
def vote_category_balanced(spark, sf_dir):
    return Sel.vote_category_balanced(votes(spark, sf_dir), CATEGORIES)


@register("selection_outcomes")
def selection_outcomes(spark, sf_dir):
    """Why each story is in the deck or is not."""
    from .join_queries import deck

    return deck(spark, sf_dir).select("run_id", "id", "phase", "reason")


@register("watchlist_score", with_articles("""SELECT article_id, CASE WHEN article_id % 3 = 0 THEN round(least(2.0, 0.35::DOUBLE * w), 6) ELSE round(least(0.1, 0.35::DOUBLE * w), 6) END AS score
 FROM (SELECT article_id, 1.5 * CAST(contains(lower(summary), 'the') AS INT) + 2.5 * CAST(contains(lower(summary), 'und') AS INT) + CAST(contains(lower(summary), 'que') AS INT) AS w FROM articles)"""))
def watchlist_score(spark, sf_dir):
    from ..operators.scoring import watchlist_score as score

    low = F.lower("summary")
    weights = 1.5 * F.contains(low, F.lit("the")).cast("int") + 2.5 * F.contains(low, F.lit("und")).cast("int") + F.contains(low, F.lit("que")).cast("int")
    return articles(spark, sf_dir).select("article_id", F.round(score(weights, F.col("article_id") % 3 == 0), 6).alias("score"))


@register("bind_run", with_articles("SELECT article_id, sha256('run-' || run_id || '|' || url) AS record_id FROM articles"))
def bind_run(spark, sf_dir):
    """Record ids hashed anew under the final run id."""
    return articles(spark, sf_dir).select("article_id", F.sha2(F.concat(F.lit("run-"), F.col("run_id").cast("string"), F.lit("|"), "url"), 256).alias("record_id"))


@register("gate_progress", "SELECT source, greatest(0, 20 - count(quality)) AS remaining FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def gate_progress(spark, sf_dir):
    """Reviews that each source still lacks."""
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.greatest(F.lit(0), 20 - F.count("quality")).alias("remaining"))


@register("miss_rate", "SELECT lang, count(*) AS n, round(count(*) FILTER (toxic = 1 AND doc_id % 4 = 0)::DOUBLE / nullif(count(*) FILTER (toxic = 1), 0), 6) AS rate, count(*) FILTER (toxic = 1) >= 10 AS reportable FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def miss_rate(spark, sf_dir):
    """The share of positives that were missed, and whether there are enough of them to report it."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    hit, missed = F.count_if(F.col("toxic") == 1), F.count_if((F.col("toxic") == 1) & (F.col("doc_id") % 4 == 0))
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.try_divide(missed, hit), 6).alias("rate"), (hit >= 10).alias("reportable"))


@register("rewrite_summary", "SELECT l_shipinstruct AS status, count(*) AS n, round(median(l_discount), 6) AS ratio FROM (SELECT l_returnflag || l_linestatus AS l_shipinstruct, l_discount FROM lineitem) GROUP BY 1")
def rewrite_summary(spark, sf_dir):
    """Rewrites by status, with their median ratio."""
    li = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("status"), "l_discount")
    return li.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("l_discount"), 6).alias("ratio"))


@register("load_dims", "SELECT c_custkey AS id, c_name AS label, CASE WHEN c_custkey % 7 = 0 THEN 'no weight' WHEN n_regionkey > 3 THEN 'unknown region' ELSE '' END AS problem FROM customer JOIN nation ON n_nationkey = c_nationkey")
def load_dims(spark, sf_dir):
    """Reference entries read from JSON, each with what is wrong with it."""
    n = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    weight = F.when(F.col("c_custkey") % 7 != 0, F.lit(1.0))
    j = n.select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("n_regionkey").alias("region"), weight.alias("weight"))).alias("j"))
    e = j.select(F.from_json("j", "id bigint, label string, region int, weight double").alias("e")).select("e.*")
    known = table(spark, sf_dir, "region").where("r_regionkey <= 3").select(F.col("r_regionkey").alias("region"), F.lit(True).alias("known"))
    problem = F.when(F.col("weight").isNull(), "no weight").when(F.col("known").isNull(), "unknown region").otherwise("")
    return e.join(known, "region", "left").select("id", "label", problem.alias("problem"))


@register("load_watchlists", """WITH c AS (SELECT c_custkey AS k, c_custkey // 100 AS file, c_custkey // 100 % 4 AS form, c_name, c_mktsegment FROM customer),
 f AS (SELECT *, form = 0 AND file % 8 = 4 AS broken FROM c)
 SELECT file, k AS item, c_name AS label, c_mktsegment AS aliases, 'C' || k % 50 AS ticker, CASE WHEN k % 7 = 0 THEN 1.0 ELSE k % 7 END::DOUBLE AS weight, NULL AS reason FROM f WHERE NOT broken AND k % 13 > 0 AND NOT (form = 1 AND k % 17 = 0)
 UNION ALL SELECT file, NULL, NULL, NULL, NULL, NULL, 'json' FROM f WHERE form = 1 AND k % 17 = 0
 UNION ALL SELECT file, NULL, NULL, NULL, NULL, NULL, 'no label' FROM f WHERE NOT broken AND k % 13 = 0 AND NOT (form = 1 AND k % 17 = 0)
 UNION ALL SELECT DISTINCT file, NULL, NULL, NULL, NULL, NULL, 'json' FROM f WHERE broken""")
def load_watchlists(spark, sf_dir):
    """Customers as entries of watchlists, a hundred a file, in four formats; some entries have no label, some lines of JSON and
    one JSON file in eight are broken."""
    k, name = F.col("c_custkey"), F.when(F.col("c_custkey") % 13 != 0, F.col("c_name")).otherwise("")
    ticker, weight = F.concat(F.lit("c"), (k % 50).cast("string")), F.when(k % 7 > 0, k % 7)
    record = F.to_json(F.struct(name.alias("label"), F.array("c_mktsegment", F.lit(" ")).alias("aliases"), ticker.alias("ticker"), weight.alias("weight"), k.alias("id")))
    line = lambda n, v: F.concat(F.lit(f"{n}"), v, F.lit("\n"))
    toml = F.concat(line("[[items]]\nlabel = ", F.concat(F.lit('"'), name, F.lit('"'))), line("aliases = ", F.concat(F.lit('["'), "c_mktsegment", F.lit('"]'))), line("ticker = ", F.concat(F.lit('"'), ticker, F.lit('"'))), line("id = ", k.cast("string")), F.coalesce(line("weight = ", weight.cast("string")), F.lit("")))
    yaml = F.concat(line("- name: ", name), line("  aliases:\n    - ", F.col("c_mktsegment")), line("  ticker: ", ticker), line("  id: ", k.cast("string")), F.coalesce(line("  weight: ", weight.cast("string")), F.lit("")))
    form = F.expr("c_custkey div 100 % 4")
    entry = F.when(form == 0, record).when(form == 1, F.when(k % 17 == 0, F.substring(record, 1, 12)).otherwise(record)).when(form == 2, toml).otherwise(yaml)
    c = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 100").alias("file"), form.alias("form"), F.struct(k.alias("k"), entry.alias("e")).alias("x"))
    each = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"])
    names = T.words_in(("json", "jsonl", "toml", "yaml"))
    whole = F.when(F.col("form") == 0, F.concat(F.lit("[\n"), F.array_join("e", ",\n"), F.when(F.col("file") % 8 == 4, "\n").otherwise("\n]"))).otherwise(F.array_join("e", "\n"))
    files = c.groupBy("file", "form").agg(each.alias("e")).select(F.element_at(names, F.col("form").cast("int") + 1).alias("format"), "file", whole.alias("value"))
    root = fresh_path(spark, "watchlists")
    files.write.partitionBy("format", "file").text(root)
    read = Ref.read_items(spark, root, pathGlobFilter="*.txt")
    got = Ref.watchlist(read).join(read.select("path", "pos", F.get_json_object("body", "$.id").cast("bigint").alias("id")), ["path", "pos"])
    good = F.col("reason").isNull()
    return got.select(
        F.regexp_extract("path", "/file=([0-9]+)/", 1).cast("bigint").alias("file"), F.when(good, F.col("id")).alias("item"), F.when(good, F.col("label")).alias("label"), F.when(good, F.array_join("aliases", ",")).alias("aliases"),
        F.when(good, F.col("ticker")).alias("ticker"), F.when(good, F.col("weight")).alias("weight"), F.split("reason", ":")[0].alias("reason"),
    )


@register("stream_articles", "SELECT event_id % 5 <> 0 AS timestamp_valid, count(*) AS n FROM events GROUP BY 1")
def stream_articles(spark, sf_dir):
    """A stream whose rows without a valid time get the given one and a flag."""
    flagged = stream.split_invalid(stream_of(landed(spark, sf_dir)), "at", F.col("event_id") % 5 != 0, F.lit("2024-01-01").cast("timestamp"))
    return drained(flagged, "articles").groupBy("timestamp_valid").agg(F.count(F.lit(1)).alias("n"))


@register("stream_filings", "SELECT user_id % 50 AS alert_id, count(*) AS loaded, max(event_id) AS mark FROM events WHERE event_id >= 10 AND event_id <= 1000000000 GROUP BY 1")
def stream_filings(spark, sf_dir):
    """Filings loaded after their source's watermark; the same filings delivered again add nothing."""
    rows, root = stream_of(landed(spark, sf_dir)), fresh_path(spark, "filings")
    for load in ("first", "again"):
        stream.load_after_marks(rows, root, load, "alert_id", "event_id", F.lit(10**9), F.lit(10)).awaitTermination()
    loaded = spark.read.schema(rows.schema).parquet(f"{root}/rows").groupBy("alert_id").agg(F.count(F.lit(1)).alias("loaded"))
    marks = spark.read.schema("alert_id bigint, mark bigint").parquet(f"{root}/marks").groupBy("alert_id").agg(F.max("mark").alias("mark"))
    return loaded.join(marks, "alert_id").select("alert_id", "loaded", "mark")
