"""Queries of the scalar functions over articles and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import articles as A
from .adapters import QUOTES, articles, quotes, table, with_articles

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


def sql_list(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


STOP = sql_list(T.STOPWORDS)


def sql_tokens(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({STOP}, t)))"


def sql_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) END"


def sql_hits(text: str, terms) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches(lower({text}), '{T.whole_word(t)}') AS INT)" for t in terms) + ")"


@register("clean_text", """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
 regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'),
 '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM pages""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_text(F.col("html")).alias("text"))


@register("clean_title", with_articles("SELECT article_id, title FROM articles"))
def clean_title(spark, sf_dir):
    """Titles that end in their source, or are written in full-width letters, come back as they were."""
    a, k = articles(spark, sf_dir), F.col("article_id")
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    wide = F.translate("title", letters, "".join(chr(ord(c) + 0xFEE0) for c in letters))
    branded = F.when(k % 3 == 0, F.concat("title", F.lit("  - "), "source")).when(k % 3 == 1, F.concat(wide, F.lit(" \t "))).otherwise(F.col("title"))
    return a.select("article_id", T.clean_title(branded, F.col("source")).alias("title"))


def sql_page_text(page: str) -> str:
    """The page's text; the references are those that the tables hold."""
    out = f"regexp_replace(regexp_replace({page}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    for ref, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&middot;", "'·'"), ("&copy;", "'©'"), ("&amp;", "'&'")):
        out = f"replace({out}, '{ref}', {char})"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\r]+', ' ', 'g'))"


@register("html_to_text", f"SELECT page_id, {sql_page_text("coalesce(html, '')")} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@register("title_spam_filter", with_articles("""SELECT article_id FROM articles, (SELECT 1) WHERE NOT (length(summary) > 320
 OR length(summary) - length(regexp_replace(summary, '[！-～]', '', 'g')) >= 8 OR regexp_matches(summary, '<[A-Za-z/][^>]*$')
 OR regexp_matches(lower(summary), '(watch|stream)[a-z ]* (free|online|live stream)'))"""))
def title_spam_filter(spark, sf_dir):
    return articles(spark, sf_dir).where(~T.title_is_spam(F.col("summary"))).select("article_id")


@register("attribute_source", with_articles("""SELECT article_id, CASE WHEN article_id % 4 = 0 THEN source ELSE 'Feed ' || source END AS attributed FROM articles"""))
def attribute_source(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("feed", F.when(F.col("article_id") % 4 == 0, F.lit("Google News Top")).otherwise(F.concat(F.lit("Feed "), "source")))
    return a.select("article_id", A.attributed_source(F.col("feed"), F.col("source")).alias("attributed"))


@register("lookback", with_articles("SELECT article_id, minute FROM articles WHERE minute >= 4320 - 30 * 60"))
def lookback(spark, sf_dir):
    return A.within_hours(articles(spark, sf_dir), "minute", 4320, 30).select("article_id", "minute")


@register("parse_ts_valid", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 1704067200 ELSE CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) END AS epoch, event_id % 5 <> 0 AS valid FROM events""")
def parse_ts_valid(spark, sf_dir):
    """Texts in two formats, or in none; those in none get the given time and a flag."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    text = F.when(F.col("event_id") % 5 == 0, F.lit("soon")).when(F.col("event_id") % 2 == 0, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss xx")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    e = e.select("event_id", text.alias("t"))
    parsed = F.coalesce(F.try_to_timestamp(F.substring("t", 6, 40), F.lit("dd MMM yyyy HH:mm:ss xx")), F.try_to_timestamp("t", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    return e.select("event_id", F.coalesce(F.unix_seconds(parsed), F.lit(1704067200)).cast("long").alias("epoch"), parsed.isNotNull().alias("valid"))


@register("normalize_title", with_articles(f"SELECT article_id, array_to_string(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: NOT list_contains({STOP}, t)), ' ') AS normal FROM articles"))
def normalize_title(spark, sf_dir):
    a = articles(spark, sf_dir)
    branded = F.when(F.col("article_id") % 2 == 0, F.concat("title", F.lit(" | "), "source")).otherwise(F.col("title"))
    return a.select("article_id", T.normalize_title(branded, F.col("source")).alias("normal"))


@register("tokenize", with_articles(f"SELECT article_id, array_to_string(list_sort({sql_tokens('summary')}), ' ') AS tokens FROM articles"))
def tokenize(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", F.array_join(F.sort_array(T.tokenize(F.col("summary"))), " ").alias("tokens"))


@register("story_key", with_articles(f"""SELECT article_id, CASE WHEN len(k) = 0 THEN lower(title) ELSE array_to_string(list_slice(list_sort(k), 1, 8), ' ') END AS story_key
 FROM (SELECT *, {sql_tokens('title')} AS k FROM articles)"""))
def story_key(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", T.story_key(F.col("title"), F.col("source")).alias("story_key"))


@register("jaccard", with_articles(f"SELECT article_id, round({sql_jaccard('a', 'b')}, 9) AS similarity FROM (SELECT article_id, {sql_tokens('title')} AS a, {sql_tokens('summary')} AS b FROM articles)"))
def jaccard(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("article_id", F.round(T.jaccard(T.tokenize(F.col("title")), T.tokenize(F.col("summary"))), 9).alias("similarity"))


ENT = sql_list(T.ENTITY_STOPWORDS)


def sql_ascii(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}\\x00-\\x7F]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g')"


_SPELLED = "A-Za-zÀ-ÖØ-öø-ÿ''’.-"


def sql_names(text: str) -> str:
    """Capital words of a text, as a list with repeats: one that a sign of another alphabet or a digit follows ends before
    its last run of letters."""
    own = f"CASE WHEN regexp_matches(w, '[^{_SPELLED}]$') THEN regexp_replace(w, '[A-Za-zÀ-ÖØ-öø-ÿ]*[^{_SPELLED}]$', '') ELSE regexp_replace(w, '[''’.-]+$', '') END"
    return f"list_filter(list_transform(regexp_extract_all({text}, '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z][{_SPELLED}]*[\\p{{L}}\\p{{N}}_]?)', 1), lambda w: {own}), lambda w: w <> '')"


def sql_entities(text: str) -> str:
    ticker = r"(?:\$|\b(?:NASDAQ|NYSE|AMEX|NYSEARCA)\s*:?\s*)?([A-Z][A-Z0-9.-]{1,5})\b"
    text = sql_ascii(text)
    phrase = r"\b[A-Z][A-Za-z0-9&.-]*(?:\s+[A-Z][A-Za-z0-9&.-]*){0,3}\b"
    return (
        f"list_distinct(list_concat(list_transform(list_filter(regexp_extract_all({text}, '{ticker}', 1), lambda m: upper(m) = m AND length(m) > 1), lambda m: replace(m, '.', '-')), "
        f"list_transform(list_filter(list_transform(regexp_extract_all({text}, '{phrase}'), lambda p: trim(regexp_replace(p, '[ \\t\\n\\r]+', ' ', 'g'))), lambda p: NOT list_contains({ENT}, p) AND length(p) > 2), lambda p: lower(p))))"
    )


@register("extract_entities", with_articles(f"SELECT article_id, len({sql_entities('title')}) AS n, array_to_string(list_sort({sql_entities('title')}), '|') AS entities FROM articles"))
def extract_entities(spark, sf_dir):
    a = articles(spark, sf_dir)
    e = T.entities(F.col("title"))
    return a.select("article_id", F.size(e).cast("long").alias("n"), F.array_join(F.sort_array(e), "|").alias("entities"))


TOP_TERMS = ("the", "and", "der", "que", "les", "for", "with")


@register("event_terms", with_articles(f"SELECT article_id, array_to_string(list_sort(list_intersect({sql_tokens('summary')}, {sql_list(T.EVENT_TERMS)})), ' ') AS terms FROM articles"))
def event_terms(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", F.array_join(F.sort_array(T.event_terms(F.col("summary"))), " ").alias("terms"))


@register("time_proximity", with_articles("""SELECT a.article_id, b.article_id AS other_id, CAST(CASE WHEN abs(a.minute - b.minute) <= 180 THEN 1.0 WHEN abs(a.minute - b.minute) <= 720 THEN 0.7
 WHEN abs(a.minute - b.minute) <= 1440 THEN 0.35 ELSE 0.0 END AS DOUBLE) AS proximity FROM articles a JOIN articles b ON b.article_id = a.article_id + 1"""))
def time_proximity(spark, sf_dir):
    a = articles(spark, sf_dir).select("article_id", F.timestamp_seconds(F.col("minute") * 60).alias("at"))
    b = a.select((F.col("article_id") - 1).alias("article_id"), F.col("article_id").alias("other_id"), F.col("at").alias("then"))
    return a.join(b, "article_id").select("article_id", "other_id", T.time_proximity(T.hours_apart(F.col("at"), F.col("then"))).alias("proximity"))


@register("term_hits", with_articles(f"""SELECT article_id, {sql_hits('summary', T.MARKET_TERMS)} AS market, {sql_hits('summary', T.SOCIAL_TERMS)} AS social, {sql_hits('summary', T.FORWARD_TERMS)} AS forward,
 {sql_hits('summary', TOP_TERMS)} AS common, regexp_matches(lower(title), 'timeline|explainer|explained|everything we know|what to know|what we know|a look at|recap') AS retrospective FROM articles"""))
def term_hits(spark, sf_dir):
    s = F.col("summary")
    return articles(spark, sf_dir).select(
        "article_id", T.term_hits(s, T.MARKET_TERMS).alias("market"), T.term_hits(s, T.SOCIAL_TERMS).alias("social"), T.term_hits(s, T.FORWARD_TERMS).alias("forward"),
        T.term_hits(s, TOP_TERMS).alias("common"), T.is_retrospective(F.col("title")).alias("retrospective"),
    )


SQL_NUMBERS = r"least(3, len(regexp_extract_all(summary_ascii, '(?i)(?:\$\s*)?\b\d[\d,.]*(?:%|\s+(?:million|billion|trillion))?\b')))"
SQL_SENTENCES = r"least(4, len(regexp_extract_all(summary_ascii, '[.!?](?:\s|$)')))"


@register("evidence_details", with_articles(f"SELECT article_id, {SQL_NUMBERS} AS numbers, {SQL_SENTENCES} AS sentences FROM (SELECT *, {sql_ascii('summary')} AS summary_ascii FROM articles)"))
def evidence_details(spark, sf_dir):
    """Numbers and sentence ends, capped."""
    s = F.col("summary")
    numbers, ends = F.least(F.lit(3), T.count_matches(s, T.NUMBER)), F.least(F.lit(4), T.count_matches(s, T.SENTENCE_END))
    return articles(spark, sf_dir).select("article_id", numbers.cast("long").alias("numbers"), ends.cast("long").alias("sentences"))


@register("url_canonical", with_articles("SELECT article_id, split_part(url, '?', 1) AS identity, regexp_replace(split_part(url, '?', 1), '/+$', '') AS canonical FROM articles"))
def url_canonical(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", T.url_identity(F.col("url")).alias("identity"), T.url_canonical(F.col("url")).alias("canonical"))


@register("stable_hash", with_articles("SELECT article_id, substr(sha1(tags[1] || '|' || title || '|' || source), 1, 16) AS story_hash, sha256(title) AS digest FROM articles"))
def stable_hash(spark, sf_dir):
    joined = F.concat_ws("|", F.col("tags")[0], "title", "source")
    return articles(spark, sf_dir).select("article_id", F.substring(F.sha1(joined), 1, 16).alias("story_hash"), F.sha2("title", 256).alias("digest"))


_SHOWN = " ".join(f"WHEN low = '{n}' THEN '{v}'" for n, v in T.SOURCE_NAMES) + " " + " ".join(f"WHEN contains(low, '{n}') THEN '{v}'" for n, v in T.SOURCE_NAMES)
_FED = "CASE page_id % 7 WHEN 0 THEN 'https://www.reuters.com/world' WHEN 1 THEN 'The Washington Post' WHEN 2 THEN 'some-local_news.co' WHEN 3 THEN 'WSJ Markets' WHEN 4 THEN 'daily news' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') END"


@register("source_name", f"""WITH s AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace({_FED}, '(?i)^(?:https?://)?(?:www\\.)?', ''), '(?i)\\.(?:com|org|net|co|io|gov|edu)(?:/.*)?$', ''), '[-_]', ' ', 'g')) AS bare FROM pages),
 k AS (SELECT *, lower(bare) AS low, CASE WHEN ends_with(lower(bare), ' news') THEN left(bare, length(bare) - 5) ELSE bare END AS short FROM s)
 SELECT page_id, CASE {_SHOWN} WHEN short = lower(short) THEN array_to_string(list_transform(string_split(short, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE short END AS name FROM k""")
def source_name(spark, sf_dir):
    k = F.col("page_id") % 7
    fed = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*", 0)
    for i, name in enumerate(("https://www.reuters.com/world", "The Washington Post", "some-local_news.co", "WSJ Markets", "daily news")):
        fed = F.when(k == i, name).otherwise(fed)
    return table(spark, sf_dir, "pages").select("page_id", T.source_name(fed).alias("name"))


@register("issuer_name", "SELECT c_custkey, c_name AS name FROM customer")
def issuer_name(spark, sf_dir):
    """Customers under a legal name of one of the usual forms."""
    forms = F.array(*[F.lit(x) for x in (" Inc.", ", Corp", " Corporation", " Ltd.", ", LLC", " plc", "")])
    return table(spark, sf_dir, "customer").select("c_custkey", T.issuer_name(F.concat("c_name", F.get(forms, (F.col("c_custkey") % 7).cast("int")))).alias("name"))


@register("truncate", with_articles("SELECT article_id, CASE WHEN length(trim(title)) > 40 THEN rtrim(substr(trim(title), 1, 40)) || '...' ELSE trim(title) END AS title FROM articles"))
def truncate(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", T.truncate(F.col("title"), 40).alias("title"))


@register("importance", """SELECT o_orderkey, round(det, 6) AS deterministic, round(CASE WHEN grade IS NULL THEN det ELSE greatest(greatest(0.0, det - 25), least(least(100.0, det + 100), det * 0.35 + grade * 0.65)) END, 6) AS importance
 FROM (SELECT o_orderkey, 100.0 / (1 + exp(-0.4 * (o_totalprice / 20000 - 9))) AS det, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 101 END AS grade FROM orders)""")
def importance(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    det = N.logistic_importance(F.col("o_totalprice") / 20000, 0.4, 9.0)
    grade = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 101)
    return o.select("o_orderkey", F.round(det, 6).alias("deterministic"), F.round(N.blend_importance(det, grade), 6).alias("importance"))


@register("percent_change", f"""WITH {QUOTES} SELECT symbol, day::VARCHAR AS day, round(CASE WHEN before <> 0 THEN (close - before) / before * 100 END, 6) AS change
 FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS before FROM quotes)""")
def percent_change(spark, sf_dir):
    from ..operators.market import close_pairs

    q = close_pairs(quotes(spark, sf_dir))
    return q.select("symbol", F.col("day").cast("string").alias("day"), F.round(N.percent_change(F.col("close"), F.col("before")), 6).alias("change"))


@register("token_cost", "SELECT conv_id, turn, round((length(text) * 0.15 + (strlen(text) + 512) * 0.6) / 1e6, 12) AS cost FROM conversations WHERE text IS NOT NULL")
def token_cost(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.round(N.token_cost(F.length("text"), N.conservative_tokens(F.col("text")), 0.15, 0.6), 12).alias("cost"))


@register("trading_calendar", """WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
 e AS (SELECT *, year(day) AS y FROM days), f AS (SELECT *, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM e),
 g AS (SELECT *, (19 * a + b - b // 4 - ((8 * b + 13) // 25) + 15) % 30 AS h FROM f),
 k AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m FROM g),
 n AS (SELECT *, (a + 11 * h + 19 * m) // 433 AS n FROM k), o AS (SELECT *, (h + m - 7 * n + 90) // 25 AS mo FROM n),
 q AS (SELECT *, make_date(y, mo, (h + m - 7 * n + 33 * mo + 19) % 32) AS easter, isodow(day) - 1 AS w, month(day) AS mon, day(day) AS d FROM o)
 SELECT day::VARCHAR AS day, w < 5 AND NOT (mon = 1 AND ((d = 1 AND w < 5) OR (d = 2 AND w = 0)) OR (mon = 1 AND w = 0 AND d BETWEEN 15 AND 21) OR (mon = 2 AND w = 0 AND d BETWEEN 15 AND 21)
  OR day = easter - 2 OR (mon = 5 AND w = 0 AND d >= 25)
  OR (y >= 2022 AND day = CASE isodow(make_date(y, 6, 19)) WHEN 6 THEN make_date(y, 6, 18) WHEN 7 THEN make_date(y, 6, 20) ELSE make_date(y, 6, 19) END)
  OR day = CASE isodow(make_date(y, 7, 4)) WHEN 6 THEN make_date(y, 7, 3) WHEN 7 THEN make_date(y, 7, 5) ELSE make_date(y, 7, 4) END
  OR (mon = 9 AND w = 0 AND d <= 7) OR (mon = 11 AND w = 3 AND d BETWEEN 22 AND 28)
  OR day = CASE isodow(make_date(y, 12, 25)) WHEN 6 THEN make_date(y, 12, 24) WHEN 7 THEN make_date(y, 12, 26) ELSE make_date(y, 12, 25) END) AS trades FROM q""")
def trading_calendar(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select(F.col("day").cast("string").alias("day"), N.trading_day(F.col("day")).alias("trades"))
