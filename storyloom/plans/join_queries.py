"""Queries of joins, clustering, selection, history and state, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import articles as A
from ..operators import market as M
from ..operators import phrases as Ph
from ..operators import selection as Sel
from ..operators import state as St
from ..operators import stories as So
from ..operators.graph import connected_components
from ..session import cut
from .adapters import CATEGORIES, QUOTES, articles, minute_of, quotes, table, with_articles
from .text_queries import sql_entities, sql_jaccard, sql_list, sql_tokens

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


SETS = f"""sets AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({sql_list(T.STOPWORDS)}, t))) AS tk,
  {sql_entities('title')} AS en, list_intersect({sql_tokens("title || ' ' || summary")}, {sql_list(T.EVENT_TERMS)}) AS ev FROM (SELECT * REPLACE (regexp_replace(title, '[|–—-]', ' ', 'g') AS title) FROM articles)),
 classes AS (SELECT min(article_id) AS id, tk, en, ev, list_distinct(list(minute)) AS ms FROM (SELECT article_id, minute, list_sort(tk) AS tk, list_sort(en) AS en, list_sort(ev) AS ev, CASE WHEN len(tk) = 0 THEN article_id END AS own FROM sets) GROUP BY tk, en, ev, own),
 members AS (SELECT s.article_id, c.id FROM sets s JOIN classes c ON list_sort(s.tk) = c.tk AND list_sort(s.en) = c.en AND list_sort(s.ev) = c.ev AND (len(s.tk) > 0 OR c.id = s.article_id)),
 pairs AS (SELECT a.id AS a, b.id AS b, {sql_jaccard('a.tk', 'b.tk')} AS t, {sql_jaccard('a.en', 'b.en')} AS e, {sql_jaccard('a.ev', 'b.ev')} AS v, list_min(list_transform(a.ms, lambda x: list_min(list_transform(b.ms, lambda y: abs(x - y))))) / 60.0 AS h,
  len(a.ev) > 0 AND len(b.ev) > 0 AND len(list_intersect(a.ev, b.ev)) = 0 AS apart, a.en AS ea, b.en AS eb, len(list_intersect(a.ev, b.ev)) > 0 AS over FROM classes a JOIN classes b ON a.id < b.id),
 scored AS (SELECT *, CASE WHEN e > 0 AND t < 0.32 AND apart THEN least(t, 0.25) ELSE t * 0.55::DOUBLE + e * 0.2::DOUBLE + v * 0.15::DOUBLE + CASE WHEN h <= 3 THEN 1.0 WHEN h <= 12 THEN 0.7 WHEN h <= 24 THEN 0.35 ELSE 0.0 END * 0.1::DOUBLE END AS s FROM pairs)"""


def sets_sql(sql: str) -> str:
    return with_articles("").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + SETS + "\n" + sql


def sets(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("title", F.regexp_replace("title", "[|–—-]", " "))
    return So.with_sets(a)


def pairs(spark, sf_dir):
    """(pairs, members) of all articles."""
    rows, members = So.classes(sets(spark, sf_dir))
    return cut(So.similar_pairs(rows).withColumn("score", F.round("score", 9)), "pairs"), members


FOREST = ", forest AS (SELECT b AS child, arg_max(a, (round(s, 9), -a)) AS prior FROM scored WHERE s >= 0.43 GROUP BY b), walk AS (SELECT id, id AS up FROM classes UNION SELECT id, prior FROM walk JOIN forest ON child = up), story AS (SELECT id, min(up) AS story_id FROM walk GROUP BY id), links AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM scored WHERE s >= 0.43 UNION ALL SELECT b FROM scored WHERE s >= 0.43) GROUP BY id)"


@register("similar_pairs", sets_sql("SELECT a, b, round(s, 6) AS score FROM scored WHERE s >= 0.43"))
def similar_pairs(spark, sf_dir):
    """Pairs of different articles, copies standing behind the first of them (see ``cluster_stories`` for membership)."""
    return pairs(spark, sf_dir)[0].select("a", "b", F.round("score", 6).alias("score"))


@register("cluster_stories", sets_sql(FOREST + " SELECT article_id, story_id, coalesce(n, 0) AS n_links FROM members JOIN story USING (id) LEFT JOIN links USING (id)"))
def cluster_stories(spark, sf_dir):
    found, members = pairs(spark, sf_dir)
    return So.cluster_stories(members, found)


@register("leader_clusters")
def leader_clusters(spark, sf_dir):
    return So.leader_clusters(sets(spark, sf_dir))


GENERIC = ("the", "of", "and", "der", "que")


@register("duplicate_event_pairs", sets_sql(f"""SELECT a, b, len(list_filter(list_intersect(ea, eb), lambda x: NOT list_contains({sql_list(GENERIC)}, x))) AS shared, round(t, 6) AS title_score FROM pairs
 WHERE h <= 24 AND len(list_filter(list_intersect(ea, eb), lambda x: NOT list_contains({sql_list(GENERIC)}, x))) > 0 AND (t >= 0.2 OR over) AND NOT (t < 0.32 AND apart)"""))
def duplicate_event_pairs(spark, sf_dir):
    return So.duplicate_event_pairs(So.classes(sets(spark, sf_dir))[0], GENERIC).withColumn("title_score", F.round("title_score", 6))


def edges(spark, sf_dir):
    """Orders as edges between neighbouring stories: long chains, hubs, and components of all sizes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k.alias("a"), F.when(c % 5 < 3, k).otherwise(k + c % 37 + 1).alias("b"))


@register("components")
def components(spark, sf_dir):
    e = edges(spark, sf_dir)
    loops = e.select(F.col("a").alias("node"))
    comp = connected_components(e)
    return loops.union(e.select("b")).distinct().join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


@register("pack_components")
def pack_components(spark, sf_dir):
    e = components(spark, sf_dir).groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max("node").cast("double").alias("score"))
    return So.pack_components(e.withColumn("run_id", F.floor(F.col("component") / 1000)))


@register("merge_by_url", with_articles("SELECT article_id, min(article_id) OVER (PARTITION BY run_id, u) AS story_id FROM (SELECT *, regexp_replace(split_part('https://' || source || '.example/' || article_id % 50 || CASE WHEN article_id % 2 = 0 THEN '/?q=1' ELSE '' END, '?', 1), '/+$', '') AS u FROM articles)"))
def merge_by_url(spark, sf_dir):
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), (F.col("article_id") % 50).cast("string"), F.when(F.col("article_id") % 2 == 0, F.lit("/?q=1")).otherwise(F.lit("")))
    return So.merge_by_url(articles(spark, sf_dir).withColumn("url", url))


STORY = "run_id * 40 + article_id % 40"


@register("pick_headline", with_articles(f"""SELECT story_id, arg_max(title, (reputation, CASE WHEN regexp_matches(lower(title), 'live|updates|latest') THEN 0 ELSE 1 END, least(length(title), 120), -seq)) AS title,
 arg_max(title, (CASE WHEN regexp_matches(lower(title), '{'|'.join(T.RETROSPECTIVE)}') THEN 0 ELSE 1 END, reputation, minute, -seq)) AS merged_title FROM (SELECT *, {STORY} AS story_id FROM articles) GROUP BY story_id"""))
def pick_headline(spark, sf_dir):
    return So.pick_headline(articles(spark, sf_dir).withColumn("story_id", F.expr(STORY)))


@register("validate_merge_sets", """WITH s AS (SELECT o_orderkey AS set_id, list_distinct(list(l_partkey % 400)) AS ids, o_custkey % 5 AS run_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
 i AS (SELECT run_id, set_id, len(ids) AS n, unnest(ids) AS id FROM s), f AS (SELECT *, min(set_id) OVER (PARTITION BY run_id, id) AS first FROM i)
 SELECT run_id, set_id, max(n) BETWEEN 2 AND 4 AND count(*) FILTER (id < 390) = count(*) AND min(id // 200) = max(id // 200) AND max(first) = set_id AND min(first) = set_id AS valid FROM f GROUP BY run_id, set_id""")
def validate_merge_sets(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    s = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderkey").alias("set_id"), (F.col("o_custkey") % 5).alias("run_id")).agg(F.collect_set(F.col("l_partkey") % 400).alias("ids"))
    known = spark.range(390).select(F.col("id").alias("node"), F.floor(F.col("id") / 200).alias("component"))
    return So.validate_merge_sets(s, known)


@register("merge_stories", """WITH r AS (SELECT l_orderkey AS set_id, l_partkey AS story_id, max(l_quantity) AS imp, max(l_extendedprice) AS tot FROM lineitem GROUP BY ALL)
 SELECT set_id, arg_max(story_id, (imp, tot, story_id)) AS destination, max(imp) AS importance, count(*) - 1 AS merged FROM r GROUP BY set_id""")
def merge_stories(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("story_id")).agg(F.max("l_quantity").alias("importance"), F.max("l_extendedprice").alias("total"))
    st = r.select(F.struct("set_id", "story_id").alias("story_id"), "importance", "total", F.lit(0).alias("latest"))
    m = So.merge_stories(st, r.select("set_id", F.struct("set_id", "story_id").alias("story_id")))
    return m.select("set_id", F.col("destination.story_id").alias("destination"), "importance", F.size("merged_from").cast("long").alias("merged"))


HIST = f"""now AS (SELECT article_id AS id, tags[1] AS category, {sql_tokens('title')} AS k FROM articles), hist AS (SELECT id + (id % 10) AS id, category, k FROM now WHERE id % 2 = 0)"""


@register("history_match", with_articles("").rstrip() + ", " + HIST + f""", s AS (SELECT n.id, h.id AS hid, 1.0::DOUBLE AS likeness FROM now n JOIN hist h ON n.id = h.id GROUP BY ALL),
 o AS (SELECT n.id, h.id AS hid, {sql_jaccard('n.k', 'h.k')} AS likeness FROM now n JOIN hist h ON n.category = h.category WHERE n.id NOT IN (SELECT id FROM s))
 SELECT id, hid AS history_id, likeness FROM s UNION ALL SELECT id, arg_max(hid, (likeness, -hid)), max(likeness) FROM o WHERE likeness >= 0.62 GROUP BY id""")
def history_match(spark, sf_dir):
    now = articles(spark, sf_dir).select(F.col("article_id").alias("id"), F.col("tags")[0].alias("category"), T.tokenize(F.col("title")).alias("keywords"))
    hist = now.where("id % 2 = 0").withColumn("id", F.col("id") + F.col("id") % 10)
    return So.match_history(now, hist)


@register("apply_history", with_articles(f""", s AS (SELECT x.article_id, y.article_id IS NOT NULL AS known, x.source <> y.source OR y.source IS NULL AS fresh_source, {sql_tokens('x.title')} AS a, {sql_tokens('y.title')} AS b, {sql_tokens('x.summary')} AS s, {sql_tokens('y.summary')} AS o, x.reputation
  FROM articles x LEFT JOIN articles y ON y.article_id = x.article_id - x.article_id % 3 AND x.article_id % 4 <> 0),
 r AS (SELECT *, CASE WHEN NOT known THEN 'new' WHEN fresh_source OR len(list_filter(a, lambda x: NOT list_contains(b, x))) >= 4 OR {sql_jaccard('s', 'o')} < 0.75 THEN 'update' ELSE 'stale' END AS state FROM s)
 SELECT article_id, state, round(reputation + CASE state WHEN 'update' THEN 0.6 WHEN 'stale' THEN -4.0 ELSE 0 END, 6) AS total FROM r""").replace("\n, s AS", ", s AS"))
def apply_history(spark, sf_dir):
    """Articles beside the record of a neighbour, or of themselves."""
    a = articles(spark, sf_dir).select("article_id", F.array("source").alias("sources"), T.tokenize(F.col("title")).alias("keywords"), "summary", F.col("reputation").alias("total"))
    old = a.select(F.col("article_id").alias("h"), F.col("sources").alias("old_sources"), F.col("keywords").alias("old_keywords"), F.col("summary").alias("old_summary"))
    k = F.col("article_id")
    matched = a.join(old, (F.col("h") == k - k % 3) & (k % 4 != 0), "left")
    return So.apply_history(matched).select("article_id", "state", F.round("total", 6).alias("total"))


@register("exclude_hosts", "SELECT page_id FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') AS h FROM pages) WHERE NOT (h = 'example.net' OR ends_with(h, '.example.net') OR h = 'tionsh.example.com' OR ends_with(h, '.tionsh.example.com'))")
def exclude_hosts(spark, sf_dir):
    bad = spark.createDataFrame([("example.net",), ("tionsh.example.com",)], "domain string")
    return A.without_hosts(table(spark, sf_dir, "pages").select("page_id", "url"), bad).select("page_id")


@register("policy_join", """SELECT page_id, CASE WHEN h = 'blog.tionsh.example.com' OR ends_with(h, '.blog.tionsh.example.com') THEN 'disabled' WHEN ends_with(h, '.example.com') THEN 'article_text' WHEN ends_with(h, '.example.org') THEN 'metadata_only' ELSE 'none' END AS policy
 FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') AS h FROM pages)""")
def policy_join(spark, sf_dir):
    rules = spark.createDataFrame([(0, "blog.tionsh.example.com", "disabled"), (1, "example.com", "article_text"), (2, "example.org", "metadata_only")], "n int, domain string, policy string")
    return A.host_policy(table(spark, sf_dir, "pages"), rules)


@register("enrichment_status", """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'not_permitted' WHEN page_id % 7 = 0 THEN 'blocked' WHEN page_id % 11 = 0 THEN 'failed' WHEN page_id % 5 = 0 THEN 'metadata_only' WHEN length(html) < 3000 THEN 'too_thin' ELSE 'extracted' END AS status FROM pages""")
def enrichment_status(spark, sf_dir):
    from ..sources.pages import enrichment_status as decide

    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    code = F.when(k % 7 == 0, 403).when(k % 11 == 0, 500).otherwise(200)
    policy = F.when(k % 6 == 0, F.lit(None)).when(k % 5 == 0, "metadata_only").otherwise("article_text")
    return p.select("page_id", decide(policy, code, F.lit("text/html"), F.length("html"), 3000).alias("status"))


@register("merge_enriched", with_articles("SELECT article_id, CASE WHEN article_id % 3 = 0 THEN 'enriched ' || title ELSE title END AS title, CASE WHEN article_id % 6 = 0 THEN 'better' ELSE source END AS source FROM articles"))
def merge_enriched(spark, sf_dir):
    """A third of the articles has an enriched version; half of these lack a source."""
    a = articles(spark, sf_dir).select("article_id", "url", "title", "source")
    better = a.where("article_id % 3 = 0").select("url", F.concat(F.lit("enriched "), "title").alias("title"), F.when(F.col("article_id") % 6 == 0, "better").otherwise("").alias("source"))
    return A.merge_enriched(a, better).select("article_id", "title", "source")


@register("watchlist_match", with_articles(f"""SELECT a.article_id, t.term FROM articles a, (SELECT unnest({sql_list(('the', 'theand', 'und', 'les que'))}) AS term) t
 WHERE CASE WHEN contains(term, ' ') THEN len(list_filter(string_split(term, ' '), lambda w: NOT list_contains(regexp_split_to_array(lower(summary), '[^\\p{{L}}\\p{{N}}_]+'), w))) = 0 ELSE regexp_matches(lower(summary), '(^|[^\\p{{L}}\\p{{N}}_])' || term || '([^\\p{{L}}\\p{{N}}_]|$)') END"""))
def watchlist_match(spark, sf_dir):
    from ..operators.watchlist import match_terms

    return match_terms(articles(spark, sf_dir).select("article_id", "summary"), ("the", "theand", "und", "les que"))


_TITLE = "regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+')"
_GRAMS = "g AS (SELECT id, array_to_string(w[i:i + n - 1], ' ') AS phrase, count(*) AS n_places, min(i) - 1 AS place FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT article_id AS id, regexp_extract_all(lower(summary), '[\\p{L}\\p{N}_]+') AS w FROM articles), (VALUES (1), (2), (3), (4)) t(n)) GROUP BY ALL)"


@register("phrase_dictionary", with_articles(f""", {_GRAMS}, t AS (SELECT {_TITLE} AS t FROM articles), p AS (SELECT DISTINCT array_to_string(t[2 * k + 1:2 * k + k % 4 + 1], ' ') AS phrase FROM t, (VALUES (0), (1), (2), (3), (5)) k(k) WHERE len(t) >= 2 * k + k % 4 + 1)
 SELECT id AS article_id, phrase, n_places, CAST(place AS INT) AS first_place FROM g JOIN p USING (phrase)"""))
def phrase_dictionary(spark, sf_dir):
    """Five phrases of one to four words from every title are looked for in all texts."""
    a = articles(spark, sf_dir)
    t = a.select(Ph.words_of(F.col("title")).alias("t"))
    whole = t.select(F.posexplode(F.transform(F.array(*[F.lit(k) for k in (0, 1, 2, 3, 5)]), lambda k: F.slice("t", 2 * k + 1, k % 4 + 1))).alias("i", "p"))
    sizes = F.element_at(F.array(*[F.lit(k % 4 + 1) for k in (0, 1, 2, 3, 5)]), F.col("i") + 1)
    phrases = whole.where(F.size("p") == sizes).select(F.array_join("p", " ").alias("phrase"))
    found = Ph.phrase_places(a.select(F.col("article_id").alias("id"), F.col("summary").alias("text")), phrases)
    return found.select(F.col("id").alias("article_id"), "phrase", F.size("places").cast("long").alias("n_places"), F.col("places")[0].alias("first_place"))


@register("explain_movers", f"""WITH w AS (SELECT doc_id AS article_id, source, CAST(70 + 5 * (CAST(regexp_extract(source, '[0-9]+') AS INT) % 6) AS DOUBLE) / 100 AS reputation, doc_id * 37 % 4320 AS seen_at, {sql_tokens("coalesce(text, '')")} AS tk, doc_id % 3 AS causal FROM documents),
 m AS (SELECT o_orderkey AS mover_id, CASE o_custkey % 3 WHEN 0 THEN 'that' WHEN 1 THEN 'des' ELSE 'por' END AS term, o_orderkey % 4320 AS minute FROM orders), g AS (SELECT DISTINCT term, minute FROM m),
 h AS (SELECT term, minute, count(article_id) AS articles, count(DISTINCT CASE WHEN causal > 0 THEN source END) AS sources, arg_max(article_id, (causal, reputation, -article_id)) AS best,
  CASE WHEN count(DISTINCT CASE WHEN causal > 0 THEN source END) >= 2 THEN 'high' WHEN count(DISTINCT CASE WHEN causal > 0 THEN source END) = 1 THEN 'medium' ELSE 'low' END AS confidence
 FROM g LEFT JOIN w ON list_contains(tk, term) AND seen_at <= minute AND seen_at >= minute - 2880 GROUP BY term, minute)
 SELECT mover_id, articles, sources, best, confidence FROM m JOIN h ON m.term = h.term AND m.minute = h.minute""")
def explain_movers(spark, sf_dir):
    d = articles(spark, sf_dir).select("article_id", "source", "reputation", "minute", T.tokenize(F.col("summary")).alias("tokens"))
    o = table(spark, sf_dir, "orders")
    m = o.select(F.col("o_orderkey").alias("mover_id"), F.when(F.col("o_custkey") % 3 == 0, "that").when(F.col("o_custkey") % 3 == 1, "des").otherwise("por").alias("term"), (F.col("o_orderkey") % 4320).alias("minute"))
    return M.explain_movers(m, d, F.col("article_id") % 3)


@register("route_discovery", with_articles("""SELECT ticker, u AS url, min(k) AS first_key FROM (SELECT article_id % 6 AS k, regexp_replace(split_part(url, '?', 1), '/+$', '') AS u FROM articles) JOIN (SELECT unnest([0, 0, 1, 2]) AS ticker, unnest([0, 3, 1, 3]) AS key) ON key = k GROUP BY ticker, u"""))
def route_discovery(spark, sf_dir):
    a = articles(spark, sf_dir).select((F.col("article_id") % 6).cast("int").alias("key"), "url")
    routes = spark.createDataFrame([(0, 0), (0, 3), (1, 1), (2, 3)], "ticker int, key int")
    return A.route_discovery(a, routes)


@register("suppress_sent", """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 60000000 AS minute FROM events), s AS (SELECT user_id, event_type, minute AS sent_minute FROM e WHERE event_id % 10 = 0)
 SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND s.event_type = e.event_type AND sent_minute >= minute - 2880 AND sent_minute < minute)""")
def suppress_sent(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", minute_of(F.col("ts")).alias("minute"))
    sent = e.where("event_id % 10 = 0").select("user_id", "event_type", F.col("minute").alias("sent_minute"))
    return St.suppress_sent(e, sent, ["user_id", "event_type"], "minute").select("event_id")


@register("dedup_filing_urls", with_articles("SELECT article_id FROM articles WHERE regexp_replace(url, '/+$', '') NOT IN (SELECT regexp_replace(url, '/+$', '') FROM articles WHERE article_id % 9 = 1)"))
def dedup_filing_urls(spark, sf_dir):
    a = articles(spark, sf_dir).select("article_id", "url")
    return A.without_filing_urls(a, a.where("article_id % 9 = 1").select("url")).select("article_id")


@register("pending_reviews", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality IS NOT NULL) OR (doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1))")
def pending_reviews(spark, sf_dir):
    """What lacks a quality review, or of even ids a toxic one."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return A.pending_reviews(d, lab, "doc_id", F.col("quality").isNotNull(), F.col("toxic") == 1, F.col("doc_id") % 2 == 0)


@register("match_examples", with_articles("""SELECT e.item_id, a.article_id FROM (SELECT item_id, [sha256('u' || item_id), sha256('v' || item_id)] AS hs, item_id % 5 AS day FROM benchmark) e JOIN (SELECT article_id, sha256('u' || article_id) AS h, article_id % 5 AS day FROM articles) a ON list_contains(hs, h) AND e.day = a.day"""))
def match_examples(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 5).alias("day"), F.array(*[F.sha2(F.concat(F.lit(c), F.col("item_id").cast("string")), 256) for c in "uv"]).alias("hashes"))
    a = articles(spark, sf_dir).select("article_id", (F.col("article_id") % 5).alias("day"), F.sha2(F.concat(F.lit("u"), F.col("article_id").cast("string")), 256).alias("hash"))
    return A.match_examples(b, a)


PAIRED = QUOTES + ", paired AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS before FROM quotes)"


@register("close_pairs", f"WITH {PAIRED} SELECT symbol, day::VARCHAR AS day, close, before FROM paired")
def close_pairs(spark, sf_dir):
    return M.close_pairs(quotes(spark, sf_dir)).select("symbol", F.col("day").cast("string").alias("day"), "close", "before")


@register("fresh_quotes", f"""WITH {QUOTES}, l AS (SELECT max(day) AS d FROM quotes), c AS (SELECT symbol, close AS latest FROM quotes, l WHERE day = d AND symbol % 3 = 0), f AS (SELECT symbol, max(close) AS latest FROM quotes WHERE symbol % 5 > 0 GROUP BY symbol)
 SELECT a.symbol, coalesce(c.latest, f.latest) AS latest, coalesce(c.latest, f.latest) / 2 AS previous, c.symbol IS NOT NULL AS from_cache FROM (SELECT DISTINCT symbol FROM quotes) a LEFT JOIN c ON c.symbol = a.symbol LEFT JOIN f ON f.symbol = a.symbol WHERE c.symbol IS NOT NULL OR f.symbol IS NOT NULL""")
def fresh_quotes(spark, sf_dir):
    """A third of the symbols have a cached quote of the last day, and older ones; most of the others are fetched."""
    q = quotes(spark, sf_dir)
    last = q.agg(F.max("day").cast("string")).first()[0]
    cached = q.where("symbol % 3 = 0").select("symbol", "day", F.col("close").alias("latest"), (F.col("close") / 2).alias("previous"))
    provider = F.concat(F.col("symbol").cast("string"), F.lit(".us"))
    universe = q.select("symbol").distinct().select("symbol", provider.alias("provider_symbol"))
    fetched = q.where("symbol % 5 > 0").select(provider.alias("provider_symbol"), F.col("close").alias("latest"), (F.col("close") / 2).alias("previous"))
    return M.fresh_quotes(universe, cached, fetched, last)


@register("detect_movers", f"""WITH {PAIRED} SELECT symbol, day::VARCHAR AS day, round((close - before) / before * 100, 6) AS change FROM paired
 WHERE before <> 0 AND abs((close - before) / before * 100) >= CASE symbol % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 7.0 ELSE 8.0 END""")
def detect_movers(spark, sf_dir):
    assets = spark.range(26).select(F.col("id").alias("symbol"), (F.col("id") % 3).alias("kind"))
    limits = F.when(F.col("kind") == 0, 2.0).when(F.col("kind") == 1, 7.0).otherwise(8.0)
    m = M.detect_movers(M.close_pairs(quotes(spark, sf_dir)), assets, limits)
    return m.select("symbol", F.col("day").cast("string").alias("day"), F.round("change", 6).alias("change"))


@register("asof_quote", f"""WITH {QUOTES}, p AS (SELECT symbol, day, close, 1 AS rank FROM quotes WHERE symbol % 2 = 0 UNION ALL SELECT symbol, day, close + 1, 2 FROM quotes), w AS (SELECT symbol, max(day) AS session FROM quotes GROUP BY symbol)
 SELECT w.symbol, session::VARCHAR AS session, arg_min(close, (rank, close)) AS close FROM w LEFT JOIN p ON p.symbol = w.symbol AND day = session GROUP BY ALL""")
def asof_quote(spark, sf_dir):
    q = quotes(spark, sf_dir)
    p = q.where("symbol % 2 = 0").withColumn("rank", F.lit(1)).unionByName(q.withColumn("close", F.col("close") + 1).withColumn("rank", F.lit(2)))
    out = M.asof_quote(p, q.groupBy("symbol").agg(F.max("day").alias("session")))
    return out.select("symbol", F.col("session").cast("string").alias("session"), "close")


@register("large_moves", f"""WITH {PAIRED} SELECT symbol, day::VARCHAR AS day, round(abs((close - before) / before * 100), 4) AS move FROM paired WHERE before <> 0 AND abs((close - before) / before * 100) >= 3 AND symbol % 5 <> 0
 ORDER BY abs((close - before) / before * 100) DESC, symbol, day LIMIT 20""")
def large_moves(spark, sf_dir):
    p = M.close_pairs(quotes(spark, sf_dir))
    out = M.large_moves(p, p.where("symbol % 5 = 0").select("symbol", "day"))
    return out.select("symbol", F.col("day").cast("string").alias("day"), F.round(F.abs("change"), 4).alias("move"))


@register("generate_alerts", f"""WITH {PAIRED} SELECT sha1('market|' || symbol || '|' || printf('%.1f', (close - before) / before * 100))[1:16] AS alert_id, symbol FROM paired WHERE before <> 0 AND abs((close - before) / before * 100) >= CASE symbol % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 7.0 ELSE 8.0 END""")
def generate_alerts(spark, sf_dir):
    p = M.close_pairs(quotes(spark, sf_dir)).withColumn("change", M.percent_change(F.col("close"), F.col("before")))
    limits = F.when(F.col("symbol") % 3 == 0, 2.0).when(F.col("symbol") % 3 == 1, 7.0).otherwise(8.0)
    return M.market_alerts(p, limits).select("alert_id", "symbol")


STORY_KEYS = "SELECT run_id * 40 + article_id % 40 AS key, count(DISTINCT source) AS sources, arg_min(title, article_id) AS title, arg_min(summary, article_id) AS text FROM articles GROUP BY 1"


@register("story_alerts", with_articles(f"""SELECT key, sha1('story|' || key || '|' || title)[1:16] AS alert_id, CASE WHEN sources >= 4 THEN 'high' ELSE 'medium' END AS confidence FROM ({STORY_KEYS})
 WHERE sources >= 2 AND (sources >= 4 OR regexp_matches(lower(title || ' ' || text), '{'|'.join(M.TRIGGERS)}'))"""))
def story_alerts(spark, sf_dir):
    first = F.min_by(F.struct("title", F.col("summary").alias("text")), "article_id")
    s = articles(spark, sf_dir).groupBy(F.expr(STORY).alias("key")).agg(F.count_distinct("source").alias("sources"), first.alias("f")).select("key", "sources", "f.*")
    return M.story_alerts(s, 4).select("key", "alert_id", "confidence")


@register("keep_movers", f"""WITH {PAIRED}, m AS (SELECT symbol, day, (close - before) / before * 100 AS change, CASE symbol % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 7.0 ELSE 8.0 END AS limit_ FROM paired WHERE before <> 0)
 SELECT symbol, day::VARCHAR AS day, row_number() OVER (PARTITION BY day ORDER BY abs(change) DESC, symbol % 7 DESC, symbol % 5 = 0 DESC, symbol % 2 = 0 DESC, symbol) AS place FROM m WHERE abs(change) >= limit_ AND (symbol % 2 = 0 OR abs(change) / limit_ >= 1.5 OR symbol % 5 = 0)""")
def keep_movers(spark, sf_dir):
    """Movers that stay in the report, in its order: even symbols are surely explained, each fifth is watched."""
    assets = spark.range(26).select(F.col("id").alias("symbol"), (F.col("id") % 3).alias("kind"))
    limits = F.when(F.col("kind") == 0, 2.0).when(F.col("kind") == 1, 7.0).otherwise(8.0)
    m = M.detect_movers(M.close_pairs(quotes(spark, sf_dir)), assets, limits)
    sure, watched = F.when(F.col("symbol") % 2 == 0, "high").otherwise("low"), F.col("symbol") % 5 == 0
    placed = M.order_movers(M.keep_movers(m, sure, watched), F.col("symbol") % 7, watched, sure)
    return placed.select("symbol", F.col("day").cast("string").alias("day"), F.col("place").cast("long").alias("place"))


@register("alert_cooldown", """WITH e AS (SELECT event_id, user_id % 50 AS alert_id, epoch_us(ts) // 60000000 AS minute FROM events), l AS (SELECT alert_id, max(minute) AS sent_minute FROM e WHERE event_id % 4 = 0 GROUP BY alert_id)
 SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.alert_id = e.alert_id AND e.minute - sent_minute < 180 AND sent_minute <= e.minute)""")
def alert_cooldown(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("alert_id"), minute_of(F.col("ts")).alias("minute"))
    last = e.where("event_id % 4 = 0").groupBy("alert_id").agg(F.max("minute").alias("sent_minute"))
    return St.alert_cooldown(e, last).select("event_id")


@register("reserve_select")
def reserve_select(spark, sf_dir):
    return Sel.reserve_select(articles(spark, sf_dir).select("run_id", F.col("article_id").alias("id"), (-F.col("minute")).alias("rank"), "tags"), CATEGORIES, 4, 40)


ONE = "SELECT run_id, article_id AS id, tags[1] AS category, source, minute, reputation, (article_id * 31 % 101)::DOUBLE AS importance FROM articles"


def single(spark, sf_dir):
    return articles(spark, sf_dir).select("run_id", F.col("article_id").alias("id"), F.col("tags")[0].alias("category"), "source", F.col("minute").alias("latest"), F.col("reputation").alias("total"), (F.col("article_id") * 31 % 101).cast("double").alias("importance"))


@register("reserve_select_single", with_articles(f""", o AS ({ONE}), r AS (SELECT *, row_number() OVER (PARTITION BY run_id, category ORDER BY -minute, id) AS r FROM o)
 SELECT run_id, id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN r > 4 THEN 1 ELSE 0 END, CASE WHEN r <= 4 THEN r ELSE 0 END, CASE WHEN r <= 4 THEN category ELSE '' END, -minute, id) AS p FROM r) WHERE p <= 40""").replace("\n, o", ", o"))
def reserve_select_single(spark, sf_dir):
    return Sel.reserve_select_single(single(spark, sf_dir).withColumn("rank", -F.col("latest")), 4, 40)


@register("schedule_articles", with_articles("""SELECT run_id, article_id, row_number() OVER (PARTITION BY run_id ORDER BY i, story_rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY i, story_rank) AS u FROM
 (SELECT *, article_id % 40 AS story_rank, row_number() OVER (PARTITION BY run_id, article_id % 40 ORDER BY reputation DESC, article_id) AS i FROM articles) WHERE i <= 2) WHERE u = 1 QUALIFY place <= 50"""))
def schedule_articles(spark, sf_dir):
    a = articles(spark, sf_dir).select("run_id", "article_id", "url", F.col("reputation").alias("evidence"), (F.col("article_id") % 40).alias("story_rank"))
    return Sel.schedule_articles(a).withColumn("place", F.col("place").cast("long"))


def deck(spark, sf_dir):
    """Stories with lanes, numbers of sources and a measured importance."""
    k = F.col("id")
    s = single(spark, sf_dir).withColumn("lane", F.concat(F.lit("lane"), (k % 3).cast("string"))).withColumn("sources", (k % 4).cast("int")).withColumn("measured", (k * 17 % 90).cast("double"))
    return Sel.select_deck(s)


@register("select_deck")
def select_deck(spark, sf_dir):
    return deck(spark, sf_dir).where("phase <> ''").select("run_id", "id", "phase", "relaxed")


@register("select_floor", with_articles(f""", o AS ({ONE}) SELECT run_id, category, id, row_number() OVER (PARTITION BY run_id, category ORDER BY importance DESC, reputation DESC, minute DESC, id) AS place FROM o QUALIFY place <= 2""").replace("\n, o", ", o"))
def select_floor(spark, sf_dir):
    return Sel.select_floor(single(spark, sf_dir)).select("run_id", "category", "id", F.col("place").cast("long").alias("place"))


@register("select_lanes")
def select_lanes(spark, sf_dir):
    return Sel.select_lanes(single(spark, sf_dir).select("run_id", "id", F.col("category").alias("lane"), "importance"))


@register("backfill", with_articles("SELECT DISTINCT run_id, id FROM (SELECT run_id, id, row_number() OVER (PARTITION BY run_id, c ORDER BY importance DESC, id) AS r FROM (SELECT run_id, article_id AS id, unnest(tags) AS c, (article_id * 31 % 101)::DOUBLE AS importance FROM articles)) WHERE r <= 10"))
def backfill(spark, sf_dir):
    a = articles(spark, sf_dir).select("run_id", F.col("article_id").alias("id"), F.explode("tags").alias("category"), (F.col("article_id") * 31 % 101).cast("double").alias("importance"))
    return Sel.backfill(a)


@register("presentation_order", with_articles(f""", o AS ({ONE}) SELECT id, row_number() OVER (PARTITION BY run_id ORDER BY list_position({sql_list(CATEGORIES)}, category), importance DESC, id) AS place FROM o""").replace("\n, o", ", o"))
def presentation_order(spark, sf_dir):
    order = Window.partitionBy("run_id").orderBy(F.array_position(T.words_in(CATEGORIES), F.col("category")), F.desc("importance"), "id")
    return single(spark, sf_dir).select("id", F.row_number().over(order).cast("long").alias("place"))


@register("diverse_order", with_articles("""SELECT article_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN r > 1 THEN 1 ELSE 0 END, evidence DESC, article_id) AS place FROM
 (SELECT run_id, article_id, length(summary) AS evidence, row_number() OVER (PARTITION BY run_id, source ORDER BY length(summary) DESC, article_id) AS r FROM articles)"""))
def diverse_order(spark, sf_dir):
    a = articles(spark, sf_dir).select("run_id", "article_id", "source", F.length("summary").alias("evidence"))
    return Sel.diverse_order(a, "run_id").select("article_id", F.col("place").cast("long").alias("place"))


@register("draft_candidates", with_articles(f"""SELECT article_id FROM (SELECT article_id, article_id % 3 = 0 AS o, count(*) FILTER (article_id % 3 <> 0) OVER (PARTITION BY {STORY}) AS n FROM articles) WHERE NOT o OR n = 0"""))
def draft_candidates(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("story_id", F.expr(STORY))
    return Sel.draft_candidates(a, a.where("article_id % 3 = 0").select("url"), "story_id").select("article_id")


@register("review_sample", "SELECT stratum, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('seed' || doc_id), doc_id) AS p, count(*) OVER (PARTITION BY stratum) AS n, count(*) OVER () AS whole FROM (SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN 'near_miss' ELSE lang END AS stratum FROM documents)) WHERE p <= CASE WHEN n >= 0.15 * whole OR stratum = 'near_miss' THEN 5 ELSE 2 END")
def review_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return Sel.review_sample(d, F.when(F.col("id") % 40 == 0, "near_miss").otherwise(F.col("lang")), "seed").select("stratum", F.col("id").alias("doc_id"))


STORY_OF = "run_id * 40 + article_id % 40"


@register("fit_sections", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used - 1 <= 1400")
def fit_sections(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("section"), F.struct("turn", "text").alias("pos"), F.col("text").alias("line"))
    return Sel.fit_sections(c, 1400).select(F.col("section").alias("conv_id"), F.col("pos.turn").alias("turn"))


@register("fit_messages", """WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n, coalesce(text, '') AS t, '(via ' || role || ')' AS s, turn % 3 = 0 AS m FROM conversations),
 l AS (SELECT *, sum(length(t) + 3 + length(s)) OVER w AS rich, sum(length(t) + 2 + CASE WHEN m THEN 1 + length(s) ELSE 0 END) OVER w AS bare, count(*) OVER (PARTITION BY conv_id) AS every FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
 o AS (SELECT *, 'Talk ' || conv_id AS header, CASE WHEN n < every THEN 2 + length('+ ' || (every - n) || ' more stories omitted for length.') ELSE 0 END AS extra FROM l),
 b AS (SELECT conv_id, header, every, max(CASE WHEN n = every AND length(header) + rich <= 900 THEN every + 1 WHEN length(header) + bare + extra <= 900 THEN n ELSE 0 END) AS rank FROM o GROUP BY ALL),
 c AS (SELECT *, rank > every AS with_sources, least(rank, every) AS shown FROM b)
 SELECT c.conv_id, CAST(shown AS INT) AS shown, CAST(every - shown AS INT) AS omitted, with_sources, header || coalesce(string_agg(chr(10) || chr(10) || t || CASE WHEN with_sources OR m THEN chr(10) || s ELSE '' END, '' ORDER BY n), '') || CASE WHEN shown < every THEN chr(10) || chr(10) || '+ ' || (every - shown) || ' more stories omitted for length.' ELSE '' END AS text
 FROM c LEFT JOIN p ON p.conv_id = c.conv_id AND p.n <= shown GROUP BY c.conv_id, shown, every, with_sources, header""")
def fit_messages(spark, sf_dir):
    """Conversations as sections, a turn a paragraph with its role as source, in messages of 900 characters."""
    c = table(spark, sf_dir, "conversations")
    s = c.select(F.col("conv_id").alias("section")).distinct().withColumn("header", F.concat(F.lit("Talk "), F.col("section").cast("string")))
    p = c.select(F.col("conv_id").alias("section"), F.struct("turn", "text").alias("pos"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("sources"), (F.col("turn") % 3 == 0).alias("merged"))
    return Sel.fit_messages(s, p, 900).withColumnRenamed("section", "conv_id")


@register("merge_articles", with_articles(f""", s AS (SELECT run_id * 8 + article_id % 8 AS set_id, {STORY_OF} AS story_id, * FROM articles), r AS (SELECT set_id, story_id, sum(length(summary)) AS total FROM s GROUP BY ALL),
 d AS (SELECT set_id, arg_max(story_id, (total, story_id)) AS destination FROM r GROUP BY set_id),
 o AS (SELECT s.set_id, destination AS story_id, article_id, split_part(source || '/' || article_id % 5, '?', 1) AS link, s.story_id <> destination AS later, s.story_id AS part, seq FROM s JOIN d ON d.set_id = s.set_id),
 f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY set_id, link ORDER BY later, part, seq) = 1)
 SELECT set_id, story_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY later, part, seq) AS INT) AS n, article_id FROM f"""))
def merge_articles(spark, sf_dir):
    """Sets of neighbouring stories, each merged into its longest, and the articles that it then has."""
    a = articles(spark, sf_dir).withColumn("set_id", F.expr("run_id * 8 + article_id % 8")).withColumn("story_id", F.expr(STORY_OF))
    st = a.groupBy("set_id", "story_id").agg(F.lit(1).alias("importance"), F.sum(F.length("summary")).alias("total"), F.lit(0).alias("latest"))
    merged = So.merge_stories(st.drop("set_id"), st.select("set_id", "story_id"))
    link = F.concat("source", F.lit("/"), (F.col("article_id") % 5).cast("string"))
    members = a.select("story_id", "seq", "article_id", F.concat(link, F.lit("?a=1")).alias("url"), F.when(F.col("article_id") % 2 == 0, F.concat(link, F.lit("?b"))).otherwise("").alias("canonical_url"))
    return So.merge_articles(merged, members)


@register("digest_table", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def digest_table(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@register("latest_success", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_success(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return Sel.first_per(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@register("latest_diagnostics", "SELECT max(event_id) AS event_id FROM events GROUP BY user_id, CAST(ts AS DATE), event_type")
def latest_diagnostics(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts"), "event_type").agg(F.max("event_id").alias("event_id")).select("event_id")


@register("current_annual", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS accession FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY o_custkey")
def current_annual(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.startswith("o_orderpriority", F.lit("1")))
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("accession"))


@register("dedup_filing_events", "SELECT min(l_orderkey * 10 + l_linenumber) AS id FROM lineitem GROUP BY CAST(l_shipdate AS DATE), l_partkey % 100")
def dedup_filing_events(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("k", F.col("l_partkey") % 100).withColumn("day", F.to_date("l_shipdate"))
    return Sel.first_per(li, ["day", "k"], "id").select("id")


@register("editorial_slots", with_articles("SELECT article_id FROM (SELECT article_id, source, row_number() OVER (PARTITION BY source ORDER BY seq) AS r FROM articles) JOIN (SELECT source AS s, count(*) FILTER (doc_id % 200 = 0) AS filings FROM documents GROUP BY source) ON s = source WHERE r <= greatest(0, 2 - least(2, filings))"))
def editorial_slots(spark, sf_dir):
    a = articles(spark, sf_dir)
    filings = a.groupBy("source").agg(F.count_if(F.col("article_id") % 200 == 0).alias("filings"))
    r = F.row_number().over(Window.partitionBy("source").orderBy("seq"))
    return a.withColumn("r", r).join(filings, "source").where(F.col("r") <= F.greatest(F.lit(0), 2 - F.least(F.lit(2), F.col("filings")))).select("article_id")


@register("union_dedup", with_articles("""SELECT u, arg_max(title, (t, pos)) AS title, min(pos) FILTER (t = mt) AS pos FROM (SELECT *, min(t) OVER (PARTITION BY u) AS mt FROM (SELECT 0 AS t, seq AS pos, title, regexp_replace(split_part(url, '?', 1), '/+$', '') AS u FROM articles WHERE article_id % 3 < 2
 UNION ALL SELECT 1, seq, '! ' || title, regexp_replace(split_part(url, '?', 1), '/+$', '') FROM articles WHERE article_id % 3 > 0)) GROUP BY u"""))
def union_dedup(spark, sf_dir):
    a = articles(spark, sf_dir).select(F.col("seq").alias("pos"), "title", T.url_canonical(F.col("url")).alias("u"), "article_id")
    one, two = a.where("article_id % 3 < 2").drop("article_id"), a.where("article_id % 3 > 0").drop("article_id").withColumn("title", F.concat(F.lit("! "), "title"))
    return St.union_dedup(one, two, F.col("u")).select("u", "title", "pos")


@register("upsert", "SELECT coalesce(o.o_orderkey, n.k) AS o_orderkey, coalesce(n.s, o.o_orderstatus) AS o_orderstatus FROM orders o FULL JOIN (SELECT o_orderkey + 100 AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'N' END AS s FROM orders WHERE o_orderkey % 5 = 0) n ON k = o_orderkey")
def upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") + 100).alias("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "N").alias("o_orderstatus"))
    return St.upsert(o, new, ["o_orderkey"])


@register("insert_ignore", "SELECT c_custkey AS k, 'old' AS origin FROM customer UNION ALL SELECT DISTINCT o_custkey + 10, 'new' FROM orders WHERE o_custkey + 10 NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("origin"))
    new = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 10).alias("k"), F.lit("new").alias("origin"))
    return St.insert_ignore(old, new, ["k"], "origin")


@register("roll_history", """WITH e AS (SELECT user_id AS id, min(epoch_us(ts) // 60000000) FILTER (event_id % 2 = 0) AS f, max(epoch_us(ts) // 60000000) FILTER (event_id % 2 = 0) AS l, max(epoch_us(ts) // 60000000) FILTER (event_id % 7 = 0) AS s, max(max(epoch_us(ts) // 60000000)) OVER () AS now FROM events GROUP BY user_id)
 SELECT id, coalesce(f, s) AS first_seen, coalesce(s, l) AS last_seen FROM e WHERE coalesce(s, l) >= now - 10080""")
def roll_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", minute_of(F.col("ts")).alias("m"))
    old = e.where("event_id % 2 = 0").groupBy("id").agg(F.min("m").alias("first_seen"), F.max("m").alias("last_seen"))
    new = e.where("event_id % 7 = 0").groupBy("id").agg(F.max("m").alias("seen"))
    return St.roll_history(old, new, e.agg(F.max("m")).first()[0], 10080)


@register("retention", "SELECT o_orderkey, CASE WHEN o_orderkey % 500 <= 180 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_orderstatus END AS o_orderstatus FROM orders")
def retention(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    guard = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return St.retention(o, F.col("o_orderkey") % 500, 180, guard, "o_custkey", "o_orderstatus").select("o_orderkey", "o_orderstatus")


@register("incremental_filings", """WITH e AS (SELECT event_id, user_id % 20 AS src, epoch_us(ts) // 60000000 AS m_at FROM events), m AS (SELECT src, min(m_at) + 5000 AS mark FROM e WHERE src < 15 GROUP BY src), c AS (SELECT max(m_at) - 1000 AS cut FROM e)
 SELECT event_id FROM e LEFT JOIN m ON m.src = e.src, c WHERE m_at <= cut AND CASE WHEN mark IS NULL THEN m_at >= cut - 2880 ELSE m_at > mark END""")
def incremental_filings(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("src"), minute_of(F.col("ts")).alias("at"))
    marks = e.where("src < 15").groupBy("src").agg((F.min("at") + 5000).alias("mark"))
    cut = F.lit(e.agg(F.max("at")).first()[0] - 1000)
    return St.incremental(e, marks, "src", "at", cut, cut - 2880).select("event_id")


@register("advance_watermarks", """WITH e AS (SELECT user_id % 20 AS src, epoch_us(ts) // 60000000 AS m_at, value FROM events), m AS (SELECT src, min(m_at) AS mark FROM e WHERE src < 15 GROUP BY src)
 SELECT coalesce(m.src, s.src) AS src, CASE WHEN whole THEN CASE WHEN mark IS NULL OR latest > mark THEN latest ELSE mark END ELSE mark END AS mark FROM m FULL JOIN (SELECT src, max(m_at) AS latest, min(value) > 0.2 AS whole FROM e GROUP BY src) s ON s.src = m.src""")
def advance_watermarks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("src"), minute_of(F.col("ts")).alias("at"), "value")
    marks = e.where("src < 15").groupBy("src").agg(F.min("at").alias("mark"))
    return St.advance(marks, e, "src", "at", F.col("value") > 0.2)
