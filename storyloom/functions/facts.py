"""Sentences, figures, anchors and tickers of texts, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_words, nonnull, words_in

# Words that results depend on.
ABBREVIATIONS = (
    "adm al approx assn atty ave blvd bros capt cf cmdr co col corp dept det dist div dr ed eds eg est etc fig ft gen gov hon ie inc jr lt ltd maj messrs mr mrs ms "
    "mt mx no pp pres prof rd rep rev sen sgt sq sr st supt univ vol vs"
).split()
ENTITY_WORDS = "A An And As At Before But By For From He Her His In It Its On Or She That The Their They This To We With".split()
TICKER_STOPWORDS = "AI API CEO CFO COO CTO DOJ ETF EU FDA FTC GDP IPO MLB NBA NATO NFL SEC TV UK UN US USA USD VC".split()
ALIASES = {"alphabet": "GOOGL", "amazon": "AMZN", "apple": "AAPL", "google": "GOOGL", "meta": "META", "microsoft": "MSFT", "nvidia": "NVDA", "tesla": "TSLA"}
NEGATIONS = (
    "no not never none neither nor without cannot can't isn't aren't wasn't weren't didn't doesn't don't won't wouldn't couldn't shouldn't hasn't haven't hadn't"
).split()
MODALS = (
    "may might could can will would should must likely unlikely possibly possible expected expects? estimated estimates? forecasts? projected proposed planned plans? reportedly allegedly"
).split()
ATTRIBUTIONS = "according\\s+to said says reported reports claimed claims alleged alleges announced confirmed denied warned argued told".split()
CAUSES = ("because\\s+of", "because", "due\\s+to", "driven\\s+by", "caused\\s+by", "prompted\\s+by", "led\\s+to", "resulting\\s+from", "as\\s+a\\s+result")
DATES = (
    "(?:19|20)[0-9]{2} january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday q[1-4]"
).split()
TICKERS = (
    r"\$([A-Z][A-Z0-9.]{0,5})\b", r"\b(?:NASDAQ|NYSE|AMEX|NYSEARCA)\s*:\s*([A-Z][A-Z0-9.]{0,5})\b", r"\(([A-Z][A-Z0-9.]{0,5})\)", r"\b([A-Z][A-Z0-9.]{0,5})\s+(?:stock|shares)\b",
)
WATCHED = (r"\$([A-Z][A-Z0-9.-]{1,5})\b", r"\b(?:NASDAQ|NYSE|AMEX|NYSEARCA)\s*:?\s*([A-Z][A-Z0-9.-]{1,5})\b", r"\(([A-Z][A-Z0-9.-]{1,5})\)")
EVENTS = (
    (("share repurchase", "stock repurchase", "share buyback"), "share_buyback"), (("acquisition", "merger"), "acquisition_or_merger"), (("regulatory approval",), "regulatory_approval"),
    (("chief executive", " ceo "), "leadership"), (("dividend",), "dividend"), (("capital raise", "offering"), "financing"), (("restructuring",), "restructuring"),
)
# End of fixed values.

#: White space after a closing sign, unless an abbreviation, a dotted acronym or an initial stands before it.
BOUNDARY = rf"(?<=[.!?])(?<!(?:^|[^A-Za-z.])(?i:{'|'.join(ABBREVIATIONS)})\.)(?<!\.[A-Za-z.]{{0,24}}\.)(?<!(?:^|[^A-Za-z.])[A-Z]\.)[ \t\n\r]+"
#: White space of a figure, the kinds that keep it on one line included.
GAP = "[ \\t\\n\\f\\r\u00a0\u2009\u202f]"
FIGURE = (
    rf"(?i)[+-]?{GAP}*[$€£]?{GAP}*[+-]?{GAP}*(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)(?:{GAP}*(?:thousand|million|billion|trillion))?"
    rf"(?:{GAP}*(?:%|percent(?:age{GAP}+points?)?|basis{GAP}+points?|bps|dollars?|euros?|pounds?))?"
)
#: Capital words may go on with accented letters of the Latin-1 block, and begin and end where letters, numbers and "_" meet
#: other signs, whatever a regex dialect takes for a word: marks, circled letters and joiners are other signs. A letter beyond
#: the first 65,536 characters has Java look behind by whole ones.
CAPITAL = (
    "(?<![\\p{L}\\p{N}_\U00010000])"
    r"([A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’.-]*)(?:(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?![\p{L}\p{N}_])|(?<=['’.-])(?=[\p{L}\p{N}_]))"
)


def split_sentences(text: Column) -> Column:
    return F.filter(F.split(nonnull(text), BOUNDARY), lambda s: s != "")


def extractive_summary(title: Column, text: Column, limit: int = 420) -> Column:
    """Whole sentences of the text up to the limit, the title before them if they do not hold it."""
    flat = F.trim(F.regexp_replace(nonnull(text), r"[ \t\n\r]+", " "))
    head = F.trim(F.regexp_replace(nonnull(title), r"[ \t\n\r]+", " "))
    full = F.when(F.contains(F.lower(flat), F.lower(head)), flat).otherwise(F.concat(head, F.lit(". "), flat))

    def add(s: Column, sentence: Column) -> Column:
        longer = F.trim(F.concat_ws(" ", s["t"], sentence))
        fits = ~s["full"] & (F.length(longer) <= limit)
        return F.struct(F.when(fits, longer).otherwise(s["t"]).alias("t"), (~fits).alias("full"))

    cut = F.aggregate(split_sentences(full), F.struct(F.lit("").alias("t"), F.lit(False).alias("full")), add)["t"]
    fitted = F.coalesce(F.nullif(cut, F.lit("")), F.rtrim(F.substring(full, 1, limit)))
    return F.when(flat == "", head).when(F.length(full) <= limit, full).otherwise(fitted)


def headline(text: Column, least: int = 20) -> Column:
    """The first sentence, or the first ones until they are long enough."""
    grown = F.aggregate(split_sentences(text), F.lit(""), lambda s, x: F.when(F.length(s) >= least, s).otherwise(F.trim(F.concat_ws(" ", s, x))))
    return grown


def dates(text: Column) -> Column:
    """Names of months and days, years and quarters, with repeats."""
    return F.regexp_extract_all(F.lower(ascii_words(text)), F.lit(r"\b(" + "|".join(DATES) + r")\b"), F.lit(1))


def figures(text: Column) -> Column:
    """Figures with sign, currency, scale and unit, and dates, as a multiset of normalised tokens."""
    plain = F.replace(nonnull(text), F.lit("−"), F.lit("-"))

    def normal(m: Column) -> Column:
        low = F.lower(m)
        value = F.regexp_replace(F.regexp_extract(low, r"([0-9][0-9,.]*)", 1), ",", "")
        value = F.when(F.contains(value, F.lit(".")), F.regexp_replace(F.regexp_replace(value, "0+$", ""), r"\.$", "")).otherwise(value)
        money = F.when(F.rlike(low, F.lit(r"[$]")), "usd").when(F.contains(low, F.lit("€")), "eur").when(F.contains(low, F.lit("£")), "gbp")
        money = money.when(F.contains(low, F.lit("dollar")), "usd").when(F.contains(low, F.lit("euro")), "eur").when(F.contains(low, F.lit("pound")), "gbp")
        unit = F.when(F.contains(low, F.lit("percentage")), "percentage_points").when(F.rlike(low, F.lit("%|percent")), "%").when(F.rlike(low, F.lit("basis|bps")), "basis_points")
        scale = F.nullif(F.regexp_extract(low, "(thousand|million|billion|trillion)", 1), F.lit(""))
        sign = F.regexp_extract(low, "([+-])", 1)
        return F.concat_ws(":", F.coalesce(money, F.lit("num")), F.concat(sign, value), scale, F.when(money.isNull(), unit))

    return F.concat(F.transform(F.regexp_extract_all(plain, F.lit(FIGURE), F.lit(0)), normal), F.transform(dates(text), lambda d: F.concat(F.lit("date:"), d)))


def anchors(text: Column) -> Column:
    """Words of negation, modality, attribution and cause, as a multiset."""
    t = F.lower(ascii_words(text))
    space = r"[ \t\n\f\r]"  # a vertical tab is white space in some dialects only

    def found(kind: str, terms) -> Column:
        hits = F.regexp_extract_all(t, F.lit(r"\b(" + "|".join(terms).replace(r"\s", space) + r")\b"), F.lit(1))
        return F.transform(hits, lambda m: F.concat(F.lit(kind + ":"), F.regexp_replace(m, space + "+", " ")))

    return F.concat(found("negation", NEGATIONS), found("modality", MODALS), found("attribution", ATTRIBUTIONS), found("causal", CAUSES))


def capitalized(text: Column) -> Column:
    """Words with a capital first letter, without common ones, as a set."""
    hits = F.regexp_extract_all(nonnull(text), F.lit(CAPITAL), F.lit(1))
    return F.array_except(F.array_distinct(hits), words_in(ENTITY_WORDS))


def headline_tickers(text: Column) -> Column:
    """Ticker symbols named in any of the usual ways, and those of well-known companies, as a set."""
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])

    def named(t: Column) -> Column:
        found = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in TICKERS]))
        symbols = F.transform(found, lambda s: F.replace(s, F.lit("."), F.lit("-")))
        known = F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(rf"\b({'|'.join(ALIASES)})\b"), F.lit(1)))
        return F.array_distinct(F.concat(F.array_except(symbols, words_in(TICKER_STOPWORDS)), F.transform(known, lambda a: F.element_at(alias, a))))

    # the plain text is worked out once, as the one element of an array, and read once for all companies
    return F.transform(F.array(ascii_words(text)), named)[0]


def explicit_tickers(text: Column) -> Column:
    """Symbols that a text names outright: after a dollar sign, after an exchange, or in brackets, as a set."""
    t = ascii_words(text)
    found = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in WATCHED]))
    return F.array_distinct(F.transform(found, lambda s: F.replace(s, F.lit("."), F.lit("-"))))


def filing_event(form: Column, items: Column, text: Column, description: Column) -> Column:
    """The key under which a filing's event is the same as another's; the first rule that applies."""
    low, base = F.lower(nonnull(text)), F.regexp_replace(form, "/A$", "")
    results = F.rlike(low, F.lit(r"\bq[1-4]\s+20[0-9]{2}\b|financial results|quarterly results|financial report|earnings"))
    outlook = F.rlike(low, F.lit("outlook|guidance"))
    key = F.when(F.array_contains(items, "2.02") | (base.isin("10-Q", "10-K", "20-F", "40-F") & (F.trim(low) == "")), "financial_results")
    key = key.when(results & outlook, "financial_results_outlook").when(results, "financial_results").when(outlook, "financial_outlook")
    for terms, name in EVENTS:
        key = key.when(F.rlike(low, F.lit("|".join(terms))), name)
    bare = F.regexp_replace(F.trim(nonnull(description)), r"\.+$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    plain = F.lower(bare).isin("", "6-k", "form 6-k", "8-k", "form 8-k") | (slug == "")
    return key.when(plain, "company_update").otherwise(slug)


# Forms of companies that readers are spared, and what a filing's headline says of its event.
LEGAL_FORMS = ("A/S", "Inc\\.?", "Corporation", "Corp\\.?", "Ltd\\.?", "Limited", "plc")
HEADLINES = {
    "financial_outlook": "updated its sales and profit outlook", "share_buyback": "updated its share buyback program", "acquisition_or_merger": "announced a major acquisition or merger update",
    "regulatory_approval": "announced a regulatory approval", "leadership": "announced a leadership update", "dividend": "announced a dividend update", "financing": "announced a financing update",
    "restructuring": "announced a restructuring update", "company_update": "filed an important company update",
}
# End of fixed values.


def filing_headline(form: Column, items: Column, text: Column, description: Column, issuer: Column) -> Column:
    """The headline that goes with :func:`filing_event`: which results, the year and direction of an outlook, and how far
    sales and profit rose where a quarter's text says both; otherwise what kind of news it is, or the description."""
    t, base = nonnull(text), F.regexp_replace(form, "/A$", "")
    who = F.trim(F.regexp_replace(F.trim(nonnull(issuer)), rf"(?i)\s+(?:{'|'.join(LEGAL_FORMS)})$", ""))
    event = filing_event(form, items, text, F.lit(""))
    found = lambda pattern, group: F.nullif(F.regexp_extract(t, "(?i)" + pattern, group), F.lit(""))
    quarter, quarter_year, year = found(r"\b(q[1-4])\s+20[0-9]{2}\b", 1), found(r"\bq[1-4]\s+(20[0-9]{2})\b", 1), found(r"\b(20[0-9]{2})\b", 1)
    rise = lambda what: found(rf"adjusted {what}(?: growth)?\s+(?:increased|rose)\s+by\s+([0-9]+(?:\.[0-9]+)?)\s*%", 1)
    sales, profit = rise("sales"), rise("operating profit")
    direction = F.when(F.rlike(t, F.lit(r"(?i)\b(?:raise[sd]?|improved)\b")), "raised").when(F.rlike(t, F.lit(r"(?i)\b(?:lower(?:ed|s)?|cut|reduced)\b")), "lowered").otherwise("updated")
    which = F.coalesce(F.concat(F.lit(" "), F.coalesce(quarter_year, year)), F.lit(""))
    figures_of = F.concat(F.lit(" after adjusted "), F.upper(quarter), F.lit(" sales rose "), sales, F.lit("% and adjusted profit rose "), profit, F.lit("%"))
    outlook = F.concat(direction, F.lit(" its"), which, F.lit(" sales and profit outlook"), F.coalesce(figures_of, F.lit(" after reporting quarterly results")))
    results = F.concat(F.lit("reported"), F.coalesce(F.concat(F.lit(" "), F.upper(quarter), F.lit(" "), quarter_year), F.lit("")), F.lit(" financial results"))
    report = F.concat(F.lit("filed its "), F.when(base == "10-Q", "quarterly").otherwise("annual"), F.lit(" financial report"))
    bare = F.regexp_replace(F.trim(nonnull(description)), r"\.+$", "")
    plain = F.lower(bare).isin("", "6-k", "form 6-k", "8-k", "form 8-k")

    def told(e: Column) -> Column:
        said = F.when(F.array_contains(items, "2.02"), "reported financial results").when(base.isin("10-Q", "10-K", "20-F", "40-F") & (F.trim(t) == ""), report)
        said = said.when(e == "financial_results_outlook", outlook).when(e == "financial_results", results)
        said = said.when((e != "company_update") | plain, F.element_at(F.create_map(*[F.lit(x) for kv in HEADLINES.items() for x in kv]), e))
        return F.concat(who, F.coalesce(F.concat(F.lit(" "), said), F.concat(F.lit(": "), bare)), F.lit("."))

    # the event is worked out once, as the one element of an array
    return F.transform(F.array(event), told)[0]
