"""Watchlist terms, entity relations and filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from .articles import bounded
from .intervals import in_force, until_next
from .mentions import best_names
from .phrases import phrase_places, words_of

# Forms, items and words that make a filing material.
MATERIAL_8K = ("1.01", "1.02", "1.03", "2.01", "2.02", "2.03", "2.04", "2.05", "2.06", "3.01", "4.02", "5.01", "5.02", "5.03", "5.04", "5.05", "5.06", "5.07", "8.01")
REVIEW_8K = ("7.01",)
PERIODIC = ("10-Q", "10-K", "20-F", "40-F")
SIX_K_TERMS = (
    "annual results", "interim results", "quarterly results", "financial results", "earnings", "guidance", "outlook", "acquisition", "merger", "disposition", "divestiture",
    "regulatory approval", "investigation", "litigation", "chief executive", "ceo", "dividend", "share repurchase", "capital raise", "offering", "restructuring",
)
EDITORIAL_TERMS = SIX_K_TERMS + ("product launch", "product recall", "data breach", "cyberattack", "bankruptcy", "delisting", "antitrust", "settlement", "profit warning", "forecast")
ETHEREUM_TERMS = (
    "protocol upgrade", "hard fork", "staking", "exchange-traded", "etf approval", "regulation", "regulatory", "security incident", "exploit", "hack",
)
RELATIONS = {
    "self": "DIRECT", "controlled_affiliate": "AFFILIATE", "managed_capital": "MANAGED_CAPITAL", "underlying_asset": "UNDERLYING_ASSET", "family_ambiguous": "FAMILY_UNRESOLVED",
    "unrelated": "MENTION_ONLY",
}
MUST_BE_FRESH, BESIDE_THE_EVENT = ("controlled_affiliate", "managed_capital", "underlying_asset"), ("quoted_speaker", "mentioned", "absent")
# End of fixed values.


def match_terms(rows: DataFrame, terms) -> DataFrame:
    """(article_id, term) of rows (article_id, summary): single words as whole words, several words if all occur.

    Terms, a list or a table (term) of any length, meet the texts' words by equality; the list is broadcast only where its
    counted size allows it. Where the words must follow each other, see :func:`phrases.phrase_places`.
    """
    if not isinstance(terms, DataFrame):
        terms = rows.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    own = terms.select("term").distinct().withColumn("w", F.array_distinct(words_of(F.col("term"))))
    parts = own.select("term", F.explode("w").alias("w"), F.size("w").alias("n"))
    keyed = rows.select("article_id", F.explode(F.array_distinct(words_of(F.col("summary")))).alias("w"))
    hit = keyed.join(bounded(parts), "w").groupBy("article_id", "term", "n").agg(F.count(F.lit(1)).alias("k"))
    return hit.where("k = n").select("article_id", "term")


def filing_is_material(form: Column, items: Column) -> Column:
    """True, false, or null where the content must decide."""
    base = F.regexp_replace(form, "/A$", "")
    eight = F.when(F.arrays_overlap(items, T.words_in(MATERIAL_8K)), F.lit(True)).when(F.arrays_overlap(items, T.words_in(REVIEW_8K)), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return F.when(base == "8-K", eight).when(base.isin(*PERIODIC), F.lit(True)).when(base == "6-K", F.lit(None).cast("boolean")).otherwise(F.lit(False))


def text_is_material(text: Column, terms=SIX_K_TERMS) -> Column:
    return F.rlike(F.lower(T.nonnull(text)), F.lit("|".join(terms)))


def ethereum_is_material(text: Column, move_explained: Column) -> Column:
    """Whether an item about the currency matters: it explains a move, or names one of the events."""
    return F.coalesce(move_explained, F.lit(False)) | text_is_material(text, ETHEREUM_TERMS)


def filing_disposition(material: Column, body: Column, metadata: Column) -> Column:
    """How a filing enters the report: by its form, its content, its metadata, or not at all."""
    return (
        F.when(material, "rendered").when(~material, "excluded_form").when(body.isNotNull() & text_is_material(body), "rendered_content").when(body.isNotNull(), "excluded_content")
        .when(text_is_material(metadata), "rendered_metadata_fallback").otherwise("excluded_metadata")
    )


def classify_entities(texts: DataFrame, names: DataFrame, negatives: DataFrame) -> DataFrame:
    """(id, ticker, name, label) of texts (id, text): the longest name of a ticker that the text holds, unless it holds one
    of the ticker's negative names (ticker, name).

    Names are (ticker, name, relationship, fresh, context), of one word or several; one with a ``context`` counts only in
    texts with that word too. All are looked up as phrases (:func:`phrases.phrase_places`), so that of a text only its
    words that stand in the lists are dealt out, never the text beside each of its words.
    """
    beside = names.where("context is not null").select(F.col("context").alias("phrase"))
    listed = names.select(F.col("name").alias("phrase")).unionByName(beside).unionByName(negatives.select(F.col("name").alias("phrase")))
    places = cut(phrase_places(texts, listed).select("id", "phrase"), "places")
    bad = places.join(bounded(negatives.select("ticker", F.col("name").alias("phrase")).distinct()), "phrase").select("id", "ticker").distinct()
    held = places.join(bounded(names.select(F.col("name").alias("phrase"), "ticker", "name", "relationship", "fresh", "context")), "phrase")
    tied = held.where("context is not null").withColumn("phrase", F.col("context")).join(places, ["id", "phrase"], "left_semi")
    hit = held.where("context is null").unionByName(tied).join(bad, ["id", "ticker"], "left_anti")
    best = hit.groupBy("id", "ticker").agg(F.max_by(F.struct("name", "relationship", "fresh"), F.struct(F.length("name"), "name")).alias("b"))
    label = F.when(~F.col("b.fresh"), "needs_review").when(F.col("b.relationship") == "issuer", "direct").otherwise("related")
    return best.select("id", "ticker", F.col("b.name").alias("name"), label.alias("label"))


def classify_mentions(texts: DataFrame, names: DataFrame, negatives: DataFrame, filings: DataFrame) -> DataFrame:
    """(id, ticker, name, label, fresh, place, reason) of texts (id, text, day, role), a row for every ticker that one names.

    Names are (ticker, name, seq, relationship, verified_at, expires_at, min_tokens, context, accession), a row for each
    time that a relationship was verified; a row holds from ``verified_at`` to ``expires_at`` inclusive, without end where
    that is null, and no longer than until the next one of the name. Names, negative names (ticker, name) and context words
    stand in a text as phrases. Of the names that a text holds, with one of their context phrases if there are any, the
    longest counts, of equal ones the first by ``seq``; names of fewer words than ``min_tokens`` do not count.

    A text with a negative name of the ticker is a mention only. Otherwise the relationship is fresh if the name's row in
    force on the text's day was verified against the annual filing then current (filings: ticker, accession, accepted),
    where both are known; a name for the issuer itself always is. Without a row in force the last one verified by then tells the
    relationship, or else the first, which is stale. Null days meet no row. Texts without any name have no row; rows that
    repeat an id are a text each.

    A text's names are judged where it is read (:func:`mentions.best_names`); what meets relationships and filings is a row
    for each ticker that a text names.
    """
    listed = names.where(F.size(words_of(F.col("name"))) >= F.coalesce("min_tokens", F.lit(1)))
    kinds = listed.groupBy("ticker", "name").agg(
        F.lit(False).alias("refused"), F.max(F.size(F.coalesce("context", F.array().cast("array<string>"))) > 0).alias("tied"), F.min("seq").alias("seq"),
        F.min_by("relationship", F.struct("verified_at", "relationship")).alias("first"),
    )
    none = F.lit(None)
    refused = negatives.select("ticker", "name").distinct().select("ticker", "name", F.lit(True).alias("refused"), F.lit(False).alias("tied"), none.cast("long").alias("seq"), none.cast("string").alias("first"))
    # a negative name comes before all others, the least of them first
    order = [F.col("refused"), F.when(F.col("refused"), 0).otherwise(F.length("name")), F.col("seq").desc_nulls_first(), F.col("name").desc()]
    beside = listed.select("ticker", "name", F.explode("context").alias("phrase"))
    found = best_names(texts.select("id", "day", "role", "text"), kinds.unionByName(refused), beside, order)
    last = texts.agg(F.max("day").alias("d")).first().d
    rows = listed.select("ticker", "name", "verified_at", "relationship", "expires_at", "accession")
    versions = until_next(rows, ["ticker", "name"], "verified_at", "replaced")
    current = until_next(filings.select("ticker", F.col("accepted").alias("since"), F.col("accession").alias("current")), ["ticker"], "since", "current_until")
    told = in_force(found.where("id is not null or refused"), versions, ["ticker", "name"], "day", "verified_at", "replaced", "left", last)
    told = in_force(told, current, ["ticker"], "day", "since", "current_until", "left", last)
    now = F.col("verified_at").isNotNull() & (F.col("expires_at").isNull() | (F.col("day") <= F.col("expires_at")))
    told = told.withColumn("relation", F.coalesce("relationship", "first"))
    told = told.withColumn("fresh", ~F.col("refused") & (F.coalesce(F.col("relation") == "self", F.lit(False)) | (now & F.coalesce(F.col("current") == F.col("accession"), F.lit(True)))))
    label = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])[F.col("relation")]
    beside_event = F.col("refused") | F.col("role").isin(*BESIDE_THE_EVENT) | (~F.col("fresh") & F.col("relation").isin(*MUST_BE_FRESH))
    reason = F.when(F.col("refused"), "negative_name").when(F.col("fresh"), "matched").otherwise("stale_relationship")
    return told.select("id", "ticker", "name", F.when(beside_event, "MENTION_ONLY").otherwise(label).alias("label"), "fresh", "place", reason.alias("reason"))


def explode_filings(payloads: DataFrame) -> DataFrame:
    """(cik, accession, form, amended, items, filing_date, accepted_at, document, description) of payloads (cik, json) with
    parallel arrays under filings.recent. Payloads whose five required arrays are missing or differ in length have none;
    items and descriptions of another length are left empty. Times may be ISO or digits only."""
    required = ("accessionNumber", "filingDate", "acceptanceDateTime", "form", "primaryDocument")
    names = (*required, "items", "primaryDocDescription")
    schema = "filings struct<recent struct<" + ", ".join(f"{n} array<string>" for n in names) + ">>"
    p = payloads.select("cik", F.from_json("json", schema).alias("j")).select("cik", "j.filings.recent.*")
    for n in required:
        p = p.where(F.size("accessionNumber") == F.size(n))
    for n in ("items", "primaryDocDescription"):
        p = p.withColumn(n, F.when(F.size(n) == F.size("form"), F.col(n)).otherwise(F.array_repeat(F.lit(""), F.size("form"))))
    r = p.select("cik", F.explode(F.arrays_zip(*names)).alias("r")).select("cik", "r.*")
    split = F.filter(F.transform(F.split(T.nonnull(F.col("items")), ","), F.trim), lambda x: x != "")
    when = F.col("acceptanceDateTime")
    accepted = F.coalesce(F.try_to_timestamp(F.substring(when, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(F.regexp_replace(when, "[^0-9]", ""), F.lit("yyyyMMddHHmmss")))
    return r.select(
        "cik", F.col("accessionNumber").alias("accession"), "form", F.endswith("form", F.lit("/A")).alias("amended"), split.alias("items"), F.try_to_date("filingDate", "yyyy-MM-dd").alias("filing_date"),
        accepted.alias("accepted_at"), F.col("primaryDocument").alias("document"), F.trim(T.nonnull(F.col("primaryDocDescription"))).alias("description"),
    )
