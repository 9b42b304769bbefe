"""Cached articles: JSON arrays of all of an article's fields, with a default for each that is not there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An article's fields, their types, and what they are where a cached article lacks them (no default: required).
FIELDS = (
    ("title", "string", None), ("url", "string", None), ("source", "string", None), ("published_at", "timestamp", None), ("summary", "string", ""), ("canonical_url", "string", ""), ("feed_content", "string", ""),
    ("extracted_text", "string", ""), ("enrichment_status", "string", "not_attempted"), ("enrichment_error_code", "string", ""), ("evidence_score", "double", 0.0), ("reputation", "double", 0.7),
    ("feed_categories", "array<string>", ()), ("feed_source_type", "string", "general"), ("feed_culture_lane", "string", ""), ("feed_timestamp_valid", "boolean", True), ("content_quality_penalty", "double", 0.0),
)
# End of fixed values.
SCHEMA = ", ".join(f"{name} {kind}" for name, kind, _ in FIELDS)
ISO = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"


def _default(kind: str, value) -> Column:
    return F.array().cast(kind) if kind.startswith("array") else F.lit(value).cast(kind)


def to_payloads(articles: DataFrame, key: str, order: str) -> DataFrame:
    """(key, payload): the articles of a key, a cache entry of bounded size, as a JSON array in their order."""
    row = F.struct(*[F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(name) if kind == "timestamp" else F.col(name) for name, kind, _ in FIELDS])
    each = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.to_json(row).alias("j")))), lambda x: x["j"])
    return articles.groupBy(key).agg(F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")).alias("payload"))


def from_payloads(payloads: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(articles, rejected) of payloads (key, payload): articles are (key, pos, the fields); a missing field has its default.
    Rejected are (key, pos, reason): a payload that is no array, and items that are no article for want of a required field
    or of a time that can be read. Items that are no objects are left out, as if they were not there."""
    opened = payloads.select(key, F.from_json("payload", "array<string>").alias("items"))
    broken = opened.where("items IS NULL").select(key, F.lit(None).cast("int").alias("pos"), F.lit("no array").alias("reason"))
    items = opened.select(key, F.posexplode("items").alias("pos", "item")).where(F.startswith(F.ltrim("item"), F.lit("{")))
    given = ", ".join(f"{name} {'string' if kind == 'timestamp' else kind}" for name, kind, _ in FIELDS)
    read = items.select(key, "pos", F.from_json("item", given).alias("a"))
    fields = []
    for name, kind, default in FIELDS:
        value = F.try_to_timestamp(F.col(f"a.{name}"), F.lit(ISO)) if kind == "timestamp" else F.col(f"a.{name}")
        fields.append((value if default is None else F.coalesce(value, _default(kind, default))).alias(name))
    rows = read.select(key, "pos", *fields)
    required = [name for name, _, default in FIELDS if default is None]
    reason = F.coalesce(*[F.when(F.col(name).isNull(), name) for name in required])
    return rows.where(reason.isNull()), broken.unionByName(rows.where(reason.isNotNull()).select(key, "pos", reason.alias("reason")))
