"""The driver's tables as domain tables, in Spark and, for the oracles, in SQL with the same values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Articles of one edition.
RUN_ROWS = 128
CATEGORIES = ("business_tech", "domestic", "global", "culture", "finance")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the title is the first twelve words, an edition holds 128 neighbouring ids."""
    d = table(spark, sf_dir, "documents")
    words = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+"), lambda w: w != ""), 1, 12)
    tags = F.array(*[F.lit(c) for c in CATEGORIES])
    one = F.element_at(tags, (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    two = F.element_at(tags, (F.pmod(F.col("doc_id") + 2, F.lit(5)) + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("article_id"), F.floor(F.col("doc_id") / RUN_ROWS).cast("long").alias("run_id"), F.col("doc_id").alias("seq"),
        F.array_join(words, " ").alias("title"), F.coalesce("text", F.lit("")).alias("summary"), "source",
        (F.lit(70) + 5 * (F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 6)).cast("double").alias("rep100"),
        (F.col("doc_id") * 37 % 4320).alias("minute"), F.when(F.col("doc_id") % 7 == 0, F.array(one, two)).otherwise(F.array(one)).alias("tags"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, F.lit("/?utm=x")).otherwise(F.lit(""))).alias("url"),
    ).withColumn("reputation", F.col("rep100") / 100).drop("rep100")


ARTICLES = """articles AS (
 SELECT doc_id AS article_id, CAST(floor(doc_id / 128.0) AS BIGINT) AS run_id, doc_id AS seq,
  array_to_string(list_slice(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> ''), 1, 12), ' ') AS title,
  coalesce(text, '') AS summary, source, CAST(70 + 5 * (CAST(regexp_extract(source, '[0-9]+') AS INT) % 6) AS DOUBLE) / 100 AS reputation,
  doc_id * 37 % 4320 AS minute,
  CASE WHEN doc_id % 7 = 0 THEN [c[doc_id % 5 + 1], c[(doc_id + 2) % 5 + 1]] ELSE [c[doc_id % 5 + 1]] END AS tags,
  'https://' || source || '.example/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '/?utm=x' ELSE '' END AS url
 FROM documents, (SELECT ['business_tech', 'domestic', 'global', 'culture', 'finance'] AS c))"""


def with_articles(sql: str) -> str:
    return f"WITH {ARTICLES}\n{sql}"


def minute_of(ts):
    """Minutes since 1970 of a timestamp without a zone."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 1440 + F.hour(ts) * 60 + F.minute(ts)).cast("long")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as closing prices: a symbol's last value of a day."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 26).alias("symbol"), F.to_date("ts").alias("day"), "ts", "event_id", F.col("value").alias("close"))
    last = F.max_by("close", F.struct("ts", "event_id")).alias("close")
    return e.groupBy("symbol", "day").agg(last)


QUOTES = """quotes AS (
 SELECT user_id % 26 AS symbol, CAST(ts AS DATE) AS day, arg_max(value, (epoch_us(ts), event_id)) AS close
 FROM events GROUP BY 1, 2)"""
