"""Logs in dated folders of JSON lines, replaced a day at a time, with a manifest that tells when a day is whole.

``root``/kind/day=YYYY-MM-DD holds the lines, ``root``/manifest/kind=.../day=... the number of a day's lines and a digest of
them that does not depend on their order. A run replaces the days that it covers, those for which it has no lines included;
other days stay. Tasks write to a staging folder that Spark moves when all are done, so a task that is killed and run again,
or a whole run that is repeated, leaves the same lines; a run that dies between lines and manifest leaves a day that
:func:`verify` tells and the next run replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: Lines of a file, about.
FILE_ROWS = 250_000
LINES = "value string, day date"


def line_of(columns: list[str]) -> Column:
    """The columns as a JSON object, keys in the order of their names, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def _summed(lines: DataFrame) -> DataFrame:
    """(day, lines, digest): a sum of the lines' hashes, in which a repeated line counts as often as it stands there."""
    digest = F.sum(F.xxhash64("value").cast("decimal(38, 0)")).cast("string")
    return lines.groupBy("day").agg(F.count(F.lit(1)).alias("lines"), digest.alias("digest"))


def write_log(rows: DataFrame, root: str, kind: str, days: DataFrame | None = None) -> DataFrame:
    """Write ``rows`` (day, and the columns of a line) as the log of a kind, and return its manifest (kind, day, lines, digest).

    ``days`` (day) names days that the run covers even if it has no lines for them. A day's lines are dealt to files by
    their hash, as many as its count needs, and sorted within, so that neither a busy day nor a restarted task changes what
    a file holds. Rows without a day are refused.
    """
    spark = rows.sparkSession
    lines = cut(rows.select(F.col("day").cast("date").alias("day"), line_of([c for c in rows.columns if c != "day"]).alias("value")), "lines")
    if not lines.where("day IS NULL").isEmpty():
        raise ValueError(f"rows of the log {kind} lack a day")
    summed = cut(_summed(lines), "summed")
    files = summed.select("day", F.ceil(F.col("lines") / FILE_ROWS).alias("files"))
    dealt = lines.join(files, "day").withColumn("file", F.pmod(F.xxhash64("value"), F.col("files")))
    # FILE_ROWS is a bound of a file too, for rows of a day that meet in one task
    dealt.repartition("day", "file").sortWithinPartitions("day", "file", "value").select("value", "day").write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 2 * FILE_ROWS).text(f"{root}/{kind}")
    manifest = summed
    if days is not None:
        none = days.select(F.col("day").cast("date").alias("day")).distinct().join(summed, "day", "left_anti")
        _remove(spark, root, kind, [r.day for r in none.collect()])
        manifest = summed.unionByName(none.select("day", F.lit(0).cast("bigint").alias("lines"), F.lit("0").alias("digest")))
    manifest = cut(manifest.select(F.lit(kind).alias("kind"), "day", "lines", "digest"), "manifest")
    manifest.repartition(1).write.partitionBy("kind", "day").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(f"{root}/manifest")
    return manifest


def _remove(spark: SparkSession, root: str, kind: str, days: list) -> None:
    """Remove the folders of days without lines; the days of a run are few."""
    for day in days:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}/day={day}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_log(spark: SparkSession, root: str, kind: str, schema: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """(day, the schema's columns, broken) of the days from ``since`` to ``until`` inclusive, which folders' names alone
    decide; a line that does not parse has nulls and is kept in ``broken``."""
    lines = spark.read.schema(LINES).text(f"{root}/{kind}")
    if since:
        lines = lines.where(F.col("day") >= F.lit(since).cast("date"))
    if until:
        lines = lines.where(F.col("day") <= F.lit(until).cast("date"))
    parsed = F.from_json("value", f"{schema}, broken string", {"columnNameOfCorruptRecord": "broken"})
    return lines.select("day", parsed.alias("x")).select("day", "x.*")


def verify(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(day, lines, listed, whole) of every day that has lines or stands in the manifest."""
    listed = spark.read.schema("kind string, day date, lines bigint, digest string").json(f"{root}/manifest").where(F.col("kind") == kind)
    told = listed.select("day", F.col("lines").alias("listed"), F.col("digest").alias("told"))
    both = _summed(spark.read.schema(LINES).text(f"{root}/{kind}")).join(told, "day", "full")
    lines = F.coalesce("lines", F.lit(0)).cast("bigint")
    whole = (lines == F.coalesce("listed", F.lit(-1))) & (F.coalesce("digest", F.lit("0")) == F.coalesce("told", F.lit("")))
    return both.select("day", lines.alias("lines"), "listed", whole.alias("whole"))


def rejection_rows(rejected: DataFrame) -> DataFrame:
    """Lines of refused articles (day, title, source, url, reason)."""
    return rejected.select("day", "title", "source", "url", "reason")


def skipped_rows(stories: DataFrame) -> DataFrame:
    """Lines of stories that were passed over: (day, story_id, title, category, total, importance, reason, sources, urls,
    matches), those with a reason."""
    return stories.where("reason <> ''").select(
        "day", F.col("title").alias("headline"), F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized")).alias("category_candidate"), F.round("total", 2).alias("score"),
        F.round("importance", 2).alias("importance"), F.col("reason").alias("reason_skipped"), F.col("sources").alias("source_names"), F.coalesce(F.get("urls", F.lit(0)), F.lit("")).alias("url"),
        F.col("story_id").alias("duplicate_cluster_id"), F.col("matches").alias("watchlist_match"),
    )


def audit_rows(paragraphs: DataFrame, articles: DataFrame, warned: DataFrame) -> DataFrame:
    """Lines of shortened paragraphs (day, story_id, category, full, delivered, status, ratio) with their evidence, the story's
    articles (story_id, seq, source, url, canonical_url, status), and what the guard said; ``warned`` (story_id) had
    differences."""
    link = F.struct("seq", "source", "url", F.coalesce(F.nullif("canonical_url", F.lit("")), F.col("url")).alias("canonical_url"), F.col("status").alias("evidence_type"))
    own = articles.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(link)), lambda x: x.dropFields("seq")).alias("evidence"))
    joined = paragraphs.join(own, "story_id", "left").join(warned.select("story_id", F.lit(True).alias("w")).distinct(), "story_id", "left")
    result = F.when(F.col("status") == "kept_original_guard_failed", "failed").when(F.col("w"), "warning").when(F.col("status") == "compressed", "passed").otherwise("not_run")
    return joined.select(
        "day", "story_id", "category", F.coalesce("evidence", F.array().cast(own.schema["evidence"].dataType)).alias("evidence"), F.coalesce(F.nullif("full", F.lit("")), F.col("delivered")).alias("full_paragraph"),
        F.col("delivered").alias("delivered_paragraph"), F.col("status").alias("compression_status"), F.col("ratio").alias("compression_ratio"), result.alias("guard_result"),
    )
