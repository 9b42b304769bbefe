"""Quote files as Spark sources: a declared schema, broken rows kept apart, and no column read that is not asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import percent_change
from ..session import cut

CSV = "Symbol string, Date date, Time string, Open double, High double, Low double, Close double, Volume bigint, broken string"
CHART = (
    "chart struct<result array<struct<meta struct<symbol string, regularMarketPrice double, previousClose double, chartPreviousClose double>, "
    "indicators struct<quote array<struct<close array<double>, volume array<bigint>>>>>>, error struct<code string>>, broken string"
)


def csv_rows(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the files below ``root`` (Symbol,Date,Time,Open,High,Low,Close,Volume, with a header; N/D is null), with the
    row's text in ``broken`` where a value is not of its kind or there are too few."""
    return spark.read.schema(CSV).csv(root, header=True, nullValue="N/D", mode="PERMISSIVE", columnNameOfCorruptRecord="broken", dateFormat="yyyy-MM-dd", enforceSchema=False)


def quotes_of_csv(rows: DataFrame) -> DataFrame:
    """(symbol, day, latest, previous, volume, change) of the rows that are whole and have a close; the previous price is
    the opening one."""
    whole = rows.where("broken IS NULL AND Close IS NOT NULL")
    return whole.select(F.upper("Symbol").alias("symbol"), F.col("Date").alias("day"), F.col("Close").alias("latest"), F.col("Open").alias("previous"), F.col("Volume").alias("volume"), percent_change(F.col("Close"), F.col("Open")).alias("change"))


def chart_rows(spark: SparkSession, root: str) -> DataFrame:
    """Chart documents, one a line, of the files below ``root``; a line that is no such document is in ``broken``."""
    return spark.read.schema(CHART).json(root, mode="PERMISSIVE", columnNameOfCorruptRecord="broken")


def quotes_of_chart(rows: DataFrame) -> DataFrame:
    """(symbol, latest, previous, volume, change): the market price, else the last close that is there; the previous close by
    the fallbacks of its two fields and the close before."""
    r = rows.where("broken IS NULL AND chart.error IS NULL").select(F.col("chart.result")[0].alias("r")).select("r.meta.*", F.col("r.indicators.quote")[0].alias("q"))
    closes, volumes = (F.filter(F.col(f"q.{c}"), lambda x: x.isNotNull()) for c in ("close", "volume"))
    last = F.coalesce("regularMarketPrice", F.when(F.size(closes) > 0, F.element_at(closes, -1)))
    before = F.coalesce("previousClose", "chartPreviousClose", F.when(F.size(closes) > 1, F.get(closes, F.size(closes) - 2)))
    got = r.select(F.upper("symbol").alias("symbol"), last.alias("latest"), before.alias("previous"), F.when(F.size(volumes) > 0, F.element_at(volumes, -1)).alias("volume")).where("latest IS NOT NULL")
    return got.withColumn("change", percent_change(F.col("latest"), F.col("previous")))


def broken_rows(rows: DataFrame) -> DataFrame:
    """(file, broken) of the rows of :func:`csv_rows` or :func:`chart_rows` that could not be read, as a written table: only
    columns that are asked for are parsed and can be found broken, so all of them are, as one hash."""
    parsed = F.xxhash64(*[c for c in rows.columns if c != "broken"]).alias("parsed")
    return cut(rows.select(parsed, "broken", F.col("_metadata.file_path").alias("file")).where("broken IS NOT NULL"), "broken").select("file", "broken")


def broken_by_file(rows: DataFrame) -> DataFrame:
    """(file, n, example) of the rows that could not be read."""
    return broken_rows(rows).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("broken").alias("example"))
