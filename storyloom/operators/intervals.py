"""Joins of points in time with intervals, by buckets of days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .articles import bounded

#: Days of a bucket. An interval is repeated for each bucket that it touches.
BUCKET_DAYS = 64


def in_force(points: DataFrame, versions: DataFrame, keys: list[str], day: str, since: str, until: str, how: str = "inner", last=None) -> DataFrame:
    """The rows of ``points`` with every row of ``versions`` of equal keys whose interval [since, until] holds the point's
    day; an ``until`` of null has no end. Columns of the two but for the keys must differ. With ``how`` as "left" points
    without one stay, and versions that are few enough are brought to the points.

    Both meet by keys and bucket of days, so that a key with a long history, or with points over many years, is split. An
    interval without an end reaches to the ``last`` day of all points, one value that is computed first if it is not given.
    """
    last = points.agg(F.max(day).alias("d")).first().d if last is None else last
    end = F.least(F.coalesce(until, F.lit(last).cast("date")), F.lit(last).cast("date"))
    bucket = lambda d: F.floor(F.unix_date(d) / BUCKET_DAYS)
    dated = versions.where(F.col(since).isNotNull() & (F.col(since) <= end))
    spread = dated.withColumn("__bucket", F.explode(F.sequence(bucket(F.col(since)), bucket(end))))
    holds = (F.col(day) >= F.col(since)) & (F.col(until).isNull() | (F.col(day) <= F.col(until)))
    if how == "inner":
        return points.withColumn("__bucket", bucket(F.col(day))).join(spread, [*keys, "__bucket"]).where(holds).drop("__bucket")
    own = spread.withColumnsRenamed({c: f"__{c}" for c in keys})
    for c in keys:
        holds = holds & (F.col(c) == F.col(f"__{c}"))
    return points.join(bounded(own), holds & (bucket(F.col(day)) == F.col("__bucket")), how).drop("__bucket", *[f"__{c}" for c in keys])


def until_next(rows: DataFrame, keys: list[str], since: str, until: str) -> DataFrame:
    """Rows that each hold until the day before the next of their keys: adds that day, null for the last. Of rows of one day
    the one that comes last by its other columns holds."""
    others = [c for c in rows.columns if c not in (*keys, since)]
    one = rows.groupBy(*keys, since).agg(F.max(F.struct(*others)).alias("__x")).select(*keys, since, "__x.*")
    following = F.lead(since).over(Window.partitionBy(*keys).orderBy(since))
    return one.withColumn(until, F.date_sub(following, 1))
