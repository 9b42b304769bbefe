"""Running totals and row numbers over groups of any size.

A plain window puts a whole group into one task. Here the order key is a uniform hash, so a group can be cut into
ordered buckets: totals of buckets are summed over the bucket numbers (a small table), and only a bucket meets in a
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket should have about.
BUCKET_ROWS = 4096


def bucket_of(hex_key: Column, buckets: int) -> Column:
    """Number of the bucket, rising with the hexadecimal key."""
    return F.floor(F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("double") * buckets / float(2**32)).cast("int")


def running_before(
    df: DataFrame, group: str, hex_key: str, value: str, ties: list[str], rows: int, out: str, bucket_rows: int = BUCKET_ROWS, light: DataFrame | None = None
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the group's rows before this one in the order ``hex_key, ties``.

    ``rows`` is the number of rows of ``df``; it only sets how fine the buckets are, not the result. Null groups are a
    group of their own. Rows equal in the key and all ties may swap places. ``light`` is a lighter table of the same rows
    (group, key and value) from which the totals of buckets are made, where ``df`` is dear to read.
    """
    buckets = max(1, -(-rows // bucket_rows))
    b, g = "__bucket", "__group"

    def bucketed(rows: DataFrame) -> DataFrame:
        named = rows.withColumn(g, F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
        return named.withColumn(b, bucket_of(F.col(hex_key), buckets))

    keyed = bucketed(df)
    ordered = Window.partitionBy(g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        (keyed if light is None else bucketed(light)).groupBy(g, b)
        .agg(F.sum(value).alias("__sum"))
        .select(g, b, F.coalesce(F.sum("__sum").over(ordered), F.lit(0)).cast("long").alias("__offset"))
    )
    inside = Window.partitionBy(g, b).orderBy(hex_key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [g, b])
        .withColumn(out, (F.col("__inside") + F.col("__offset")).cast("long"))
        .drop(g, b, "__inside", "__offset")
    )
