"""Labelled rows, and bounded, repeatable samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; by this rows are held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def labelled_ids(labels: DataFrame, label: str, of: int, held: int) -> DataFrame:
    """(doc_id, y) of all labelled rows that are not held out.

    Rows with a null id or label are left out; of a doc_id that is labelled twice the larger label counts.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), of) != held))
    return own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def sample_ids(ids: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the ids at most; where there are more, they are taken by their hash: the same ones each time,
    whatever the partitions."""
    n = ids.count()
    return ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < int(most / n * 2**31)) if n > most else ids
