"""Small tables of ids and keys, broadcast only up to a counted number of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Most bytes of a table that are broadcast; beyond that it is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes that a hashed row takes: a number alone, and a digest with a few numbers.
ID_BYTES, KEY_BYTES = 16, 96


def bounded_ids(ids: DataFrame, row_bytes: int = ID_BYTES) -> DataFrame:
    """The ids as a written table, marked for broadcast where it is small enough."""
    table = cut(ids, "ids")
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def text_key(text: Column) -> Column:
    """A digest of the whole text; null is as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def without_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text's key is not in ``keys`` (key): rows are told by their text, so that neither null
    nor repeated ids matter."""
    gone = bounded_ids(keys.select(F.col("key").alias("__gone")).distinct(), KEY_BYTES)
    return docs.join(gone, text_key(F.col("text")) == F.col("__gone"), "left_anti")
