"""Upserts, suppression, retention and incremental loads over state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import first_per


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key; a null in a new row keeps the old value."""
    values = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(new.alias("n"), keys, "full")
    return joined.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in values])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], *order) -> DataFrame:
    """Old rows, and of the new keys their first row."""
    return old.unionByName(first_per(new, keys, *order).join(old.select(*keys), keys, "left_anti"))


def union_dedup(one: DataFrame, two: DataFrame, key: Column) -> DataFrame:
    """Both tables (pos, ...) with one row of each key: the last row's values at the first row's place."""
    rows = one.withColumn("__t", F.lit(0)).unionByName(two.withColumn("__t", F.lit(1))).withColumn("__k", key)
    order = F.struct("__t", "pos")
    values = [c for c in one.columns if c != "pos"]
    best = rows.groupBy("__k").agg(F.max_by(F.struct(*values), order).alias("v"), F.min(order).alias("first"))
    return best.select("v.*", F.col("first.__t").alias("part"), F.col("first.pos").alias("pos"))


def suppress_sent(rows: DataFrame, sent: DataFrame, keys: list[str], at: str, hours: int = 48) -> DataFrame:
    """Rows whose key was not sent within the hours before; sent has the keys and ``sent_minute``."""
    o, s = rows.alias("o"), sent.alias("s")
    same = [F.col(f"o.{k}") == F.col(f"s.{k}") for k in keys]
    recent = (F.col("s.sent_minute") >= F.col(f"o.{at}") - 60 * hours) & (F.col("s.sent_minute") < F.col(f"o.{at}"))
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return o.join(s, cond & recent, "left_anti")


def roll_history(old: DataFrame, new: DataFrame, now: int, keep: int) -> DataFrame:
    """History (id, first_seen, last_seen) after a run's stories (id, seen): first sight is kept, stale rows go."""
    both = old.join(new, "id", "full")
    rolled = both.select("id", F.coalesce("first_seen", "seen").alias("first_seen"), F.coalesce("seen", "last_seen").alias("last_seen"))
    return rolled.where(F.col("last_seen") >= now - keep)


def retention(rows: DataFrame, age: Column, days: int, protected: DataFrame, key: str, payload: str | None = None) -> DataFrame:
    """Rows that are young or protected; with ``payload`` old rows stay and only lose that column."""
    marked = rows.join(protected.select(key).distinct().withColumn("__p", F.lit(True)), key, "left")
    stays = (age <= days) | F.col("__p").isNotNull()
    if payload:
        return marked.withColumn(payload, F.when(stays, F.col(payload))).drop("__p")
    return marked.where(stays).drop("__p")


def incremental(rows: DataFrame, marks: DataFrame, source: str, at: str, cutoff: Column, fallback: Column) -> DataFrame:
    """Rows after their source's watermark and up to the cutoff; without a watermark, those from the fallback on."""
    joined = rows.join(marks.select(source, "mark"), source, "left")
    fresh = F.when(F.col("mark").isNull(), F.col(at) >= fallback).otherwise(F.col(at) > F.col("mark"))
    return joined.where(fresh & (F.col(at) <= cutoff)).drop("mark")


def advance(marks: DataFrame, loaded: DataFrame, source: str, at: str, complete: Column) -> DataFrame:
    """Watermarks after a load: the latest time of sources of which no row is missing, else the old mark."""
    seen = loaded.groupBy(source).agg(F.max(at).alias("latest"), F.min(complete.cast("int")).alias("whole"))
    both = marks.join(seen, source, "full")
    moved = F.when(F.col("whole") == 1, F.greatest("latest", "mark")).otherwise(F.col("mark"))
    return both.select(source, moved.alias("mark"))


def alert_cooldown(alerts: DataFrame, last: DataFrame, minutes: int = 180) -> DataFrame:
    """Alerts (alert_id, minute) whose last sending is ``minutes`` ago at least."""
    recent = (F.col("a.alert_id") == F.col("l.alert_id")) & (F.col("a.minute") - F.col("l.sent_minute") < minutes) & (F.col("l.sent_minute") <= F.col("a.minute"))
    return alerts.alias("a").join(last.alias("l"), recent, "left_anti")
