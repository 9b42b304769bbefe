"""Stateful streams: suppression, cooldown and incremental loads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import advance, incremental


def suppress_repeats(events: DataFrame, keys: list[str], at: str, hours: int = 48) -> DataFrame:
    """The first event of a key within the hours; later ones of that time are dropped."""
    return events.withWatermark(at, f"{hours} hours").dropDuplicatesWithinWatermark(keys)


def cooldown(alerts: DataFrame, minutes: int = 180, late: str = "1 hour") -> DataFrame:
    """Alerts (alert_id bigint, at timestamp) that are sent: none within the minutes after the last one sent of its id.

    Rows may be ``late`` by so much; older ones are dropped. An id is forgotten once the watermark lies the minutes beyond
    its last sending, when it no longer holds anything back, so that state does not grow with the ids ever seen. A row
    that comes after a later one of its id was sent counts as within its minutes."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = sorted(t for f in frames for t in f["at"])
        out = []
        for t in times:
            if last is None or t.value // 1000 - last >= minutes * 60_000_000:
                last = t.value // 1000
                out.append(t)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"alert_id": [key[0]] * len(out), "at": out})

    timed = alerts.withWatermark("at", late).groupBy("alert_id")
    return timed.applyInPandasWithState(run, "alert_id bigint, at timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def split_invalid(articles: DataFrame, at: str, valid: Column, as_of: Column) -> DataFrame:
    """Articles with an event time: the given one where theirs is invalid, and a flag."""
    return articles.withColumn("timestamp_valid", F.coalesce(valid, F.lit(False))).withColumn(at, F.when(F.col("timestamp_valid"), F.col(at)).otherwise(as_of))


def load_after_marks(stream: DataFrame, root: str, load: str, source: str, at: str, cutoff: Column, fallback: Column):
    """Start a query that appends the rows after their source's watermark and then advances it, batch by batch.

    Rows go to ``root``/rows and watermarks to ``root``/marks, each under the load's name and the batch's number, so that a
    batch that runs twice is written once. Watermarks only rise: of all written the greatest counts, and another load of
    the same rows adds nothing. A batch writes the watermarks of all sources, so those of the batch before the last are
    removed: what a batch reads does not grow with the batches."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema[at].dataType.simpleString()
        seen = spark.read.option("ignoreMissingFiles", True).schema(f"{source} {batch.schema[source].dataType.simpleString()}, mark {kind}")
        # a batch that is repeated must see what the first try saw, not what it wrote
        every = seen.parquet(f"{root}/marks").where(F.input_file_name().contains(f"load={load}/batch={n}/") == F.lit(False))
        marks = every.groupBy(source).agg(F.max("mark").alias("mark"))
        fresh = incremental(batch, marks, source, at, cutoff, fallback)
        fresh.write.mode("overwrite").parquet(f"{root}/rows/load={load}/batch={n}")
        loaded = spark.read.schema(batch.schema).parquet(f"{root}/rows/load={load}/batch={n}")
        advance(marks, loaded, source, at, F.lit(True)).write.mode("overwrite").parquet(f"{root}/marks/load={load}/batch={n}")
        # the batch before this one is kept, for this one may run again
        spent = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/marks/load={load}/batch={n - 2}")
        spent.getFileSystem(spark._jsc.hadoopConfiguration()).delete(spent, True)

    # the folder of watermarks exists from the start, with none in it
    empty = stream.sparkSession.createDataFrame([], f"{source} {stream.schema[source].dataType.simpleString()}, mark {stream.schema[at].dataType.simpleString()}")
    empty.write.mode("overwrite").parquet(f"{root}/marks/load={load}/batch=none")
    return load_incremental(stream, f"{root}/checkpoints/{load}", write)


def load_incremental(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]):
    """Start a query that hands each micro-batch to ``write`` with its number; writers use that to stay idempotent."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
