"""A cache of sources that is filled once a day, as a stream with state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .leaders import ROCKS


DAY_MS = 86_400_000


class OnceADay(StatefulProcessor):
    """The first successful fetch of a key and day is passed on; later ones of that day are not.

    State is the newest day of a key and the days of the last few for which it has something. A timer forgets a key once the
    watermark lies so far behind its newest day that whatever may still come is of other days; so state follows the keys that
    are in use, by event time, and a replay gives the same rows."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "newest bigint, days array<bigint>")

    def _expiry(self, newest: int) -> int:
        return (newest + self.days + 1) * DAY_MS

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["day", "fetch_id"])
        known = self.known.get() if self.known.exists() else None
        newest, kept, out = int(frame["day"].max()), set(known[1] if known else ()), []
        newest = max(newest, known[0]) if known else newest
        for r in frame[frame["ok"].fillna(False).astype(bool)].itertuples():
            if r.day not in kept:
                kept.add(r.day)
                out.append((*key, r.day, r.fetch_id, r.body))
        if known is None or newest > known[0]:
            if known:
                self.handle.deleteTimer(self._expiry(known[0]))
            self.handle.registerTimer(self._expiry(newest))
        # a day that the watermark has passed cannot come again
        past = timerValues.getCurrentWatermarkInMs() // DAY_MS
        self.known.update((newest, sorted(d for d in kept if d >= past)))
        yield pd.DataFrame(out, columns=["source_id", "discovery_key", "day", "fetch_id", "body"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.known.clear()
        yield pd.DataFrame([], columns=["source_id", "discovery_key", "day", "fetch_id", "body"])

    def close(self) -> None:
        pass


def once_a_day(fetches: DataFrame, days: int = 2) -> DataFrame:
    """(source_id, discovery_key, day, fetch_id, body) of a stream of fetches (source_id, discovery_key, at, fetch_id, ok,
    body): of each key and day the first successful one, by fetch_id within a batch. Fetches may come again, as when a source
    is read twice, and late by ``days`` days behind the newest of all; later ones are dropped."""
    fetches.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    dated = fetches.withWatermark("at", f"{days} days").select("source_id", "discovery_key", "at", F.floor(F.unix_millis("at") / DAY_MS).alias("day"), "fetch_id", "ok", "body")
    types = "source_id bigint, discovery_key string, day bigint, fetch_id bigint, body string"
    return dated.groupBy("source_id", "discovery_key").transformWithStateInPandas(OnceADay(days), types, "Append", "EventTime")
