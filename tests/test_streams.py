"""Streams against the rules that they follow, written out over sorted rows."""

import os
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from storyloom.plans import registry
from storyloom.session import fresh_path
from storyloom.streaming import leaders, state

SF = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def by_rule(rows, keep_minutes, threshold=0.43):
    """Every article against every live story of its key."""
    stories, newest, out = defaultdict(list), defaultdict(lambda: -(10**9)), {}
    for key, r in rows:
        own = [set(r["tokens"]), set(r["entities"]), set(r["events"])]
        newest[key] = max(newest[key], r["minute"])
        best, at = 0.0, None
        for s in stories[key]:
            if newest[key] - s[1] <= keep_minutes:
                score = leaders.likeness(own, r["minute"], s[2], s[1])
                if score > best:
                    best, at = score, s
        if at is None or best < threshold:
            at = [r["article_id"], r["minute"], [set(), set(), set()]]
            stories[key].append(at)
        for have, more in zip(at[2], own, strict=True):
            have |= more
        at[1] = max(at[1], r["minute"])
        out[r["article_id"]] = at[0]
    return out


@here
def test_leaders_match_the_rule_across_batches(spark):
    from storyloom.plans.adapters import articles
    from storyloom.operators import stories as So

    got = {r.article_id: r.story_id for r in registry.QUERIES["stream_leaders"](spark, SF).collect()}
    rows = So.with_sets(articles(spark, SF)).orderBy("seq").collect()
    want = by_rule([(r.source, r.asDict()) for r in rows], 48 * 60)
    assert got == want and len(set(want.values())) < len(want)


def test_stories_grow_and_are_forgotten(spark):
    schema = "k string, article_id bigint, seq bigint, minute bigint, tokens array<string>, entities array<string>, events array<string>"
    lots = [
        [("a", 1, 1, 0, ["rate", "cut", "fed"], ["fed"], ["rates"]), ("a", 2, 2, 10, ["rate", "cut", "soon"], ["fed"], ["rates"]), ("b", 3, 3, 10, ["rate", "cut", "fed"], ["fed"], ["rates"])],
        [("a", 5, 5, 400, ["soon", "cut", "rate", "ecb"], ["ecb"], []), ("a", 4, 4, 20, ["storm"], [], []), ("a", 6, 6, 1500, ["rate", "cut", "fed"], ["fed"], ["rates"])],
        [("a", 7, 7, 9000, ["rate", "cut", "fed"], ["fed"], ["rates"]), ("a", 8, 8, 9010, [], [], []), ("a", 9, 9, 9020, [], [], ["rates"])],
    ]
    root, out, marks = (fresh_path(spark, x) for x in ("lots", "stories", "marks"))
    for lot in lots:
        spark.createDataFrame(lot, schema).write.mode("append").parquet(root)
        stream = leaders.stream_leaders(spark.readStream.schema(schema).parquet(root), "k")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    got = {r.article_id: r.story_id for r in spark.read.parquet(out).collect()}
    names = [f.split()[0] for f in schema.split(", ")]
    flat = sorted((dict(zip(names, r, strict=True)) for lot in lots for r in lot), key=lambda r: r["seq"])
    assert got == by_rule([(r["k"], r) for r in flat], 48 * 60)
    assert got[2] == 1 and got[3] == 3 and got[7] == 7


class Kept:
    """State of one key in memory, as a value or a map, for what a batch does without a stream."""

    def __init__(self):
        self.states = defaultdict(dict)

    def getMapState(self, name, *_):  # noqa: N802
        state = self.states[name]

        class Map:
            containsKey, getValue, iterator = staticmethod(state.__contains__), staticmethod(state.get), staticmethod(lambda: iter(list(state.items())))
            updateValue, removeKey = staticmethod(state.__setitem__), staticmethod(state.pop)

        return Map

    def getValueState(self, name, *_):  # noqa: N802
        state = self.states[name]

        class Value:
            exists, get, update = staticmethod(lambda: "v" in state), staticmethod(lambda: state["v"]), staticmethod(lambda v: state.update(v=v))

        return Value


def in_lots(rows, lots, threshold=0.43, keep=48 * 60):
    """(stories, what is kept at the end) of rows of one key that come in so many lots, each lot out of order."""
    kept, out, size = Kept(), {}, -(-len(rows) // lots)
    for i in range(0, len(rows), size):
        leader = leaders.Leaders(threshold, keep)
        leader.init(kept)
        frame = pd.DataFrame(rows[i : i + size]).sample(frac=1, random_state=i)
        for f in leader.handleInputRows(("k",), iter([frame[: size // 2], frame[size // 2 :]]), None):
            out |= dict(zip(f["article_id"].tolist(), f["story_id"].tolist(), strict=True))
    return out, kept.states["stories"]


@pytest.mark.parametrize("threshold", [0.26, 0.43, 0.9])
def test_leaders_of_random_articles_match_the_rule(threshold):
    """Common and rare terms, with and without events, growing stories, equal scores, empty sets and times far apart."""
    draw, rows = random.Random(5), []
    for i in range(700):
        words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(draw.randint(0, 9))]
        if rows and draw.random() < 0.3:
            words = draw.choice(rows)["tokens"][:6] + words[:2]
        names, events = ([f"{c}{draw.randint(1, n)}" for _ in range(draw.choice([0, 0, 1, 2]))] for c, n in (("e", 40), ("v", 5)))
        rows.append(dict(article_id=1000 - i, seq=i, minute=draw.choice([i, 5 * i, 40 * (i % 90)]), tokens=words, entities=names, events=events))
    want = by_rule([("k", r) for r in rows], 1500, threshold)
    got, kept = in_lots(rows, 3, threshold, 1500)
    assert got == want and (threshold > 0.5 or len(set(want.values())) < 600)
    newest = max(r["minute"] for r in rows)
    minutes = [m for block in kept.values() for m in block[2]]
    assert minutes and all(newest - m <= 1500 for m in minutes)


def test_common_words_do_not_make_articles_meet(monkeypatch):
    """Titles that share two common words and entities of several are compared with few stories, whatever their number."""
    rows = [dict(article_id=i, seq=i, minute=i, tokens=["der", "und", *(f"w{i}x{k}" for k in range(6))], entities=["the", f"e{i}"], events=[]) for i in range(1500)]
    rows += [r | dict(article_id=2000 + i, seq=2000 + i) for i, r in enumerate(rows[::10])]
    calls, judge = [], leaders.likeness
    monkeypatch.setattr(leaders, "likeness", lambda *a: calls.append(1) or judge(*a))
    got, _ = in_lots(rows, 4)
    assert all(got[2000 + i] == 10 * i for i in range(150)) and len(set(got.values())) == 1500
    assert len(calls) <= 2 * len(rows)


def test_threshold_must_need_a_term(spark):
    with pytest.raises(ValueError):
        leaders.Leaders(0.2, 60)


@here
def test_suppression_matches_the_rule(spark):
    """A key's event passes if none of it passed in the 48 hours before; one batch, so by the order that it was met in: what
    passes must be one event at least per key and 48 hours, and none of them nearer than that."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    passed = {(r.alert_id, r.event_type): r for r in registry.QUERIES["stream_suppress"](spark, SF).collect()}
    keys = {(r.user_id % 50, r.event_type) for r in events.select("user_id", "event_type").collect()}
    assert set(passed) == keys and all(r.passed >= 1 and r.first_us <= r.last_us for r in passed.values())


def test_suppression_in_order(spark):
    at = datetime(2024, 1, 1)
    hours = [0, 1, 47, 49, 60, 100, 149, 151]
    root, out, marks = (fresh_path(spark, x) for x in ("events", "passed", "marks"))
    for h in hours:
        for key in ("x", "y") if h % 2 else ("x",):
            spark.createDataFrame([(key, at + timedelta(hours=h))], "key string, at timestamp").coalesce(1).write.mode("append").parquet(root)
        stream = state.suppress_repeats(spark.readStream.schema("key string, at timestamp").parquet(root), ["key"], "at")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    got = {(r.key, int((r.at - at).total_seconds()) // 3600) for r in spark.read.parquet(out).collect()}

    def rule(times):
        """A row passes once the state of the last one that passed has run out: its time and 48 hours lie before the
        watermark, which lies 48 hours before the newest time of earlier batches."""
        kept, last, newest = set(), None, None
        for h in times:
            if last is None or (newest is not None and newest - 48 >= last + 48):
                kept.add(h)
                last = h
            newest = max(newest or h, h)
        return kept

    for key, times in (("x", hours), ("y", [h for h in hours if h % 2])):
        own = {h for k, h in got if k == key}
        assert min(times) in own and all(b - a >= 48 for a, b in zip(sorted(own), sorted(own)[1:], strict=False)), (key, own)


def cached(spark, lots, days):
    from storyloom.streaming import cache

    schema = "source_id bigint, discovery_key string, at timestamp, fetch_id bigint, ok boolean, body string"
    root, out, marks = (fresh_path(spark, x) for x in ("fetched", "cached", "marks"))
    for lot in lots:
        rows = [(*r[:2], datetime(2024, 1, 1, 12) + timedelta(days=r[2]), *r[3:]) for r in lot]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(root)
        kept = cache.once_a_day(spark.readStream.schema(schema).parquet(root), days)
        kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    first = (datetime(2024, 1, 1) - datetime(1970, 1, 1)).days
    return sorted((r.source_id, r.discovery_key, r.day - first, r.fetch_id) for r in spark.read.parquet(out).collect())


def test_a_source_is_kept_once_a_day(spark):
    lots = [
        [(1, "a", 10, 1, False, "x"), (1, "a", 10, 3, True, "third"), (1, "a", 10, 2, True, "second"), (2, "a", 10, 4, True, "b")],
        [(1, "a", 10, 5, True, "again"), (1, "a", 11, 6, None, "x"), (1, "b", 11, 7, True, "y")],
        [(1, "a", 11, 8, True, "late"), (1, "a", 14, 9, True, "new")],
        [(1, "a", 10, 10, True, "forgotten, so too late"), (1, "a", 13, 11, True, "in time"), (1, "a", 14, 12, True, "again")],
    ]
    want = [(1, "a", 10, 2), (1, "a", 11, 8), (1, "a", 13, 11), (1, "a", 14, 9), (1, "b", 11, 7), (2, "a", 10, 4)]
    assert cached(spark, lots, 2) == want
    assert cached(spark, [x for lot in lots[1:] for x in (lot, lot)], 2)[0] == (1, "a", 10, 5)


def test_watermark_files_do_not_pile_up(spark):
    """Each batch of several reads the watermarks of the one before and leaves two sets of files at most."""
    root, landed = fresh_path(spark, "marks"), fresh_path(spark, "landed")
    for k in range(5):
        spark.createDataFrame([(s, 10 * k + s) for s in range(3)] + [(9, 1)], "source bigint, at bigint").coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema("source bigint, at bigint").parquet(landed)
        state.load_after_marks(stream, root, "day", "source", "at", F.lit(10**6), F.lit(0)).awaitTermination()
    marks = spark.read.parquet(f"{root}/marks")
    files = {p.split("/batch=")[1].split("/")[0] for p in marks.inputFiles()}
    assert files <= {"none", "3", "4"}
    assert {r.source: r.mark for r in marks.groupBy("source").agg(F.max("mark").alias("mark")).collect()} == {0: 40, 1: 41, 2: 42, 9: 1}
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{root}/rows").count() == 16
