"""Phrases in texts and relations in force against rules written out."""

import datetime
import random
import re

from pyspark.sql import functions as F
from storyloom.operators import intervals, mentions, phrases, watchlist


def words(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def test_phrases_at_every_place(spark):
    r = random.Random(4)
    vocabulary = ["new", "york", "bank", "of", "the", "é", "x1", "über"]
    texts = [(k, r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(r.randrange(0, 80)))) for k in range(80)] + [(100, None), (101, ""), (102, "New York"), (103, "new new new york york")]
    listed = sorted({" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 6))) for _ in range(150)}) + ["New  York", "unknown", "york unknown", "", "...", None, "new new", "new"]
    got = {}
    found = phrases.phrase_places(spark.createDataFrame(texts, "id bigint, text string"), spark.createDataFrame([(p,) for p in listed + listed[:5]], "phrase string"))
    for x in found.collect():
        assert (x.id, x.phrase) not in got
        got[x.id, x.phrase] = x.places
    want = {}
    for p in set(listed) - {None}:
        q = words(p)
        for k, t in texts:
            w = words(t)
            places = [i for i in range(len(w) - len(q) + 1) if q and w[i : i + len(q)] == q]
            if places:
                want[k, p] = places
    assert got == want


def test_long_and_hot_texts(spark):
    texts = spark.createDataFrame([(1, "the bank " * 30_000 + "of new york")] + [(k, "the bank of the") for k in range(2, 500)], "id bigint, text string")
    found = phrases.phrase_places(texts, spark.createDataFrame([("the bank",), ("bank of new york",), ("the",)], "phrase string")).groupBy("phrase").agg(F.count("*").alias("n"), F.sum(F.size("places")).alias("s")).collect()
    assert {x.phrase: (x.n, x.s) for x in found} == {"the bank": (499, 30_498), "the": (499, 30_996), "bank of new york": (1, 1)}


def test_phrases_are_found_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SET_PHRASES", 3)
    texts = spark.createDataFrame([(k, f"word{k % 7} of word{k % 5} and word{k % 7} of") for k in range(60)], "id bigint, text string")
    listed = spark.createDataFrame([(f"word{k} of",) for k in range(7)] + [("of word3 and",), ("and",)], "phrase string")
    found = phrases.phrase_places(texts, listed)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(x.id, x.phrase): x.places for x in found.collect()}
    want = {(k, f"word{k % 7} of"): [0, 4] for k in range(60)} | {(k, "of word3 and"): [1] for k in range(60) if k % 5 == 3} | {(k, "and"): [3] for k in range(60)}
    assert got == want


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def test_intervals(spark):
    r = random.Random(9)
    points = [(k, r.choice("ab"), day(r.randrange(0, 900))) for k in range(200)] + [(900, "a", None), (901, None, day(3))]
    versions = [(i, r.choice("ab"), day(s := r.randrange(-50, 900)), r.choice([None, day(s), day(s + r.randrange(0, 400))])) for i in range(60)] + [(99, "a", None, None)]
    p = spark.createDataFrame(points, "p bigint, k string, day date")
    v = spark.createDataFrame(versions, "v bigint, k string, since date, until date")
    got = sorted((x.p, x.v) for x in intervals.in_force(p, v, ["k"], "day", "since", "until").collect())
    assert got == sorted((a, b) for a, k, d in points for b, q, s, u in versions if d and k and k == q and s and s <= d and (u is None or d <= u))
    assert intervals.in_force(p.limit(0), v, ["k"], "day", "since", "until").count() == 0


NAMES = [
    ("A", "acme", 0, "self", day(0), None, 1, [], "F1"), ("A", "acme capital", 1, "managed_capital", day(0), day(100), 1, [], "F1"), ("A", "acme steel works", 2, "controlled_affiliate", day(0), None, 1, [], "F1"),
    ("A", "tower", 3, "underlying_asset", day(0), None, 1, ["acme group", "harbour"], None), ("A", "short", 4, "self", day(0), None, 2, [], None), ("B", "acme", 0, "unrelated", day(0), None, 1, [], None),
    ("C", "dual", 0, "controlled_affiliate", day(0), day(10), 1, [], None), ("C", "dual", 1, "self", day(50), None, 1, [], None),
]


def told(spark, rows):
    texts = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id bigint, text string, day date, role string")
    names = spark.createDataFrame(NAMES, "ticker string, name string, seq bigint, relationship string, verified_at date, expires_at date, min_tokens int, context array<string>, accession string")
    negatives = spark.createDataFrame([("A", "acme records")], "ticker string, name string")
    filings = spark.createDataFrame([("A", "F1", day(0)), ("A", "F2", day(200))], "ticker string, accession string, accepted date")
    return {(x.id, x.ticker): (x.name, x.label, x.fresh, x.reason) for x in watchlist.classify_mentions(texts, names, negatives, filings).collect()}


def test_mentions(spark):
    got = told(spark, [
        ("Acme, capital!", day(100), "party"), ("acme capital", day(101), "party"), ("ACME steel works", day(199), "subject"), ("acme steel works", day(200), "subject"), ("the acme", day(300), "subject"),
        ("tower of harbour", day(5), "party"), ("tower alone", day(5), "party"), ("Acme Records and acme", day(5), "party"), ("short", day(5), "party"), ("acme", day(5), "mentioned"), ("dual", day(5), "party"),
        ("dual", day(20), "party"), ("dual", day(60), "party"), ("nothing", day(5), "party"), ("acme", None, "party"), (None, day(5), "party"),
    ])
    fresh, stale = (True, "matched"), (False, "stale_relationship")
    assert got == {
        (0, "A"): ("acme capital", "MANAGED_CAPITAL", *fresh), (0, "B"): ("acme", "MENTION_ONLY", *fresh), (1, "A"): ("acme capital", "MENTION_ONLY", *stale), (1, "B"): ("acme", "MENTION_ONLY", *fresh),
        (2, "A"): ("acme steel works", "AFFILIATE", *fresh), (2, "B"): ("acme", "MENTION_ONLY", *fresh), (3, "A"): ("acme steel works", "MENTION_ONLY", *stale), (3, "B"): ("acme", "MENTION_ONLY", *fresh),
        (4, "A"): ("acme", "DIRECT", *fresh), (4, "B"): ("acme", "MENTION_ONLY", *fresh), (5, "A"): ("tower", "UNDERLYING_ASSET", *fresh), (7, "A"): ("acme records", "MENTION_ONLY", False, "negative_name"), (7, "B"): ("acme", "MENTION_ONLY", *fresh),
        (9, "A"): ("acme", "MENTION_ONLY", *fresh), (9, "B"): ("acme", "MENTION_ONLY", *fresh), (10, "C"): ("dual", "AFFILIATE", *fresh), (11, "C"): ("dual", "MENTION_ONLY", *stale), (12, "C"): ("dual", "DIRECT", *fresh),
        (14, "A"): ("acme", "DIRECT", *fresh), (14, "B"): ("acme", "MENTION_ONLY", *stale),
    }


def test_names_of_long_texts_do_not_carry_the_text(spark):
    """A text is not shuffled beside each of its words: 5,000 words of 13 bytes would be 325 MB."""
    rng = random.Random(5)
    text = " ".join(f"{rng.getrandbits(48):012x}" for _ in range(5000)) + " Acme, Steel of Ohio"
    t = spark.createDataFrame([(1, text), (2, "acme steel"), (3, "acme steel, ohio; acme records")], "id long, text string")
    rows = [("A", "acme", "brand", True, None), ("A", "acme steel", "issuer", True, "ohio")]
    names = spark.createDataFrame(rows, "ticker string, name string, relationship string, fresh boolean, context string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = watchlist.classify_entities(t, names, spark.createDataFrame([("A", "acme records")], "ticker string, name string"))
    assert sorted(map(tuple, got.collect())) == [(1, "A", "acme steel", "direct"), (2, "A", "acme", "related")]
    assert written() - before < 10 << 20


def test_mentions_leave_no_more_than_a_row_for_each_ticker(spark, monkeypatch):
    """Names that many tickers have meet in many texts: 400 texts with 60 names of 40 tickers would be 960,000 rows to shuffle."""
    rng = random.Random(6)
    listed = [(f"T{t}", " ".join(f"w{(k + j) % 60}" for j in range(1 + t % 3)), k * 40 + t, rng.choice(["self", "controlled_affiliate"]), day(rng.randrange(0, 90)), None, 1, [f"c{t % 4}"] if k % 3 == 0 else [], None) for k in range(60) for t in range(40)]
    texts = [(i, " ".join(f"w{k}" for k in range(60)) + f" c{i % 5}" + (" bad thing" if i % 10 == 0 else ""), day(i % 100), "party") for i in range(400)]
    names = spark.createDataFrame(listed, "ticker string, name string, seq bigint, relationship string, verified_at date, expires_at date, min_tokens int, context array<string>, accession string")
    args = (spark.createDataFrame(texts, "id bigint, text string, day date, role string"), names, spark.createDataFrame([("T3", "thing"), ("T3", "bad thing")], "ticker string, name string"), spark.createDataFrame([], "ticker string, accession string, accepted date"))
    want = {}
    for i, text, _, _ in texts:
        for t, n, seq, *_, near, _ in listed:
            held = f" {text} "
            if f" {n} " in held and (not near or any(f" {c} " in held for c in near)):
                want[i, t] = max(want.get((i, t), (0,)), (len(n), -seq, n))
        if i % 10 == 0:
            want[i, "T3"] = (0, 0, "bad thing")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = {(x.id, x.ticker): x.name for x in watchlist.classify_mentions(*args).collect()}
    assert got == {k: v[2] for k, v in want.items()} and written() - before < 1 << 20
    monkeypatch.setattr(mentions, "SET_NAMES", 700)
    monkeypatch.setattr(mentions, "STEP", 100)
    assert {(x.id, x.ticker): x.name for x in watchlist.classify_mentions(*args).collect()} == got
