"""Alert ids by the exact binary value, and windows of articles against pairs looked at one by one."""

import hashlib
import random

from pyspark.sql import functions as F
from storyloom.operators import market


def test_tenths_round_as_numbers_are_printed(spark):
    values = [1508.25, -1508.25, 0.25, -0.25, 0.35, 2.45, 2.5, 1234567.85, 99.95, -99.95, 3.05, 1e-9, 7.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", market.tenths(F.col("v")).alias("t")).collect()
    assert {r.i: r.t.replace("-0.0", "0.0") for r in rows} == {i: f"{v:.1f}".replace("-0.0", "0.0") for i, v in enumerate(values)}


def test_alert_ids(spark):
    movers = spark.createDataFrame([(20, 1508.25), (21, -8.55), (22, 1.0)], "symbol int, change double")
    got = {r.symbol: r.alert_id for r in market.market_alerts(movers, F.lit(2.0)).collect()}
    assert got == {s: hashlib.sha1(f"market|{s}|{c:.1f}".encode()).hexdigest()[:16] for s, c in ((20, 1508.25), (21, -8.55))}


def test_movers_as_by_pairs(spark):
    r = random.Random(11)
    articles = [(k, f"s{r.randrange(6)}", r.choice([0.7, 0.8, 0.9]), r.randrange(0, 4000), r.sample(["oil", "rate", "chip", "x"], r.randrange(0, 4)), r.randrange(3)) for k in range(400)]
    movers = [(k, r.choice(["oil", "rate", "chip", "none", None]), r.randrange(-10, 5000)) for k in range(300)]
    movers += [(500 + k, "oil", articles[k][3] + d) for k in range(20) for d in (0, 120, 121)]
    a = spark.createDataFrame(articles, "article_id bigint, source string, reputation double, minute bigint, tokens array<string>, causal int")
    m = spark.createDataFrame(movers, "mover_id bigint, term string, minute bigint")
    got = sorted((x.mover_id, x.articles, x.sources, x.best, x.confidence) for x in market.explain_movers(m, a, F.col("causal"), hours=2).collect())
    want = []
    for mover, term, minute in movers:
        seen = [x for x in articles if term in x[4] and minute - 120 <= x[3] <= minute]
        sources = len({x[1] for x in seen if x[5] > 0})
        best = max(seen, key=lambda x: (x[5], x[2], -x[0]), default=(None,))[0]
        want.append((mover, len(seen), sources, best, "high" if sources >= 2 else "medium" if sources else "low"))
    assert got == sorted(want)


def test_movers_without_articles(spark):
    a = spark.createDataFrame([], "article_id bigint, source string, reputation double, minute bigint, tokens array<string>")
    m = spark.createDataFrame([(1, "x", 5)], "mover_id bigint, term string, minute bigint")
    assert [tuple(x) for x in market.explain_movers(m, a, F.lit(1)).collect()] == [(1, 0, 0, None, "low")]
