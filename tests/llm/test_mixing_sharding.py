"""Curriculum mixing and hash-tree sharding: laws, exact figures and defined cases."""

import re
import zlib

from pyspark.sql import functions as F

from storyloom.llm import mixing, sharding

SCHEMA = "doc_id bigint, text string, source string"


def rows(n=300):
    return [(i, " ".join(["w"] * (1 + i * 7 % 50)), None if i % 11 == 0 else f"s{i % 5 if i % 3 else 0}") for i in range(n)]


def test_targets_are_met_and_capped(spark):
    data = rows()
    got = mixing.mix_report(spark.createDataFrame(data, SCHEMA)).collect()
    size = {i: len(t.split()) for i, t, _ in data}
    source = {i: s for i, _, s in data}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    sizes = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    taken = dict.fromkeys(names, 0)
    for x in got:
        assert x["size"] == size[x.doc_id] and x.source_size == sizes[source[x.doc_id]] and 0 <= x.taken <= 2 * x["size"]
        assert abs(x.target - target[source[x.doc_id]]) < 1e-6
        taken[source[x.doc_id]] += x.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.mix_report(spark.createDataFrame(data[::-1], SCHEMA).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_stream_is_ordered_and_follows_the_schedule(spark):
    data = [(i, "a b c d", "x" if i % 2 else "y") for i in range(400)]
    schedule = spark.createDataFrame([("x", 0.0, 2.0), ("x", 1.0, 0.0), ("y", 0.0, 0.0), ("y", 1.0, 2.0)], "source string, t double, weight double")
    out = mixing.mix_documents(spark.createDataFrame(data, SCHEMA), schedule, share=1.0).collect()
    at = [x.position for x in out]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert sum(x.words for x in out) == 1600
    early = [x.source for x in out if x.position < 0.25]
    assert 0.80 < early.count("x") / len(early) < 0.95  # the integral to 1/4 is 7/16 against 1/16
    cut = [x for x in out if x.words < 4]
    assert all(len(x.text.split()) == x.words for x in cut)


def test_mixing_cases(spark):
    assert mixing.mix_report(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix_report(spark.createDataFrame([(1, None, "a"), (2, "", "a"), (2, "", "a"), (3, "b b", None)], SCHEMA)).collect()
    assert sorted((x.doc_id, x["size"], x.taken) for x in got) == [(1, 0, 0), (2, 0, 0), (2, 0, 0), (3, 2, 3)]


def test_unscheduled_sources_and_clashing_names(spark):
    schedule = spark.createDataFrame([("x", 0.0, 1.0, 9), ("x", 1.0, 1.0, 9), ("y", 0.0, 0.0, 9), ("y", 1.0, 0.0, 9)], "source string, t double, weight double, size int")
    data = [(i, "a b", s) for i, s in enumerate(["x", "x", "y", "z", None])]
    docs = spark.createDataFrame(data, SCHEMA)
    names = ["target", "area", "t0", "size", "position", "epoch", "words", "before", "mass", "taken", "source_size", "weight", "dotted.name"]
    clash = docs.selectExpr("*", *[f"concat('own ', doc_id) AS `{n}`" for n in names])
    report = {x.doc_id: (x["size"], x.source_size, x.target, x.taken, x.position is None) for x in mixing.mix_report(clash, schedule).collect()}
    assert report == {0: (2, 4, 8.0, 4, False), 1: (2, 4, 8.0, 4, False), 2: (2, 2, 0.0, 0, True), 3: (2, 2, 0.0, 0, True), 4: (2, 2, 0.0, 0, True)}
    out = mixing.mix_documents(clash, schedule)
    assert set(out.columns) == set(clash.columns)
    rows = out.collect()
    assert sorted((x.doc_id, x.epoch, x["words"]) for x in rows) == [(0, 0, 2), (0, 1, 2), (1, 0, 2), (1, 1, 2)]
    assert all(x.target == x["size"] == x["dotted.name"] == f"own {x.doc_id}" and 0 <= x.position <= 1 for x in rows)


def test_a_very_long_text_is_counted_and_cut_whole(spark):
    data = [(1, "\n" + "word " * 300_000, "x"), (2, "a b", "x"), (3, "c", "y")]
    got = {x.doc_id: (x["size"], x.taken) for x in mixing.mix_report(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[1][0] == 300_000 and abs(sum(t for _, t in got.values()) - 1.5 * 300_003) <= 1
    out = mixing.mix_documents(spark.createDataFrame(data, SCHEMA)).collect()
    assert abs(sum(x.words for x in out) - 1.5 * 300_003) <= 1 and all(len(x.text.split()) == x.words for x in out)


def test_sharding_law(spark):
    data = [(i, None if i % 50 == 0 else "é" * (i % 9), "s") for i in range(2000)] + [(5, "twice", "s")] * 3
    got = sharding.shard_documents(spark.createDataFrame(data, SCHEMA), 8).collect()
    assert len(got) == len(data)
    by_shard = {}
    for x in got:
        by_shard.setdefault(x.shard, []).append(x.slot)
        assert x.grown_shard in (x.shard, 8)
    assert set(by_shard) == set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert all(abs(len(v) / len(data) - 1 / 8) < 0.03 for v in by_shard.values())
    moved = sum(x.grown_shard == 8 for x in got) / len(got)
    assert abs(moved - 1 / 9) < 0.03
    texts = {i: t for i, t, _ in data}
    for x in got:
        if x.doc_id != 5:
            b = (texts[x.doc_id] or "").encode()
            assert x["size"] == len(b) + 1 and x.text_crc32 == zlib.crc32(b)
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_weights_move_only_into_the_changed_subtree(spark):
    tree = sharding.layout(8)
    other = sharding.layout(8)
    other[1]["racks"][0]["shards"][1] = (5, 3.0)
    ids = spark.range(4000).select("id", sharding.descend(F.col("id"), tree).alias("a"), sharding.descend(F.col("id"), other).alias("b"))
    moved = [(x.a, x.b) for x in ids.where("a <> b").collect()]
    assert moved and all(b in (4, 5, 6, 7) for _, b in moved)
    assert all(b in (4, 5) for a, b in moved if a in (6, 7)) and all(b == 5 for a, b in moved if a == 4)


def test_words_pattern():
    assert re.findall(mixing.WORD.replace(r"\x0D", "\r"), "a\x0bb c d") == ["a", "b c", "d"]
