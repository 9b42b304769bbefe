"""Message fitting and article merging against the rules written out."""

import random

from pyspark.sql import functions as F
from storyloom.operators import meetings, selection, stories


def fitted(header, paragraphs, limit, most):
    """(text, shown, omitted, with sources) by trying one message after the other."""
    shown, rich = min(len(paragraphs), most or len(paragraphs)), True
    while shown >= 0:
        parts = [header]
        for text, sources, merged in paragraphs[:shown]:
            parts += ["", text + (f"\n(via {sources})" if sources and (rich or merged) else "")]
        missing = len(paragraphs) - shown
        if missing:
            parts += ["", f"+ {missing} more stories omitted for length."]
        message = "\n".join(parts)
        if len(message) <= limit:
            return message, shown, missing, rich
        if rich:
            rich = False
        else:
            shown -= 1
    if len(header) > limit:
        suffix = "\n+ More omitted for length."
        header = header[: max(0, limit - len(suffix))].rstrip() + suffix
    return header, 0, len(paragraphs), False


def test_messages_fit_as_by_trying(spark):
    r = random.Random(7)
    cases = []
    for k in range(120):
        paragraphs = [("w" * r.randrange(1, 60), r.choice(["AP", "Reuters, AP", "", None]), r.random() < 0.3) for _ in range(r.randrange(0, 9))]
        cases.append((k, "Header of " + "x" * r.randrange(0, 40), paragraphs))
    sections = spark.createDataFrame([(k, h) for k, h, _ in cases], "section bigint, header string")
    rows = spark.createDataFrame([(k, i, *p) for k, _, ps in cases for i, p in enumerate(ps)], "section bigint, pos int, text string, sources string, merged boolean")
    for limit, most in ((150, None), (400, 3), (30, None), (5000, None)):
        got = {x.section: (x.text, x.shown, x.omitted, x.with_sources) for x in selection.fit_messages(sections, rows, limit, most).collect()}
        for k, h, ps in cases:
            want = fitted(h, ps, limit, most)
            mine = got[k] if want[1] or got[k][1] else (*got[k][:3], want[3])  # without a paragraph it is all the same
            assert mine == want, (k, limit)


def test_merged_stories_keep_each_url_once(spark):
    merged = spark.createDataFrame([(1, "b", ["a", "c"]), (2, "z", [])], "set_id bigint, destination string, merged_from array<string>")
    members = [
        ("a", 1, 11, "https://x/1?q", ""), ("a", 2, 12, "https://x/2", None), ("b", 2, 22, "https://y/2", "https://x/2?utm"), ("b", 1, 21, "https://y/1", ""), ("c", 1, 31, "https://x/1", ""), ("c", 2, 32, "https://z", "https://y/9"),
        ("z", 1, 41, "https://x/1", ""), ("z", 2, 42, None, None), ("other", 1, 51, "https://q", ""),
    ]
    rows = spark.createDataFrame(members, "story_id string, seq int, article_id bigint, url string, canonical_url string")
    got = sorted((r.set_id, r.n, r.story_id, r.article_id) for r in stories.merge_articles(merged, rows).collect())
    assert got == [(1, 1, "b", 21), (1, 2, "b", 22), (1, 3, "b", 11), (1, 4, "b", 32), (2, 1, "z", 41), (2, 2, "z", 42)]


def test_source_types_break_ties(spark):
    votes = spark.createDataFrame([(1, "culture", 2), (1, "business_tech", 2), (1, "global", 1), (2, "culture", 1), (2, "finance", 1), (3, "domestic", 3)], "story_id bigint, tag string, votes bigint")
    types = spark.createDataFrame([(1, "mixed_tech_culture"), (1, "culture"), (1, "global"), (2, "wire"), (3, "finance")], "story_id bigint, source_type string")
    preferences = {"culture": ("culture",), "global": ("global",), "finance": ("finance",), "mixed_tech_culture": ("business_tech", "culture")}
    left = selection.prefer_by_source_type(votes, types, preferences, ["story_id"])
    assert sorted((r.story_id, r.tag) for r in left.collect()) == [(1, "culture"), (2, "culture"), (2, "finance"), (3, "domestic")]
    assert left.where(F.col("votes") > 2).count() == 1


def test_pairs_are_judged_where_they_meet(spark):
    """Candidates are neither written nor shuffled again to drop those that meet twice: nothing is aggregated after the joins."""
    titles = [(k, f"Alpha Beta {w} merger of banks {w} deal") for k, w in enumerate(("gamma", "delta", "gamma delta", "omega"))]
    a = spark.createDataFrame([(0, k, k, 60 * k, "s", 0.7, t, "u", "") for k, t in titles], "run_id long, article_id long, seq long, minute long, source string, reputation double, title string, url string, summary string")
    rows, _ = stories.classes(stories.with_sets(a))
    for found in (stories.similar_pairs(rows), stories.duplicate_event_pairs(rows, ("the",))):
        assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
        each = [(x.a, x.b) for x in found.collect()]
        assert sorted(each) == [(i, j) for i in range(4) for j in range(i + 1, 4)]


def test_pairs_of_hot_keys_are_counted_in_cells(spark, monkeypatch):
    """Sets with and without events, wide ones, and rows without a time, under keys dealt to many cells, against all pairs
    judged one by one. No join makes a row for each pair that meets."""
    r = random.Random(5)
    monkeypatch.setattr(meetings, "PART", 16)
    words, names, terms = [f"w{k}" for k in range(24)], [f"n{k}" for k in range(5)], ["merger", "recall", "war"]
    some = lambda xs, most: r.sample(xs, r.randrange(0, most + 1))
    rows = [(k, some(words, 6) + ["hot"] * (k % 3 > 0), some(names, 2), some(terms, 2) if k % 2 else [], [float(x) for x in sorted(r.sample(range(4000), r.randrange(0, 4)))]) for k in range(150)]
    rows += [(200 + k, [f"w{x}" for x in range(40) if x != k], ["n1"], [], [float(k)]) for k in range(6)]
    found = spark.createDataFrame(rows, "id long, tokens array<string>, entities array<string>, events array<string>, minutes array<double>").cache()
    title, score = stories.pair_scores()
    every = found.alias("a").join(found.alias("b"), F.col("a.id") < F.col("b.id")).cache()
    for threshold in (0.43, 0.3):
        got = stories.similar_pairs(found, threshold)
        assert "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = every.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), title.alias("t"), score.alias("s")).where(F.col("s") >= threshold)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    shared = F.size(F.array_remove(F.array_intersect("a.entities", "b.entities"), "n0"))
    over = F.arrays_overlap("a.events", "b.events")
    apart = (title < 0.32) & (F.size("a.events") > 0) & (F.size("b.events") > 0) & ~over
    want = every.where((shared > 0) & (stories._hours("a", "b") <= 24) & ((title >= 0.2) | over) & ~apart).select("a.id", "b.id", shared, title)
    got = stories.duplicate_event_pairs(found, ("n0",))
    assert "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_id_of_many_sets_is_no_window(spark):
    sets = spark.createDataFrame([(0, 1, [1, 2]), (0, 2, [2, 3]), (0, 3, [3, 4]), (1, 4, [1, 2, 3, 4, 5]), (1, 5, [6, 9])], "run_id long, set_id long, ids array<long>")
    known = spark.createDataFrame([(k, 0) for k in range(1, 7)], "node long, component long")
    got = stories.validate_merge_sets(sets, known)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {x.set_id: x.valid for x in got.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
