"""Records of a run against the same written out, and labels before runs against all pairs."""

import datetime
import hashlib
import json
import random

from storyloom.operators import candidates, market

DAY = datetime.date(2026, 7, 1)
STORY = "key string, seq bigint, title string, category string, lane string, urls array<string>, sources array<string>, summary string, day date, total double, importance double, evidence double, quality double, penalty double, is_update boolean, skip_reason string, merged_from array<string>"
ARTICLE = "article_id string, seq bigint, title string, source string, url string, canonical_url string, day date, text string, penalty double, stage string, code string, skip_reason string"


def sha(value):
    return hashlib.sha256(json.dumps(value, separators=(",", ":")).encode()).hexdigest()


def story(key, seq, urls, total=0.0, skip=None, sources=("AP",), merged=None):
    return (key, seq, f"Title {key}", "global", None, urls, list(sources), "s" * 700, DAY, total, 1.0, 2.0, 3.0, 0.4, False, skip, merged)


def records(spark, stories, refused=(), sent=(), ended=(), chosen=(), target=10):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return candidates.candidate_records(
        frame(stories, STORY), frame(refused, ARTICLE), frame(sent, "key string, paragraph string"), frame(ended, "key string, stage string, code string, skip_reason string"),
        frame(chosen, "key string, phase string, code string"), "run", target,
    )


def test_records(spark):
    stories = [
        story("a", 0, ["https://x/2/?q", "https://x/1", "https://x/1?z", ""], 5.0), story("b", 1, None, 3.0, "low evidence"), story("c", 2, [], -1.0, "stale/repeated from yesterday", ['say "hi"', "ü"], ["k1", "k2"]), story("d", 3, ["https://y"], 0.5),
        story("e", 4, ["https://y/"], 9.0, "duplicate of d"), story("f", 5, [f"https://u/{i}" for i in range(9)], 1.5),
    ]
    refused = [("r", 0, "Bad", "BBC", "https://y", None, DAY, None, 1.5, "quality", "empty_summary", None), ("r2", 1, "Bad", "BBC", None, "", DAY, "t", 1.5, "quality", "thin", "x")]
    frame = records(spark, stories, refused, [("a", "Sent text")], [("d", "gate", "g1", "was gated")], [("a", "floor", ""), ("f", "fill", "source_cap")])
    assert frame.columns == candidates.RECORD and len(frame.columns) == 28
    got = {r.headline + r.filter_reason_code: r for r in frame.collect()}
    a = got["Title a"]
    assert json.loads(a.all_urls_json) == ["https://x/1", "https://x/2"] and a.all_urls_json == json.dumps(["https://x/1", "https://x/2"])
    assert a.story_key == sha(["https://x/1", "https://x/2"]) and a.candidate_id == sha(["run", "cluster", a.story_key]) and json.loads(a.url_hashes_json) == [sha("https://x/1"), sha("https://x/2")]
    assert (a.disposition, a.filter_stage, a.review_stratum, a.deck_rank, a.selection_phase, a.delivered_paragraph, len(a.summary_excerpt)) == ("selected", "", "selected", 0, "floor", "Sent text", 600)
    b, c, d, f = got["Title bevidence_gate"], got["Title chistory_stale"], got["Title dg1"], got["Title fsource_cap"]
    assert (b.filter_stage, b.review_stratum, b.canonical_url, b.story_key) == ("evidence", "near_miss", "", sha(["title b", "2026-07-01"]))
    assert (c.review_stratum, json.loads(c.sources_json), c.source_count, json.loads(c.merged_from_json)) == ("deep_filtered", ['say "hi"', "ü"], 2, ["k1", "k2"])
    assert (d.filter_stage, d.legacy_skip_reason, d.review_stratum) == ("gate", "was gated", "mid") and "Title eduplicate_gate_merged" not in got
    assert (f.filter_stage, len(json.loads(f.all_urls_json)), f.selection_phase) == ("selection", 5, "")
    r, r2 = got["Badempty_summary"], got["Badthin"]
    assert (r.candidate_kind, r.review_stratum, r.category, r.summary_excerpt) == ("hard_rejected_article", "hard_reject", "uncategorized", "") and r.story_key == sha(["https://y"])
    assert r2.story_key == sha(["BBC", "bad", "2026-07-01"]) and r2.legacy_skip_reason == "x"
    assert records(spark, []).count() == 0


def test_labels_before_runs(spark):
    r = random.Random(2)
    c = [(k, k % 11, r.randrange(6)) for k in range(90)]
    runs = [(k, f"v{k % 2}", k * 10) for k in range(11)]
    labels = [(r.randrange(95), r.choice(["relevant", "irrelevant", "unclear"]), r.choice([None, r.randrange(0, 120)])) for _ in range(60)]
    examples = [(r.randrange(95), r.choice(["pending", "relevant"]), r.randrange(0, 120)) for _ in range(30)]
    frame = spark.createDataFrame
    got = candidates.labels_before(
        frame(c, "candidate_id bigint, run_id bigint, story_key bigint"), frame(runs, "run_id bigint, pipeline_version string, created_at bigint"), frame(labels, "subject_id bigint, verdict string, created_at bigint"),
        frame(examples, "candidate_id bigint, verdict string, reviewed_at bigint"),
    ).collect()
    story_of = {k: s for k, _, s in c}
    said = [(story_of[k], at, v, k) for k, v, at in labels + [x for x in examples if x[1] != "pending"] if k in story_of and at is not None]
    for x in got:
        best = max(((at, v, k) for s, at, v, k in said if s == x.story_key and at <= x.run_id * 10), default=(None, None, None))
        assert (x.labelled_at, x.verdict, x.labelled) == best
    assert len(got) == 90


def test_fresh_quotes(spark):
    frame = spark.createDataFrame
    universe = frame([("A", "a.us"), ("B", "b.us"), ("C", "c.us"), ("D", "d.us")], "symbol string, provider_symbol string")
    cached = frame([("A", DAY, 1.0, None), ("B", DAY - datetime.timedelta(1), 2.0, 1.0), ("A", DAY, 0.5, 9.0)], "symbol string, day date, latest double, previous double")
    fetched = frame([("a.us", 7.0, 7.0), ("b.us", 8.0, None), ("x.us", 1.0, 1.0), ("d.us", None, 1.0)], "provider_symbol string, latest double, previous double")
    got = {r.symbol: (r.latest, r.previous, r.from_cache) for r in market.fresh_quotes(universe, cached, fetched, str(DAY)).collect()}
    assert got == {"A": (1.0, None, True), "B": (8.0, None, False), "D": (None, 1.0, False)}
