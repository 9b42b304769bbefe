"""Loaders of reference files: what they read and what they refuse, by line and reason."""

import json

import pytest
from storyloom.sources import reference_data as R


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)


def test_watchlists_in_every_format(spark, tmp_path):
    put(tmp_path, "a.json", json.dumps({"items": ["AI", {"name": " Apple ", "aliases": ["x", " "], "ticker": "aapl", "weight": 2}, {"label": ""}, {"label": "W", "weight": "much"}]}))
    put(tmp_path, "b.jsonl", '{"label": "Ü"}\n\n{"label": \n"plain"\n')
    put(tmp_path, "c.toml", '[[items]]\nlabel = "T"\naliases = ["one", "two"]\nweight = 0.5\n')
    put(tmp_path, "d.yaml", "# list\n- name: \"Y\"\n  aliases:\n    - first\n    - second\n  ticker: y\n- bare\n")
    put(tmp_path, "e.toml", "ok = 1\nbroken = = 2\n")
    put(tmp_path, "f.json", '[\n"a",\n}')
    put(tmp_path, "g.txt", "x")
    put(tmp_path, "h.json", b"[\n\n\xff]")
    rows = R.watchlist(R.read_items(spark, str(tmp_path))).collect()
    good = {r.label: (r.aliases, r.ticker, r.weight) for r in rows if r.reason is None}
    assert good == {
        "AI": ([], "", 1.0), "Apple": (["x"], "AAPL", 2.0), "Ü": ([], "", 1.0), "plain": ([], "", 1.0), "T": (["one", "two"], "", 0.5), "Y": (["first", "second"], "Y", 1.0), "bare": ([], "", 1.0),
    }
    bad = sorted((r.path.rsplit("/", 1)[1], r.line, r.reason.split(":")[0]) for r in rows if r.reason is not None)
    assert bad == sorted([("a.json", None, "no label"), ("a.json", None, "weight is no number"), ("b.jsonl", 3, "json"), ("e.toml", 2, "toml"), ("f.json", 3, "json"), ("g.txt", None, "unknown format"), ("h.json", 3, "not UTF-8")], key=str)


def test_benchmark(spark, tmp_path):
    good = {"ticker": "aapl", "event_date": "2026-01-02", "source_url": "https://a.example/1", "headline": "h", "materiality_rationale": "r", "provenance": "p"}
    rows = [good, good | {"ticker": "XX"}, good | {"source_url": "https:///x"}, good | {"headline": " "}, good | {"event_date": "soon"}, good | {"event_date": "2026-01-03"}, good | {"event_date": "2026-01-03"}]
    put(tmp_path, "b.jsonl", "\n".join(map(json.dumps, rows)))
    tickers = spark.createDataFrame([("AAPL",)], "ticker string")
    got = R.benchmark(R.read_items(spark, str(tmp_path)), tickers).orderBy("line").collect()
    assert [r.reason for r in got] == [None, "ticker", "url", "text", "day", "repeated", "repeated"]
    assert str(got[0].day) == "2026-01-02" and got[0].ticker == "AAPL"


def test_feeds(spark, tmp_path):
    put(tmp_path, "s.toml", '[agent]\nhours = 30\n[[feeds]]\nname = "A"\nurl = "https://a.example/rss"\nreputation = 0.9\ncategories = ["global"]\n[[feeds]]\nname = "B"\nurl = "ftp://b"\n[[feeds]]\nname = "C"\nurl = "http://c.example"\nreputation = 7\n')
    got = R.feeds(R.read_items(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r.name, r.reputation, r.categories, r.reason) for r in got] == [("A", 0.9, ["global"], None), ("B", 0.7, [], "url"), ("C", 7.0, [], "reputation")]


FILING = {"legal_regime": "us", "required_edgar": True, "observed_forms": ["8-K"], "subsidiary_exhibit": "e", "omission_allowance": "o", "evidence_url": "https://s.example", "verified_at": "2026-07-31"}
NAME = {"name": "Apple Inc.", "relationship": "self", "source": "https://s.example", "verified_at": "2026-07-31", "expires_at": None}
TICKER = {"legal_issuer": "Apple Inc.", "cik": "0000320193", "filing": FILING, "names": [NAME], "negative_names": ["Apple Bank"]}


def test_entity_map(spark, tmp_path):
    changed = {
        "OK": {}, "CIK": {"cik": "12"}, "FORMS": {"filing": FILING | {"observed_forms": [" "]}}, "URL": {"filing": FILING | {"evidence_url": "http://x"}}, "DAY": {"filing": FILING | {"verified_at": "x"}},
        "NONE": {"names": []}, "REL": {"names": [NAME, NAME | {"relationship": "cousin"}]}, "SELF": {"names": [NAME | {"relationship": "unrelated"}]}, "EXP": {"names": [NAME | {"expires_at": "later"}]},
        "TWO": {"names": [NAME, NAME | {"name": "Beats", "relationship": "controlled_affiliate", "expires_at": "2027-01-01", "min_tokens": 2, "requires_context": ["music"], "verified_against_accession": "A1"}]},
    }
    whole = {"schema_version": 1, "generated_at": "2026-07-31T16:30:00-04:00", "tickers": {k: TICKER | v for k, v in changed.items()}}
    put(tmp_path, "map.json", json.dumps(whole))
    put(tmp_path, "old.json", json.dumps(whole | {"schema_version": 2}))
    put(tmp_path, "local.json", json.dumps(whole | {"generated_at": "2026-07-31T16:30:00"}))
    names, negatives, rejected = R.entity_map(R.read_items(spark, str(tmp_path)))
    got = sorted(names.collect(), key=lambda r: (r.ticker, r.seq))
    assert [(r.ticker, r.name, r.min_tokens, r.context, r.accession, str(r.expires_at)) for r in got] == [
        ("OK", "Apple Inc.", 1, [], None, "None"), ("TWO", "Apple Inc.", 1, [], None, "None"), ("TWO", "Beats", 2, ["music"], "A1", "2027-01-01"),
    ]
    assert {r.ticker for r in negatives.collect()} == {"OK", "TWO"}
    told = {(r.path.rsplit("/", 1)[1], r.ticker): r.reason for r in rejected.collect()}
    assert told == {
        ("old.json", None): "schema version", ("local.json", None): "time", ("map.json", "CIK"): "cik", ("map.json", "FORMS"): "forms", ("map.json", "URL"): "evidence", ("map.json", "DAY"): "filing day",
        ("map.json", "NONE"): "no names", ("map.json", "REL"): "name", ("map.json", "SELF"): "no self name", ("map.json", "EXP"): "name",
    }


def test_missing_folder_is_told(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        R.read_items(spark, str(tmp_path / "none")).collect()
