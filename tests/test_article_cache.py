"""Cached articles there and back, with defaults and refusals."""

import json

from storyloom.sources import article_cache as C


def test_round_trip_defaults_and_refusals(spark):
    full = {
        "title": 'T "x"\n', "url": "https://a", "source": "AP", "published_at": "2026-07-01T10:00:00+00:00", "summary": "s", "canonical_url": "c", "feed_content": "f", "extracted_text": "é", "enrichment_status": "extracted",
        "enrichment_error_code": "e", "evidence_score": 1.5, "reputation": 0.9, "feed_categories": ["global", "culture"], "feed_source_type": "tech", "feed_culture_lane": "music", "feed_timestamp_valid": False, "content_quality_penalty": 0.4,
    }
    bare = {k: full[k] for k in ("title", "url", "source", "published_at")}
    rows = [(1, json.dumps([full, bare, "text", 7, bare | {"published_at": "2026-07-01T10:00:00.250000-04:00"}])), (2, json.dumps([bare | {"url": None}, bare | {"published_at": "soon"}])), (3, "{}"), (4, "[]"), (5, None)]
    articles, rejected = C.from_payloads(spark.createDataFrame(rows, "k bigint, payload string"), "k")
    got = {(r.k, r.pos): r for r in articles.collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 4)]
    assert [got[1, 0][k] for k in full if k != "published_at"] == [v for k, v in full.items() if k != "published_at"]
    assert [got[1, 1][k] for k in full if k not in bare] == ["", "", "", "", "not_attempted", "", 0.0, 0.7, [], "general", "", True, 0.0]
    assert (got[1, 4].published_at - got[1, 1].published_at).total_seconds() == 4 * 3600 + 0.25
    assert sorted((r.k, r.pos, r.reason) for r in rejected.collect() if r.pos is not None) == [(2, 0, "url"), (2, 1, "published_at")]
    assert {r.k for r in rejected.collect() if r.pos is None} >= {5}
    again, none = C.from_payloads(C.to_payloads(articles.where("k = 1"), "k", "pos"), "k")
    assert none.count() == 0
    names = [name for name, *_ in C.FIELDS]
    assert [tuple(r[n] for n in names) for r in again.orderBy("pos").collect()] == [tuple(got[1, p][n] for n in names) for p in (0, 1, 4)]
