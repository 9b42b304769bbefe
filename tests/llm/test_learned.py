"""Quality and toxicity: held-out accuracy, exact neighbours, and defined cases."""

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from storyloom.llm import quality, toxicity
from storyloom.llm.shingles import word_hashes

SCHEMA = "doc_id bigint, text string"


def labelled(prose, n=400):
    docs, labels = [], []
    for i in range(n):
        text = prose(i, 40 + i % 60, 5000).capitalize() + "."
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            text = " ".join(w + random.Random(i).choice(["###", "$$$"]) for w in text.split()) if i % 2 else " ".join([text.split()[0]] * 80)
        if toxic:
            words = text.split()
            words[3] = random.Random(i).choice(["nastyish", "vileness"])
            text = " ".join(words)
        docs.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_quality_on_held_out_rows(spark, prose):
    docs, labels = labelled(prose)
    frame = spark.createDataFrame(docs + [(900, None), (901, ""), (902, " \n"), (0, docs[0][1])], SCHEMA)
    featured = quality.features(frame)
    ranking = quality.train(featured, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = quality.score_documents(featured, ranking).collect()
    assert len(got) == len(docs) + 4
    want = {i: q for i, q, _ in labels}
    held = [x for x in got if x.held_out and x.doc_id in want]
    assert held and all(x.predicted == want[x.doc_id] for x in held)
    assert all(0 <= x.score <= 1 for x in got)
    kept = {x.doc_id for x in quality.keep_quality(frame, quality.score_documents(featured, ranking), ranking.threshold).collect()}
    assert not [i for i, q in want.items() if q == 0 and i in kept]
    assert sum(i in kept for i, q in want.items() if q == 1) >= 0.98 * sum(want.values())


def test_quality_learns_from_all_labelled_rows(spark, prose):
    docs, labels = labelled(prose)
    frame = spark.createDataFrame(docs, SCHEMA)
    featured = quality.features(frame)
    ranking = quality.train(featured, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), most=60)
    marks = {d: q for d, q, _ in labels}
    own = [x for x in featured.collect() if x.doc_id in marks and zlib.crc32(str(x.doc_id).encode()) % 5 != 0]
    assert len(own) > 180
    np.testing.assert_allclose(ranking.mean, np.mean([x.x for x in own], 0), rtol=1e-9, atol=1e-12)
    got = {x.doc_id: x for x in quality.score_documents(featured, ranking).collect()}
    liked = [got[x.doc_id].score for x in own if marks[x.doc_id] == 1]
    np.testing.assert_allclose(ranking.threshold, np.quantile(liked, quality.REJECT_QUANTILE), rtol=1e-9)
    held = [(x.score, marks[x.doc_id]) for x in got.values() if x.held_out and x.doc_id in marks]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_quality_features_by_hand(spark):
    x = quality.features(spark.createDataFrame([(1, "Ab ab ab 1|\nX"), (2, None)], SCHEMA)).collect()
    f = dict(zip(quality.FEATURES, x[0].x, strict=True))
    assert abs(f["letters"] - 7 / 13) < 1e-9 and abs(f["bars"] - 1 / 13) < 1e-9 and abs(f["repeats"] - 2 / 5) < 1e-9
    assert x[1].x == [0.0] * len(quality.FEATURES)
    assert spark.createDataFrame([("a  b",)], "t string").select(F.size(word_hashes(F.col("t")))).first()[0] == 2


def test_without_labels(spark):
    docs, labels = spark.createDataFrame([(1, "a b")], SCHEMA), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    featured = quality.features(docs)
    assert quality.score_documents(featured, quality.train(featured, labels)).first().score == 0.5
    assert toxicity.score_documents(docs, toxicity.build_index(docs, labels)).first().score == 0.0
    none = spark.createDataFrame([], SCHEMA)
    assert toxicity.score_documents(none, toxicity.build_index(none, labels)).count() == 0 and quality.features(none).count() == 0


def test_toxicity_on_held_out_rows(spark, prose):
    docs, labels = labelled(prose, 600)
    frame = spark.createDataFrame(docs + [(900, None), (901, "")], SCHEMA)
    index = toxicity.build_index(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = toxicity.score_documents(frame, index).collect()
    want = {i: t for i, _, t in labels}
    held = [x for x in got if x.held_out and x.doc_id in want]
    assert sum(x.predicted == want[x.doc_id] for x in held) >= 0.97 * len(held)
    caught = next(x for x in held if want[x.doc_id] and x.predicted)
    assert caught.evidence and caught.similarities == sorted(caught.similarities, reverse=True)


def test_toxicity_statistics_cover_all_training_rows(spark, prose):
    docs, labels = labelled(prose, 600)
    frame, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    index = toxicity.build_index(frame, marks, most=60)
    label = {i: t for i, _, t in labels}
    rows = [(set(re.findall(r"[^\W\d_]+", t.lower())), label[i]) for i, t in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    n, pos = len(rows), sum(y for _, y in rows)
    assert len(index.ids) < 120 < n
    every = sorted(set().union(*(own for own, _ in rows)))
    hashed = {t: h for t, h in spark.createDataFrame([(t,) for t in every], "t string").select("t", toxicity.words(F.col("t"))[0]).collect()}
    weight = dict(zip(index.terms.tolist(), index.weights.tolist(), strict=True))
    seen = 0
    for t in every:
        if hashed[t] in weight:
            df, p = sum(t in own for own, _ in rows), sum(t in own and y for own, y in rows)
            chi = n * (p * n - df * pos) ** 2 / (df * (n - df) * pos * (n - pos)) if df < n else 0.0
            assert abs(weight[hashed[t]] - (math.log((1 + n) / (1 + df)) + 1) * (chi / (chi + 40)) ** 2) < 1e-9
            seen += 1
    assert seen == len(weight) > 100
    again = toxicity.build_index(frame.repartition(5), marks, most=60)
    assert (again.terms == index.terms).all() and again.slope == index.slope


def test_scores_are_those_of_a_full_comparison(spark, prose):
    docs, labels = labelled(prose, 500)
    frame = spark.createDataFrame(docs, SCHEMA)
    index = toxicity.build_index(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    hashes = {i: np.array(w, np.int64) for i, w in frame.select("doc_id", toxicity.words(F.col("text"))).collect()}
    dense = np.zeros((len(index.ids), len(index.terms)))
    for r, i in enumerate(index.ids):
        ts, ws = index.vector(hashes[int(i)])
        dense[r, ts] = ws
    got = {x.doc_id: x for x in toxicity.score_documents(frame, index).collect()}
    for i, h in hashes.items():
        q = np.zeros(len(index.terms))
        ts, ws = index.vector(h)
        q[ts] = ws
        cos = dense @ q
        best = sorted(range(len(cos)), key=lambda r: (-round(cos[r], 12), r))[:15]
        best = [r for r in best if cos[r] > 0]
        vote = (sum(cos[r] * index.y[r] for r in best) + 0.5 * index.base) / (sum(cos[r] for r in best) + 0.5)
        score = 1 / (1 + math.exp(-(index.slope * vote + index.shift))) if best else index.none
        assert got[i].evidence == [int(index.ids[r]) for r in best] and abs(got[i].score - score) < 1e-9


def test_toxicity_cases(spark, prose):
    docs, labels = labelled(prose, 200)
    frame = spark.createDataFrame(docs, SCHEMA)
    index = toxicity.build_index(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    rows = [(2**53 + 1, "w1 nastyish"), (None, "w1 nastyish"), (3, None), (3, ""), (4, "12 34 --"), (5, "w1 nastyish"), (5, "w1 nastyish"), (6, "wa wb wc " * 200_000 + "nastyish")]
    odd = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "'a' AS words", "2 AS evidence").coalesce(1)
    got = toxicity.score_documents(odd, index).collect()
    assert sorted((x.doc_id for x in got), key=str) == sorted((i for i, _ in rows), key=str)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, set()).add(round(x.score, 12))
    assert all(len(v) == 1 for v in by.values()) and by[2**53 + 1] == by[None] == by[5]
    assert by[3] == by[4] == {round(index.none, 12)}


def test_common_terms_are_bounded_by_block():
    r = np.random.default_rng(3)
    n, v = 3000, 60
    texts = [r.choice(v, r.integers(1, 12), p=np.arange(1, v + 1) / (v * (v + 1) / 2)) for _ in range(n)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    index = toxicity.Index(np.arange(v), r.random(v) ** 4 + 1e-4, np.arange(n), r.integers(0, 2, n), ends, np.concatenate(texts))
    dense = np.zeros((n, v))
    for k in range(n):
        own = slice(index.ends[k], index.ends[k + 1])
        dense[k, index.term[own]] = index.weight[own]
    for k in range(0, n, 50):
        cos = dense @ dense[k]
        own = slice(index.ends[k], index.ends[k + 1])
        place, got = index.nearest(index.term[own], index.weight[own], 15)
        best = sorted(range(n), key=lambda i: (-round(cos[i], 12), i))[:15]
        assert place.tolist() == best and np.allclose(got, cos[best])
    assert index.opened < index.passed
