"""MinHash near-dedup and its sketches against brute force, and its defined cases."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from storyloom.llm import minhash_dedup, shingles

SCHEMA = "doc_id bigint, text string"


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("width, rounds", [(4, 3), (5, 3), (4, 0)])
def test_components_match_brute_force(spark, prose, monkeypatch, width, rounds):
    monkeypatch.setattr(minhash_dedup, "LEADER_ROUNDS", rounds)
    r = random.Random(width)
    rows = []
    for base in range(12):
        words = prose(base, 120).split()
        for _ in range(r.randrange(1, 9)):
            copy = list(words)
            for _ in range(r.randrange(0, 7)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "two words"), (906, " Two  WORDS "), (907, "É é"), (908, "é é"), (909, prose(0, 120)), (910, prose(0, 120).upper())]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash_dedup.near_components(spark.createDataFrame(rows, SCHEMA), width, 80).collect()}
    assert got == brute(rows, width, 80)


def test_repeated_null_and_clashing_rows(spark, prose):
    t = prose(1, 60)
    rows = [(1, t, "a"), (1, t, "b"), (2, t, "c"), (None, t, "d"), (3, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string").withColumnRenamed("component_id", "band")
    got = sorted((str(x["doc_id"]), x["component_id"], x["kept"]) for x in minhash_dedup.near_components(docs).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 3, True), ("None", None, True)]
    kept = minhash_dedup.keep_one(docs.select("doc_id", "text"))
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == ["1", "3", "None"]


def test_empty_table(spark):
    assert minhash_dedup.near_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketch_estimates_similarity_and_always_fills():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    sketch = shingles.fast_sketch(np.concatenate([a, b, pool[:1]]), np.array([len(a), len(b), 1]), 512)
    assert (sketch != np.iinfo(np.uint64).max).all()
    assert abs((sketch[0] == sketch[1]).mean() - 1 / 3) < 0.08


def test_parities_bound_the_difference():
    rng = np.random.default_rng(6)
    for n in (5, 60, 700):
        pool = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
        a, b = pool[:n], pool[n // 3 : n + n // 3]
        bits = shingles.parities(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert sum(int(x).bit_count() for x in bits[0] ^ bits[1]) <= len(set(a) ^ set(b))
