"""Collocations by stripes against counters of a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from storyloom.llm import collocations as K

SCHEMA = "doc_id bigint, text string, lang string, rank string, word int"


def by_rule(rows, kept=K.KEPT):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    often = {k: v for k, v in f.items() if v >= 30 and len(k[1]) > 1}
    gone = {(lang, q[i : i + m]) for (lang, q), v in often.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * v >= 80 * f[lang, q[i : i + m]]}
    out = []
    for lang in n:
        own = []
        for (g, p), a in often.items():
            if g == lang and (g, p) not in gone:
                cuts = [(2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                own.append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(own)[:kept])]
    return sorted(out)


def made(spark, rows):
    data = [(k % 7 or None, t, lang, "clash", k) for k, (t, lang) in enumerate(rows)]
    return sorted(map(tuple, K.collocations(spark.createDataFrame(data, SCHEMA).repartition(6)).collect()))


def test_matches_rule(spark, monkeypatch):
    r = random.Random(3)
    common = ["the", "Of", "né", "x-y", "ÀB", "😀", "w w"]
    sets = ["new york stock exchange", "in the light of", "New York", "per cent", "a a a a a"]
    rows = []
    for _ in range(400):
        words = []
        for _ in range(r.randrange(0, 60)):
            words += [r.choice(common)] if r.random() < 0.6 else [r.choice(sets)] if r.random() < 0.5 else [f"q{r.randrange(4000)}"]
            words += r.choice([[], [], [], [", "], ["."], ["\n"], ["\t"]])
        rows.append((" ".join(words), r.choice(["en", "en", "de", None, "und"])))
    rows += [(None, "en"), ("", None), (" \t ", "fr"), (".,;", "de"), ("the of " * 20_000, "en"), ("y" * 50_000, None)] + [("copied line of text here\n" * 3, "en")] * 40
    assert made(spark, rows) == by_rule(rows)
    monkeypatch.setattr(K, "CHUNK", 1)
    monkeypatch.setattr(K, "HOT_SHARE", 8)  # some prefixes are dealt to several places, some are not
    assert made(spark, rows) == by_rule(rows)


def test_ties_and_kept(spark, monkeypatch):
    rows = [(f"{x} {y}. ", "en") for x in "abcdef" for y in "uvwxyz" for _ in range(30)]
    got = made(spark, rows)
    assert got == by_rule(rows) and len(got) == 36
    monkeypatch.setattr(K, "KEPT", 10)
    assert made(spark, rows) == by_rule(rows, 10)


def test_empty_table_and_rare_words(spark):
    assert made(spark, []) == []
    assert made(spark, [("one two three four five", "en")] * 29) == []
    assert made(spark, [("one two three four five", "en")] * 30) == by_rule([("one two three four five", "en")] * 30)


def test_exact_beyond_64_bits(spark):
    big = 2**61
    counts = spark.createDataFrame([("en", "", "a", "a", big), ("en", "", "b", "b", big + 3), ("en", "a", "b", "a b", big - 5)], "lang string, prefix string, word string, phrase string, f bigint")
    (row,) = K.scored(counts).collect()
    assert row.score == 2_000_000 * (big - 5) // (2 * big + 3)


def test_filter_forgets_nothing():
    h = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    bits = 1 << 16
    words = np.zeros(bits // 64, np.uint64)
    for at in K.Filter.places(h, bits):
        np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    f = K.Filter(bits, words)
    assert f.has(h).all()
    assert f.has(np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64)).mean() < 0.1


def test_full_filter_stays_exact(spark, monkeypatch):
    """What a crowded filter lets pass is counted and found rare."""
    monkeypatch.setattr(K, "MOST_BITS", 64)
    rows = [("of the light. the of. by q of the day by day", "en")] * 35 + [("rare words of the kind", "de")] * 3
    assert made(spark, rows) == by_rule(rows)


def test_words_do_not_span_rows():
    coded = K.Coded(pa.array(["en", "en", "de"]), pa.array(["ab", "cd", "ab. x"]))
    assert coded.words.to_pylist() == ["ab", "cd", "x"] and not coded.follows().any()
    sliced = pa.array(["zz", "Ab cd", "e"]).slice(1)
    coded = K.Coded(pa.array(["en", "de"]), sliced)
    assert [coded.words[i].as_py() for i in coded.word] == ["ab", "cd", "e"] and coded.follows().tolist() == [True, False, False]
