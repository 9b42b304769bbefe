"""Licence scans: base places against SQL and a rule, the rare-word index against every place of every template."""

import os
import random

import pytest
from oracle import run_sql
from pyspark.sql import functions as F

from storyloom.llm import licences as L

SF = "/root/testdata/sf0.001"
NOTICES = [t for t, _ in L.TEMPLATES.values()]


def every_place(index, words):
    """Labels of all places of all templates, looked at one by one."""
    found = set()
    for name in index.words:
        for begin in range(-L.SLACK, len(words)):
            if index.coverage(name, begin, words) >= L.COVERAGE and index.holds(name, begin, words):
                found.add(name)
    return found


def noisy(notice, r):
    words = notice.split()
    for _ in range(r.randrange(3)):
        k = r.randrange(len(words))
        words[k : k + 1] = r.choice([[], ["really", words[k]], [words[k].upper()]])
    return " ".join(words)


def test_index_finds_what_every_place_finds(prose):
    r = random.Random(5)
    texts = []
    for k in range(60):
        parts = [prose(k, r.randrange(0, 300))]
        for _ in range(r.randrange(4)):
            parts += [noisy(r.choice(NOTICES), r), prose(k + 100, r.randrange(0, 90))]
        texts.append(" ".join(parts))
    docs = [L.words_of(t) for t in texts]
    counts = {}
    for words in docs:
        for w in set(words):
            counts[w] = counts.get(w, 0) + 1
    index = L.Index(counts, len(docs))
    wanted = [every_place(index, words) for words in docs]
    got = [{name for name, *_ in index.scan(words)[0]} for words in docs]
    assert all(g <= w for g, w in zip(got, wanted, strict=True))
    planted, hit = sum(map(len, wanted)), sum(len(g & w) for g, w in zip(got, wanted, strict=True))
    assert planted > 60 and hit == planted


def test_mandatory_phrases_decide():
    index = L.Index({}, 10)
    labels = lambda t: {n for n, *_ in index.scan(L.words_of(t))[0]}
    assert labels("Released under the MIT License.") == {"mit"}
    assert labels("Released under the MIT and other License") == set()
    assert labels("Licensed under the GNU Public General License, version 3") == set()
    assert "gpl-3.0" in labels("is licensed under the GNU General Public License version 3")
    assert "gpl-2.0" not in labels("is licensed under the GNU General Public License version 3")
    assert labels("x " * 5000 + NOTICES[9] + " y" * 5000 + " " + NOTICES[14]) >= {list(L.TEMPLATES)[9], list(L.TEMPLATES)[14]}


SCHEMA = "doc_id bigint, text string, labels string, score int"
ROWS = [
    (1, None, None, 1), (2, "", "x", 2), (None, "the MIT license", "x", 3), (3, "MIT\nLicense and Apache-License; CC BY 4.0, cc by", None, 4), (3, "MIT\nLicense and Apache-License; CC BY 4.0, cc by", None, 4),
    (4, "GNU GENERAL public licenses gnu general public license", None, 5), (5, "mit licénse mit license2 mit license", None, 6), (6, "w " * 300_000 + "cc by", None, 7), (7, "cc cc by by cc  by", None, 8), (8, " \n\t.,", None, 9),
]


def test_defined_cases(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    rows = L.scan_licences(docs).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str)
    want = [
        (1, 0, 0, None, None, ""), (2, 0, 0, None, None, ""), (None, 3, 1, 1, 1, "mit"), (3, 11, 4, 0, 9, "apache,cc-by,mit"), (3, 11, 4, 0, 9, "apache,cc-by,mit"),
        (4, 8, 1, 4, 4, "gpl"), (5, 6, 1, 4, 4, "mit"), (6, 300_002, 1, 300_000, 300_000, "cc-by"), (7, 6, 2, 1, 4, "cc-by"), (8, 0, 0, None, None, ""),
    ]
    assert got == sorted(want, key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in rows)
    assert L.scan_licences(spark.createDataFrame([], SCHEMA)).collect() == []


BASE_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 p AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')) t(p, label)),
 s AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), h AS (SELECT doc_id, i - 1 AS i, label FROM s JOIN p ON w[i:i + len(p) - 1] = p)
SELECT doc_id, len(w) AS n_words, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM w LEFT JOIN h USING (doc_id) GROUP BY doc_id, w"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_whole_table(spark):
    from oracle import rows_of

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.scan_licences(docs)
    base = got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert rows_of(base.columns, [tuple(r) for r in base.collect()]) == run_sql(BASE_SQL, SF)
    counts, n = L.document_counts(docs)
    index = L.Index(counts, n)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got.where(F.col("labels") != F.col("base_labels")).collect():
        want = every_place(index, L.words_of(texts[r.doc_id]))
        assert set(r.labels.split(",")) == want | set(filter(None, r.base_labels.split(",")))
