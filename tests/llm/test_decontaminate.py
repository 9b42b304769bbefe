"""Pigeonhole edit matching against brute force, and its defined cases."""

import random
import re

from storyloom.llm import decontaminate


def best(item, text):
    """Least edits between the item and any stretch of the text."""
    row = list(range(len(item) + 1))
    least = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, x in enumerate(item, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != c))
        least = min(least, row[-1])
    return least


def test_myers_finds_the_best_place():
    r = random.Random(1)
    for _ in range(300):
        item = "".join(r.choice("abc") for _ in range(r.randrange(1, 25)))
        text = "".join(r.choice("abc") for _ in range(r.randrange(0, 60)))
        want = best(item, text)
        got = decontaminate.myers(item, text, 3)
        assert (got is None) if want > 3 else got[0] == want


def test_matches_brute_force(spark, prose):
    r = random.Random(2)
    items = [(i, prose(100 + i, 20).title() + ".") for i in range(6)] + [(50, ""), (51, None), (52, "?!"), (53, prose(100, 20))]
    docs = []
    for d in range(40):
        text = prose(d, 60)
        if d % 2:
            passage = list(items[d % 6][1])
            for _ in range(r.randrange(0, 9)):
                passage[r.randrange(len(passage))] = r.choice("abcdé ")
            text += "\n" + "".join(passage) + " " + prose(d + 500, 10)
        docs.append((d, text))
    docs += [(90, None), (91, ""), (92, "x" * 50_000 + " " + items[2][1])]
    plain = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip()
    want = set()
    for d, t in docs[:-1]:
        for i, x in items:
            p = plain(x)
            if p and best(p, plain(t)) <= int(len(p) * decontaminate.BUDGET):
                want.add((d, i, best(p, plain(t))))
    want.add((92, 2, 0))
    frame, tests = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(x)[:3] for x in decontaminate.contaminated(frame, tests).collect()} == want
    assert {tuple(x)[:3] for x in decontaminate.contaminated(frame, tests, block_chars=150).collect()} == want
    left = {x.doc_id for x in decontaminate.clean_documents(frame, tests).collect()}
    assert left == {d for d, _ in docs} - {d for d, *_ in want}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a text")], "doc_id bigint, text string")
    assert decontaminate.contaminated(some, items).count() == 0 and decontaminate.clean_documents(some, items).count() == 1


def test_rows_are_judged_each_for_itself(spark, prose):
    item = prose(1, 20)
    rows = [(2**53 + 1, "a " + item, "x"), (2**53, "clean", "x"), (None, "b " + item, "x"), (None, "clean too", None), (7, "c " + item, "x"), (7, "clean again", "x"), (7, "clean again", "x"), (8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string").selectExpr("*", "1 AS t", "'k' AS key").coalesce(1)
    items = spark.createDataFrame([(2**53 + 3, item, 1), (None, prose(2, 20), 1)], "item_id bigint, text string, block int")
    got = sorted(((x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, items).collect()), key=str)
    assert got == sorted([(2**53 + 1, 2**53 + 3), (None, 2**53 + 3), (7, 2**53 + 3)], key=str)
    left = decontaminate.clean_documents(docs, items)
    assert left.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in left.collect()), key=str) == sorted([(i, t) for i, t, _ in rows if item not in (t or "")], key=str)
