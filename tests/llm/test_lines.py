"""Line dedup and its distance against brute force, and its defined cases."""

import random

from pyspark.sql import functions as F

from storyloom.llm import line_dedup

SCHEMA = "doc_id bigint, text string"


def mutate(r, line, n):
    out = list(line)
    for _ in range(n):
        kind, p = r.random(), r.randrange(len(out))
        if kind < 0.4:
            out[p] = r.choice("abcdé")
        elif kind < 0.7:
            out.insert(p, r.choice("abcdé"))
        else:
            del out[p]
    return "".join(out)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance(spark):
    r = random.Random(4)
    pairs = []
    while len(pairs) < 400:
        a = "".join(r.choice("abé") for _ in range(r.randrange(1, 40)))
        b = mutate(r, a, r.randrange(0, 3)) if len(a) > 4 else a
        a, b = max(a, b, key=len), min(a, b, key=len)
        if len(a) - len(b) <= 2:
            pairs.append((a, b, edits(a, b)))
    df = spark.createDataFrame(pairs, "a string, b string, d int").withColumn("m", line_dedup.banded_distance(F.col("a"), F.col("b"), 2))
    assert df.where("(d <= 2 and m <> d) or (d > 2 and m <= 2)").count() == 0


def test_classes_match_brute_force(spark):
    r = random.Random(9)
    bases = ["".join(r.choice("abcd efg") for _ in range(r.choice([9, 22, 24, 25, 50, 71, 72, 74, 120]))).strip() or "x" * 30 for _ in range(25)]
    docs = [(i, "\n".join(mutate(r, r.choice(bases), r.randrange(0, 5)) for _ in range(8)) + "\n\n  short line ") for i in range(25)]
    docs += [(100, None), (101, ""), (102, "short line\n short line\t\n" + bases[0])]
    place, order = {}, []
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            line = line.strip(line_dedup.BLANK)
            if line:
                place.setdefault(line, (i, k))
                order.append((i, k, line))
    up = {p: p for p in place.values()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(place, 0)
    every = list(place)
    for n, a in enumerate(every):
        for b in every[:n]:
            allowed = max([k for least, k in line_dedup.BANDS if min(len(a), len(b)) >= least], default=0)
            if abs(len(a) - len(b)) <= allowed and edits(a, b) <= allowed:
                links[a] += 1
                links[b] += 1
                x, y = root(place[a]), root(place[b])
                up[max(x, y)] = min(x, y)
    want = sorted((i, k, *root(place[x]), links[x], root(place[x]) == (i, k)) for i, k, x in order)
    got = line_dedup.near_lines(spark.createDataFrame(docs, SCHEMA))
    assert sorted((x.doc_id, x.line_no, x.class_doc, x.class_line, x.n_links, x.kept) for x in got.collect()) == want
    assert max(links.values()) > 0


def test_empty_and_repeated(spark):
    assert line_dedup.near_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    line = "a line that is long enough to be compared"
    got = line_dedup.near_lines(spark.createDataFrame([(1, line), (1, line), (2, line + "!")], SCHEMA)).collect()
    assert sorted((x.doc_id, x.class_doc, x.n_links, x.kept) for x in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_lines_with_a_common_beginning_meet_only_where_the_rest_is_alike(spark):
    r = random.Random(3)
    begin = "a beginning that very many lines have in common, "
    lines = [begin + "".join(r.choice("abcdefghijklmnop") for _ in range(70)) for _ in range(400)]
    lines += [lines[7][:-2] + "zz", lines[9][:60] + lines[9][61:]]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], SCHEMA)
    got = {x.doc_id: (x.n_links, x.class_doc) for x in line_dedup.near_lines(docs).collect()}
    assert {i: v for i, v in got.items() if v[0]} == {7: (1, 7), 400: (1, 7), 9: (1, 9), 401: (1, 9)}
    texts = docs.select(F.xxhash64("text").alias("id"), F.col("text").alias("line"))
    live = line_dedup.met(line_dedup.search_rows(texts))
    most = lambda df: df.groupBy("h").agg(F.count_distinct("id").alias("n")).agg(F.max("n")).first()[0]
    assert most(live) > 300
    for _ in range(2):
        live = line_dedup.met(line_dedup.split_again(live, texts))
    assert most(live) < 20


def test_documents_without_near_lines(spark):
    docs = [(1, "alpha line one\n\nbeta"), (1, "alpha line one\n\nbeta"), (1, "gamma line\nbeta"), (None, "delta line of nobody\nbeta two"), (2, "alpha line 0ne\n \nnew"), (3, None), (4, "beta"), (5, "")]
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "'x' AS line", "1 AS line_no", "2 AS k", "'y' AS whole")
    got = sorted(((x.doc_id, x.text) for x in line_dedup.without_near_lines(frame).collect()), key=str)
    assert got == sorted([(1, "alpha line one\n"), (1, "gamma line\nbeta"), (None, "delta line of nobody\nbeta two"), (2, " \nnew"), (3, None), (4, ""), (5, "")], key=str)
