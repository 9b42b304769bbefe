"""Embedding range join against brute force, and its defined cases."""

import numpy as np

from storyloom.llm import embedding_dedup


def brute(rows, least):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, j in zip(*np.nonzero(hit), strict=True):
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return {rows[i][0]: (int(hit[i].sum()), rows[root(i)][0]) for i in range(len(rows))}


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PER_PIVOT", 40)
    monkeypatch.setattr(embedding_dedup, "PART", 30)
    r = np.random.default_rng(8)
    rows = []
    for c in range(60):
        base = r.normal(size=12)
        rows += [base + r.normal(size=12) * 0.08 for _ in range(1 + c % 9)]
    rows += [rows[0]] * 40 + [rows[5] * 3.5]
    rows = [(i, [float(np.float32(v)) for v in x]) for i, x in enumerate(rows)]
    bad = [(900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] * 12), (904, [None] + [1.0] * 11), (905, [float("inf")] * 12), (906, [1.0, 2.0]), (None, [1.0] * 12)]
    frame = spark.createDataFrame(rows + bad + [rows[3]], "vec_id bigint, embedding array<float>")
    got = embedding_dedup.near_vectors(frame, 0.95).collect()
    want = brute(rows, 0.95)
    assert len(got) == len(rows) + len(bad) + 1
    for x in got:
        n, c = want.get(x.vec_id, (0, x.vec_id))
        assert (x.n_links, x.component_id, x.kept) == (n, c, x.vec_id == c or x.vec_id is None), x


def test_empty_table(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_none_below_the_bound(spark):
    """Pairs a few units in the last place on either side of the bound."""
    rows = [(0, [1.0, 0.0, 0.0])]
    for k in range(-40, 41):
        c = 0.95 + k * 1e-16
        rows.append((k + 100, [c, 0.0 if k % 2 else float(np.sqrt(1 - c * c)), float(np.sqrt(1 - c * c)) if k % 2 else 0.0]))
    got = {x.vec_id: x.n_links for x in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 0.95).collect()}
    x = embedding_dedup._unit(__import__("pandas").Series([v for _, v in rows]))
    want = sum(float(np.einsum("i,i->", x[0], y)) >= 0.95 for y in x[1:])
    assert got[0] == want and 0 < want < 81


def test_copies_of_a_hot_cell_are_dealt_in_slices(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PART", 8)
    monkeypatch.setattr(embedding_dedup, "DEALT_ROWS", 50)
    monkeypatch.setattr(embedding_dedup, "DEALT_BYTES", 800)
    r = np.random.default_rng(1)
    rows = [(i, (np.ones(6) + r.normal(size=6) * 0.25).tolist()) for i in range(150)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 0.95).collect()}
    assert got == brute(rows, 0.95)


def test_vectors_are_not_copied_for_the_cells_that_they_visit(spark, monkeypatch):
    """Vectors without clusters, which may link into every cell: each is written in one block, and nothing is dealt out for
    the join, whose rows are pairs of blocks."""
    for name, value in (("PER_PIVOT", 20), ("PART", 8), ("DEALT_ROWS", 30), ("LEAST_BLOCKS", 3)):
        monkeypatch.setattr(embedding_dedup, name, value)
    kept, write = {}, embedding_dedup.cut
    monkeypatch.setattr(embedding_dedup, "cut", lambda df, label: kept.setdefault(label, (df, write(df, label)))[1])
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=5).tolist()) for i in range(200)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 0.9).collect()}
    assert got == brute(rows, 0.9)
    assert "RepartitionByExpression" not in kept["links"][0]._jdf.queryExecution().optimizedPlan().toString()
    assert kept["blocks"][0].selectExpr("sum(length(rep)) / 8 as n").first().n == len(rows)
