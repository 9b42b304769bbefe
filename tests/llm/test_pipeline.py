"""The corpus pipeline over the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_stages_keep_and_drop_what_they_should(spark):
    import corpus_pipeline as p
    from storyloom.session import cut

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    seen = []
    for name, stage in p.STAGES:
        docs = cut(stage(spark, docs, SF), "t")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != p.STAGES[-1][0]:
            assert docs.columns == list(p.COLUMNS)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not [i for i in seen[0] if labels.get(i) == 0]
    assert sum(labels.get(i) == 1 for i in seen[0]) >= 0.97 * sum(q == 1 for i, q in labels.items() if i in before)
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[4] == seen[3]
    assert set(docs.columns) == {*p.COLUMNS, "shard"}
    assert docs.where("shard < 0 or shard > 7").count() == 0


def test_odd_rows_in_every_stage(spark, prose):
    import corpus_pipeline as p
    from storyloom.session import cut

    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("n_chars > 600")
    texts = [r.text for r in good.orderBy("doc_id").limit(12).collect()]
    big = 2**53 + 1
    rows = [(big, texts[0], "en", "a"), (None, texts[1], "en", "a"), (None, texts[2] + " " + item, "en", "b"), (5, texts[3], None, None), (5, texts[3], None, None), (5, texts[4] + "\n" + item, "en", "b")]
    rows += [(6, None, "en", "b"), (7, "", "en", "b"), (8, " \n\t", "en", None), (9, (texts[5] + "\n") * 300, "en", "a"), (10, texts[6], "en", "a"), (11, texts[6], "en", "b"), (12, "one", "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.selectExpr("*", "'x' AS size", "1 AS band", "2 AS score", "'k' AS key", "'t' AS target", "3 AS shard").repartition(5)
    seen = []
    for name, stage in p.STAGES:
        docs = cut(stage(spark, docs, SF), "odd")
        seen.append(sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str))
        assert name == p.STAGES[-1][0] or docs.columns == list(p.COLUMNS)
    quality, near, clean, mixed, placed = seen
    assert (big, texts[0]) in quality and (None, texts[1]) in quality and quality.count((5, texts[3])) == 2
    assert (10, texts[6]) in near and (11, texts[6]) not in near and (big, texts[0]) in near and (None, texts[1]) in near
    assert sum(i == 5 for i, _ in near) == 1
    assert (None, texts[1]) in clean and not any(item in (t or "") for _, t in clean) and (9, (texts[5] + "\n") * 300) in clean
    taken = {i for i, _ in mixed}
    assert taken <= {i for i, t in clean if (t or "").strip()} and (big in taken or None in taken)
    assert mixed == placed and docs.where("shard is null or shard < 0 or shard > 7").count() == 0


def test_an_empty_table_stays_empty(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0
