"""Training-corpus pipeline: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir), with docs of the columns of ``documents``, and return a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``; others that docs
may have, whatever their names, are dropped by the first stage.

Defined cases: rows with a null doc_id are judged by quality and decontamination like any other, link with nothing in
near-dedup, and are mixed and sharded under the key of an empty id. Null and empty texts, and texts of white space, pass the
first three stages as their scores allow and are never taken by the mix, which has no word of them to give. Rows that
repeat a doc_id are judged each by its own text; near-dedup keeps one of them. Ties fall to the least doc_id. Texts are
read whole, however long. An empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import decontaminate, minhash_dedup, mixing, quality, sharding
from storyloom.session import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = 8
#: Five-word shingles at a similarity of 0.8.
WIDTH, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking rejects go: those below a low quantile of the scores of preferred rows."""
    docs = docs.select(*COLUMNS)
    featured = cut(quality.features(docs), "features")
    ranking = quality.train(featured, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, quality.score_documents(featured, ranking), ranking.threshold)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id; of rows that repeat a doc_id, one."""
    return minhash_dedup.keep_one(docs, WIDTH, PERCENT).select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a document is repeated as often as it is taken, and ends where its source's budget
    does."""
    mixed = mixing.mix_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, by the key law."""
    return sharding.with_shard(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("curriculum mixing", mixing_stage),
    ("hash-tree sharding", sharding_stage),
]

#: Scores, sketches and edit distances have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
