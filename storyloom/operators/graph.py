"""Connected components of edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, forget, tasks

MAX_ROUNDS = 60
#: Most bytes of a list of nodes that is broadcast, at so many for a node; beyond that it is joined by a shuffle.
BROADCAST_BYTES, NODE_BYTES = 32 << 20, 16
#: Where no more nodes than this keep components open, a round costs less than setting stars aside.
FEW_LOOSE = 1 << 16


def respread(df: DataFrame) -> DataFrame:
    """Deal an aggregate's rows out anew, so that a join on its key gets an exchange on either side, which adaptive
    execution can split where one key holds many rows."""
    return df.repartition(tasks(df.sparkSession))


def _to_least(edges: DataFrame) -> DataFrame:
    """Large star: every node's larger neighbours are tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(respread(least), "a").select(F.col("b").alias("x"), F.col("m").alias("y"))


def _chain(edges: DataFrame) -> DataFrame:
    """Small star: every node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(respread(least), "u").where("v <> m").select(F.col("v").alias("b"), F.col("m").alias("a"))
    return tied.union(least.select(F.col("u").alias("b"), F.col("m").alias("a"))).distinct()


def _split_stars(edges: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """(done, open, loose): the edges of components that are stars around their least node, those of all others, if any, and
    how many nodes keep these from being stars. A star's center has no edge below it, and its other nodes have that one edge."""
    ends = edges.select(F.col("b").alias("n"), F.lit(1).alias("k")).union(edges.select(F.col("a").alias("n"), F.lit(0).alias("k")))
    loose = cut(ends.groupBy("n").agg(F.sum("k").alias("below"), F.min("k").alias("least")).where("below > 1 or (below > 0 and least = 0)").select("n"), "loose")
    many = loose.count()
    if not many:
        return edges, None, 0
    told = F.broadcast(loose) if many * NODE_BYTES <= BROADCAST_BYTES else loose
    inner = edges.join(told, F.col("b") == F.col("n"), "left_semi").select(F.col("a").alias("n")).union(loose).distinct()
    inner = cut(inner.withColumn("open", F.lit(True)), "inner")
    told = F.broadcast(inner) if inner.count() * NODE_BYTES <= BROADCAST_BYTES else inner
    flagged = cut(edges.join(told, F.col("a") == F.col("n"), "left").select("a", "b", F.coalesce("open", F.lit(False)).alias("open")), "flagged")
    done = cut(flagged.where("not open").select("a", "b"), "stars")
    for spent in (loose, inner):
        forget(spent)
    return done, flagged.where("open").select("a", "b"), many


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component being the least node that it reaches.

    Alternates two star contractions until the edges are stars around their least nodes; each round works on a table in
    the shared folder, and minima are combined before the shuffle, so that neither a node with many edges nor a large
    component meets in one task. Components that are stars are set aside, so that later rounds work on what is still open.
    Edges with a null end, and loops, tie nothing.
    """
    now = cut(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col("a") < F.col("b")).distinct(), "edges")
    stars, many = None, FEW_LOOSE + 1
    for _ in range(MAX_ROUNDS):
        left = now
        if many > FEW_LOOSE:
            done, left, many = _split_stars(now)
            stars = done if stars is None else stars.union(done)
        elif _stars(now):
            stars, left = stars.union(now), None
        if left is None:
            break
        new = cut(_chain(_to_least(left)).select("a", "b"), "edges")
        forget(now)
        if left is not now:
            forget(left)
        now = new
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge, and none of its own below it: the edges are then stars."""
    ends = edges.select(F.col("b").alias("n"), F.lit(1).alias("k")).union(edges.select(F.col("a").alias("n"), F.lit(0).alias("k")).distinct())
    return ends.groupBy("n").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()
