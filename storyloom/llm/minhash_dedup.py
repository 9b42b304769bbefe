"""MinHash near-dedup: fast similarity sketches, banding, and exact verification on whole shingle sets.

Documents with the same word sequence are one class, so copies never meet each other. In a bucket of classes that agree
in a band, each is compared with the bucket's leader, not with all others; where that leaves more than one component in
a bucket, others of it lead in turn. What is left in buckets of several components in the end meets by prefixes: sets of
the wanted similarity have one of their rarest shingles in common, and of the documents that share it only those outside
the largest component look for others. So components are those of all pairs that share a band, though hardly any pairs are
made, and neither a hot band nor a large group is compared with itself.

With 128 coordinates in 32 bands of 4, a pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^32, 5e-8.

Defined cases: null and empty texts, and texts of white space, have no shingles and link with nothing, themselves
included; a row with a null doc_id links with nothing; repeated rows of a doc_id give equal rows; other columns are
ignored, whatever their names; an empty table gives an empty result; texts are read whole, however long. Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components, respread
from ..session import bound_batches, cut, forget
from .bounded import bounded_ids
from .shingles import PARITIES, full_sets, sketched

COORDINATES, ROWS = 128, 4
#: Rounds with leaders before the rest meets by prefixes.
LEADER_ROUNDS = 3


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    common, sizes = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    joined = pairs.join(right, "b").join(left, "a")
    return cut(joined.where(100 * common >= percent * (sizes - common)).drop("sa", "sb"), "links")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = cut(sketched(docs, width, COORDINATES, ROWS), "sketches")
    linkable = seen.where("n_shingles > 0 and doc_id is not null")
    firsts = linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"))
    copies = cut(firsts.where("copies > 1").select("k1", "k2", "rep"), "copies")
    member = linkable.select("doc_id", "k1", "k2").join(copies, ["k1", "k2"]).where("doc_id <> rep").select("doc_id", "rep").distinct()
    member = cut(member, "members")
    classes = linkable.join(member, "doc_id", "left_anti").select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    pairs_of_bucket = cut(_shared(classes), "buckets")
    links = _link(docs, pairs_of_bucket, width, percent)
    edges = links.union(member.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    comp = connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    comp = cut(comp, "components")
    out = seen.select("doc_id", "n_shingles").join(comp, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _shared(classes: DataFrame) -> DataFrame:
    """The (band, doc_id, n_shingles) of buckets with at least two classes."""
    many = classes.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    return classes.join(respread(many), "band").select("band", "doc_id", "n_shingles").distinct()


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(doc_id, u): how many of a document's shingles no other document of ``sets`` has; documents with none are left
    out. Counts are combined before the shuffle, so that a very common shingle is no burden."""
    shared = sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    return shared.where("n = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("u"))


def _prefix_pairs(sets: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """Pairs x, y (structs doc_id, n, u, c) of the documents ``left`` (doc_id, n, u, c) that lie in different components,
    share one of the rarest shingles of both, and may be similar enough.

    A pair is told where it meets, by what its rows carry: by its own shingles and parities, and by the place of the
    shingle among those of either, ordered by rarity: at the first one that a pair shares, what either has behind it bounds
    the overlap. So a shingle that many share makes rows for the likely pairs only.
    """
    each = sets.join(left, "doc_id").select("doc_id", "n", F.explode("shingles").alias("s"))
    common = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "s"))
    # shingles of one document come first in the order; as they meet nothing, their number is taken off the prefix
    shared = each.join(respread(common), "s").withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).withColumn("r", rank + F.col("n") - F.col("m"))
    prefix = shared.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("s", "doc_id", "r")
    told = left.join(sets.select("doc_id", "parity"), "doc_id")
    prefix = cut(prefix.join(told, "doc_id").select("s", "c", F.struct("doc_id", "n", "u", "c", "r", "parity").alias("v")), "prefixes")
    sizes = prefix.groupBy("s", "c").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("s").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.count(F.lit(1)).alias("several")).where("several > 1").select("s", "most")
    held = prefix.join(respread(largest), "s")
    y = held.select("s", F.col("v").alias("y"), (F.col("c") == F.col("most")).alias("large"))
    x = held.where("c <> most").select("s", F.col("v").alias("x"))
    odd = sum((F.bit_count(F.col("x.parity")[i].bitwiseXOR(F.col("y.parity")[i])) for i in range(PARITIES // 64)), F.lit(0))
    near = (100 + percent) * odd <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
    behind = F.least(F.col("x.n") - F.col("x.r"), F.col("y.n") - F.col("y.r")) + 1
    once = F.col("large") | (F.col("x.doc_id") < F.col("y.doc_id"))
    met = x.join(y, "s").where(once & _fits(percent) & _enough(behind, percent) & near)
    return met.select(*[F.struct(*[F.col(f"{v}.{k}") for k in ("doc_id", "n", "u", "c")]).alias(v) for v in ("x", "y")])


def _enough(common: Column, percent: int) -> Column:
    """Whether x and y can be similar enough with so many common shingles."""
    return 100 * common >= percent * (F.col("x.n") + F.col("y.n") - common)


def _fits(percent: int) -> Column:
    """Whether x and y, of different components, can be similar enough by what none of the others has."""
    return _enough(F.least(F.col("x.n") - F.col("x.u"), F.col("y.n") - F.col("y.u")), percent) & (F.col("x.c") != F.col("y.c"))


def _link(docs: DataFrame, buckets: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that hold together all that links over shared buckets would.

    A document's own shingles, which none of the others has, bound its overlap with any of them. The document with the
    least share of these is the likeliest original of a bucket, so it leads; and pairs whose bound stays below the
    threshold need no comparison. Nor do those whose parities differ in too many places: each is a shingle that one of
    the two lacks.
    """
    ids = bounded_ids(buckets.select("doc_id").distinct())
    sets = cut(full_sets(docs.join(ids, "doc_id", "left_semi"), width).dropDuplicates(["doc_id"]), "sets")
    own = bounded_ids(_own_shingles(sets))
    live = buckets.join(own, "doc_id", "left").select(
        "band", "doc_id", F.col("n_shingles").alias("n"), F.coalesce("u", F.lit(0)).alias("u"), F.col("doc_id").alias("c"), F.lit(False).alias("led")
    )
    links = tested = None
    for step in range(LEADER_ROUNDS + 1):
        if step < LEADER_ROUNDS:
            rank = F.struct((F.col("u") / F.col("n")).alias("r"), F.xxhash64("doc_id").alias("h"), "doc_id", "n", "u", "c")
            x = respread(live.where(~F.col("led")).groupBy("band").agg(F.min(rank).alias("l"))).select("band", "l.*")
            pairs = live.alias("y").join(x.alias("x"), "band").where(_fits(percent))
        else:
            left = cut(live.select("doc_id", "n", "u", "c").distinct(), "left")
            pairs = _prefix_pairs(sets, left, percent)
        end = [f(F.col(f"x.{k}"), F.col(f"y.{k}")).alias(n) for n, f, k in (("a", F.least, "doc_id"), ("b", F.greatest, "doc_id"), ("ca", F.least, "c"), ("cb", F.greatest, "c"))]
        pairs = pairs.select(*end).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = _verified(sets, pairs, percent)
        links = found.select("a", "b") if links is None else links.union(found.select("a", "b"))
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        if step == LEADER_ROUNDS:
            break
        comp = cut(connected_components(found, "ca", "cb"), "components")
        named = live.join(comp, F.col("c") == F.col("node"), "left").withColumn("c", F.coalesce("component", "c")).drop("node", "component")
        named = named.join(x.select("band", F.col("doc_id").alias("l")), "band", "left")
        state = named.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max(F.when(F.col("doc_id") == F.col("l"), F.col("c"))).alias("lc"))
        state = respread(state.where("c0 <> c1").select("band", "lc"))
        led = F.col("led") | F.coalesce(F.col("c") == F.col("lc"), F.lit(False))
        live = cut(named.join(state, "band").select("band", "doc_id", "n", "u", "c", led.alias("led")), "buckets")
        if live.isEmpty():
            break
    forget(sets)
    return links


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each component, that with the least doc_id; rows that repeat a doc_id are one."""
    found = cut(near_components(docs, width, percent), "found")
    twice = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    gone = bounded_ids(found.where("not kept").select("doc_id").union(twice).distinct())
    again = bounded_ids(found.where("kept").join(twice, "doc_id", "left_semi").select("doc_id").distinct())
    once = docs.join(gone, "doc_id", "left_anti")
    return once.union(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*once.columns))
