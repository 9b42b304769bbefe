"""Time-varying curriculum: sources are mixed to the integrals of their weight schedules.

A schedule gives each source's weight at knots of training time 0 to 1, linear between them. The integral is the
source's share; what a source may give is capped, and the excess goes to the others by weight. A document's running
place in its source's demand is inverted through the schedule's running integral: that is its training position, by
which documents are range-sorted.

A source that a schedule does not name has weight 0, and so target 0; its documents stay in the report with nothing taken.
Other columns are kept by :func:`mix_documents`, whatever their names, but for ``epoch``, ``words`` and ``position``, which
are the operator's own; :func:`mix_report` leaves them out. Texts are counted whole, however long.

Defined cases: a null text has size 0 and takes no words; a null source is a source of its own, ordered last; sources
without words have target 0; empty tables give empty results; repeated rows are documents of their own. The document at
the edge of a source's budget is taken in part, so that each source meets its target within a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import running_before
from ..session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, repeating; their share of all words; most times a word is taken.
WEIGHTS, SHARE, TIMES = (3, 1, 2), 1.5, 2.0
#: The production schedule: each source's weight at the start, the middle and the end, as a multiple of its mean
#: weight. The first kind fades out, the second rises, the third peaks in the middle; each has a mean of 1.
SHAPES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (0.5, 1.5, 0.5))
KNOTS = (0.0, 0.5, 1.0)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def standard_schedule(sources: DataFrame) -> DataFrame:
    """(source, t, weight) of the production curriculum for a table of (source)."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    kind = F.pmod(F.col("__rank"), F.lit(3)).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), kind + 1)
    shapes = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s")) for t, s in zip(KNOTS, shape, strict=True)]) for shape in SHAPES])
    return (
        sources.withColumn("__rank", rank)
        .select("source", weight.alias("__w"), F.explode(F.element_at(shapes, kind + 1)).alias("__k"))
        .select("source", F.col("__k.t").alias("t"), (F.col("__w") * F.col("__k.s")).alias("weight"))
    )


def integrate(schedule: DataFrame) -> DataFrame:
    """One row for each stretch between knots: t0, t1, w0, slope, the integral before it (``before``) and in it, and in
    all (``mass``). A null source is kept."""
    by = Window.partitionBy(F.col("source").isNull(), "source").orderBy("t")
    ends = schedule.select("source", F.col("t").alias("t0"), F.col("weight").alias("w0"), F.lead("t").over(by).alias("t1"), F.lead("weight").over(by).alias("w1"))
    area = (F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t0"))
    run = Window.partitionBy(F.col("source").isNull(), "source").orderBy("t0")
    whole = Window.partitionBy(F.col("source").isNull(), "source")
    return (
        ends.where(F.col("t1") > F.col("t0"))
        .withColumn("area", area)
        .withColumn("before", F.coalesce(F.sum("area").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("mass", F.sum("area").over(whole))
    )


def targets(sizes: DataFrame, share: float = SHARE, times: float = TIMES) -> DataFrame:
    """Targets of a table (source, source_size, weight): the share of all words, split by weight, each at most ``times``
    its source's size, the excess going to the others by weight.

    With sources ordered by cap over weight, those below the level at which the rest is shared are the capped ones, so
    one pass of running sums finds what repeated resharing would. One row per source, so one task holds it.
    """
    cap = F.col("source_size") * F.lit(times)
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    whole = sizes.select("source", "source_size", "weight", (F.sum("source_size").over(every) * F.lit(share)).alias("__total"))
    levels = (
        whole.where("weight > 0")
        .withColumn("__cap", cap)
        .withColumn("__left", F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        .withColumn("__weights", F.sum("weight").over(onward))
        .withColumn("__full", F.col("__cap") * F.col("__weights") <= F.col("__left") * F.col("weight"))
    )
    free = F.struct("__left", "__weights")
    level = (
        levels.withColumn("__n", F.row_number().over(order))
        .withColumn("__free", F.min(F.when(~F.col("__full"), F.struct("__n", free.alias("v")))).over(every))
    )
    target = F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("__free.v.__left") * F.col("weight") / F.col("__free.v.__weights"))
    weighed = level.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))
    return weighed.union(whole.where("not weight > 0").select("source", "source_size", "weight", F.lit(0.0).alias("target")))


def _position(place: Column) -> Column:
    """The time at which the running integral over the stretch's columns reaches ``place`` (same unit as ``mass``)."""
    rest = F.greatest(place - F.col("before"), F.lit(0.0))
    slope = (F.col("w1") - F.col("w0")) / (F.col("t1") - F.col("t0"))
    root = F.sqrt(F.greatest(F.col("w0") * F.col("w0") + 2 * slope * rest, F.lit(0.0)))
    # 2r / (w + sqrt(w^2 + 2ar)) solves a/2 x^2 + w x = r without cancelling, also for a slope of 0
    return F.least(F.col("t0") + F.when(rest > 0, 2 * rest / (F.col("w0") + root)).otherwise(F.lit(0.0)), F.col("t1"))


def _sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, __key), with the hash that orders a source's documents."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), key.alias("__key"))


def _plan(rows: DataFrame, light: DataFrame, schedule: DataFrame | None, share: float, times: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``source_size``, ``target``, ``taken`` (words, repeats counted) and ``__before`` (words of the source
    before it, in the order of the hashed id), and the schedule. ``light``, a written table, has the same documents without
    their texts; all sums are made from it."""
    by_source = cut(light.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    schedule = standard_schedule(by_source.select("source")) if schedule is None else schedule.select("source", "t", "weight")
    mass = integrate(schedule).groupBy("source").agg(F.max("mass").alias("weight"))
    weighed = by_source.alias("a").join(mass.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    goal = targets(weighed, share, times).select(F.col("source").alias("__source"), "source_size", "target")
    placed = running_before(rows, "source", "__key", "size", ["doc_id", "size"], light.count(), "__before", light=light)
    joined = placed.join(goal, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "__key")
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    rest = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    extra = F.greatest(F.least(rest - F.col("__before"), F.col("size")), F.lit(0))
    return joined.withColumn("taken", (whole * F.col("size") + extra).cast("long")), schedule


def first_positions(planned: DataFrame, schedule: DataFrame, epoch: Column) -> DataFrame:
    """Add ``position``: the training time of the document's copy number ``epoch`` (0, 1, ...); null without a schedule."""
    stretch = integrate(schedule).withColumnRenamed("source", "__s")
    share = F.when(F.col("target") > 0, (epoch * F.col("source_size") + F.col("__before")) / F.col("target")).otherwise(F.lit(0.0))
    place = F.least(share, F.lit(1.0)) * F.col("mass")
    last = F.col("before") + F.col("area") >= F.col("mass")
    inside = (place >= F.col("before")) & ((place < F.col("before") + F.col("area")) | last)
    return (
        planned.join(stretch, F.col("source").eqNullSafe(F.col("__s")) & inside, "left")
        .withColumn("position", _position(place))
        .drop("__s", "t0", "w0", "t1", "w1", "area", "before", "mass")
    )


def mix_documents(docs: DataFrame, schedule: DataFrame | None = None, share: float = SHARE, times: float = TIMES) -> DataFrame:
    """The training stream: a row for each taken copy, range-sorted by position, with ``epoch``, ``words`` (those taken
    of this copy) and ``position``. The text of a copy that is taken in part ends at its last taken word."""
    light = cut(_sized(docs), "sizes")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("__key"))
    planned, schedule = _plan(packed, light, schedule, share, times)
    planned = planned.where(F.col("taken") > 0)
    copies = F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int"))
    rows = planned.withColumn("epoch", F.explode(copies)).withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    text = F.col("__row").getField("text")
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    blank = F.rlike(text, F.lit(r"^[\x20\x09-\x0D]")).cast("int")
    short = F.regexp_replace(F.array_join(F.slice(parts, 1, (F.col("words") + blank).cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    rows = rows.withColumn("__text", F.when(F.col("words") < F.col("size"), short).otherwise(text))
    order = ["position", "source", "doc_id", "epoch"]
    placed = first_positions(rows, schedule, F.col("epoch")).repartitionByRange(*order).sortWithinPartitions(*order)
    own = ("epoch", "words", "position")
    return placed.select(*[(F.col("__text") if c == "text" else F.col("__row").getField(c)).alias(c) for c in docs.columns if c not in own], *own)


def mix_report(docs: DataFrame, schedule: DataFrame | None = None, share: float = SHARE, times: float = TIMES) -> DataFrame:
    """Every document with its size, its source's size and target, the words taken and the position of its first copy
    (null if none is taken)."""
    light = cut(_sized(docs), "sizes")
    planned, schedule = _plan(light, light, schedule, share, times)
    placed = first_positions(planned, schedule, F.lit(0))
    return placed.select("doc_id", "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, F.col("position")).alias("position"))
