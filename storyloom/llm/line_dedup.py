"""Near-duplicate lines by a segment-partition edit join, in column expressions only.

The edits allowed between two lines grow with the shorter one, by :data:`BANDS`: none below 8 characters, 1 from 8, 2 from
24 and 3 from 72 on. Within k edits, two lines share one of the k + 1 segments of the shorter unchanged, shifted by no more
than the edits before and after it allow. Each line's segments are indexed under a hash of their text, number and the
line's length; each line probes the substrings of its own at those shifts, for its own length and the shorter ones that it
may link with. Where many lines meet, what is left of them without the shared segment is split and probed in the same way:
a common beginning does not bring lines together unless they share a part of the rest too. Pairs that meet in the end are
held against a bound on their character pairs, and verified by Spark's edit distance with a threshold, where they meet.

Equal lines are one class, so a common line is searched once. Lines are trimmed; blank lines belong to no class.

Defined cases: null and empty texts have no lines; repeated rows of a document give equal rows, the first of equal
lines being the one of least (doc_id, line_no); a null doc_id sorts first; other columns are ignored, whatever their
names; an empty table gives an empty result. Lines are compared whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut
from .bounded import BROADCAST_BYTES, KEY_BYTES, bounded_ids

#: (characters, edits): lines of at least so many characters may differ by so many edits.
BANDS = ((8, 1), (24, 2), (72, 3))
#: Buckets of more rows than this are split again, and how often; no pair is lost by it or without it.
HOT, LEVELS = 256, 1
#: What lines are trimmed of.
BLANK = " \t\n\x0b\x0c\r"


def edits_of(n: Column, bands=BANDS) -> Column:
    """The edits allowed for a shorter line of ``n`` characters."""
    out = F.lit(0)
    for least, edits in bands:
        out = F.when(n >= least, F.lit(edits)).otherwise(out)
    return out


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, key) of the lines that are not blank; line numbers count from 0."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    parts = parts.withColumn("line", F.btrim("line", F.lit(BLANK))).where("line <> ''")
    return parts.withColumn("key", F.unhex(F.md5("line")))


def _banded(bands=BANDS) -> list[tuple[int, int, int]]:
    """(least, edits, below) of each band."""
    return [(least, edits, bands[k + 1][0] if k + 1 < len(bands) else 2**31 - 1) for k, (least, edits) in enumerate(bands)]


def _places(edits: int, gap: int | None) -> list[tuple[int, int, int]]:
    """(i, shift, c) of the index rows (no gap) or of the probes of a line longer by ``gap``: segment, shift, and a number
    that holds both, -i for an index row."""
    if gap is None:
        return [(i, 0, -i) for i in range(1, edits + 2)]
    out = []
    for i in range(1, edits + 2):
        low, high = max(-(i - 1), gap - (edits + 1 - i)), min(i - 1, gap + (edits + 1 - i))
        out += [(i, s, (gap * 16 + i) * 16 + s + 8) for s in range(low, high + 1)]
    return out


def _table(rows: list[tuple[int, ...]], names: tuple[str, ...]) -> Column:
    """Rows of numbers as a constant array of structs."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows])


def _part(line: Column, m: Column, k: Column, i: Column, shift: Column) -> Column:
    """Segment ``i`` of ``k`` of a line of ``m`` characters, taken from ``line`` at a shift."""
    start = F.floor(m * (i - 1) / k).cast("int")
    return F.substring(line, start + 1 + shift, F.floor(m * i / k).cast("int") - start)


def search_rows(lines: DataFrame, bands=BANDS) -> DataFrame:
    """(id, h, c): the index rows (c < 0) and probes (c > 0) of lines (id, line)."""
    names = ("least", "below", "k", "gap", "i", "shift", "c")
    rows = [(least, below, edits + 1, gap or 0, *place) for least, edits, below in _banded(bands) for gap in (None, *range(edits + 1)) for place in _places(edits, gap)]
    last = [r for r in rows if r[2] == bands[-1][1] + 1]
    n = F.length("line")
    plan = F.when(n >= sum(bands[-1]), _table(last, names)).otherwise(_table(rows, names))
    each = lines.select("id", "line", n.alias("n")).select("id", "line", "n", F.explode(plan).alias("p")).select("id", "line", "p.*", (F.col("n") - F.col("p.gap")).alias("m"))
    part = _part(F.col("line"), F.col("m"), F.col("k"), F.col("i"), F.col("shift"))
    return each.where((F.col("m") >= F.col("least")) & (F.col("m") < F.col("below"))).select("id", F.xxhash64(part, "i", "m").alias("h"), "c")


def met(rows: DataFrame) -> DataFrame:
    """The rows (h, id, c, ...) whose bucket holds an index row and another line, with the bucket's ``rows``; of equal rows
    one."""
    by = Window.partitionBy("h")
    wide = rows.withColumn("__lo", F.min("id").over(by)).withColumn("__hi", F.max("id").over(by)).withColumn("__c", F.min("c").over(by)).withColumn("rows", F.count(F.lit(1)).over(by))
    return wide.where("__lo <> __hi and __c < 0").drop("__lo", "__hi", "__c").distinct()


def split_again(live: DataFrame, texts: DataFrame, bands=BANDS) -> DataFrame:
    """Rows (id, n, rest, h, c) of what is left of each line (``rest``) without the part by which it came into its bucket,
    split and probed in turn within the bucket. ``live`` has (h, id, c) in the first round, and later ``rest`` and ``n``
    too, n being the length of the shorter line as it was, which sets the edits."""
    c, seg = F.col("c"), F.col("c") < 0
    if "rest" in live.columns:
        rows = live.withColumnRenamed("rest", "line")
    else:
        rows = live.join(texts.select("id", "line"), "id").withColumn("n", F.lit(None).cast("int"))
    rows = rows.select(
        "h", "id", "line", "n", seg.alias("seg"), F.when(seg, 0).otherwise(F.shiftright("c", 8)).alias("gap"),
        F.when(seg, -c).otherwise(F.shiftright("c", 4).bitwiseAND(F.lit(15))).alias("i"), F.when(seg, 0).otherwise(c.bitwiseAND(F.lit(15)) - 8).alias("shift"),
    )
    rows = rows.withColumn("m", F.length("line") - F.col("gap")).withColumn("n", F.coalesce("n", "m")).withColumn("k", edits_of(F.col("n"), bands) + 1)
    start = F.floor(F.col("m") * (F.col("i") - 1) / F.col("k")).cast("int")
    size = F.floor(F.col("m") * F.col("i") / F.col("k")).cast("int") - start
    at = start + F.col("shift")
    rest = F.concat(F.substring(F.col("line"), F.lit(1), at), F.substring(F.col("line"), at + size + 1, F.length("line")))
    plans = [_table(_places(edits, gap), ("i", "shift", "c")) for _, edits, _ in _banded(bands) for gap in (None, *range(edits + 1))]
    first = F.lit(0)
    for k, (_, edits) in enumerate(bands):
        first = F.when(F.col("k") == edits + 1, F.lit(sum(e + 2 for _, e in bands[:k]))).otherwise(first)
    plan = F.get(F.array(*plans), first + F.when(F.col("seg"), 0).otherwise(F.col("gap") + 1))
    each = rows.select("h", "id", "n", "gap", "k", rest.alias("rest"), plan.alias("plan")).select("h", "id", "n", "gap", "k", "rest", F.explode("plan").alias("p"))
    m = F.length("rest") - F.col("gap")
    return each.select("id", "n", "rest", F.xxhash64("h", _part(F.col("rest"), m, F.col("k"), F.col("p.i"), F.col("p.shift")), "p.i", m).alias("h"), F.col("p.c").alias("c"))


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once; in a function of an array it would be for each element."""
    return F.transform(F.array(value), use)[0]


def pair_sketch(line: Column) -> Column:
    """64 parities of hashed neighbouring characters; an edit changes four at most."""

    def walk(chars: Column) -> Column:
        def flip(acc: Column, i: Column) -> Column:
            bit = F.pmod(F.xxhash64(F.get(chars, i - 1), F.get(chars, i)), F.lit(64)).cast("int")
            return acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(chars) - 1, F.lit(1))), F.lit(0).cast("bigint"), flip)

    return _let(F.split(line, ""), walk)


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of ``a`` and ``b`` where it is at most ``edits``, else a greater number."""
    found = F.levenshtein(a, b, edits)
    return F.when(found < 0, edits + 1).otherwise(found)


def _firsts(lines: DataFrame, known: DataFrame) -> DataFrame:
    """One row of each line: those that occur once, and the first of the others (``known``)."""
    few = F.broadcast(known) if known.count() * KEY_BYTES <= BROADCAST_BYTES else known
    joined = lines.join(few, "key", "left")
    return joined.where(F.col("first").isNull() | (F.col("first") == F.struct("doc_id", "line_no"))).select("key", "line")


def _near(s: str, p: str, bands) -> Column:
    """Whether the lines of two rows (sig, n, line) are within the edits; sketches that are too far apart spare the distance."""
    shorter, gap = F.least(f"{s}.n", f"{p}.n"), F.abs(F.col(f"{s}.n") - F.col(f"{p}.n"))
    near = F.lit(False)
    for least, edits, below in _banded(bands):
        within = (gap <= edits) & (F.bit_count(F.col(f"{s}.sig").bitwiseXOR(F.col(f"{p}.sig"))) <= 4 * edits)
        within = within & (banded_distance(F.col(f"{s}.line"), F.col(f"{p}.line"), edits) <= edits)
        near = F.when((shorter >= least) & (shorter < below), within).otherwise(near)
    return near


def _links(live: DataFrame, texts: DataFrame, bands, once: bool) -> DataFrame:
    """(a, b), a < b: the keys of lines (id, key, sig, n, line) that meet as index row and probe in a bucket and are within
    the edits; they are judged where they meet, so that other pairs are neither shuffled nor written.

    With ``once`` a pair is judged in the least of the buckets that it meets in only; for that each row carries its line's
    buckets, which is worth it where many lines meet again and again."""
    rows = live.select("h", "id", (F.col("c") < 0).alias("seg")).distinct()
    ends = rows.join(texts, "id")
    if once:
        ends = ends.join(rows.groupBy("id", "seg").agg(F.collect_set("h").alias("all")), ["id", "seg"])
    s, p = ends.where("seg").alias("s"), ends.where("not seg").alias("p")
    meet = (F.col("s.h") == F.col("p.h")) & (F.col("s.id") != F.col("p.id")) & ((F.col("s.n") < F.col("p.n")) | (F.col("s.id") < F.col("p.id")))
    if once:
        meet = meet & (F.array_min(F.array_intersect("s.all", "p.all")) == F.col("s.h"))
    return s.join(p, meet & _near("s", "p", bands)).select(F.least("s.key", "p.key").alias("a"), F.greatest("s.key", "p.key").alias("b"))


def near_lines(docs: DataFrame, bands=BANDS) -> DataFrame:
    """(doc_id, line_no, n_chars, class_doc, class_line, n_links, kept) of every line that is not blank.

    The class is named by its first line; ``n_links`` counts the other texts within the edits; a line is kept if it is the
    first of its class.
    """
    return _named_lines(docs, bands).drop("key")


def _named_lines(docs: DataFrame, bands) -> DataFrame:
    lines = lines_of(docs)
    light = cut(lines.select("doc_id", "line_no", "key", F.length("line").alias("n_chars")), "lines")
    place = F.struct("doc_id", "line_no")
    known = cut(light.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"), "known")
    single = _firsts(lines, known).where(F.length("line") >= bands[0][0])
    live = cut(met(search_rows(single.select(F.xxhash64("line").alias("id"), "line"), bands)), "live")
    ids = bounded_ids(live.select("id").distinct())
    again = _firsts(lines, known).withColumn("id", F.xxhash64("line")).join(ids, "id", "left_semi")
    texts = cut(again.select("id", "key", "line", pair_sketch(F.col("line")).alias("sig")).dropDuplicates(["key"]), "texts")
    judged = texts.select("id", "key", "sig", F.length("line").alias("n"), "line")
    found = None
    for level in range(LEVELS + 1):
        hot = live.where(F.col("rows") > HOT) if level < LEVELS else live.limit(0)
        calm = live.where(F.col("rows") <= HOT) if level < LEVELS else live
        own = _links(calm, judged, bands, once=level > 0)
        found = own if found is None else found.union(own)
        if level == LEVELS or hot.isEmpty():
            break
        live = cut(met(split_again(hot, texts, bands)), "split")
    links = cut(found.distinct(), "links")
    return _classes(light, known, links)


def _classes(light: DataFrame, known: DataFrame, links: DataFrame) -> DataFrame:
    place = F.struct("doc_id", "line_no")
    comp = cut(connected_components(links), "components")
    counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    firsts = light.join(comp, F.col("key") == F.col("node")).groupBy("component").agg(F.min(place).alias("first"))
    linked = comp.join(firsts, "component").join(counts, "node").select(F.col("node").alias("key"), "first", "n_links")
    linked = cut(linked, "linked")
    alone = known.join(linked, "key", "left_anti").select("key", "first", F.lit(0).cast("long").alias("n_links"))
    state = cut(linked.union(alone), "classes")
    named = light.join(state, "key", "left").withColumn("c", F.coalesce("first", place))
    return named.select(
        "key", "doc_id", "line_no", "n_chars", F.col("c.doc_id").alias("class_doc"), F.col("c.line_no").alias("class_line"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("line_no") == F.col("c.line_no"))).alias("kept"),
    )


def without_near_lines(docs: DataFrame, bands=BANDS) -> DataFrame:
    """(doc_id, text): each document's text with its blank lines and the first line of each class. Rows that repeat both
    id and text come back once, those with other texts each; a text of which no line is left is empty, null stays null."""
    rows = docs.select("doc_id", "text").distinct().withColumn("whole", F.unhex(F.md5("text")))
    kept = _named_lines(docs, bands).where("kept").select(F.col("doc_id").alias("d"), F.col("line_no").alias("l"), F.col("key").alias("k")).distinct()
    lines = rows.select("doc_id", "whole", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("bare", F.btrim("line", F.lit(BLANK)))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line_no") == F.col("l")) & (F.unhex(F.md5("bare")) == F.col("k"))
    good = lines.join(kept, same, "left").where((F.col("bare") == "") | F.col("k").isNotNull())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    left = good.groupBy(F.col("doc_id").alias("d"), F.col("whole").alias("w")).agg(text.alias("left"))
    named = rows.join(left, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("whole") == F.col("w")), "left")
    return named.select("doc_id", F.when(F.col("text").isNotNull(), F.coalesce("left", F.lit(""))).alias("text"))
