"""Collocated phrases of two to four words, counted by stripes.

A stripe is a prefix (no word, or one to three) with an associative counter of the words that follow it. Tasks count the
stripes of their own texts, a few megabytes at a time; stripes are shuffled by (lang, prefix) and merged element by element;
those of a hot prefix are dealt to :data:`BUCKETS` places by their next words. An entry of a merged
stripe is the count of a phrase: entries give the extensions, the entry of a phrase's own words in the stripe before gives
its total as a prefix, and the largest entry of its stripe, or of the entries that it ends, tells what subsumes it.

Every count that the result can depend on is at least :data:`LEAST`, and no phrase is more frequent than a part of it. So
stripes go by length in three readings of the texts: single words; pairs of frequent words; three and four words whose
every pair is frequent. Frequent parts are told by a filter of bounded size (Bloom's: it forgets none, and what it lets pass
in excess is counted and then found rare), so the counts are exact at every size.

One more word is enough to look for what subsumes a phrase: if a phrase of four words holds one of two, the three words
between hold the two as well and are at least as frequent as the four.

Defined cases: null texts count as empty, a null lang as ``und``, with which rows of that lang are counted. Rows that repeat
an id or a text count each; ids are not read. Very long texts are read whole. An empty table gives an empty result. Other
columns than text and lang are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches, cut
from .shingles import mix

LEAST, KEPT, MOST_WORDS = 30, 2000, 4
#: A phrase goes if a longer one has this share of its count.
SUBSUMED_PERCENT = 80
#: Factor of scores.
SCALE = 2_000_000
#: Places of a hot prefix's stripes, by their next words: the empty prefix, and one with this share of all words. There can be
#: no more than so many of these.
BUCKETS, HOT_SHARE = 16, 1000
#: Bytes of texts after which a task counts the stripes of what it has read; with batches of 8 MB, twice as many at most.
CHUNK = 4 << 20
#: Bits of a filter of frequent parts: about 12 a part, this many at most.
MOST_BITS = 1 << 27

U = np.uint64
#: A stripe's next words stand in one string, with spaces, which no word holds.
STRIPE = "lang string, prefix string, bucket int, words string, counts array<int>"
# Bytes that end a piece, and blanks between its words; lower case of A-Z.
KIND, LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER[ord("A") : ord("Z") + 1] += 32


def text_hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode())


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair from the hashes of its halves."""
    with np.errstate(over="ignore"):
        return mix(mix(a * U(0x9E3779B97F4A7C15)) + b)


class Filter:
    """A set of hashes that forgets none of them and may hold others too."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            step = mix(hashes) | U(1)
            return [(hashes + U(k) * step) & U(bits - 1) for k in range(3)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes, self.bits):
            found &= (self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)
        return found


def filter_of(parts: DataFrame) -> Filter:
    """A filter of rows (lang, prefix, word): single words where the prefix is empty, else pairs.

    Its words of 64 bits are made by the tasks and gathered: at most :data:`MOST_BITS` / 64 rows reach the driver.
    """
    bits = 1 << 10
    wanted = 12 * parts.count()
    while bits < min(wanted, MOST_BITS):
        bits <<= 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, prefix, word = (np.fromiter((text_hash(x) for x in batch.column(k).to_pylist()), U, batch.num_rows) for k in range(3))
            single = np.fromiter((x == "" for x in batch.column(1).to_pylist()), bool, batch.num_rows)
            hashes = np.where(single, joined(lang, word), joined(joined(lang, prefix), joined(lang, word)))
            at = np.unique(np.concatenate(Filter.places(hashes, bits)))
            mask = U(1) << (at & U(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> U(6)).astype(np.int64)), pa.array(mask.view(np.int64))], ["place", "mask"])

    rows = parts.select("lang", "prefix", "word").mapInArrow(run, "place bigint, mask bigint").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, U)
    words[rows["place"].to_numpy()] = rows["mask"].to_numpy().astype(np.int64).view(U)
    return Filter(bits, words)


class Coded:
    """The words of some texts as numbers, with the place where each word's piece goes on."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        langs = langs.dictionary_encode()
        self.langs = langs.dictionary
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], int(offsets[0])) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        kind = KIND[data]
        inside = kind == 0
        fresh = np.zeros(len(data) + 1, bool)  # a row begins here
        fresh[offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | fresh[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | fresh[1:-1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        lengths = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(lengths), pa.py_buffer(LOWER[data[inside]])).dictionary_encode()
        self.words, self.word = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
        cuts = fresh[:-1] | (kind == 2)
        self.piece = np.cumsum(cuts, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
        row = np.searchsorted(offsets, starts, side="right") - 1
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[row] if len(starts) else np.zeros(0, np.int32)

    def follows(self) -> np.ndarray:
        """Whether each word has another one behind it in its piece."""
        more = np.zeros(len(self.word), bool)
        more[:-1] = self.piece[1:] == self.piece[:-1]
        return more

    def hashes(self) -> np.ndarray:
        lang = np.fromiter((text_hash(x) for x in self.langs.to_pylist()), U, len(self.langs))
        word = np.fromiter((text_hash(x) for x in self.words.to_pylist()), U, len(self.words))
        return joined(lang[self.lang], word[self.word])

    def stripes(self, prefix: np.ndarray, shown: pa.Array, langs: np.ndarray, word: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        """Stripes of occurrences: the number of each one's prefix and next word; ``shown`` and ``langs`` say what a prefix
        is, ``hot`` whether its stripe is dealt to several places."""
        n = max(len(self.words), 1)
        keys, counts = np.unique(prefix.astype(np.int64) * n + word, return_counts=True)
        own, following = keys // n, keys % n
        used = np.unique(following)
        bucket = np.zeros(n, np.int64)
        bucket[used] = [zlib.crc32(x.encode()) % BUCKETS for x in self.words.take(pa.array(used)).to_pylist()]
        group = own * BUCKETS + bucket[following] * hot[own]
        order = np.argsort(group, kind="stable")
        group, following, counts = group[order], following[order], counts[order]
        firsts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        ends = pa.array(np.append(firsts, len(group)).astype(np.int32))
        which = group[firsts] // BUCKETS
        return pa.RecordBatch.from_arrays(
            [
                self.langs.take(pa.array(langs[which])), shown.take(pa.array(which)), pa.array((group[firsts] % BUCKETS).astype(np.int32)),
                pc.binary_join(pa.ListArray.from_arrays(ends, self.words.take(pa.array(following))), " "), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32))),
            ],
            ["lang", "prefix", "bucket", "words", "counts"],
        )

    def single(self) -> Iterator[pa.RecordBatch]:
        """Stripes of the empty prefix."""
        yield self.stripes(self.lang, pa.array([""] * len(self.langs)), np.arange(len(self.langs)), self.word, np.ones(len(self.langs), np.int64))

    def pairs(self, frequent: Filter, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Stripes of single words, of frequent words only; hot words are told by their hashes."""
        hashes = self.hashes()
        known = frequent.has(hashes)
        at = np.flatnonzero(self.follows()[:-1] & known[:-1] & known[1:]) if len(known) > 1 else np.zeros(0, np.int64)
        kinds, first, number = np.unique(self.lang[at].astype(np.int64) * max(len(self.words), 1) + self.word[at], return_index=True, return_inverse=True)
        lang, word = np.divmod(kinds, max(len(self.words), 1))
        yield self.stripes(number, self.words.take(pa.array(word)), lang, self.word[at + 1], np.isin(hashes[at[first]], hot).astype(np.int64))

    def longer(self, frequent: Filter, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Stripes of two and three words whose pairs, the next word included, are all frequent; hot ones begin with a hot
        pair."""
        n = max(len(self.words), 1)
        more, hashes = self.follows(), self.hashes()
        good = np.zeros(len(more), bool)
        at = np.flatnonzero(more)
        good[at] = frequent.has(joined(hashes[at], hashes[at + 1]))
        # Numbers of the prefixes that begin at each place, made longer by a word each time.
        kinds, number = np.unique(self.lang.astype(np.int64) * n + self.word, return_inverse=True)
        lang, word = np.divmod(kinds, n)
        shown, place = self.words.take(pa.array(word)), np.arange(len(more))
        for length in range(2, MOST_WORDS):
            keep = good[place + length - 2]
            place, number = place[keep], number[keep]
            kinds, first, number = np.unique(number * n + self.word[place + length - 1], return_index=True, return_inverse=True)
            before, word = np.divmod(kinds, n)
            own_hot = np.isin(joined(hashes[place[first]], hashes[place[first] + 1]), hot).astype(np.int64)
            shown, lang = pc.binary_join_element_wise(shown.take(pa.array(before)), self.words.take(pa.array(word)), " "), lang[before]
            last = good[place + length - 1]
            yield self.stripes(number[last], shown, lang, self.word[place[last] + length], own_hot)


def hot_of(parts: DataFrame, words: int) -> np.ndarray:
    """Hashes of the rows (lang, prefix, word, f) with a great share of all words; of single words, or of pairs, there are
    :data:`HOT_SHARE` at most."""
    rows = parts.where(F.col("f") * HOT_SHARE >= max(words, 1)).select("lang", "prefix", "word").collect()
    one = lambda lang, word: joined(np.array([text_hash(lang)], U), np.array([text_hash(word)], U))
    return np.array([(joined(one(r.lang, r.prefix), one(r.lang, r.word)) if r.prefix else one(r.lang, r.word))[0] for r in rows], U)


def counted(texts: DataFrame, name: str, *told) -> DataFrame:
    """(lang, prefix, word, f) of the stripes that ``Coded`` makes under that name, merged; ``told`` are the filter of
    frequent parts and the hashes of hot ones."""
    held = texts.sparkSession.sparkContext.broadcast(told)

    def of(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, texts = (pa.concat_arrays([b.column(k) for b in rows]) for k in range(2))
        made = getattr(Coded(langs, texts), name)(*held.value)
        yield from (x for x in made if x.num_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= CHUNK:
                yield from of(waiting)
                waiting, size = [], 0
        if size:
            yield from of(waiting)

    stripes = texts.mapInArrow(run, STRIPE).repartition("lang", "prefix", "bucket")
    entries = stripes.select("lang", "prefix", "bucket", F.inline(F.arrays_zip(F.split("words", " "), "counts"))).toDF("lang", "prefix", "bucket", "word", "n")
    merged = entries.groupBy("lang", "prefix", "bucket", "word").agg(F.sum("n").alias("f"))
    return merged.select("lang", "prefix", "word", "f")


def phrase_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, prefix, word, words, f) of all phrases of up to four words that occur often enough, and (lang, n), the number
    of words of each lang."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    often = F.col("f") >= LEAST
    words = cut(counted(texts, "single"), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    singles, every = words.where(often), words.agg(F.sum("f").alias("n")).first().n or 0
    pairs = cut(counted(texts, "pairs", filter_of(singles), hot_of(singles, every)).where(often), "pairs")
    longer = cut(counted(texts, "longer", filter_of(pairs), hot_of(pairs, every)).where(often), "longer")
    everything = singles.unionByName(pairs).unionByName(longer)
    return everything.withColumn("phrase", F.when(F.col("prefix") == "", F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word"))), totals


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates: phrases of two words and more, by their lowest-scoring cut."""
    candidates = counts.where(F.col("prefix") != "").select("lang", "phrase", F.col("f").alias("a"))
    parts = counts.select("lang", F.col("phrase").alias("part"), "f")
    words = F.split("phrase", " ")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice(words, F.lit(1), F.col("k"))).alias("head"), F.concat_ws(" ", F.slice(words, F.col("k") + 1, F.size(words))).alias("tail"))
    first, rest = parts.toDF("lang", "head", "l"), parts.toDF("lang", "tail", "r")
    wide = "cast({} as decimal(19, 0))".format
    score = F.expr(f"{wide('a')} * {SCALE} div ({wide('l')} + {wide('r')})")
    each = cuts.join(first, ["lang", "head"]).join(rest, ["lang", "tail"]).withColumn("score", score)
    lowest = each.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x"))
    return lowest.select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")


def subsumed(counts: DataFrame) -> DataFrame:
    """(lang, phrase, most): the largest count of a phrase that is one word longer, at either end."""
    longer = counts.where(F.contains("prefix", F.lit(" ")))
    behind = longer.select("lang", F.col("prefix").alias("phrase"), "f")
    before = longer.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "f")
    return behind.unionByName(before).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame) -> DataFrame:
    """Each lang's first :data:`KEPT` phrases: (lang, rank, phrase, a, l, r, n, score), all numbers bigint."""
    counts, totals = phrase_counts(docs)
    wide = "cast({} as decimal(19, 0))".format
    own = scored(counts).join(subsumed(counts), ["lang", "phrase"], "left")
    own = own.where(F.expr(f"most IS NULL OR 100 * {wide('most')} < {SUBSUMED_PERCENT} * {wide('a')}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = own.withColumn("rank", rank).where(F.col("rank") <= KEPT)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
