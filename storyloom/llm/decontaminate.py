"""Benchmark decontamination by pigeonhole edit matching.

With an error budget of k edits a test item is split into k + 1 pieces; any occurrence within the budget holds one piece
unchanged. Pieces are found exactly in whole documents by one automaton, and the text around each hit is verified with
Myers' bit-parallel distance. Documents are scanned where they lie: nothing is shuffled. Items are dealt by Spark into
blocks of about a bounded size, files in the shared folder which the tasks read; a worker keeps the automaton of its last
block. Each block costs a scan of the documents.

Both sides are compared in lower case with every run of characters other than letters and digits as one space.

Defined cases: null and empty texts match nothing; items without letters or digits match nothing; repeated items each
match under their own id; repeated documents each give their rows; other columns are ignored, whatever their names;
empty tables give an empty result; rows with a null doc_id give rows with a null doc_id, and items without an id are left
out; texts are read whole, however long. :func:`clean_documents` tells rows by their text, so that null and repeated ids
are judged each row for itself. Of several places in a document, the first with the least distance is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, cut, fresh_path
from .bounded import text_key, without_texts

#: Edits allowed for each character of an item.
BUDGET = 0.05
#: Characters of items in a block, about.
BLOCK_CHARS = 4_000_000


def plain(text: Column) -> Column:
    """The text as it is compared."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in ``budget + 1`` pieces of nearly equal length, with their offsets."""
    n = budget + 1
    ends = [len(item) * i // n for i in range(n + 1)]
    return [(ends[i], item[ends[i] : ends[i + 1]]) for i in range(n) if ends[i] < ends[i + 1]]


def myers(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of ``item`` in ``text`` within the budget; the first of equally good ones."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rises = down | (full & ~(diagonal | up))
        falls = up & diagonal
        if rises & top:
            score += 1
        elif falls & top:
            score -= 1
        rises = (rises << 1) & full
        falls = (falls << 1) & full
        up = falls | (full & ~(diagonal | rises))
        down = rises & diagonal
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def windows(hits: list[tuple[int, int]], length: int, budget: int) -> list[tuple[int, int]]:
    """Joined stretches of text around hits (place, offset in the item) that hold every occurrence of the item."""
    out: list[tuple[int, int]] = []
    for place, offset in sorted(hits, key=lambda h: h[0] - h[1]):
        start = max(0, place - offset - budget)
        end = place - offset + length + budget
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> list[str]:
    """Folders of Parquet files (item_id, t) that hold the items (item_id, text), dealt out by a hash."""
    wanted = cut(items.select(F.col("item_id").cast("long").alias("item_id"), plain(F.col("text")).alias("t")).where("t <> '' and item_id is not null").distinct(), "items")
    n = max(1, -(-(wanted.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars))
    path = fresh_path(items.sparkSession, "blocks")
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("item_id", "t"), F.lit(n)).cast("int"))
    dealt.repartition(n, "block").write.partitionBy("block").parquet(path)
    return [f"{path}/block={k}" for k in range(n)]


class Block:
    """The items of a block with the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        import ahocorasick

        self.items = sorted(items)
        self.budgets = [int(len(t) * budget) for _, t in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(self.items):
            for offset, piece in pieces(t, self.budgets[i]):
                where.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton() if where else None
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, end, length) of the items in a text."""
        if self.automaton is None:
            return []
        hits: dict[int, list[tuple[int, int]]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for i, offset in places:
                hits.setdefault(i, []).append((last - length + 1, offset))
        out = []
        for i, own in hits.items():
            item, t = self.items[i]
            best = None
            for start, end in windows(own, len(t), self.budgets[i]):
                at = myers(t, text[start:end], self.budgets[i])
                if at and (best is None or at[0] < best[0]):
                    best = (at[0], start + at[1])
            if best:
                out.append((item, best[0], best[1], len(t)))
        return out


#: The last block that this worker opened.
_OPEN: dict[tuple[str, float], Block] = {}


def _opened(path: str, budget: float) -> Block:
    from pyarrow import parquet
    from pyarrow.fs import FileSelector, FileSystem

    if (path, budget) not in _OPEN:
        _OPEN.clear()
        fs, base = FileSystem.from_uri(path)
        rows = []
        for info in fs.get_file_info(FileSelector(base, allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as source:
                    got = parquet.ParquetFile(source).read(columns=["item_id", "t"]).to_pydict()
                rows += zip(got["item_id"], got["t"], strict=True)
        _OPEN[path, budget] = Block(rows, budget)
    return _OPEN[path, budget]


def _scan(docs: DataFrame, path: str, budget: float) -> DataFrame:
    """(id, item_id, distance, end_char, item_chars) of the block's items in rows (id, t), ids being strings."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = _opened(path, budget)
        for frame in frames:
            found = [(doc, *hit) for doc, text in zip(frame["id"], frame["t"], strict=True) for hit in block.found(text)]
            yield pd.DataFrame(found, columns=["id", "item_id", "distance", "end_char", "item_chars"])

    return docs.mapInPandas(run, "id string, item_id bigint, distance int, end_char bigint, item_chars int")


def _found(docs: DataFrame, items: DataFrame, budget: float, block_chars: int) -> DataFrame:
    bound_batches(docs.sparkSession)
    out = None
    for path in blocks(items, block_chars):
        hit = _scan(docs, path, budget)
        out = hit if out is None else out.union(hit)
    return out


def contaminated(docs: DataFrame, items: DataFrame, budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end_char, item_chars) for each item (item_id, text) found in a document (doc_id, text).

    ``end_char`` counts characters of the compared text.
    """
    light = docs.select(F.col("doc_id").cast("string").alias("id"), plain(F.col("text")).alias("t"))
    return _found(light, items, budget, block_chars).select(F.col("id").cast("long").alias("doc_id"), "item_id", "distance", "end_char", "item_chars")


def clean_documents(docs: DataFrame, items: DataFrame, budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item is found."""
    light = docs.select(F.hex(text_key(F.col("text"))).alias("id"), plain(F.col("text")).alias("t"))
    return without_texts(docs, _found(light, items, budget, block_chars).select(F.unhex("id").alias("key")))
