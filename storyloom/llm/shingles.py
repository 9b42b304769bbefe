"""Word shingles of whole texts and their fast similarity sketches, a batch of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U = np.uint64


def word_hashes(text: Column) -> Column:
    """The 64-bit hashes of the text's words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; empty for null."""
    parts = F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.coalesce(F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply and shift), as a hash of hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))


def shingle_sets(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, one after the other, and how many each has. Documents with fewer words
    than ``width`` have the whole sequence as their one shingle, those without words none."""
    h = mix(hashes.view(np.uint64))
    n = np.diff(starts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        for k in range(width):
            rolled = mix(rolled * U(0x9E3779B97F4A7C15) + h[k : k + len(rolled)] + U(k + 1))
    out = []
    for d in range(len(n)):
        s, m = starts[d], n[d]
        if m >= width:
            out.append(np.unique(rolled[s : s + m - width + 1]))
        elif m:
            x = np.zeros(1, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(m):
                    x = mix(x * U(0x9E3779B97F4A7C15) + h[s + k] + U(k + 1))
                out.append(mix(x + U(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array([len(x) for x in out], np.int64)


def fast_sketch(shingles: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches with ``t`` coordinates (a power of two), a row per document.

    In round i below t each shingle is thrown into one hashed bin; in round t + j all go to bin j. A bin keeps the
    least (round, value) that it gets, and a document stops once its bins are full, which 2t rounds guarantee for any
    document with a shingle. Two documents agree in a coordinate with the probability of their Jaccard similarity, and
    the number that agree is concentrated as for independent samples.
    """
    empty = np.iinfo(np.uint64).max
    sketch = np.full((len(sizes), t), empty, np.uint64)
    flat = sketch.reshape(-1)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(2 * t):
        if not len(doc):
            break
        with np.errstate(over="ignore"):
            v = mix(shingles ^ mix(np.array([i + 1], np.uint64) * U(0xA24BAED4963EE407)))
        at = doc * t + ((v & U(t - 1)).astype(np.int64) if i < t else i - t)
        new = flat[at] >= U(i << 54)  # empty, or filled in this round: earlier rounds have lesser values
        np.minimum.at(flat, at[new], (v[new] >> U(10)) | U(i << 54))
        short = (sketch == empty).any(1)
        left = short[doc]
        doc, shingles = doc[left], shingles[left]
    return sketch


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of ``rows`` coordinates, the band's number included."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(t // rows, dtype=np.uint64) + U(1), (n, t // rows))
        for k in range(rows):
            h = mix(h * U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h


def sequence_keys(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's word sequence."""
    h = hashes.view(np.uint64)
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(starts[:-1], np.diff(starts)).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for seed in (0x9E3779B97F4A7C15, 0xA24BAED4963EE407):
            run = np.concatenate([[U(0)], np.cumsum(mix(h ^ mix(place * U(seed) + U(seed))), dtype=np.uint64)])
            out.append(mix(run[starts[1:]] - run[starts[:-1]] + np.diff(starts).astype(np.uint64)))
    return out[0], out[1]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _columns(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    lists = batch.column(1)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    starts = lists.offsets.to_numpy().astype(np.int64)
    return batch.column(0), lists.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]], starts - starts[0]


def sketched(docs: DataFrame, width: int, t: int, rows: int) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, bands) of every document (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, hashes, starts = _columns(batch)
            values, sizes = shingle_sets(hashes, starts, width)
            k1, k2 = sequence_keys(hashes, starts)
            b = bands(fast_sketch(values, sizes, t), rows)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(sizes), _lists(np.ascontiguousarray(b).reshape(-1), np.full(len(sizes), t // rows))],
                ["doc_id", "k1", "k2", "n_shingles", "bands"],
            )

    light = docs.select("doc_id", word_hashes(F.col("text")).alias("words"))
    return light.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, n_shingles bigint, bands array<bigint>")


PARITIES = 1024


def parities(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each document the parities of how many of its shingles fall to each of :data:`PARITIES` hashed places, as 64-bit
    words. Two documents differ in as many shingles at least as in parities."""
    place = (mix(shingles ^ U(0x2545F4914F6CDD1D)) & U(PARITIES - 1)).astype(np.int64)
    out = np.zeros((len(sizes), PARITIES // 64), np.uint64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for d in range(len(sizes)):
        odd = (np.bincount(place[ends[d] : ends[d + 1]], minlength=PARITIES) & 1).astype(np.uint8)
        out[d] = np.packbits(odd, bitorder="little").view(np.uint64)
    return out


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles, parity) of every document (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, hashes, starts = _columns(batch)
                values, sizes = shingle_sets(hashes, starts, width)
                words = parities(values, sizes)
                yield pa.RecordBatch.from_arrays([ids, _lists(values, sizes), _lists(words.reshape(-1), np.full(len(sizes), words.shape[1]))], ["doc_id", "shingles", "parity"])

    return docs.select("doc_id", word_hashes(F.col("text")).alias("words")).mapInArrow(run, "doc_id bigint, shingles array<bigint>, parity array<bigint>")
