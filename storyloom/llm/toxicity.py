"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Every word of a text is a term. A term weighs (1 + ln tf) * idf * r^2 in the vectors, r = chi2 / (chi2 + 40) being how
surely its presence goes with either label; without r the few telling words of a long text drown among its others.
Numbers of rows, idf and chi-square cover all labelled rows outside the held-out fold; only the examples are a bounded
sample of these rows, by the hash of their id, and all of their words are indexed. Votes of the nearest examples,
weighted by similarity, are calibrated on the examples with each example's own vote left out.

Terms are summed up by falling impact. Those of little impact are only bounded, the common ones by their greatest value
in each block of examples, and blocks whose bound stays below the neighbours found so far are never opened. The
neighbours are those of a full comparison.

Defined cases: a document without a word of the examples (also null or empty) has no neighbours, and its score is the
calibrated share of label 1; without labels of both kinds every score is the share of label 1 (0 without any); repeated
rows give equal rows, and a labelled id's rows are each an example; null ids stay null; other columns are ignored, whatever their names; texts are read whole, however
long. Labels, language, source and id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, cut
from .bounded import bounded_ids
from .labelled import labelled_ids, remainder, sample_ids

#: Most labelled rows in the index, most of them that calibrate it, and neighbours that vote.
MOST_EXAMPLES, MOST_CALIBRATED, NEIGHBOURS = 6_000, 3_000, 15
#: The chi-square at which a term has half of its full say (before squaring).
HALF_CHI = 40.0
FOLDS, HELD, CUT = 4, 2, 0.3
#: Examples in a block, how many of the commonest terms have a row of values, and the cosine that may be left to terms
#: of little impact in the first pass; none of them changes a result.
BLOCK, COMMON, REST = 64, 128, 0.05
#: Sums in the index are of single precision, neighbours of double: candidates may miss the bound by this.
MARGIN = 1e-6


def words(text: Column) -> Column:
    """The 64-bit hashes of the words of the whole text in lower case, in order; empty for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def term_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n, p) of the ``terms``: in how many rows (words, y) each occurs, and in how many of label 1."""
    each = rows.select(F.col("y").cast("long").alias("y"), F.explode(F.array_distinct("words")).alias("term"))
    return each.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))


def term_weights(n: np.ndarray, p: np.ndarray, rows: int, pos: int) -> np.ndarray:
    """idf * r^2 of terms that occur in ``n`` of the rows, ``p`` of them with label 1."""
    n, p = n.astype(float), p.astype(float)
    below = np.maximum(n * (rows - n) * pos * (rows - pos), 1e-300)
    chi = np.where(n < rows, rows * (p * rows - n * pos) ** 2 / below, 0.0)
    return (np.log((1 + rows) / (1 + n)) + 1) * (chi / (chi + HALF_CHI)) ** 2


class Index:
    """Inverted index of labelled examples. The hashes of an example's words lie in ``hashes`` between its ``ends``."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, labels: np.ndarray, ends: np.ndarray, hashes: np.ndarray, none: float = 0.0):
        self.terms, self.weights, self.none, self.slope, self.shift = terms, weights, none, 1.0, 0.0
        n, v = len(ids), max(len(terms), 1)
        key = np.repeat(np.arange(n, dtype=np.int64), np.diff(ends)) * v + np.searchsorted(terms, hashes)
        key, tf = np.unique(key, return_counts=True)
        doc, term = (key // v).astype(np.int32), (key % v).astype(np.int32)
        w = (1 + np.log(tf)) * weights[term] if n else np.zeros(0)
        doc, term, w = doc[w > 0], term[w > 0], w[w > 0]
        w /= np.sqrt(np.bincount(doc, w * w, n))[doc] if n else 1.0
        first = np.searchsorted(doc, np.arange(n + 1))
        heaviest = [int(term[a + np.argmax(w[a:b])]) if b > a else -1 for a, b in zip(first[:-1], first[1:], strict=True)]
        order = np.lexsort((ids, heaviest)).astype(np.int64) if n else np.zeros(0, np.int64)  # like stands by like: blocks have tight bounds
        self.ids, self.y = np.asarray(ids, np.int64)[order], np.asarray(labels, float)[order]
        self.base = float(self.y.mean()) if n else none
        new = np.zeros(n, np.int32)
        new[order] = np.arange(n)
        by = np.argsort(new[doc], kind="stable")
        doc, self.term, self.weight = new[doc][by], term[by], w[by]
        self.ends = np.searchsorted(doc, np.arange(n + 1))
        by = np.argsort(self.term, kind="stable")
        self.doc, self.value = doc[by], self.weight[by].astype(np.float32)
        self.start = np.searchsorted(self.term[by], np.arange(len(terms) + 1))
        self.blocks = max(1, -(-n // BLOCK))
        size = np.diff(self.start)
        self.greatest = np.zeros(len(terms))
        if len(self.value):
            self.greatest[size > 0] = np.maximum.reduceat(self.value, self.start[:-1][size > 0])
        common = np.argsort(-size, kind="stable")[:COMMON]
        common = common[size[common] > self.blocks]
        self.place = np.full(len(terms), -1, np.int32)
        self.place[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        for k, t in enumerate(common):
            own = slice(self.start[t], self.start[t + 1])
            self.dense[k, self.doc[own]] = self.value[own]
        self.most = self.dense.reshape(len(common), self.blocks, BLOCK).max(2) if len(common) else np.zeros((0, self.blocks))
        self.opened = self.passed = 0

    def vector(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text and their weights, scaled to length one; terms that no example has are not in the space."""
        found, tf = np.unique(hashes, return_counts=True)
        if not len(self.terms) or not len(found):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
        known = self.terms[at] == found
        at = at[known]
        w = (1 + np.log(tf[known])) * self.weights[at]
        long = np.linalg.norm(w)
        return (at[w > 0], w[w > 0] / long) if long > 0 else (np.zeros(0, np.int64), np.zeros(0))

    def _sums(self, ts: np.ndarray, ws: np.ndarray) -> np.ndarray:
        """What these terms give to the cosine of each example."""
        at = self.place[ts]
        few = at < 0
        low, size = self.start[ts[few]], self.start[ts[few] + 1] - self.start[ts[few]]
        total = int(size.sum())
        sums = np.zeros(self.blocks * BLOCK)
        if total:
            take = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
            sums[: len(self.y)] = np.bincount(self.doc[take], np.repeat(ws[few], size) * self.value[take], len(self.y))
        for k, w in zip(at[~few], ws[~few], strict=True):
            sums += w * self.dense[k]
        return sums

    def _exact(self, place: np.ndarray, ts: np.ndarray, ws: np.ndarray) -> np.ndarray:
        """The cosines of the examples at ``place``, from all of their terms."""
        query = np.zeros(len(self.terms))
        query[ts] = ws
        size = self.ends[place + 1] - self.ends[place]
        first = np.cumsum(size) - size
        take = np.repeat(self.ends[place] - first, size) + np.arange(int(size.sum()))
        out = np.zeros(len(place))
        if len(take):
            out[size > 0] = np.add.reduceat(query[self.term[take]] * self.weight[take], first[size > 0])
        return out

    def nearest(self, ts: np.ndarray, ws: np.ndarray, k: int = NEIGHBOURS, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples, those with cosine 0 left out; ties go to the lower place.

        Terms are summed up in the order of their greatest impact until the others can add no more than :data:`REST`;
        of the rest only bounds are taken, by block where a term is common. Examples whose sum and bound stay below the
        k-th greatest sum are out; the cosines of the others are worked out in full.
        """
        impact = ws * self.greatest[ts]
        order = np.argsort(-impact, kind="stable")
        rest = np.append(impact[order].sum() - np.cumsum(impact[order]), 0.0)
        m = min(int(np.argmax(rest <= REST)) + 1, len(ts))
        sums = self._sums(ts[order[:m]], ws[order[:m]])
        if leave >= 0:
            sums[leave] = -np.inf
        least = max(np.partition(sums, -k)[-k], 0.0) if len(sums) >= k else 0.0
        later = order[m:]
        at = self.place[ts[later]]
        bound = np.full(self.blocks, impact[later[at < 0]].sum())
        if (at >= 0).any():
            bound += ws[later[at >= 0]] @ self.most[at[at >= 0]]
        hope = (sums.reshape(self.blocks, BLOCK) + bound[:, None]).reshape(-1)[: len(self.y)]
        place = np.flatnonzero((hope >= least - MARGIN) & (hope > 0))
        self.opened += len(np.unique(place // BLOCK))
        self.passed += self.blocks
        if (self.ends[place + 1] - self.ends[place]).sum() > (self.start[ts[later] + 1] - self.start[ts[later]]).sum():
            cos = sums[place] + self._sums(ts[later], ws[later])[place]
            if len(place) > k:
                place = place[cos >= np.partition(cos, -k)[-k] - MARGIN]
        cos = self._exact(place, ts, ws)
        place, cos = place[cos > 0], cos[cos > 0]
        best = np.lexsort((place, -np.round(cos, 12)))[:k]
        return place[best], cos[best]

    def vote(self, place: np.ndarray, cos: np.ndarray) -> float:
        """The share of label 1 among the neighbours by similarity, with half a neighbour's weight for its usual share."""
        return float((cos @ self.y[place] + 0.5 * self.base) / (cos.sum() + 0.5))

    def score(self, hashes: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        place, cos = self.nearest(*self.vector(hashes))
        if not len(place):
            return self.none, place, cos
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.vote(place, cos) + self.shift, -30, 30)))), place, cos


def build_index(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES) -> Index:
    """The calibrated index, from the labelled rows outside the held-out fold."""
    bound_batches(docs.sparkSession)
    ids = bounded_ids(labelled_ids(labels, "toxic", FOLDS, HELD))
    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "y", words(F.col("text")).alias("words"))
    rows = cut(rows, "labelled")
    n, pos = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or pos in (0, n):
        none = np.zeros(0, np.int64)
        return Index(none, np.zeros(0), none, none, np.zeros(1, np.int64), none, pos / n if n else 0.0)
    sample = sample_ids(rows, most)
    own = bounded_ids(sample.select(F.explode("words").alias("term")).distinct())
    stats = term_counts(rows, own).orderBy("term").toArrow()
    weights = term_weights(stats["n"].to_numpy(), stats["p"].to_numpy(), n, pos)
    held = sample.orderBy("doc_id", F.xxhash64("words")).toArrow().combine_chunks()
    lists = held["words"].combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.int64()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends, hashes = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
    index = Index(stats["term"].to_numpy(), weights, held["doc_id"].to_numpy(), held["y"].to_numpy(), ends - ends[0], hashes[ends[0] : ends[-1]], pos / n)
    _calibrate(index)
    return index


def _calibrate(index: Index, rows: int = MOST_CALIBRATED) -> None:
    """A logistic curve from votes to labels, over at most ``rows`` examples, each without its own vote."""
    n = len(index.y)
    order = np.argsort(index.ids, kind="stable")
    votes, y = [], []
    for i in order[np.linspace(0, n - 1, min(rows, n)).astype(int)]:
        own = slice(index.ends[i], index.ends[i + 1])
        place, cos = index.nearest(index.term[own], index.weight[own], leave=int(i))
        if len(place):
            votes.append(index.vote(place, cos))
            y.append(index.y[i])
    if not votes:
        return
    x, t, w = np.stack([votes, np.ones(len(votes))], 1), np.array(y), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (p - t) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    index.slope, index.shift = float(w[0]), float(w[1])


def score_documents(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, similarities): the neighbours' doc_ids and cosines are the
    evidence."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            ends, hashes = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            got = [own.score(hashes[ends[i] : ends[i + 1]]) for i in range(len(lists))]
            evidence = pa.array([own.ids[g[1]].tolist() for g in got], pa.list_(pa.int64()))
            near = pa.array([g[2].tolist() for g in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), evidence, near], ["doc_id", "score", "evidence", "similarities"])

    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    scored = light.mapInArrow(run, "doc_id bigint, score double, evidence array<bigint>, similarities array<double>")
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence", "similarities"
    )
