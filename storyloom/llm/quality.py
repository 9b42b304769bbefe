"""Quality classifier by Bradley-Terry pairwise ranking.

Features of the whole text are compared between preferred and other documents: the probability that one beats the other
is the logistic function of the difference of their linear scores, and weights minimise the logistic loss over
preference pairs. Documents are then rejected below a quantile of the scores.

Defined cases: null and empty texts, and texts of white space, have all features 0 and are scored like any other row;
without labels of both kinds every score is 0.5; repeated rows give equal rows; other columns are not read by the
scorer, whatever their names, and :func:`keep_quality` returns them as they are; it tells rows by their text, so that
rows with null or repeated ids are judged each for itself; texts are read whole, however long. Labels, language, source and id never
enter a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, cut
from .bounded import bounded_ids, text_key, without_texts
from .labelled import labelled_ids, remainder
from .shingles import word_hashes

#: Labelled rows that are compared with each other, preference pairs made of them at least, and the fold held out.
MOST_LABELLED, PAIRS, FOLDS, HELD = 20_000, 60_000, 5, 0
#: Documents are rejected below this quantile of the scores of preferred training rows.
REJECT_QUANTILE = 0.002
CUT = 0.3
FEATURES = ("letters", "capitals", "digits", "marks", "bars", "spaces", "word_length", "repeats", "variety", "lines", "long")


def _byte_classes() -> np.ndarray:
    """For each byte: 1 if it belongs to that class. Bytes from 128 on are parts of letters outside ASCII."""
    b = np.arange(256)
    lower, upper = (b >= 97) & (b <= 122), (b >= 65) & (b <= 90)
    digit, space = (b >= 48) & (b <= 57), (b == 32) | ((b >= 9) & (b <= 13))
    other = b >= 128
    marks = ~(lower | upper | digit | space | other)
    return np.stack([lower | upper | other, upper, digit, marks, b == 124, space, b == 10]).astype(np.uint8)


_CLASSES = _byte_classes()


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches of ``values`` between ``starts``, without widening all values at once."""
    out = np.zeros(len(starts) - 1, np.int64)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        out[some] = np.add.reduceat(values, starts[:-1][some], dtype=np.int64)
    return out


def text_features(data: np.ndarray, starts: np.ndarray, hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A row of :data:`FEATURES` for each text: its bytes lie in ``data`` from ``starts``, its words' hashes likewise."""
    sums = np.stack([_sums(c[data], starts) for c in _CLASSES])
    size = np.maximum(np.diff(starts), 1)
    n = np.diff(words)
    some = np.maximum(n, 1)
    same = np.concatenate([[0], (hashes[1:] == hashes[:-1])]).astype(np.uint8) if len(hashes) else np.zeros(0, np.uint8)
    first = words[:-1][n > 0]
    same[first] = 0  # a text's first word has none before it
    distinct = np.array([len(np.unique(hashes[words[d] : words[d + 1]])) for d in range(len(n))], np.float64)
    letters, capitals, digits, marks, bars, spaces, lines = sums / size
    return np.stack([
        letters, capitals / np.maximum(letters, 1e-9), digits, marks, bars, spaces, (sums[0] + sums[2] + sums[3]) / some / 10,
        _sums(same, words) / some, np.where(n > 0, np.log(np.maximum(distinct, 1)) / np.log(some + 1), 0), sums[6] / some, np.log1p(n) / 10,
    ], 1)


def features(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns, with ``text``) reduced to (doc_id, key, x): the text's digest and features."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text, hashes = batch.column(2).cast(pa.large_string()), batch.column(3)
            starts = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2], np.uint8)[starts[0] : starts[-1]] if text.buffers()[2] else np.zeros(0, np.uint8)
            words = hashes.offsets.to_numpy().astype(np.int64)
            values = hashes.values.to_numpy(zero_copy_only=False)[words[0] : words[-1]]
            x = text_features(data, starts - starts[0], values, words - words[0])
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], ["doc_id", "key", "x"])

    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).cast("string").alias("text"))
    return light.select("doc_id", "key", "text", word_hashes(F.col("text")).alias("w")).mapInArrow(run, "doc_id bigint, key binary, x array<double>")


@dataclass(frozen=True)
class Ranking:
    """A fitted linear score with its scaling, its calibration and the threshold for keeping documents."""

    mean: tuple[float, ...]
    weight: tuple[float, ...]
    slope: float
    shift: float
    threshold: float

    def score(self, x: Column) -> Column:
        parts = F.zip_with(x, F.array(*map(F.lit, self.mean)), lambda a, m: a - m)
        worth = F.aggregate(F.zip_with(parts, F.array(*map(F.lit, self.weight)), lambda a, w: a * w), F.lit(0.0), lambda s, a: s + a)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * worth + F.lit(self.shift))))


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second and first derivatives of the logistic loss at ``w``, summed over the rows."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return (x * (p * (1 - p) + 1e-9)[:, None]).T @ x, x.T @ (p - y)


def _newton(slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], d: int, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights of least regularised logistic loss, from the sums that ``slopes`` gives at any weights."""
    w = np.zeros(d)
    for _ in range(steps):
        second, first = slopes(w)
        step = np.linalg.solve(second + ridge * np.eye(d), first + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _spread_slopes(rows: DataFrame) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """:func:`_slopes` over a table (x, y): tasks sum their rows, the driver adds one row of each task."""

    def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = len(w)
            total = np.zeros(d * d + d)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
                total += np.concatenate([m.reshape(-1) for m in _slopes(x, batch.column(1).to_numpy(zero_copy_only=False), w)])
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])

        total = np.sum([r.s for r in rows.select("x", "y").mapInArrow(run, "s array<double>").collect()], axis=0)
        d = len(w)
        return total[: d * d].reshape(d, d), total[d * d :]

    return at


def _preferences(y: np.ndarray, pairs: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of preferred rows and of those they beat: each row's turn comes as often as any other's of its label."""
    turns = [np.concatenate([rng.permutation(own) for _ in range(-(-pairs // len(own)))])[:pairs] for own in (np.flatnonzero(y == 1), np.flatnonzero(y == 0))]
    return turns[0], turns[1]


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7, quantile: float = REJECT_QUANTILE) -> Ranking:
    """Weights from preference pairs (a row labelled 1 beats a row labelled 0), and a two-parameter calibration."""
    d = len(FEATURES)
    if not len(y) or y.min() == y.max():
        return Ranking((0.0,) * d, (0.0,) * d, 0.0, 0.0, 0.0)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / spread
    rng = np.random.default_rng(seed)
    over, under = _preferences(y, max(pairs, len(y)), rng)
    gap = z[over] - z[under]
    w = _newton(lambda v: _slopes(gap, np.ones(len(gap)), v), d, ridge=1.0)
    m = z @ w
    placed = np.stack([m, np.ones(len(m))], 1)
    slope, shift = _newton(lambda v: _slopes(placed, y.astype(float), v), 2, ridge=1e-3)
    kept = 1 / (1 + np.exp(-np.clip(slope * m[y == 1] + shift, -30, 30)))
    return Ranking(tuple(map(float, mean)), tuple(map(float, w / spread)), float(slope), float(shift), float(np.quantile(kept, quantile)))


def fit_spread(rows: DataFrame, groups: int, pairs: int = PAIRS, seed: int = 7, quantile: float = REJECT_QUANTILE) -> Ranking:
    """:func:`fit` over all rows (doc_id, x, y) of a written table, however many.

    Rows are dealt to groups by a hash of their id and compared within their group, each with several of the other label;
    groups without rows of both labels have no pairs. Scaling, calibration and quantile are those of all rows.
    """
    d = len(FEATURES)
    each = [F.get("x", F.lit(k)) for k in range(d)]
    told = rows.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0), *[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    if not told[0] or not told[1]:
        return fit(np.zeros((0, d)), np.zeros(0))
    mean, spread = np.array(told[2 : 2 + d]), np.array(told[2 + d :]) + 1e-6

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        y, z = part["y"].to_numpy(), (np.array(part["x"].tolist(), float) - mean) / spread
        if y.min() == y.max():
            return pd.DataFrame({"x": [], "y": []})
        over, under = _preferences(y, max(pairs, len(y)), np.random.default_rng([seed, key[0]]))
        return pd.DataFrame({"x": list(z[over] - z[under]), "y": 1.0})

    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)))
    gaps = cut(dealt.groupBy("g").applyInPandas(compare, "x array<double>, y double"), "preferences")
    weight = _newton(_spread_slopes(gaps), d, ridge=1.0) / spread
    worth = F.aggregate(F.zip_with(F.zip_with("x", F.array(*map(F.lit, mean.tolist())), lambda a, m: a - m), F.array(*map(F.lit, weight.tolist())), lambda a, w: a * w), F.lit(0.0), lambda s, a: s + a)
    placed = cut(rows.select(F.array(worth, F.lit(1.0)).alias("x"), F.col("y").cast("double").alias("y")), "placed")
    slope, shift = map(float, _newton(_spread_slopes(placed), 2, ridge=1e-3))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(slope) * F.get("x", F.lit(0)) + F.lit(shift)))))
    at = quantile * (told[0] - 1)
    lowest = placed.where("y = 1").select(score.alias("s")).orderBy("s").limit(int(at) + 2).orderBy(F.desc("s")).limit(2).collect()
    high, low = lowest[0].s, lowest[-1].s
    threshold = low + (high - low) * (at - int(at)) if told[0] > 1 else low
    return Ranking(tuple(map(float, mean)), tuple(map(float, weight)), slope, shift, float(threshold))


def train(featured: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Ranking:
    """Fit on all labelled rows outside the held-out fold; where they are more than ``most``, in groups of about so many."""
    ids = bounded_ids(labelled_ids(labels, "quality", FOLDS, HELD))
    rows = cut(featured.join(ids, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "x", "y"), "labelled")
    n = rows.count()
    if n > most:
        return fit_spread(rows, -(-n // most))
    own = rows.toPandas().sort_values("doc_id")
    x = np.array(own["x"].tolist(), float).reshape(n, len(FEATURES))
    return fit(x, own["y"].to_numpy())


def score_documents(featured: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, key, held_out, score, predicted) of every featured row."""
    scored = featured.select("doc_id", "key", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), ranking.score(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_quality(docs: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """The documents that are not rejected: those with a score at or above the threshold, a quantile of the scores."""
    return without_texts(docs, scored.where(F.col("score") < threshold))
