"""Embedding near-dedup as an exact metric range join.

Vectors are scaled to length one, where cosine >= c means a distance of at most r = sqrt(2 - 2c). Pivots, a bounded
sample, partition the vectors: each lies in the cell of its nearest pivot. By the triangle inequality a vector can only
link into another cell if its distance to that cell's pivot exceeds the cell's radius by no more than r, and if it lies
no farther than r beyond the border between the two pivots; only there it is compared.

Vectors are written once, in blocks of neighbouring cells of at most 8 MB, and pairs of blocks are read from that table
where they are compared: nothing is copied for each cell that a vector may link into, so what is written and shuffled
grows with the vectors, and only reading and comparing with their square.

Equal vectors are one class with a weight, so copies never meet. A pair is compared in one pair of blocks only, so links are counted once. Each pair of blocks sends on counts and a spanning forest of its links, not its pairs. A pair
links if the sum of products of its scaled vectors, in doubles, is at least the bound.

In many dimensions without clusters distances are nearly equal and borders are near to most vectors: the join is then a
blocked comparison of all pairs, still exact and of bounded memory and disk.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links with nothing, nor do
vectors of different lengths; a null vec_id is kept with a null component; repeated rows of a vec_id are one vector
(the one of least components); other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import BROADCAST_BYTES, NODE_BYTES, connected_components, respread
from ..session import bound_batches, cut, forget
from .shingles import mix

#: Vectors for each pivot, most pivots, and vectors that a block may hold whatever their number in all.
PER_PIVOT, MOST_PIVOTS, PART = 2048, 512, 2048
#: Most vectors of a block, and most bytes of them; blocks that vectors are dealt to at least, if these hold more than PART.
DEALT_ROWS, DEALT_BYTES, LEAST_BLOCKS = 200_000, 8 << 20, 12
#: Bytes of blocks that a task of the join holds, and products of a matrix that it looks at.
HELD_BYTES, PRODUCTS = 32 << 20, 4 << 20
SLACK = 1e-9


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, e) of the vectors that can link, one of each id, components as doubles, or floats where they are."""
    e = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where(F.col("e").isNotNull() & F.col("vec_id").isNotNull()).where(F.coalesce(fine, F.lit(False)))


def _unit(lists: pd.Series) -> np.ndarray:
    return _scaled(np.stack(lists.to_list()).astype(np.float64) if len(lists) else np.zeros((0, 1)))


def _scaled(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots_of(classes: DataFrame, rows: int, seed: int = 11) -> np.ndarray:
    """At most :data:`MOST_PIVOTS` of the vectors, far from each other, out of a bounded sample."""
    want = max(1, min(MOST_PIVOTS, rows // PER_PIVOT))
    pool = classes.orderBy(F.xxhash64("rep", F.lit(seed)), "rep").select("e").limit(4 * want).toPandas()
    x = _unit(pool["e"])
    if len(x) <= 1:
        return x
    chosen, far = [0], x @ x[0]
    while len(chosen) < min(want, len(x)):
        k = int(np.argmin(far))
        if far[k] >= 1 - 1e-12:
            break
        chosen.append(k)
        far = np.maximum(far, x @ x[k])
    return x[chosen]


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the nearest pivots and the distances to them."""
    cell = (x @ pivots.T).argmax(1)
    return cell, np.linalg.norm(x - pivots[cell], axis=1)


def _cell_sizes(classes: DataFrame, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each cell has, and the distance of the farthest from its pivot (-10 without any)."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        n, far = np.zeros(len(p), np.int64), np.full(len(p), -10.0)
        for frame in frames:
            if len(frame):
                cell, d = _nearest(_unit(frame["e"]), p)
                n += np.bincount(cell, minlength=len(p))
                np.maximum.at(far, cell, d)
        yield pd.DataFrame({"cell": np.flatnonzero(n), "n": n[n > 0], "far": far[n > 0]})

    sizes, reach = np.zeros(len(pivots), np.int64), np.full(len(pivots), -10.0)
    each = classes.select("e").mapInPandas(run, "cell int, n long, far double")
    for r in each.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect():  # a row per pivot
        sizes[r["cell"]], reach[r["cell"]] = r["n"], r["far"]
    return sizes, reach


def _gaps(pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0) + 1e-12)  # never below the true distance


def _blocks_of_cells(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first block, blocks) of each cell: large cells have blocks of their own, small ones share one with their neighbours."""
    out, block, held = [], 0, 0
    for n in sizes:
        if n > most or held + n > most:
            block, held = block + (held > 0), 0
        parts = max(1, -(-int(n) // most))
        out.append((block, parts))
        block, held = (block + parts, 0) if parts > 1 else (block, held + int(n))
    return out


def _blocks(classes: DataFrame, pivots: np.ndarray, radius: float, sizes: np.ndarray, reach: np.ndarray, most: int) -> tuple[DataFrame, int]:
    """(block, lower, rep, w, cell, x), and how many there are: a row for each block, with the blocks up to it that may hold
    links of its vectors, and these in the order of their cells, as bytes of 64-bit and 32-bit numbers."""
    dealt = _blocks_of_cells(sizes, most)
    many = max(first + parts for first, parts in dealt)
    near = _gaps(pivots) <= reach[:, None] + reach[None] + radius + SLACK
    np.fill_diagonal(near, True)
    cells = np.zeros((len(pivots), many), bool)
    for c, (first, parts) in enumerate(dealt):
        cells[c, first : first + parts] = sizes[c] > 0
    ties = (cells.T.astype(np.int32) @ near.astype(np.int32) @ cells.astype(np.int32)) > 0
    lower = [np.flatnonzero(ties[b, : b + 1]).tolist() for b in range(many)]
    shared = classes.sparkSession.sparkContext.broadcast((pivots, np.array(dealt), lower))
    kind = dict(classes.dtypes)["e"]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, dealt, _ = shared.value
        for frame in frames:
            if len(frame):
                cell, _ = _nearest(_unit(frame["e"]), p)
                part = (mix(frame["rep"].to_numpy().view(np.uint64)) % dealt[cell, 1].astype(np.uint64)).astype(np.int64)
                yield frame.assign(block=dealt[cell, 0] + part, cell=cell)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = shared.value[2]
        now, held = None, []

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = np.concatenate([c.flatten().to_numpy() for c in t.column("e").chunks])
            raw = [t.column("rep").to_numpy().tobytes(), t.column("w").to_numpy().tobytes(), t.column("cell").to_numpy().tobytes(), x.tobytes()]
            names = ["block", "lower", "rep", "w", "cell", "x"]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([lower[now]], pa.list_(pa.int32())), *[pa.array([v], pa.binary()) for v in raw]], names)

        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
            for low, high in zip(edges, edges[1:], strict=False):
                if high > low:
                    if held and block[low] != now:
                        yield row()
                        held = []
                    now = int(block[low])
                    held.append(batch.slice(low, high - low))
        if held:
            yield row()

    rows = classes.select("rep", "w", "e").mapInPandas(deal, f"rep bigint, w bigint, e {kind}, block int, cell int")
    together = rows.repartition(many, "block").sortWithinPartitions("block", "cell")
    return cut(together.mapInArrow(gather, "block int, lower array<int>, rep binary, w binary, cell binary, x binary"), "blocks"), many


class _Block:
    """A block's vectors: scaled, as doubles and floats, with their ids, weights and cells."""

    def __init__(self, row: dict, side: str, dim: int, kind: np.dtype):
        self.rep, self.w, self.cell = (np.frombuffer(row[f"{side}_{c}"], t) for c, t in (("rep", np.int64), ("w", np.int64), ("cell", np.int32)))
        self.x = _scaled(np.frombuffer(row[f"{side}_x"], kind).reshape(-1, dim).astype(np.float64))
        self.light = self.x.astype(np.float32)


def _join(pairs: DataFrame, pivots: np.ndarray, reach: np.ndarray, radius: float, least: float, dim: int, kind: str) -> DataFrame:
    """(a, b, n): for each vector how many vectors it links with in a pair of blocks (b null), and forest edges (n null)."""
    shared = pairs.sparkSession.sparkContext.broadcast((pivots, reach))
    number = np.dtype(np.float32 if kind == "array<float>" else np.float64)
    blur = (dim + 8) * 1.2e-7 + SLACK  # by which a product of floats may be off

    def compare(one: _Block, mine: slice, two: _Block, theirs: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Linked rows of ``one`` within ``mine`` and of ``two`` among ``theirs``; only later ones of the same block."""
        found = []
        step = max(1, PRODUCTS // (mine.stop - mine.start))
        for k in range(0, len(theirs), step):
            some = theirs[k : k + step]
            dots = two.light[some] @ one.light[mine].T
            r, c = np.nonzero(dots >= least - blur)
            dots, r, c = dots[r, c], some[r], c + mine.start
            if same:
                later = r > c
                dots, r, c = dots[later], r[later], c[later]
            fits = np.ones(len(r), bool)
            edge = np.flatnonzero(dots <= least + blur)  # the others are clear of rounding
            for part in np.array_split(edge, len(edge) // 10_000 + 1):
                fits[part] = np.einsum("ij,ij->i", two.x[r[part]], one.x[c[part]]) >= least
            found.append((c[fits], r[fits]))
        return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2

    def links(one: _Block, two: _Block, same: bool, p: np.ndarray, reach: np.ndarray, gaps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        dots = two.x @ p.T
        own = dots[np.arange(len(two.x)), two.cell]
        edges = [0, *(np.flatnonzero(np.diff(one.cell)) + 1), len(one.cell)]
        for low, high in zip(edges, edges[1:], strict=False):
            c = one.cell[low]
            beyond = (own - dots[:, c]) / gaps[two.cell, c]
            near = (beyond <= radius + SLACK) & (np.sqrt(np.maximum(2 - 2 * dots[:, c], 0)) <= reach[c] + radius + SLACK) | (two.cell == c)
            near[: low + 1 if same else 0] = False
            yield compare(one, slice(low, high), two, np.flatnonzero(near), same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, reach = shared.value
        gaps = _gaps(p)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                one, same = _Block(row, "a", dim, number), row["a_block"] == row["b_block"]
                two = one if same else _Block(row, "b", dim, number)
                tree: dict[int, int] = {}

                def root(v: int, tree=tree) -> int:
                    while tree.setdefault(v, v) != v:
                        tree[v] = tree[tree[v]]
                        v = tree[v]
                    return v

                n = [np.zeros(len(one.x), np.int64), np.zeros(len(two.x), np.int64)]
                edges = []
                for c, r in links(one, two, same, p, reach, gaps):
                    np.add.at(n[0], c, two.w[r])
                    np.add.at(n[1], r, one.w[c])
                    for u, v in zip(one.rep[c].tolist(), two.rep[r].tolist(), strict=True):
                        a, b = root(u), root(v)
                        if a != b:
                            tree[max(a, b)] = min(a, b)
                            edges.append((u, v))
                a = np.concatenate([one.rep[n[0] > 0], two.rep[n[1] > 0], np.array([e[0] for e in edges], np.int64)])
                counts = np.concatenate([n[0][n[0] > 0], n[1][n[1] > 0]])
                if len(a):
                    yield pa.RecordBatch.from_pydict({
                        "a": pa.array(a), "b": pa.array([None] * len(counts) + [e[1] for e in edges], pa.int64()), "n": pa.array(counts.tolist() + [None] * len(edges), pa.int64()),
                    })

    return pairs.mapInArrow(run, "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    bound_batches(vectors.sparkSession)
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    valid = cut(valid_vectors(every).groupBy("vec_id").agg(F.min("e").alias("e")), "vectors")
    grouped = valid.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"))
    classes = cut(grouped.withColumn("dim", F.size("e")), "classes")
    copies = cut(classes.where("w > 1").select("e", "rep", "dim"), "copies")
    size = copies.agg(F.sum(F.col("dim") * 8 + NODE_BYTES)).first()[0] or 0
    told = F.broadcast(copies) if size <= BROADCAST_BYTES else respread(copies)
    member = cut(valid.join(told, "e").where("vec_id <> rep").select("vec_id", "rep"), "members")
    forget(valid)
    links = None
    for dim in [r["dim"] for r in classes.select("dim").distinct().orderBy("dim").collect()]:
        found = _links(classes.where(F.col("dim") == dim), cosine, dim)
        links = found if links is None else links.union(found)
    base = every.select("vec_id")
    if links is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = cut(links.where("n is not null").groupBy("a").agg(F.sum("n").alias("n")), "counts")
    edges = links.where("n is null").select("a", "b").union(member.select(F.col("rep").alias("a"), F.col("vec_id").alias("b")))
    comp = cut(connected_components(edges), "components")
    own = classes.select(F.col("rep").alias("r"), "w").join(counts, F.col("r") == F.col("a"), "left").select("r", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    own = cut(own.where("n_links > 0"), "own")
    per_copy = member.join(own, F.col("rep") == F.col("r")).select("vec_id", "n_links")
    state = own.select(F.col("r").alias("vec_id"), "n_links").union(per_copy).join(comp, F.col("vec_id") == F.col("node"), "left").select("vec_id", "n_links", "component")
    component = F.coalesce("component", "vec_id")
    return base.join(state, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def _links(classes: DataFrame, cosine: float, dim: int) -> DataFrame:
    radius = float(np.sqrt(2 - 2 * cosine))
    rows, kind = classes.count(), dict(classes.dtypes)["e"]
    pivots = pivots_of(classes, rows)
    sizes, reach = _cell_sizes(classes, pivots)
    width = dim * (4 if kind == "array<float>" else 8)
    most = max(1, min(DEALT_ROWS, DEALT_BYTES // width, max(PART, -(-rows // LEAST_BLOCKS))))
    blocks, many = _blocks(classes, pivots, radius, sizes, reach, most)
    sides = min(many, max(LEAST_BLOCKS, -(-rows * width // HELD_BYTES)))
    held = ["block", "rep", "w", "cell", "x"]
    one = blocks.select(*[F.col(c).alias(f"a_{c}") for c in held]).coalesce(sides)
    two = blocks.select("lower", *[F.col(c).alias(f"b_{c}") for c in held]).coalesce(sides)
    pairs = one.join(two, F.array_contains("lower", F.col("a_block"))).drop("lower")
    found = cut(_join(pairs, pivots, reach, radius, cosine, dim, kind), "links")
    forget(blocks)
    return found
