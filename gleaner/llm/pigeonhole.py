"""Near-duplicate vectors: a subspace pigeonhole join.

On unit vectors cosine >= t means a squared distance of at most 2 - 2t.  Vectors
are rotated at random and split into blocks of ``block_dims`` coordinates; some
block of a linked pair then keeps to its proportional share of that budget.
Each block is range-joined on its first ``RANGED`` coordinates: rows fall into
cells of the block's radius along each, and only equal and adjacent cells can
meet.  The first coordinate's cells deal the work: a unit is one pair of them,
or of chunks of them where a cell has more than ``chunk_rows`` rows, so no task
holds more than two chunks; inside a unit the other coordinates' cells say which
rows meet.  A candidate pair is taken up in the first block whose budget it
keeps, so once, and verified there by its cosine in double precision on the
original vectors (scaled by a power of two, which is exact).

On vectors without structure every block keeps a fixed share of all pairs, so
the work still grows with the square of the rows.

A task returns how many links each of its vectors gained and a spanning star of
the components it saw, never the pairs, so dense groups do not swell the output.
Equal vectors are merged first and counted.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without vec_id, link with nothing (0 links, their own
component, kept).  Vectors of different length never link.  Rows that share a
vec_id share links and component.  Extra columns are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, matrix, spanning_labels, unit, usable

_SLACK = 1 + 1e-9
#: Coordinates of a block that are cut into cells.
RANGED = 3
#: Coordinates of a block that are compared before the others.
FIRST = 8
_UNIT = ("dim", "block", "cell", "step", "i", "j")


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_starts(dim: int, block_dims: int) -> np.ndarray:
    return np.arange(0, dim, block_dims)


def budgets(dim: int, block_dims: int, threshold: float) -> np.ndarray:
    """The squared distance each block may use, in proportion to its size."""
    width = np.minimum(block_dims, dim - block_starts(dim, block_dims))
    return (2 - 2 * threshold) * width / dim * _SLACK


def block_distances(a: np.ndarray, b: np.ndarray, block_dims: int) -> np.ndarray:
    """Squared distance per block of rotated rows, the same from either side."""
    return np.add.reduceat((a - b) ** 2, block_starts(a.shape[1], block_dims), axis=1)


def _radii(dim: int, block_dims: int, threshold: float) -> np.ndarray:
    return np.sqrt(budgets(dim, block_dims, threshold)) * _SLACK


def _cells(x: np.ndarray, block_dims: int, threshold: float) -> np.ndarray:
    """(rows, blocks): the cell of each row along each block's first axis."""
    dim = x.shape[1]
    return np.floor((x @ rotation(dim))[:, block_starts(dim, block_dims)] / _radii(dim, block_dims, threshold)).astype(np.int64)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component near one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _near(low: np.ndarray, left: np.ndarray, right: np.ndarray, radius: float, budget: float):
    """Pairs (rows of left, rows of right) whose block coordinates ``low`` are
    within the budget; both sides are sorted into cells along the second and
    third coordinate, and only adjacent cells are multiplied."""
    ranged = min(RANGED, low.shape[1])
    cells = np.floor(low[:, 1:ranged] / radius).astype(np.int64)
    cells -= cells.min(axis=0, initial=0) - 1 if len(cells) else 0
    width = int(cells[:, -1].max(initial=0)) + 2 if ranged > 1 else 1
    key = cells[:, 0] * width + cells[:, 1] if ranged == 3 else (cells[:, 0] if ranged == 2 else np.zeros(len(low), np.int64))
    left, right = left[np.argsort(key[left], kind="stable")], right[np.argsort(key[right], kind="stable")]
    lk, rk = key[left], key[right]
    few = low[:, :FIRST]
    size = (few * few).sum(axis=1)
    ones = np.ones((len(low), 1))
    # One product gives the first coordinates' squared distance less the budget.
    a = np.concatenate([-2 * few, size[:, None] - budget - 1e-4, ones], axis=1).astype(np.float32)[left]
    b = np.concatenate([few, ones, size[:, None]], axis=1).astype(np.float32)[right].T
    cuts = np.flatnonzero(np.r_[True, np.diff(lk) != 0]) if len(lk) else np.zeros(0, int)
    for s, e in zip(cuts, np.r_[cuts[1:], len(lk)], strict=True):
        for turn in (-1, 0, 1) if ranged == 3 else (0,):
            k = lk[s] + turn * width
            f, t = np.searchsorted(rk, [k - (ranged > 1), k + 1 + (ranged > 1)])
            for c in range(s, e, 2048):
                i, j = np.nonzero(a[c : min(c + 2048, e)] @ b[:, f:t] <= 0)
                for h in range(0, len(i), 1 << 16):
                    p, q = left[c + i[h : h + (1 << 16)]], right[f + j[h : h + (1 << 16)]]
                    near = ((low[p] - low[q]) ** 2).sum(axis=1) <= budget + 1e-9
                    yield p[near], q[near]


def _units(cells: np.ndarray, h: np.ndarray, many: dict):
    """(key columns, sides, rows) of the units that rows go to: for each pair of
    chunks of equal or adjacent cells its cell, the step to the other, and the
    chunk of either.  ``many``: chunks of each cell."""
    own, back = np.unique(cells, return_inverse=True)
    n, after, before = (np.array([many.get(int(c) + d, 0) for c in own], np.int64)[back] for d in (0, 1, -1))
    me = (h % n.astype(np.uint64)).astype(np.int64)
    for j in range(int(n.max(initial=0))):
        r = np.flatnonzero(n > j)
        yield (cells[r], np.zeros(len(r), np.int64), np.minimum(me[r], j), np.maximum(me[r], j)), (me[r] > j).astype(np.int8), r
    for j in range(int(after.max(initial=0))):
        r = np.flatnonzero(after > j)
        yield (cells[r], np.ones(len(r), np.int64), me[r], np.full(len(r), j)), np.zeros(len(r), np.int8), r
    for j in range(int(before.max(initial=0))):
        r = np.flatnonzero(before > j)
        yield (cells[r] - 1, np.ones(len(r), np.int64), np.full(len(r), j), me[r]), np.ones(len(r), np.int8), r


def links(classes: DataFrame, threshold: float = 0.95, block_dims: int = 16, chunk_rows: int = 16384) -> DataFrame:
    """(a, b, n) from (id, copies, embedding): rows with b null say that a gained
    links to n vectors of other classes, rows with b that a and b are
    connected."""
    spark = classes.sparkSession

    def census(batches):
        held: dict = {}
        for batch in batches:
            by = np.array([len(v) for v in batch.column(1)])
            for dim in np.unique(by):
                x = unit(matrix(batch.filter(pa.array(by == dim)).column(1)))
                for k, cells in enumerate(_cells(x, block_dims, threshold).T):
                    for cell, n in zip(*np.unique(cells, return_counts=True), strict=True):
                        held[dim, k, cell] = held.get((dim, k, cell), 0) + n
        if held:
            dim, k, cell = zip(*held, strict=True)
            yield pa.RecordBatch.from_pydict({"dim": pa.array(dim, pa.int64()), "block": pa.array(k, pa.int64()), "cell": pa.array(cell, pa.int64()), "n": pa.array(held.values(), pa.int64())})

    counted = classes.select("id", "embedding").mapInArrow(census, "dim long, block long, cell long, n long").groupBy("dim", "block", "cell").agg(F.sum("n").alias("n"))
    # At most 2 / radius cells a block: their number does not grow with the rows.
    chunks = spark.sparkContext.broadcast({(r.dim, r.block, r.cell): math.ceil(r.n / chunk_rows) for r in counted.collect()})

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            by = np.array([len(v) for v in batch.column(2)])
            for dim in np.unique(by):
                at = np.flatnonzero(by == dim)
                cells = _cells(unit(matrix(batch.take(pa.array(at)).column(2))), block_dims, threshold)
                h = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                for k in range(cells.shape[1]):
                    for key, side, rows in _units(cells[:, k], h, {c: n for (d, b, c), n in chunks.value.items() if d == dim and b == k}):
                        part = batch.take(pa.array(at[rows]))
                        fixed = [pa.array(np.full(len(rows), v, np.int32)) for v in (dim, k)]
                        yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(x) for x in key), pa.array(side), *part.columns], names=[*_UNIT, "side", "id", "copies", "embedding"])

    kind = classes.schema["embedding"].dataType.simpleString()
    dealt = classes.select("id", "copies", "embedding").mapInArrow(deal, f"dim int, block int, cell long, step long, i long, j long, side byte, id long, copies long, embedding {kind}")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def join(table: pa.Table) -> pa.Table:
        dim, k, _, step, i, j = (table.column(c)[0].as_py() for c in _UNIT)
        side = table.column("side").to_numpy()
        ids, copies, x = table.column("id").to_numpy(), table.column("copies").to_numpy(), matrix(table.column("embedding"))
        same = step == 0 and i == j
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 0 if same else side == 1)
        if not len(left) or not len(right):
            return arrow.empty_table()
        u, x = unit(x) @ rotation(dim), _scaled(x)
        norm = np.sqrt((x * x).sum(axis=1))
        allowed, low = budgets(dim, block_dims, threshold), u[:, k * block_dims : (k + 1) * block_dims]
        gained, found = np.zeros(len(ids), np.int64), []
        for a, b in _near(low, left, right, _radii(dim, block_dims, threshold)[k], allowed[k]):
            if same:
                a, b = a[a < b], b[a < b]
            for c in range(0, len(a), 1 << 15):
                p, q = a[c : c + (1 << 15)], b[c : c + (1 << 15)]
                fits = block_distances(u[p], u[q], block_dims) <= allowed
                first = fits[:, k] & ~fits[:, :k].any(axis=1)
                p, q = p[first], q[first]
                linked = (x[p] * x[q]).sum(axis=1) / (norm[p] * norm[q]) >= threshold
                p, q = p[linked], q[linked]
                gained += np.bincount(p, copies[q], len(ids)).astype(np.int64) + np.bincount(q, copies[p], len(ids)).astype(np.int64)
                found.append((p, q))
        p, q = (np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
        if not len(p):
            return arrow.empty_table()
        order = np.argsort(ids, kind="stable")  # so the least row is the least id
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        label = spanning_labels(len(ids), place[p], place[q])
        tied = np.flatnonzero(label != np.arange(len(label)))
        some = np.flatnonzero(gained)
        return pa.table([np.r_[ids[some], ids[order[tied]]], pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[order[label[tied]]])]), np.r_[gained[some], np.zeros(len(tied), np.int64)]], schema=arrow)

    return dealt.groupBy(*_UNIT).applyInArrow(join, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, block_dims: int = 16, chunk_rows: int = 16384) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors``."""
    good = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", good.alias("good"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    classes = materialize(rows.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")), "vec-classes")
    told = materialize(links(classes, threshold, block_dims, chunk_rows), "vec-links")
    counts = told.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    found = connected_components(told.where("b is not null").select("a", "b"))
    placed = classes.join(counts, "id", "left").join(found, "id", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"), F.lit(True).alias("good"))
    out = rows.select("vec_id", "h1", "h2", "good").join(placed, ["h1", "h2", "good"], "left")
    own = F.coalesce("component", "vec_id").alias("component_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own, F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"))
