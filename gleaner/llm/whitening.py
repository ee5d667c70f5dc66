"""Whitening of embeddings by tiled covariance.

Each component c becomes x = floor(``SCALE`` * c) + ``SHIFT``.  Rows are packed into
row-blocks, and each row-block into column blocks of ``tile`` dimensions.  Pairs of
column blocks are the tiles of the covariance matrix.  The column blocks meet by
row-block in one shuffle; a task multiplies the centred tile pairs of one row-block
after another (bounded: ``block_rows`` rows at a time) and adds them up, so it sends
one partial sum a tile, and Spark sums per tile key.  The driver assembles the
matrix (dimensions squared, whatever the rows) and takes its eigenvectors; a last
pass projects every row.  The same tiled covariance, of the whitened rows, tells how
far they are from white.

Edge cases: vectors that are null or hold null or non-finite components take no part,
nor do those of another length than most (ties: the longer); without any, or if most
are empty, the result is empty.  Components whose eigenvalue is nought but for
rounding (fewer rows than dimensions, equal vectors) have no scale and are left out.
Repeated rows count each; a null vec_id stays null; other columns are ignored.  A
``deviation`` beyond 64 bits is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite, matrix

SCALE, SHIFT = 1024, 100_000


def scaled(c: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT of doubles, exact while below 2**53."""
    return np.floor(SCALE * c) + SHIFT


def fitted(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) that take part, and their length."""
    rows = vectors.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long"), "embedding")
    most = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = most.dims if most else 0
    return rows.where(F.size("embedding") == dims), dims


def sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(n, S): the number of rows and the exact sum of x in every dimension."""

    def run(batches):
        n, s = 0, [0] * dims
        for batch in filter(len, batches):
            n += batch.num_rows
            x = scaled(matrix(batch.column(0)))
            if np.abs(x).max(initial=0) < 1 << 40:  # a batch's sum stays far from 2**63
                s = [a + int(b) for a, b in zip(s, x.astype(np.int64).sum(axis=0), strict=True)]
            else:
                s = [a + sum(map(int, col)) for a, col in zip(s, x.T, strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(-1, dims), pa.int32()), "s": list(map(str, [n, *s]))})

    parts = rows.select("embedding").mapInArrow(run, "at int, s string")
    held = {r.at: int(r.s) for r in parts.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return held.get(-1, 0), [held.get(i, 0) for i in range(dims)]


def column_blocks(rows: DataFrame, make, tile: int, block_rows: int) -> DataFrame:
    """(row_block, col_block, n, data): ``make`` turns the rows' Arrow column into a
    centred matrix; blocks are of float64."""

    def run(batches):
        first, at = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for i in range(0, batch.num_rows, block_rows):
                y = make(matrix(batch.column(0).slice(i, block_rows)))
                cols = range(0, y.shape[1], tile)
                yield pa.RecordBatch.from_pydict({
                    "row_block": pa.array([first + at] * len(cols), pa.int64()), "col_block": pa.array([j // tile for j in cols], pa.int32()),
                    "n": pa.array([len(y)] * len(cols), pa.int32()), "data": [np.ascontiguousarray(y[:, j : j + tile]).tobytes() for j in cols],
                })
                at += 1

    return rows.select("embedding").mapInArrow(run, "row_block long, col_block int, n int, data binary")


def tile_sums(blocks: DataFrame) -> DataFrame:
    """(i, j, at, s): entries of the summed products of column blocks i <= j."""

    def run(batches):
        tiles, held, now = {}, [], None

        def multiply():
            for a, x in held:
                for b, y in held:
                    if a <= b:
                        p = x.T @ y
                        tiles[a, b] = tiles[a, b] + p if (a, b) in tiles else p
            held.clear()

        for batch in batches:
            for row, col, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row != now:
                    multiply()
                    now = row
                held.append((col, np.frombuffer(data).reshape(n, -1)))
        multiply()
        for (a, b), p in tiles.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([a] * p.size, pa.int32()), "j": pa.array([b] * p.size, pa.int32()), "at": pa.array(range(p.size), pa.int32()), "s": p.ravel()})

    dealt = blocks.repartition("row_block").sortWithinPartitions("row_block", "col_block")
    return dealt.mapInArrow(run, "i int, j int, at int, s double").groupBy("i", "j", "at").agg(F.sum("s").alias("s"))


def covariance(rows: DataFrame, make, width: int, n: int, tile: int = 16, block_rows: int = 2048) -> np.ndarray:
    """The covariance (divisor n) of the rows that ``make`` centres, by tiles."""
    tile = min(tile, width)
    out = np.zeros((width, width))
    for r in tile_sums(column_blocks(rows, make, tile, block_rows)).collect():  # width squared at most
        across = min(tile, width - r.j * tile)
        a, b = r.i * tile + r.at // across, r.j * tile + r.at % across
        out[a, b] = out[b, a] = r.s / n
    return out


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), falling; those without scale
    left out; each vector's largest entry is positive."""
    values, vectors = np.linalg.eigh(v)
    keep = [i for i in np.argsort(-values, kind="stable")[:most] if values[i] > 1e-12 * max(np.trace(v), 0)]
    w = vectors[:, keep]
    return values[keep], w * np.where(np.take_along_axis(w, np.abs(w).argmax(axis=0)[None], 0) < 0, -1, 1) if keep else w


def whiten(vectors: DataFrame, most: int = 8, tile: int = 16, block_rows: int = 2048) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row
    for each vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, dims = fitted(vectors)
    n, s = sums(rows, dims) if dims else (0, [])
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    whole = np.array([t // n for t in s], np.float64)
    rest = np.array([t % n / n for t in s])

    def centred(c):
        return (scaled(c) - whole) - rest

    v = covariance(rows, centred, dims, n, tile, block_rows)
    e, w = components(v, most)
    if not len(e):
        return vectors.sparkSession.createDataFrame([], schema)
    w = w / np.sqrt(e)

    def white(c):
        return centred(c) @ w

    def white_sums(batches):
        total = np.zeros(len(e))
        for batch in filter(len, batches):
            total += white(matrix(batch.column(0))).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(e)), pa.int32()), "s": total})

    means = {r.at: r.s / n for r in rows.select("embedding").mapInArrow(white_sums, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()}
    mean = np.array([means[i] for i in range(len(e))])
    error = float(np.abs(covariance(rows, lambda c: white(c) - mean, len(e), n, tile, block_rows) - np.eye(len(e))).max())
    explained = (e / np.trace(v)).tolist()
    bound = float(3e9 / np.sqrt(dims))

    def deviation(c):
        x = scaled(c)
        if np.abs(x).max(initial=0) * n < 2**62 and (np.abs(centred(c)).max(initial=0) + 1) * n < bound:
            return ((n * x.astype(np.int64) - np.array(s, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * int(b) - t) ** 2 for b, t in zip(r, s, strict=True)) for r in x]
        return [d if d < 1 << 63 else None for d in exact]

    def project(batches):
        k = len(e)
        for batch in batches:
            for i in range(0, batch.num_rows, block_rows):
                part = batch.slice(i, block_rows)
                c = matrix(part.column(1))
                m = len(c)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array([d for d in deviation(c) for _ in range(k)], pa.int64()), pa.array(white(c).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "embedding").mapInArrow(project, schema)
