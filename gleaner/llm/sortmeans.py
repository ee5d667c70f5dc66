"""Centroid clustering by sort-means, exact in whole numbers.

Every component becomes the integer floor(``SCALE`` * x).  The vectors are packed
once into blocks of at most ``block_rows``, dealt to buckets by their number and
written as a bucketed table.  A round orders, for each centroid, the others by their
distance from it; a vector starts from the centroid it had before and looks at the
others in that order, until one lies strictly beyond twice the vector's distance
from its old centroid: neither it nor any later one can be nearer or as near.  A
round writes each block's centroid numbers (a byte or four a vector) and its sums,
so what moves from round to round is small: the next round joins it to the blocks
by bucket, and the blocks stay where they are.  Counts and sums are added by
Spark; the driver holds k centroids.

The first centroids are the ``k`` vectors of smallest hash (sha256 of the seed, a
colon and the vec_id).  Ties between centroids go to the smaller number; an empty
cluster keeps its centroid.

Edge cases: vectors that are null, of another length than ``dims``, or hold null or
non-finite components take no part.  Rows that repeat a vec_id are vectors of their
own (as first centroids they come in order of their components); rows without
vec_id are clustered, but are no first centroid unless all are.  With fewer than
``k`` vectors each is a first centroid; an empty table gives an empty result; other
columns are ignored.  Integers of 2**27 or more, whose squared distances may leave
64 bits, raise an error.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, finite, materialize, matrix, release

SCALE = 1024
_LIMIT = 1 << 27


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles as 64-bit integers."""
    out = np.floor(SCALE * x)
    if out.size and np.abs(out).max() >= _LIMIT:
        raise ValueError(f"a component of {_LIMIT // SCALE} or more: squared distances may leave 64 bits")
    return out.astype(np.int64)


def order_centroids(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, apart): for each centroid the others by rising squared distance from
    it, and those distances."""
    apart = ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")
    others = np.array([[j for j in row if j != i] for i, row in enumerate(order)], np.int64).reshape(len(c), len(c) - 1)
    return others, np.take_along_axis(apart, others, axis=1)


def assign(x: np.ndarray, before: np.ndarray, c: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances computed) of the rows of ``x``, which
    had the clusters ``before``."""
    cluster, best = before.copy(), ((x - c[before]) ** 2).sum(axis=1)
    computed = len(x)
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        reach = 4 * best[rows]  # twice the distance, squared
        for other, far in zip(order[a], apart[a], strict=True):
            rows, reach = rows[far <= reach], reach[far <= reach]
            if not len(rows):
                break
            d = ((x[rows] - c[other]) ** 2).sum(axis=1)
            computed += len(rows)
            won = (d < best[rows]) | ((d == best[rows]) & (other < cluster[rows]))
            best[rows[won]], cluster[rows[won]] = d[won], other
    return cluster, best, computed


def _blocks(vectors: DataFrame, dims: int, block_rows: int) -> DataFrame:
    """(block, ids, x): the vectors packed as 16- or 32-bit integers."""

    def run(batches):
        first, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for i in range(0, batch.num_rows, block_rows):
                part = batch.slice(i, block_rows)
                x = integers(matrix(part.column(1)))
                kind = np.int16 if np.abs(x).max() < 1 << 15 else np.int32
                yield pa.RecordBatch.from_pydict({"block": pa.array([first + n], pa.int64()), "ids": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), "x": [x.astype(kind).tobytes()]})
                n += 1

    rows = vectors.where((F.size("embedding") == dims) & finite(F.col("embedding"))).select(F.col("vec_id").cast("long"), "embedding")
    return rows.mapInArrow(run, "block long, ids array<long>, x binary")


def _bucketed(blocks: DataFrame) -> DataFrame:
    """``blocks`` as a table bucketed by number, its files in the shared folder."""
    spark = blocks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"gleaner_blocks_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/gleaner-{spark.sparkContext.applicationId}/{name}"
    blocks.repartition(n, "block").write.bucketBy(n, "block").option("path", path).saveAsTable(name)
    return spark.table(name)


def _unpack(n: int, data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if len(data) == 2 * n * dims else np.int32).reshape(n, dims).astype(np.int64)


def first_centroids(vectors: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where((F.size("embedding") == dims) & finite(F.col("embedding"))).select(key.alias("h"), "embedding").orderBy(F.col("h").asc_nulls_last(), "embedding").limit(k).collect()
    return integers(np.array([r.embedding for r in rows], np.float64).reshape(len(rows), dims))


def _round(blocks: DataFrame, before: DataFrame | None, c: np.ndarray, last: bool) -> DataFrame:
    """One assignment of all blocks: (block, assigned, count, total), or with
    ``last`` (vec_id, cluster, distance)."""
    order, apart = order_centroids(c)
    k, dims = c.shape
    kind = np.uint8 if k <= 256 else np.int32

    def run(batches):
        for batch in batches:
            for block, ids, data, old in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                x = _unpack(len(ids), data, dims)
                start = np.zeros(len(ids), np.int64) if old is None else np.frombuffer(old, kind).astype(np.int64)
                cluster, d, _ = assign(x, start, c, order, apart)
                if last:
                    yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "cluster": cluster.astype(np.int32), "distance": d})
                    continue
                count, total = np.bincount(cluster, minlength=k), np.zeros((k, dims), np.int64)
                np.add.at(total, cluster, x)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "assigned": [cluster.astype(kind).tobytes()], "held": pa.array([count.tolist() + total.ravel().tolist()], pa.list_(pa.int64()))})

    rows = blocks.withColumn("assigned", F.lit(None).cast("binary")) if before is None else blocks.join(before.hint("shuffle_hash"), "block")
    rows = rows.select("block", "ids", "x", "assigned")
    return rows.mapInArrow(run, "vec_id long, cluster int, distance long" if last else "block long, assigned binary, held array<long>")


def _moved(c: np.ndarray, state: DataFrame) -> np.ndarray:
    """Centroids at the floor of their vectors' mean."""
    k, dims = c.shape
    sums = state.select(F.posexplode("held").alias("at", "held")).groupBy("at").agg(F.sum(F.col("held").cast("decimal(38,0)")).alias("held")).collect()
    held = [0] * (k + k * dims)
    for r in sums:
        held[r.at] = int(r.held)
    out = c.copy()
    for i in range(k):
        if held[i]:
            out[i] = [s // held[i] for s in held[k + i * dims : k + (i + 1) * dims]]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, block_rows: int = 8192) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) after ``rounds`` rounds and a last
    assignment; ``distance`` is squared."""
    spark = vectors.sparkSession
    c = first_centroids(vectors, k, dims, seed)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), c
    blocks, state = _bucketed(_blocks(vectors, dims, block_rows)), None
    for _ in range(rounds):
        new = materialize(_round(blocks, state, c, False), "sortmeans")
        if state is not None:
            release(state)
        state, c = new, _moved(c, new)
    return materialize(_round(blocks, state, c, True), "sortmeans-last"), c


def digest(assigned: DataFrame, c: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = assigned.sparkSession
    sums = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    rows = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for i, x in enumerate(c)]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
