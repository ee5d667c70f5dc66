"""Nearest neighbours by cosine with vantage-point trees per shard.

A top tree, fitted on at most ``sample_rows`` vectors, cuts space into at most
``max_regions`` regions; every vector belongs to one.  A region is dealt by a hash
into shards of about ``shard_rows``, and each shard's tree (the split is the
median distance to a vantage point) is built once and kept as one row.  Queries
first search their own region.  With the distance of the k-th best found there,
they then visit only the regions that the triangle inequality does not rule out,
and skip branches of their trees by the same rule: what lies farther than
``factor`` times the distance of the k-th best so far is left.  Factor 1 is exact
search; smaller factors skip more.  On unit vectors the Euclidean distance orders
as the cosine does.  Finalists are scored again, row by row in double precision
on the original vectors, and results are merged by query.

A task holds a shard's tree and a block of at most ``query_rows`` queries.  On
vectors without structure no region can be ruled out at factor 1.

Edge cases: null, empty or zero vectors, and those with null or non-finite
components, take no part as query or candidate; so do rows without vec_id.
Vectors of another length than the query's are no candidates.  Rows that share
the query's vec_id are its own; a vec_id that repeats is one query (its smallest
vector) but every row is a candidate.  Ties go to the smaller vec_id, with fewer
than k candidates all are returned; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, matrix, release, unit, usable

_EPS = 1e-7
_FOUND = "query_id long, vec_id long, score double"


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def _build(x: np.ndarray, rows: np.ndarray, leaf: int, rng) -> tuple:
    """(rows,) for a leaf, else (vantage vector, radius, inside, outside)."""
    if len(rows) <= leaf:
        return (rows,)
    vantage = x[int(rng.choice(rows))]
    d = _distance(x[rows] @ vantage)
    radius = float(np.median(d))
    inside = d <= radius
    if inside.all():  # many equal vectors
        return (rows,)
    return vantage, radius, _build(x, rows[inside], leaf, rng), _build(x, rows[~inside], leaf, rng)


def top_tree(x: np.ndarray, regions: int) -> tuple:
    """A tree over a sample whose leaves hold the number of a region."""
    tree = _build(x, np.arange(len(x)), max(1, math.ceil(len(x) / max(1, regions))), np.random.default_rng(11))
    numbers = iter(range(len(x)))

    def named(node: tuple) -> tuple:
        return (next(numbers),) if len(node) == 1 else (*node[:2], named(node[2]), named(node[3]))

    return named(tree)


def region_of(tree: tuple, u: np.ndarray) -> np.ndarray:
    """The region of each unit row."""
    out = np.zeros(len(u), np.int32)
    todo = [(tree, np.arange(len(u)))]
    while todo:
        node, rows = todo.pop()
        if len(node) == 1:
            out[rows] = node[0]
        elif len(rows):
            inside = _distance(u[rows] @ node[0]) <= node[1]
            todo += [(node[2], rows[inside]), (node[3], rows[~inside])]
    return out


def regions_near(tree: tuple, u: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, region) of the regions that may hold something within ``reach``."""
    rows_out, regions, todo = [], [], [(tree, np.arange(len(u)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if len(node) == 1:
            rows_out.append(rows)
            regions.append(np.full(len(rows), node[0], np.int32))
        else:
            d = _distance(u[rows] @ node[0])
            todo += [(node[2], rows[d - node[1] <= reach[rows]]), (node[3], rows[node[1] - d <= reach[rows]])]
    return np.concatenate([np.zeros(0, np.int64), *rows_out]), np.concatenate([np.zeros(0, np.int32), *regions])


class Searcher:
    """The k nearest of each query among ``x`` (unit rows with ``ids``)."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int, factor: float, leaf: int = 256, tree: tuple | None = None):
        self.x, self.ids, self.k, self.factor, self.keep = x, ids, k, factor, 2 * k + 2
        self.tree = tree if tree is not None else _build(x, np.arange(len(x)), leaf, np.random.default_rng(7))
        self.compared = 0

    def search(self, q: np.ndarray, own: np.ndarray, reach: np.ndarray | None = None) -> np.ndarray:
        """Row numbers of the nearest, -1 where there are fewer; a few more than
        k, for ties.  What is farther than ``reach`` is not looked for."""
        self.q, self.own = q, own
        self.limit = np.full(len(q), np.inf) if reach is None else reach
        self.best = np.full((len(q), self.keep), -np.inf)
        self.rows = np.full((len(q), self.keep), -1)
        self._walk(self.tree, np.arange(len(q)))
        return self.rows

    def _reach(self, active: np.ndarray) -> np.ndarray:
        kth = self.best[active, self.k - 1]
        return np.minimum(np.where(np.isinf(kth), np.inf, _distance(kth)), self.limit[active]) * self.factor + _EPS

    def _walk(self, node: tuple, active: np.ndarray) -> None:
        if not len(active):
            return
        if len(node) == 1:
            return self._leaf(node[0], active)
        vantage, radius, inside, outside = node
        d = _distance(self.q[active] @ vantage)
        near = d <= radius
        reach = self._reach(active)
        self._walk(inside, active[near & (d - radius <= reach)])
        self._walk(outside, active[~near & (radius - d <= reach)])
        reach = self._reach(active)
        self._walk(outside, active[near & (radius - d <= reach)])
        self._walk(inside, active[~near & (d - radius <= reach)])

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        for i in range(0, len(rows), 4096):  # a leaf of equal vectors may be long
            part = rows[i : i + 4096]
            self.compared += len(part) * len(active)
            s = self.q[active] @ self.x[part].T
            s[self.own[active][:, None] == self.ids[part][None, :]] = -np.inf
            s = np.concatenate([self.best[active], s], axis=1)
            r = np.concatenate([self.rows[active], np.broadcast_to(part, (len(active), len(part)))], axis=1)
            top = np.argpartition(-s, self.keep - 1, axis=1)[:, : self.keep]
            s, r = np.take_along_axis(s, top, 1), np.take_along_axis(r, top, 1)
            order = np.argsort(-s, axis=1, kind="stable")
            s, r = np.take_along_axis(s, order, 1), np.take_along_axis(r, order, 1)
            self.best[active], self.rows[active] = s, np.where(np.isinf(s), -1, r)


def _spare_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows without the copies of one vector that come after the first k + 1 by
    id: ties go to smaller ids, so no query can need them."""
    order = np.argsort(ids, kind="stable")
    _, group = np.unique(np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)
    by = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(group[by]) != 0])
    turn = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    return order[by[turn <= k]]


def _top_trees(base: DataFrame, rows: int, shard_rows: int, sample_rows: int, max_regions: int) -> dict:
    """A top tree per vector length, from the rows of smallest hash."""
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").collect()
    by: dict = {}
    for r in sample:
        by.setdefault(len(r.embedding), []).append(r.embedding)
    regions = min(max_regions, math.ceil(rows / shard_rows))
    return {d: top_tree(unit(np.array(x, float)), math.ceil(regions * len(x) / len(sample))) for d, x in by.items()}


def _placed(rows: DataFrame, trees, column: int) -> DataFrame:
    """``rows`` with ``dim`` and ``region`` (0 where no sample had its length)."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            dims = np.array([len(v) for v in batch.column(column)], np.int32)
            region = np.zeros(len(dims), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d in trees.value:
                    region[at] = region_of(trees.value[d], unit(matrix(batch.take(pa.array(at)).column(column))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(region)], names=[*names, "dim", "region"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, dim int, region int")


def _shards(placed: DataFrame, k: int, shard_rows: int, leaf: int) -> DataFrame:
    """(dim, region, shard, held): one row a shard, with its vectors, ids and tree."""
    sizes = placed.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    # At most max_regions rows a vector length, so the sizes are broadcast.
    dealt = placed.join(F.broadcast(sizes), ["dim", "region"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    arrow = pa.schema([("dim", pa.int32()), ("region", pa.int32()), ("shard", pa.int32()), ("held", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        ids, x = table.column("vec_id").to_numpy(), matrix(table.column("embedding"))
        kept = _spare_copies(x, ids, k)
        x, ids = x[kept], ids[kept]
        tree = _build(unit(x), np.arange(len(x)), leaf, np.random.default_rng(7))
        return pa.table([table.column("dim")[:1], table.column("region")[:1], table.column("shard")[:1], pa.array([pickle.dumps((ids, x, tree))], pa.binary())], schema=arrow)

    return dealt.select("dim", "region", "shard", "vec_id", "embedding").groupBy("dim", "region", "shard").applyInArrow(run, "dim int, region int, shard int, held binary")


def _searched(asked: DataFrame, shards: DataFrame, k: int, factor: float, query_rows: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query (query_id, embedding,
    reach) in each shard of its dim and region."""
    sizes = asked.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("blocks"))
    dealt = asked.join(sizes, ["dim", "region"]).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("blocks")).cast("int"))
    packed = pa.schema([("dim", pa.int32()), ("region", pa.int32()), ("asked", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        rows = table.column("query_id").to_numpy(), matrix(table.column("embedding")), table.column("reach").to_numpy()
        return pa.table([table.column("dim")[:1], table.column("region")[:1], pa.array([pickle.dumps(rows)], pa.binary())], schema=packed)

    # At most max_regions rows a vector length.
    parts = F.broadcast(shards.groupBy("dim", "region").agg(F.max("shard").alias("last")))
    blocks = dealt.groupBy("dim", "region", "block").applyInArrow(pack, "dim int, region int, asked binary")
    blocks = materialize(blocks.join(parts, ["dim", "region"]).withColumn("shard", F.explode(F.sequence(F.lit(0), "last"))).drop("last"), "vp-blocks")

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids, x, tree = pickle.loads(batch.column(0)[i].as_py())
                own, q, reach = pickle.loads(batch.column(1)[i].as_py())
                yield _scored(ids, x, tree, own, q, reach, k, factor)

    met = shards.join(blocks, ["dim", "region", "shard"]).select("held", "asked").mapInArrow(run, _FOUND)
    with arrow_rows(asked.sparkSession, 2):  # such a row may hold megabytes
        found = materialize(met, "vp-found")
    release(blocks)
    return found


def _scored(ids, x, tree, own, q, reach, k: int, factor: float) -> pa.RecordBatch:
    rows = Searcher(unit(x), ids, k, factor, tree=tree).search(unit(q), own, reach)
    turn, col = np.nonzero(rows >= 0)
    a, b = q[turn], x[rows[turn, col]]
    # Row by row, so equal vectors get equal scores.
    with np.errstate(all="ignore"):
        score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    score = np.where(np.isfinite(score), score, (unit(a) * unit(b)).sum(axis=1) if len(a) else score)
    found = ids[rows[turn, col]]
    order = np.lexsort((found, -score, turn))
    turn, found, score = turn[order], found[order], score[order]
    starts = np.flatnonzero(np.r_[True, np.diff(turn) != 0]) if len(turn) else np.zeros(0, int)
    place = np.arange(len(turn)) - np.repeat(starts, np.diff(np.r_[starts, len(turn)]))
    first = place < k
    return pa.RecordBatch.from_pydict({"query_id": own[turn[first]], "vec_id": found[first], "score": score[first]})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, shard_rows: int = 4096, query_rows: int = 2048, leaf: int = 256, sample_rows: int = 8192, max_regions: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest ``vectors``;
    both tables hold vec_id and embedding."""
    spark = vectors.sparkSession
    good = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    base = vectors.where(good).select(F.col("vec_id").cast("long"), "embedding")
    asked = queries.where(good).groupBy(F.col("vec_id").cast("long").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    rows = base.count()
    trees = spark.sparkContext.broadcast(_top_trees(base, rows, shard_rows, sample_rows, max_regions))
    shards = materialize(_shards(_placed(base, trees, 1), k, shard_rows, leaf), "vp-trees")
    at_home = materialize(_placed(asked.withColumn("reach", F.lit(float("inf"))), trees, 1), "vp-queries")
    first = _searched(at_home, shards, k, factor, query_rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = first.withColumn("rank", rank)
    kth = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))

    def route(batches):
        for batch in batches:
            dims, home = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            kth = batch.column(4).to_numpy(zero_copy_only=False).astype(float)
            reach = np.where(np.isnan(kth), np.inf, _distance(np.nan_to_num(kth)) * (1 + 1e-12) + _EPS)
            for d in np.unique(dims):
                if d not in trees.value:
                    continue
                at = np.flatnonzero(dims == d)
                row, region = regions_near(trees.value[d], unit(matrix(batch.take(pa.array(at)).column(1))), reach[at] * factor + _EPS)
                row = at[row]
                away = region != home[row]
                row, region = row[away], region[away]
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(reach[row]), taken.column(2), pa.array(region)], names=["query_id", "embedding", "reach", "dim", "region"])

    kind = at_home.schema["embedding"].dataType.simpleString()
    routed = at_home.select("query_id", "embedding", "dim", "region").join(kth, "query_id", "left").mapInArrow(route, f"query_id long, embedding {kind}, reach double, dim int, region int")
    found = first.union(_searched(routed, shards, k, factor, query_rows))
    release(shards, at_home)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
