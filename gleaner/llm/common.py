"""Helpers that several corpus operators share: materialised intermediate
tables, bounded Arrow batches and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python worker at once; texts can be long, so it is small.
ARROW_ROWS = 512
#: A node with over one in so many of the links is a hub.
HUB_SHARE = 2000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Where the session
    names none a temporary folder is set on one machine; a cluster needs one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="gleaner-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: cuts lineage, survives lost executors and is compressed."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{checkpoint_dir(spark).rstrip('/')}/gleaner-{app}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.gleaner_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing lazy reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.gleaner_path)


def cleanup(spark: SparkSession) -> None:
    """Remove every intermediate table of this application."""
    _delete(spark, f"{checkpoint_dir(spark).rstrip('/')}/gleaner-{spark.sparkContext.applicationId}")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of at most ``n`` rows for the jobs run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batch, column: int, limit: int = 4 << 20):
    """Cut an Arrow batch into runs of rows whose ``column`` (string or binary)
    holds about ``limit`` bytes; a longer single value is a run of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def join_by_key(rows: DataFrame, sizes: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) with the columns of ``sizes``, which has one row a
    key and counts the key's rows as ``n``.  Keys with over ``1 / HUB_SHARE`` of all
    rows, so at most ``HUB_SHARE`` of them, are broadcast; others meet by a shuffle."""
    held = F.struct(*(c for c in sizes.columns if c != key))
    kept = sizes.select(key, held.alias("_held"))
    hot = F.broadcast(kept.where(F.col("_held.n") > max(64, total // HUB_SHARE)).withColumnRenamed("_held", "_hot"))
    told = rows.join(hot, key, "left")
    cold = told.where("_hot is null").drop("_hot").join(kept, key)
    return cold.unionByName(told.where("_hot is not null").withColumnRenamed("_hot", "_held")).select(*rows.columns, "_held.*")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (id, component): the smallest id reachable by links, for
    every id in a link.

    Alternates the large-star and small-star steps of map-reduce connected
    components: every round rewrites the edge table with two grouped minima
    and two joins, and stops when a round changes nothing.  Nothing is
    collected but a count and a checksum.  Self links and nulls are ignored;
    an empty table gives an empty result.

    Hubs, nodes with over ``1 / HUB_SHARE`` of all links, have their minimum
    broadcast (at most ``2 * HUB_SHARE`` rows at any size, as the links' ends
    are twice the links), and their links need no shuffle.
    """

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        hubs = F.broadcast(low.where(F.col("n") > max(64, n // HUB_SHARE)).select("u", F.col("m").alias("hub")))
        told = both.join(hubs, "u", "left")
        out = told.where("hub is null").join(low.select("u", "m"), "u").select("u", "v", "m").union(told.where("hub is not null").select("u", "v", "hub"))
        if large:
            out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, "edges")
    before = mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        half = materialize(star(e, True, before[0]), "edges")
        release(e)
        e = materialize(star(half, False, before[0]), "edges")
        release(half)
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle; raise max_rounds")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def spanning_labels(n: int, a: "np.ndarray", b: "np.ndarray") -> "np.ndarray":
    """The least row number connected to each of ``n`` rows by links a - b."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def usable(vector) -> "F.Column":
    """True for vectors with a direction: not null, not empty, every component
    finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def finite(vector) -> "F.Column":
    """True for vectors without null or non-finite components; false for null."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column) -> "np.ndarray":
    """An Arrow list column of equally long vectors as a float64 matrix."""
    import numpy as np

    if not len(column):
        return np.zeros((0, 0))
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: "np.ndarray") -> "np.ndarray":
    """Rows at length one; scaled first, so no component over- or underflows."""
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
