"""MinHash near-duplicates with tensored banding.

A document's set holds its distinct five-word shingles.  Two collections of
``HALVES`` half keys (``WIDTH`` minhashes each) are computed, and every pair of
a first and a second half forms the key of one table: ``HALVES**2`` tables from
``2 * HALVES * WIDTH`` minhashes, about the square root of what separate tables
would need.  Two documents are candidates if some table holds both, that is if
they share at least one half of each collection; at Jaccard 0.75 that fails for
about two pairs in ten thousand, and less above.  A first half that only one
document has can meet nobody, so its row of tables is never written.

Documents with equal sets are first merged, so copies cost one row each.
Candidates are confirmed on full shingle sets in two steps, without listing the
pairs of a bucket: first each document against the smallest document it met.
Buckets that then still hold several components are joined to clusters.  In a
cluster the documents that share a first half are compared exactly, whatever its size.
One that fits into one block (``BLOCK_BYTES`` of sets, ``BLOCK_ROWS`` documents)
goes to one task as a whole, which looks at the pairs that share a half; a larger one
goes by halves, in such blocks, a task per pair of blocks of one half.  A task
returns links between components that it joins, not the pairs, and a block whose
documents are in one component already is left.  No bucket or partner is capped.

Edge cases: null, empty or blank texts have no set (0 shingles) and link with
nothing; a text of fewer than five words has one shingle, its word sequence; a
row without doc_id links with nothing, has a null component and is kept; rows
that share a doc_id are one document, linked through all their texts, and get
its component; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_by_key, materialize, release, slices, small_batches, spanning_labels

WORDS = 5
HALVES = 17
WIDTH = 3
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 512
_N = 2 * HALVES * WIDTH
_PARTS = 16
_SEEDS = np.random.default_rng(20240607)
_XOR = _SEEDS.integers(0, 2**63, _N, dtype=np.uint64)
_MUL = _SEEDS.integers(0, 2**63, _N, dtype=np.uint64) | np.uint64(1)
_JOIN = _SEEDS.integers(0, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
_PLACE = _SEEDS.integers(0, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles."""
    # bytes.lower() lowers A-Z alone; bytes.split() parts at space and 9-13.
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    n = len(h) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(_mix(total))


def minhashes(found: np.ndarray) -> np.ndarray:
    """The ``_N`` minima; long sets go through in parts."""
    low = np.full(_N, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 8192):
        low = np.minimum(low, ((found[i : i + 8192, None] ^ _XOR) * _MUL).min(axis=0))
    return low


def half_keys(found: np.ndarray) -> np.ndarray:
    """(2, HALVES) keys of the two collections."""
    low = _mix(minhashes(found)).reshape(2, HALVES, WIDTH)
    return _mix((low * _JOIN).sum(axis=2, dtype=np.uint64) + np.arange(HALVES, dtype=np.uint64))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, digest, first, second) of every row; digest is
    null without words, mark a hash that tells texts of one doc_id apart."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sizes, digests, first, second = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text)
                    sizes.append(len(found))
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    a, b = _signed(half_keys(found)) if len(found) else (None, None)
                    first.append(a)
                    second.append(b)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(first, longs), pa.array(second, longs)], names=["doc_id", "mark", "n_shingles", "digest", "first", "second"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, mark long, n_shingles long, digest binary, first array<long>, second array<long>")


def buckets(sets: DataFrame) -> DataFrame:
    """(key, doc, leader, n): the table rows that hold several documents, with
    the bucket's smallest document and its size."""

    def first_halves(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).flatten().to_numpy()
            turn = np.tile(np.arange(HALVES, dtype=np.int32), len(ids))
            yield pa.RecordBatch.from_pydict({"half": keys, "turn": turn, "doc": np.repeat(ids, HALVES)})

    half = sets.select("doc", "first").mapInArrow(first_halves, "half long, turn int, doc long")
    met = half.groupBy("half", "turn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    turns = half.join(met, ["half", "turn"]).groupBy("doc").agg(F.collect_set("turn").alias("turns"))  # at most HALVES each
    alive = sets.join(turns, "doc").select("doc", "first", "second", "turns")

    def tables(batches):
        for batch in batches:
            docs, keys = [], []
            for doc, a, b, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.array(a).view(np.uint64)[turns], np.array(b).view(np.uint64)
                keys.append((_mix(a)[:, None] + b[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.arange(HALVES, dtype=np.uint64)[None, :]).ravel())
                docs.append(np.full(len(keys[-1]), doc, np.int64))
            if keys:
                yield pa.RecordBatch.from_pydict({"key": _signed(_mix(np.concatenate(keys))), "doc": np.concatenate(docs)})

    rows = alive.mapInArrow(tables, "key long, doc long")
    leaders = rows.groupBy("key").agg(F.min("doc").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(leaders, "key").select("key", "doc", "leader", "n")


def _held_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, held): the shingle sets of the wanted (doc, mark) as bytes."""

    def sets(batches):
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["doc", "held"])

    # Texts and ids meet by a shuffle at every size: ids grow with the corpus.
    ids = wanted.select(F.col("doc").alias("doc_id"), "mark").hint("merge")
    met = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).join(ids, ["doc_id", "mark"], "left_semi")
    return met.groupBy("doc_id", "mark").agg(F.first("text").alias("text")).select("doc_id", "text").mapInArrow(sets, "doc long, held binary")


def confirm(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose full sets (doc, held) have 100 * intersection >= percent *
    union."""
    both = pairs.join(held.select(F.col("doc").alias("a"), F.col("held").alias("held_a")), "a").join(held.select(F.col("doc").alias("b"), F.col("held").alias("held_b")), "b")

    def check(batches):
        for batch in batches:
            for part in slices(batch, 2):
                ok = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "held_a", "held_b").mapInArrow(check, "a long, b long")


def _common_counts(left: list, right: list) -> np.ndarray:
    """(left, right) sizes of the sets' intersections.  Only shingles that occur on
    both sides matter; they are counted by matrix products, so many at a time."""
    known = np.intersect1d(np.concatenate(left), np.concatenate(right))
    total = np.zeros((len(left), len(right)), np.float32)
    if not len(known):
        return total

    def spots(sets: list) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(known, flat)
        ok = known[np.minimum(at, len(known) - 1)] == flat
        return row[ok], at[ok]

    (lr, lc), (rr, rc) = spots(left), spots(right)
    lo, ro = np.argsort(lc, kind="stable"), np.argsort(rc, kind="stable")
    lr, lc, rr, rc = lr[lo], lc[lo], rr[ro], rc[ro]
    for start in range(0, len(known), 4096):
        width = min(4096, len(known) - start)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        for m, r, c in ((x, lr, lc), (y, rr, rc)):
            a, b = np.searchsorted(c, [start, start + width])
            m[r[a:b], c[a:b] - start] = 1
        total += x @ y.T
    return total


def _groups(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, doc, blocks, first) of what is to be compared with each other, in how many
    blocks: of a large cluster (id, component) the documents of each first half, a small
    one as a whole, with the halves of which its pairs must share one."""
    rows = clusters.select(F.col("id").alias("doc"), F.col("component").alias("cluster")).join(classes.select("doc", F.col("n_shingles").alias("size"), "first"), "doc")
    rows = materialize(rows, "near-clusters")
    blocks = F.ceil(F.greatest(F.sum("size") * 8 / BLOCK_BYTES, F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("blocks")
    n = F.count(F.lit(1)).alias("n")
    placed = materialize(join_by_key(rows, rows.groupBy("cluster").agg(n, blocks), "cluster", rows.count()).drop("n"), "near-placed")
    halves = placed.where("blocks > 1").select("doc", "size", F.posexplode("first").alias("turn", "half")).select(F.xxhash64("turn", "half").alias("key"), "doc", "size").distinct()
    halves = materialize(halves, "near-halves")
    seen = halves.groupBy("key").agg(n, blocks, F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(7))).alias("y")).where("n > 1")
    once = seen.groupBy("n", "x", "y").agg(F.min_by(F.struct("key", "blocks"), "key").alias("k")).select("k.*", "n")  # halves of the same members
    large = join_by_key(halves.select("key", "doc"), once, "key", halves.count()).drop("n")
    small = placed.where("blocks = 1").select(F.xxhash64("cluster").alias("key"), "doc", "blocks", "first").distinct()
    return small.unionByName(large.withColumn("first", F.lit(None).cast("array<long>")))


def compare_groups(members: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between the components of each group's documents, spanning
    those that its links join; ``members``: key, doc, blocks, c (component), first
    (null: all pairs, else those with a half in common); ``held``: (doc, held) sets.

    Ids are dealt first, and sets go only to pairs of blocks that hold several
    components."""
    rows = members.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    # A document meets its own block and every other: one task a pair of blocks.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "c", "first")
    rows = rows.withColumn("unit", F.concat_ws(":", "key", "i", "j"))
    several = rows.groupBy("unit").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("unit")
    # A unit's ids meet it in parts, so a task's load does not hang on a few units.
    several = several.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1)))).hint("shuffle_hash")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(_PARTS)).cast("int")).join(several, ["unit", "part"], "left_semi").drop("part").join(held, "doc")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        owner, at = np.unique(table.column("c").to_numpy(), return_inverse=True)
        own = table.column("own").to_numpy()
        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        if len(owner) < 2 or not len(left) or not len(right):
            return arrow.empty_table()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("held").to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        common = _common_counts([sets[k] for k in left], [sets[k] for k in right]).astype(np.int64)
        linked = 100 * common >= percent * (sizes[left][:, None] + sizes[right][None, :] - common)
        halves = table.column("first").to_pylist()
        if halves[0] is not None:
            halves = [np.unique(np.array(x, np.int64)) for x in halves]
            linked &= _common_counts([halves[k] for k in left], [halves[k] for k in right]) > 0
        a, b = np.nonzero(linked & (at[left][:, None] != at[right][None, :]))
        root = spanning_labels(len(owner), at[left[a]], at[right[b]])
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([owner[tied], owner[root[tied]]], schema=arrow)

    return rows.groupBy("unit").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    sketched = materialize(sketch(docs), "near-sketch")
    least = F.min_by(F.struct("mark", "n_shingles", "first", "second"), "doc_id")
    classes = sketched.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), least.alias("of"))
    classes = materialize(classes.select("digest", "doc", "of.*"), "near-classes")
    # A doc_id with several texts is linked to the classes of all of them.
    blank = F.coalesce("digest", F.lit(b""))
    several = sketched.where("doc_id is not null").groupBy("doc_id").agg(F.min(blank).alias("lo"), F.max(blank).alias("hi")).where("lo <> hi").select("doc_id")
    own = sketched.join(several, "doc_id", "left_semi").join(classes.select("digest", "doc"), "digest").where("doc_id <> doc")
    links = materialize(own.select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).distinct(), "near-links")
    found = materialize(connected_components(links), "near-components")
    met = materialize(buckets(classes), "near-buckets")

    def of(ids: DataFrame, by: str, name: str) -> DataFrame:
        """``ids`` with the component of column ``by``, itself if it has none."""
        known = found.select(F.col("id").alias(by), F.col("component").alias("_c"))
        return ids.join(known, by, "left").withColumn(name, F.coalesce("_c", by)).drop("_c")

    def joined(more: DataFrame) -> None:
        nonlocal links, found
        old = links, found
        links = materialize(links.union(more), "near-links")
        found = materialize(connected_components(links), "near-components")
        release(*old)

    spread = met.where("doc <> leader")
    held = materialize(_held_sets(docs, classes.select("doc", "mark").join(spread.select("doc").union(spread.select("leader")), "doc", "left_semi")), "near-sets")
    tried = materialize(spread.groupBy(F.col("doc").alias("a")).agg(F.min("leader").alias("b")), "near-pairs")
    joined(confirm(tried, held, percent))
    # A bucket whose members are not all in the leader's component is open,
    # unless it is a pair that was compared just now.
    stars = of(of(spread, "doc", "c"), "leader", "lc").where("c <> lc")
    done = tried.select(F.col("a").alias("doc"), F.col("b").alias("leader"), F.lit(2).cast("long").alias("n"))
    open_ = stars.join(done, ["doc", "leader", "n"], "left_anti").select("key").distinct()
    chains = materialize(spread.join(open_, "key", "left_semi").select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct(), "near-open")
    release(met, tried)
    if not chains.isEmpty():
        groups = materialize(_groups(connected_components(chains), classes), "near-groups")
        more = materialize(compare_groups(of(groups, "doc", "c"), held, percent), "near-links")
        joined(more)
        release(groups, more)
    placed = of(classes.select("digest", "doc"), "doc", "placed").select("digest", "placed")
    out = of(sketched.select("doc_id", "n_shingles", "digest").join(placed, "digest", "left"), "doc_id", "alone")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("placed", "alone")).alias("component_id")
    done = materialize(out.select("doc_id", "n_shingles", component, F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "near-result")
    release(held, chains, sketched, classes, links, found)
    return done
