"""Toxicity: a linear classifier on character n-grams whose features are scaled
by naive Bayes log-count ratios.

Whole texts are lower-cased, put behind a space and cut into n-grams of
``NGRAMS`` characters (code points), hashed to ``2**BITS`` buckets.  A feature is the presence
of a bucket in a document times its log-count ratio; a logistic regression with
an L2 penalty, Spark ML's on sparse vectors, weighs these.  The ratios and the
weights come from a bounded sample of labelled rows (``max_per_class`` of either
class, distinct texts); scoring covers every row.  Every bucket seen in
``min_docs`` documents of the sample whose ratio is ``min_z`` times its standard
error from zero is a feature: there is no limit on their number but ``2**BITS``.

Edge cases: a null or empty text has no feature and scores the intercept;
labels that are null or not 0/1, or whose document is missing, are ignored; a
document labelled both ways counts as toxic; without any labelled row every
score is 0, with one class only every score is that class's value.  Repeated
rows score alike, extra columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, small_batches

NGRAMS = (3, 4, 5, 6)
BITS = 20
SLICE = 1 << 14


@dataclass
class ToxicityModel:
    """``buckets`` ascending, with one ``weights`` value each (ratio times
    coefficient), and the ``intercept``; ``constant`` is set when there was
    nothing to learn from."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float
    constant: float | None = None


def _grams(data: np.ndarray):
    """The bucket of the n-gram at every position, for each length."""
    h = np.zeros(len(data), np.uint32)
    mul, mix = np.uint32(0x01000193), np.uint32(0x9E3779B1)
    for n in range(1, max(NGRAMS) + 1):
        if len(data) < n:
            return
        h = h[: len(data) - n + 1] * mul + data[n - 1 :] + np.uint32(1)
        if n in NGRAMS:
            g = (h ^ (h >> np.uint32(15))) * mix
            yield (g + np.uint32(n)) * mix >> np.uint32(32 - BITS)


def _joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one array of code points with zeros between them, and the row of
    every position, -1 for the zeros."""
    pad = max(NGRAMS)
    parts = [np.frombuffer((" " + (t or "").lower()).encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in parts])
    rows = np.repeat(np.repeat(np.arange(len(parts), dtype=np.int32), 2), np.column_stack([sizes, np.full(len(parts), pad)]).ravel())
    data = np.zeros(len(rows), np.uint32)
    ends = np.cumsum(sizes + pad) - pad
    for p, n, end in zip(parts, sizes, ends, strict=True):
        data[end - n : end] = p
        rows[end : end + pad] = -1
    return data, rows


def _hits(texts: list, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct known buckets in each text."""
    data, owner = _joined(texts)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g in _grams(data):
        at = np.flatnonzero(known[g])
        at = at[owner[at] >= 0]
        rows.append(owner[at].astype(np.int64))
        found.append(g[at].astype(np.int64))
    both = np.unique((np.concatenate(rows) << BITS) | np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def _document_counts(batches):
    """Per partition: in how many documents of either class each bucket is."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            data, owner = _joined([text])
            seen = np.zeros(1 << BITS, bool)
            for g in _grams(data):
                seen[g[owner[: len(g)] >= 0]] = True
            counts[toxic] += seen
    k = range(0, 1 << BITS, SLICE)
    yield pa.RecordBatch.from_pydict({"slice": pa.array([i // SLICE for i in k], pa.int32()), "counts": pa.array([counts[:, i : i + SLICE].tobytes() for i in k], pa.binary())})


def _ratios(n_neg: int, n_pos: int, min_z: float, min_docs: int):
    """Log-count ratios of a slice of buckets; 0 for those that are no feature."""

    def select(key, pdf):
        import pandas as pd

        neg, pos = sum(np.frombuffer(x, np.int32).astype(np.int64).reshape(2, -1) for x in pdf["counts"])
        # Smoothing in proportion to the classes, so a rare class is not drowned.
        p, n = pos + n_pos / (n_pos + n_neg), neg + n_neg / (n_pos + n_neg)
        ratio = np.log(p / (n_pos + 1)) - np.log(n / (n_neg + 1))
        z = np.abs(ratio) / np.sqrt(1 / p + 1 / n)
        ratio[(z < min_z) | (pos + neg < min_docs)] = 0
        return pd.DataFrame({"slice": [key[0]], "ratios": [ratio.astype(np.float32).tobytes()]})

    return select


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = 3000, min_docs: int = 3, min_z: float = 3.0, penalty: float = 1e-3) -> ToxicityModel:
    """Learn from at most ``max_per_class`` labelled rows of either class, those
    with the smallest hash of doc_id; ``docs`` may be filtered beforehand."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = [r for c in (0, 1) for r in known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class).collect()]
    if not picked:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0)
    if len({r.toxic for r in picked}) == 1:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 0.0, float(picked[0].toxic))
    chosen = spark.createDataFrame(picked, "doc_id long, toxic int")
    # At most 2 * max_per_class ids, so this broadcast has a fixed bound.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "toxic").agg(F.first("text").alias("text"))
    sample = materialize(sample.select("text", "toxic").repartition(12), "toxic-sample")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    counted = sample.mapInArrow(_document_counts, "slice int, counts binary")
    found = counted.groupBy("slice").applyInPandas(_ratios(sizes.get(0, 0), sizes.get(1, 0), min_z, min_docs), "slice int, ratios binary")
    # 2**BITS numbers of four bytes, whatever the input.
    ratio = np.frombuffer(b"".join(r.ratios for r in sorted(found.collect(), key=lambda r: r.slice)), np.float32)
    buckets = np.flatnonzero(ratio)
    if not len(buckets):
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 0.0, sizes.get(1, 0) / sum(sizes.values()))
    shared = spark.sparkContext.broadcast(ratio)
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def vectors(batches):
        ratio = shared.value
        known = ratio != 0
        place, n = np.cumsum(known) - 1, int(known.sum())
        for batch in batches:
            for part in slices(batch, 0):
                row, bucket = _hits(part.column("text").to_pylist(), known)
                cuts = pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32())
                sparse = [pa.array(np.zeros(len(part)), pa.int8()), pa.array(np.full(len(part), n), pa.int32())]
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (place[bucket].astype(np.int32), ratio[bucket].astype(np.float64))]
                yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.float64()), pa.StructArray.from_arrays([*sparse, *lists], fields=list(kind))], names=["label", "features"])

    rows = materialize(sample.select("text", "toxic").mapInArrow(vectors, schema), "toxic-vectors")
    learned = LogisticRegression(maxIter=100, regParam=penalty, standardization=False).fit(rows)
    return ToxicityModel(buckets, learned.coefficients.toArray() * ratio[buckets], float(learned.intercept))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1), computed from ``text`` alone."""
    if "toxicity" in docs.columns:
        docs = docs.withColumnRenamed("toxicity", "toxicity_before")
    if model.constant is not None:
        return docs.withColumn("toxicity", F.lit(model.constant))
    spark = docs.sparkSession
    small_batches(spark)
    weights = np.zeros(1 << BITS, np.float32)
    weights[model.buckets] = model.weights
    shared, intercept, names = spark.sparkContext.broadcast(weights), model.intercept, docs.columns

    def run(batches):
        weights = shared.value
        known = weights != 0
        for batch in batches:
            for part in slices(batch, names.index("text")):
                row, bucket = _hits(part.column("text").to_pylist(), known)
                total = np.bincount(row, weights=weights[bucket], minlength=len(part)) + intercept
                out = pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*names, "toxicity"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Fit on the rows that are not held out (crc32 of doc_id modulo 4 is not 2)
    and score every row: doc_id, held_out, score, predicted."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held), labels, max_per_class=3000)
    out = score(docs.select("doc_id", "text").withColumn("held_out", held).select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
