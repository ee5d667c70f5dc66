"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed to cells (source, language, topic).  Raking scales the
cells' weights to one dimension's target shares after the other until all
marginals fit; documents are then drawn by Poisson sampling with probability
``min(1, rate * weight)`` of their cell.  The rate is solved so that the expected
tokens kept are ``budget``, or ``share`` of all tokens: a small cell of large
weight is kept whole instead of scaling all others down.  Expected token shares
equal the targets but for what such whole cells lack.  Draws hash the row, so a
run can be repeated and a lost task recomputed.  Raking that ends before the
marginals fit gives a warning.

The cell table is an aggregate.  Up to ``max_local_cells`` rows of it (checked by
a count) are raked in numpy on the driver and broadcast back; a larger one is
raked by the same steps as DataFrame aggregates and joins.

Edge cases: null source, language or topic are a value of their own; null or
blank texts have 0 tokens and take their cell's weight; values without a target
(or with a target but no tokens) keep factor 1; an empty table gives an empty
result; repeated rows are drawn together; extra columns pass through.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

DIMENSIONS = ("source", "lang", "topic")
_NULL = "\u0000null"
_MADE = ("mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_kept")


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def form_topic(text: Column) -> Column:
    """A coarse topic from a text's form, where the input brings none."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains(" | "), "table").when(text.contains("@"), "contact").when(text.rlike("[0-9]{4}"), "figures").when(text.contains("\n"), "prose").otherwise("short")


def tempered(cells: DataFrame, power: float) -> dict[str, DataFrame]:
    """Targets per dimension: the shares now, raised to ``power`` and made to
    sum to 1; below 1 this lifts small groups and lowers large ones."""
    out = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0").select(d, F.pow("t", F.lit(power)).alias("t"))
        out[d] = sums.crossJoin(F.broadcast(sums.agg(F.sum("t").alias("all")))).select(d, (F.col("t") / F.col("all")).alias("share"))  # the broadcast side is one row
    return out


def _local(cells, targets, total: float, rounds: int, tolerance: float) -> np.ndarray:
    tokens = cells["tokens"].to_numpy(float)
    weight = np.ones(len(cells))
    codes = {}
    for d in DIMENSIONS:
        want = dict(zip(targets[d][d], targets[d]["share"], strict=True))
        values, code = np.unique(cells[d].to_numpy(object).astype(str), return_inverse=True)
        codes[d] = code, np.array([want.get(v, np.nan) for v in values]) * total
    for _ in range(rounds):
        worst = 0.0
        for code, want in codes.values():
            have = np.bincount(code, tokens * weight, len(want))
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = want / have
            factor = np.where(np.isfinite(factor) & (factor > 0), factor, 1.0)
            weight *= factor[code]
            worst = max(worst, float(np.max(np.abs(factor - 1), initial=0)))
        if worst < tolerance:
            break
    else:
        _unfit(rounds, worst)
    return weight


def _unfit(rounds: int, worst: float) -> None:
    warnings.warn(f"raking: after {rounds} rounds a marginal is still off by a factor of 1 +- {worst:.3g}", stacklevel=3)


def _spread(cells: DataFrame, targets: dict[str, DataFrame], total: float, rounds: int, tolerance: float) -> DataFrame:
    out = cells.withColumn("weight", F.lit(1.0))
    for _ in range(rounds):
        worst = 0.0
        for d in DIMENSIONS:
            have = out.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("have"))
            factor = F.col("share") * total / F.col("have")
            factors = have.join(targets[d], d, "left").select(d, F.coalesce(F.when((F.col("have") > 0) & (factor > 0), factor), F.lit(1.0)).alias("factor"))
            factors = materialize(factors, "mix-factors")
            worst = max(worst, factors.agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            out = materialize(out.join(factors, d).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"), "mix-cells")
        if worst < tolerance:
            break
    else:
        _unfit(rounds, worst)
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 100, tolerance: float = 1e-9, max_local_cells: int = 100_000) -> DataFrame:
    """(source, lang, topic, tokens) -> the same with ``weight``, such that sums
    of tokens * weight have the target shares along every dimension.
    ``targets``: per dimension a table (value, share)."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if cells.count() > max_local_cells:
        return _spread(cells, targets, total, rounds, tolerance)
    local = cells.toPandas()
    local["weight"] = _local(local, {d: t.where(F.col(d).isNotNull()).toPandas() for d, t in targets.items()}, total, rounds, tolerance)
    schema = "source string, lang string, topic string, tokens long, weight double"
    return spark.createDataFrame([tuple(r) for r in local[[*DIMENSIONS, "tokens", "weight"]].values.tolist()], schema)


def draw_rate(raked: DataFrame, budget: float | None, share: float) -> float:
    """The rate at which sum(tokens * min(1, rate * weight)) is ``budget``, or
    ``share`` of the tokens; with less than that in the table, all is kept."""
    held = raked.where("tokens > 0")
    sums = held.agg(F.sum("tokens").alias("all"), F.min("weight").alias("least")).first()
    if not sums["all"]:
        return 1.0
    wanted = share * sums["all"] if budget is None else budget
    if wanted >= sums["all"]:
        return 1 / sums["least"]
    # Cells once whole stay whole as the rate grows, so this ends.
    rate, whole = 0.0, -1
    while True:
        full = F.col("weight") * rate >= 1
        now = held.agg(F.count_if(full).alias("whole"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("kept"), F.sum(F.when(~full, F.col("tokens") * F.col("weight")).otherwise(0.0)).alias("rest")).first()
        if now["whole"] == whole or not now["rest"]:
            return rate
        whole, rate = now["whole"], max(rate, (wanted - now["kept"]) / now["rest"])


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = 0.7, budget: int | None = None, share: float = 0.5, seed: int = 17, topic: Column | None = None, max_local_cells: int = 100_000) -> DataFrame:
    """``docs`` with mix_topic, mix_tokens, mix_weight, mix_probability and
    mix_kept.  ``targets``: per dimension a table (value, share); by default the
    present shares raised to ``power``.  ``budget``: expected tokens to keep, by
    default ``share`` of all.  Columns of ``docs`` that have such a name already get
    "_before" behind it."""
    docs = docs.withColumnsRenamed({c: f"{c}_before" for c in _MADE if c in docs.columns})
    topic = form_topic(F.col("text")) if topic is None else topic
    key = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": topic}
    keyed = docs.select(*docs.columns, *(F.coalesce(c, F.lit(_NULL)).alias(f"mix_{d}") for d, c in key.items()), token_count(F.col("text")).alias("mix_tokens"))
    cells = materialize(keyed.groupBy(*(F.col(f"mix_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("mix_tokens").alias("tokens")), "mix-counts")
    targets = tempered(cells, power) if targets is None else {d: t.withColumn(d, F.coalesce(F.col(d).cast("string"), F.lit(_NULL))) for d, t in targets.items()}
    raked = rake(cells, targets, max_local_cells=max_local_cells)
    rate = draw_rate(raked, budget, share)
    weights = raked.select(*(F.col(d).alias(f"mix_{d}") for d in DIMENSIONS), F.col("weight").alias("mix_weight"))
    if raked.count() <= max_local_cells:
        weights = F.broadcast(weights)
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    chance = F.least(F.lit(1.0), F.col("mix_weight") * rate)
    out = keyed.join(weights, [f"mix_{d}" for d in DIMENSIONS]).withColumn("mix_probability", chance)
    return out.select(*docs.columns, "mix_topic", "mix_tokens", "mix_weight", "mix_probability", (drawn < chance).alias("mix_kept"))


def drawn(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows, with the columns of ``docs``."""
    return mix(docs, **options).where("mix_kept").select(*(F.col(f"{c}_before").alias(c) if c in _MADE else c for c in docs.columns))
