"""The strategy chain: normal forms, plausibility and the choice of one value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import kinds as K
from ..functions import text as T


def resolve(asked: DataFrame, candidates: DataFrame, keys: list[str], strategies: list[str] | None = None) -> DataFrame:
    """One row per asked (keys, kind): the first plausible candidate in strategy
    order; else, but for contact kinds, the most confident implausible one at half
    its confidence, at least 1; else missing.  ``candidates``: keys, strategy,
    value, confidence; ``strategies`` is their order."""
    order = F.array_position(F.array(*map(F.lit, strategies or C.STRATEGIES)), F.col("strategy"))
    rows = candidates.join(asked.select(*keys, "kind"), keys).withColumn("value", K.normal(F.col("kind"), F.col("value"))).where(F.col("value").isNotNull())
    rows = rows.withColumn("ok", K.plausible(F.col("kind"), F.col("value"))).where(F.col("ok") | ~F.col("kind").isin(C.CONTACT_KINDS)).withColumn("turn", order)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ok"), F.when(F.col("ok"), F.lit(0)).otherwise(-F.col("confidence")), "turn"))
    best = rows.withColumn("_r", rank).where("_r = 1").select(*keys, "value", F.when(F.col("strategy") == "NextData", "StructuredData").otherwise(F.col("strategy")).alias("source"), F.when(F.col("ok"), F.col("confidence")).otherwise(F.greatest(F.lit(1), F.floor(F.col("confidence") / 2).cast("int"))).alias("confidence"))
    out = asked.join(best, keys, "left").withColumn("is_missing", F.col("value").isNull())
    out = out.withColumn("source", F.coalesce("source", F.lit("None"))).withColumn("confidence", F.coalesce("confidence", F.lit(0)))
    return out.withColumn("level", T.confidence_level(F.col("confidence")))


def wide(results: DataFrame, names: list[str]) -> DataFrame:
    """(page_id, rec_idx, one column per field)."""
    return results.groupBy("page_id", "rec_idx").pivot("name", names).agg(F.first("value"))


def required_warnings(results: DataFrame) -> DataFrame:
    """(page_id, name): required fields that some record lacks."""
    return results.where("required").groupBy("page_id", "name").agg(F.max("is_missing").alias("lacking")).where("lacking").select("page_id", "name")
