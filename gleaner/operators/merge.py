"""Merging profiles into records, and upserts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import text as T


def merge_profiles(listing: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """Listing results with their profile page's: per (keys, name) a contact value
    goes when the profile says contact is impossible; a missing or low-confidence
    profile value leaves a listing value; otherwise the profile's wins.
    ``profile`` also has ``unavailable``."""
    cols = ["value", "source", "confidence", "level", "is_missing"]
    p = profile.select(*keys, "name", "unavailable", *(F.col(c).alias(f"p_{c}") for c in cols))
    rows = listing.join(p, [*keys, "name"], "left").withColumn("visited", F.col("p_is_missing").isNotNull())
    gone = F.coalesce(F.col("unavailable") & F.col("p_is_missing") & F.col("kind").isin(C.CONTACT_KINDS), F.lit(False))
    keep = F.coalesce(F.col("p_is_missing"), F.lit(True)) | ((F.col("p_level") == "Low") & ~F.col("is_missing"))
    empty = {"value": F.lit(None).cast("string"), "source": F.lit("None"), "confidence": F.lit(0), "level": F.lit("None"), "is_missing": F.lit(True)}
    merged = {c: F.when(gone, empty[c]).when(keep, F.col(c)).otherwise(F.col(f"p_{c}")) for c in cols}
    others = [c for c in listing.columns if c not in cols]
    return rows.select(*others, *(v.alias(c) for c, v in merged.items()), "visited")


def dedupe_key(profile_url: Column, fields: Column) -> Column:
    """url: and the profile URL, else fields: and a digest of the sorted values."""
    told = F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "|")
    return F.when(~T.is_blank(profile_url), F.concat(F.lit("url:"), F.lower(T.trim(profile_url)))).otherwise(F.concat(F.lit("fields:"), F.upper(F.sha2(told.cast("binary"), 256))))


def upsert(rows: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The last row of each key, at the place of its first (``first_seq``)."""
    last = F.max_by(F.struct(*rows.columns), order)
    return rows.groupBy(F.col(key).alias("_k")).agg(last.alias("_r"), F.min(order).alias("first_seq")).select("_r.*", "first_seq")


def merge_into(saved: DataFrame | None, batch: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Saved rows with a new batch upserted; within the batch the last row of a
    key wins at the first's place."""
    new = upsert(batch, key, order)
    if saved is None:
        return new
    # One outer join and no union: a union of joined parts cannot be joined again where its parts were split unevenly.
    both = saved.select(key, F.struct(*new.columns).alias("_old")).join(new.select(key, F.struct(*new.columns).alias("_new")), key, "full")
    row = F.coalesce("_new", "_old")
    return both.select(*(row[c].alias(c) for c in new.columns if c != "first_seq"), F.coalesce("_old.first_seq", "_new.first_seq").alias("first_seq"))


def skip_log(events: DataFrame) -> DataFrame:
    """Current skips from ordered events (seq, kind, page, url, reason; reason null
    marks a success): the latest per (kind, page, url), unless a later success
    cleared it.  A page's success clears all skips of that page, a profile's all
    profile skips of its url on any page."""
    latest = F.max_by(F.struct(*events.columns), "seq")
    skips = events.where("reason is not null").groupBy(*(F.col(c).alias(f"_{c}") for c in ("kind", "page", "url"))).agg(latest.alias("_r")).select("_r.*")
    won = events.where("reason is null")
    pages = won.where("kind = 'Page'").groupBy("page").agg(F.max("seq").alias("_p"))
    profiles = won.where("kind = 'Profile'").groupBy("url").agg(F.max("seq").alias("_u")).withColumn("kind", F.lit("Profile"))
    rows = skips.join(pages, "page", "left").join(profiles, ["url", "kind"], "left")
    return rows.where("seq > coalesce(_p, seq - 1) and seq > coalesce(_u, seq - 1)").select(*events.columns)


def expand_locations(rows: DataFrame, column: str) -> DataFrame:
    """One row per location where several are joined by semicolons."""
    parts = F.filter(F.transform(F.split(column, ";"), T.trim), lambda p: p != "")
    many = F.when(F.size(parts) > 1, parts).otherwise(F.array(F.col(column)))
    return rows.select(*(F.explode(many).alias(c) if c == column else F.col(c) for c in rows.columns))


def degenerate_pages(results: DataFrame) -> DataFrame:
    """(page_id): pages of several records in which no field takes more than one
    value."""
    per = results.groupBy("page_id", "name").agg(F.countDistinct(F.when(~T.is_blank(F.col("value")), F.col("value"))).alias("d"))
    many = results.groupBy("page_id").agg(F.countDistinct("rec_idx").alias("n")).where("n > 1")
    return per.groupBy("page_id").agg(F.max("d").alias("d")).where("d <= 1").join(many, "page_id").select("page_id")
