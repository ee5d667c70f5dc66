"""Profile and next-page links, and walks over a page table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import urls as U
from ..sources.stage import staged


def anchors(elems: DataFrame, texts: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, pre, tag, href, rel, label, aria, target, page_url, ancestors): links with a
    usable reference, resolved against the page."""
    urls = pages.select(F.col("page_id").cast("long"), F.col("url").alias("page_url"))
    rows = elems.where("tag in ('a', 'link')").select("page_id", "pre", "tag", "ancestors", F.col("attrs")["href"].alias("href"), F.lower(F.col("attrs")["rel"]).alias("rel"), F.coalesce(F.col("attrs")["aria-label"], F.lit("")).alias("aria"))
    rows = rows.where(U.is_candidate(F.col("href"))).join(urls, "page_id").join(texts.select("page_id", "pre", F.col("vtext").alias("label")), ["page_id", "pre"], "left")
    return rows.withColumn("label", F.coalesce("label", F.lit(""))).withColumn("target", U.resolve(F.col("page_url"), F.col("href"))).where("target is not null")


def profile_links(records: DataFrame, elems: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, rec_idx, profile_url): a record's first same-host link around or
    inside a heading, else its first with a label of 3 or more characters that is
    no pagination."""
    mine = links.where("tag = 'a'").where(U.same_host(F.col("target"), F.col("page_url"))).withColumn("scope", F.explode("ancestors")).join(records.select("page_id", "rec_idx", F.col("pre").alias("scope")), ["page_id", "scope"])
    heads = elems.where(F.col("tag").isin(C.HEADINGS)).select("page_id", "pre", "ancestors")
    wrapping = heads.select("page_id", F.explode("ancestors").alias("pre")).distinct()
    wrapped = mine.select("page_id", "pre", F.explode("ancestors").alias("up")).join(heads.select("page_id", F.col("pre").alias("up")), ["page_id", "up"]).select("page_id", "pre").distinct()
    headed = wrapping.union(wrapped).distinct().withColumn("headed", F.lit(True))
    rows = mine.join(headed, ["page_id", "pre"], "left")
    label = F.trim("label")
    rank = F.when(F.col("headed"), 0).when((F.length(label) >= 3) & ~label.rlike(C.PAGINATION_TEXT), 1)
    rows = rows.withColumn("rank", rank).where("rank is not null")
    return rows.groupBy("page_id", "rec_idx").agg(F.min_by("target", F.struct("rank", "pre")).alias("profile_url"))


def next_links(links: DataFrame) -> DataFrame:
    """(page_id, next_url): the first a[rel=next], else the first link[rel=next],
    if it stays on the host; else the first link that says next, if it does and is
    not the page itself."""
    says = (F.col("tag") == "a") & (F.trim("label").rlike(C.NEXT_TEXT) | F.trim("aria").rlike(C.NEXT_TEXT))
    rel = F.col("rel") == "next"
    ours = U.same_host(F.col("target"), F.col("page_url"))
    url = F.struct("target", ours.alias("ours"), "page_url")
    first = links.where(rel | says).groupBy("page_id").agg(F.min_by(url, F.when(rel, F.struct((F.col("tag") != "a").alias("late"), "pre"))).alias("r"), F.min_by(url, F.when(says, F.col("pre"))).alias("s"))
    said = F.when(F.col("s.ours") & (F.lower("s.target") != F.lower("s.page_url")), F.col("s.target"))
    return first.select("page_id", F.coalesce(F.when(F.col("r.ours"), F.col("r.target")), said).alias("next_url")).where("next_url is not null")


def walk(start: DataFrame, hops: DataFrame, max_pages: int = C.MAX_PAGES) -> DataFrame:
    """(root, page_number, url): pages reached from (root, url) by following hops
    (url, next_url), each once, case ignored, at most ``max_pages`` a root.  A join a
    page: walks of all roots go on together until none moves.  Of several hops
    from one url the smallest counts; a page seen again ends its walk."""
    hops = staged(hops.where("next_url is not null").groupBy(F.lower("url").alias("_u")).agg(F.min("next_url").alias("next_url")))
    seen = now = staged(start.select("root", F.lit(1).alias("page_number"), "url").distinct())
    for n in range(2, min(max(max_pages, 1), C.MAX_PAGES) + 1):
        reached = now.select("root", F.lower("url").alias("_u")).join(hops, "_u").select("root", F.lit(n).alias("page_number"), F.col("next_url").alias("url"))
        fresh = reached.withColumn("_u", F.lower("url")).join(seen.select("root", F.lower("url").alias("_u")), ["root", "_u"], "left_anti")
        now = staged(fresh.select("root", "page_number", "url"))
        if now.isEmpty():
            break
        seen = staged(seen.union(now))
    return seen


def redirected(requests: DataFrame, hops: DataFrame, max_hops: int = C.MAX_REDIRECTS) -> DataFrame:
    """(url, final_url, hops, reason): where a request ends by logged answers
    (url, status, location): a 301, 302, 303, 307 or 308 with a location leads on,
    relative ones resolved, every address checked.  ``reason``: "too many
    redirects" after ``max_hops``, or why an address is not allowed."""
    moved = hops.where(F.col("status").isin(301, 302, 303, 307, 308) & F.col("location").isNotNull()).groupBy(F.col("url").alias("now")).agg(F.min("location").alias("location"))
    rows = requests.select("url").distinct().withColumn("now", F.col("url")).withColumn("hops", F.lit(0)).withColumn("reason", U.rejection(F.col("url"))).withColumn("over", F.lit(False))
    for _ in range(max_hops + 1):
        rows = rows.join(moved, "now", "left")
        goes = F.col("location").isNotNull() & F.col("reason").isNull() & (F.col("hops") <= max_hops)
        to = F.when(goes, U.resolve(F.col("now"), F.col("location"))).otherwise(F.col("now"))
        # The new address is a column before its check uses it.
        rows = rows.select("url", to.alias("now"), goes.alias("goes"), (F.col("hops") + goes.cast("int")).alias("hops"), "reason")
        rows = rows.select("url", "now", "hops", F.when(F.col("goes"), U.rejection(F.col("now"))).otherwise(F.col("reason")).alias("reason"))
    over = F.when(F.col("hops") > max_hops, F.lit("too many redirects"))
    return rows.select("url", F.col("now").alias("final_url"), "hops", F.coalesce(over, "reason").alias("reason"))


def frontier(rows: DataFrame) -> DataFrame:
    """The first record (by page and place) to name each profile URL, case
    ignored."""
    first = F.min_by(F.struct(*rows.columns), F.struct("page_id", "rec_idx"))
    return rows.where("profile_url is not null").groupBy(F.lower("profile_url")).agg(first.alias("_r")).select("_r.*")


def majority_type(rows: DataFrame) -> DataFrame:
    """Drops records of another entity type than a page's majority: with two or
    more records matched and one type over half of them, that type and unmatched
    records stay.  ``rows``: page_id, rec_idx, type (null if unmatched)."""
    rows = rows.withColumn("_t", F.lower("type"))
    per = rows.where("_t <> ''").groupBy("page_id", F.col("_t").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("page_id").agg(F.sum("n").alias("matched"), F.max_by("type", "n").alias("top"), F.max("n").alias("top_n"))
    firm = total.where("matched >= 2 and top_n * 2 > matched").select("page_id", "top")
    return rows.join(firm, "page_id", "left").where("top is null or _t is null or _t = top").drop("top", "_t")


def entity_by_url(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """``rows`` (page_id, rec_idx, profile_url) with the type of the page's first
    entity of that url or @id."""
    url = F.coalesce(F.col("leaves")["url"], F.col("leaves")["@id"])
    keyed = entities.where(url.isNotNull()).groupBy("page_id", U.compare_key(url).alias("_k")).agg(F.min_by("type", "ent").alias("type"))
    return rows.withColumn("_k", U.compare_key(F.col("profile_url"))).join(keyed, ["page_id", "_k"], "left").drop("_k")
