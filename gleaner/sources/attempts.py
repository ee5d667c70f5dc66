"""Fetch attempts as rows: outcomes, retries and waits.  A live fetcher is out of
scope; logs of attempts are the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import text as T


def outcome(status: Column, html: Column) -> Column:
    """What an attempt came to, from its status and body."""
    return (
        F.when(status.isNull(), "NetworkError").when(status == 403, "Forbidden").when(status == 429, "RateLimited").when(status >= 500, "ServerError")
        .when(~status.between(200, 299), "NetworkError").when(T.is_blank(html), "EmptyResponse").when(T.challenge_marker(html).isNotNull(), "ChallengePage").otherwise("Success")
    )


def retry_wait_ms(attempt: Column, retry_after_s: Column, retry_at: Column | None = None, now: Column | None = None) -> Column:
    """Wait after a 429 in a single fetch: the seconds the server asks for, else
    until the date it names (``retry_at``, if after ``now``), else doubling from a
    second; at most 8 seconds."""
    until = F.lit(None).cast("double")
    if retry_at is not None:
        gap = (F.unix_millis(retry_at) - F.unix_millis(F.current_timestamp() if now is None else now)).cast("double")
        until = F.when(gap > 0, gap)
    return F.least(F.coalesce(retry_after_s * 1000, until, F.pow(F.lit(2.0), attempt) * 1000), F.lit(8000.0)).cast("long")


def retry_date(value: Column) -> Column:
    """A Retry-After header's date; null for seconds or anything else."""
    return F.try_to_timestamp(F.regexp_extract(value, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))


def backoff_s(attempt: Column, base: float = 30.0, most: float = 120.0, jitter: Column | None = None) -> Column:
    """Wait before a job's next attempt.  ``jitter``: a column from 0 to 1 (say
    ``rand()``) that adds up to a fifth."""
    base, most = max(base, 0.0), max(base, most, 0.0)
    wait = F.least(F.pow(F.lit(2.0), attempt - 1) * base, F.lit(most))
    return wait if jitter is None else wait * (1 + 0.2 * jitter)


def page_delay_s(page: Column, draw: Column, least: float = 5.0, most: float = 15.0, every: int = 10, pause: float = 45.0) -> Column:
    """Pause before a job's page: none before the first, else between ``least`` and
    ``most`` (300 at most) by ``draw`` from 0 to 1, and ``pause`` more at every
    ``every``-th."""
    least = max(least, 0.0)
    wait = least + draw * (max(least, min(most, C.MAX_DELAY_S)) - least)
    longer = F.when(page % every == 0, max(pause, 0.0)).otherwise(0.0) if every > 0 else F.lit(0.0)
    return F.when(page <= 1, 0.0).otherwise(wait + longer)


def settled(attempts: DataFrame, retries: int = 3) -> DataFrame:
    """The attempt that counts of each (job_id, page): the first success, or the last
    one made; a page is tried at most ``retries`` (1 to 10) times, and no more
    after Forbidden or UrlNotAllowed."""
    most = min(max(retries, 1), 10)
    w = Window.partitionBy("job_id", "page").orderBy("attempt")
    rows = attempts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    final = F.col("outcome").isin("Success", "Forbidden", "UrlNotAllowed")
    rows = rows.withColumn("_done", F.coalesce(F.max(final.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_done = 0")
    last = F.row_number().over(Window.partitionBy("job_id", "page").orderBy(F.desc("attempt")))
    return rows.withColumn("_r", last).where("_r = 1").withColumn("tries", F.col("_n")).drop("_r", "_n", "_done")


def cooled(attempts: DataFrame, key: str = "walk") -> DataFrame:
    """(key, pages, wait_ms, cooldowns, ended_by) of walks over listing pages, from
    logged attempts (key, page from 1, attempt from 1, outcome).

    Each attempt at a next page waits ``POLITE_MS``; one that is rate-limited is
    followed by a cooldown and another, ``MAX_COOLDOWNS`` at most; any other failure, and a
    page without attempts, ends the walk.  ``pages``: how many pages came; ``ended_by``: the
    outcome that ended it, null if the log did.  The first page has one attempt and no
    wait.  A walk has at most ``MAX_PAGES`` pages; attempts beyond its end count not."""
    attempt = Window.partitionBy(key, "page").orderBy("attempt")
    limited = (F.col("outcome") == "RateLimited") & (F.col("page") > 1)
    turn = F.row_number().over(attempt)
    rows = attempts.where(F.col("page") <= C.MAX_PAGES).withColumn("_n", turn).withColumn("_over", F.coalesce(F.max((~limited).cast("int")).over(attempt.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    made = rows.where((F.col("_over") == 0) & (F.col("_n") <= C.MAX_COOLDOWNS + 1) & ((F.col("page") > 1) | (F.col("_n") == 1)))
    each = made.groupBy(key, "page").agg(F.max_by("outcome", "_n").alias("outcome"), F.count(F.lit(1)).alias("tries"))
    walk = Window.partitionBy(key).orderBy("page")
    broken = (F.row_number().over(walk) != F.col("page")) | (F.coalesce(F.lag("outcome").over(walk), F.lit("Success")) != "Success")
    each = each.withColumn("_broken", broken).withColumn("_out", F.max(F.col("_broken").cast("int")).over(walk)).where("_out = 0")
    won, tries = F.col("outcome") == "Success", F.col("tries")
    wait = F.when(F.col("page") > 1, tries * C.POLITE_MS + (tries - 1) * C.COOLDOWN_S * 1000).otherwise(0)
    return each.groupBy(key).agg(
        F.sum(won.cast("long")).alias("pages"), F.sum(wait).cast("long").alias("wait_ms"), F.sum(F.when(F.col("page") > 1, tries - 1).otherwise(0)).alias("cooldowns"), F.max(F.when(~won, F.col("outcome"))).alias("ended_by")
    )


def readable(fetched: DataFrame, body: str = "body", charset: str = "charset") -> DataFrame:
    """Rows whose body is within the size limit, with ``html`` decoded; an unknown
    charset reads as UTF-8."""
    known = F.upper(F.coalesce(charset, F.lit("UTF-8"))).isin("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE")
    cs = F.upper(F.coalesce(charset, F.lit("UTF-8")))
    html = F.when(~known | (cs == "UTF-8"), F.decode(body, "UTF-8"))
    for name in ("US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE"):
        html = html.when(cs == name, F.decode(body, name))
    return fetched.where(F.octet_length(body) <= C.MAX_BODY).withColumn("html", html)
