"""Checkpointed crawl jobs: page outcomes folded into job state in batch, the same as
a stateful stream of attempts, and an upsert sink that replays change nothing in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import catalog as C
from ..operators.merge import upsert


def job_state(pages: DataFrame, stop_on_failure: bool = False) -> DataFrame:
    """(job_id, status, total_pages, last_completed_page, failed_pages,
    records_saved, last_error, skips) from settled pages (job_id, page,
    total_pages, outcome, records; optionally detail).  Pages run in order; a
    Forbidden page, or any failed one with ``stop_on_failure``, blocks the job
    there; other failures are noted and passed.  ``skips``: an item (page, kind,
    reason) a failed page."""
    detail = F.col("detail") if "detail" in pages.columns else F.lit("")
    w = Window.partitionBy("job_id").orderBy("page")
    failed = F.col("outcome") != "Success"
    stops = failed & ((F.col("outcome") == "Forbidden") | F.lit(stop_on_failure))
    reason = F.concat_ws(" \u2014 ", "outcome", F.when(detail != "", detail))
    # A job has at most MAX_JOB_PAGES pages.
    rows = pages.withColumn("total_pages", F.least("total_pages", F.lit(C.MAX_JOB_PAGES))).where(F.col("page") <= F.col("total_pages")).withColumn("failed", failed).withColumn("stops", stops).withColumn("reason", reason)
    rows = rows.withColumn("before", F.coalesce(F.max(F.col("stops").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("before = 0")
    out = rows.groupBy("job_id").agg(
        F.max("stops").alias("blocked"), F.coalesce(F.max(F.when(~F.col("stops"), F.col("page"))), F.lit(0)).alias("last_completed_page"), F.array_sort(F.collect_set(F.when(F.col("failed"), F.col("page")))).alias("failed_pages"),
        F.sum(F.when(F.col("failed"), 0).otherwise(F.col("records"))).cast("long").alias("records_saved"), F.max("total_pages").alias("total_pages"),
        F.max_by(F.when(F.col("failed"), F.concat(F.lit("Page "), "page", F.lit(": "), "reason")), F.when(F.col("failed"), F.col("page"))).alias("last_error"),
        F.array_sort(F.collect_list(F.when(F.col("failed"), F.struct("page", F.lit("Page").alias("kind"), "reason")))).alias("skips"),
    )
    status = F.when(F.col("blocked"), "Blocked").when(F.col("last_completed_page") >= F.col("total_pages"), "Completed").otherwise("Paused")
    return out.select("job_id", status.alias("status"), "total_pages", "last_completed_page", "failed_pages", "records_saved", "last_error", "skips")


def resume_from(state: DataFrame, from_page: int | None, saved: DataFrame | None = None, max_profiles: int | None = None) -> DataFrame:
    """State rewound so that ``from_page`` (within 1 and the job's pages) runs next,
    Paused until it does: failures and skips from there on go, and with ``saved``
    records (job_id, page, visited) the visited profiles are counted anew.  Without
    ``from_page`` the job goes on where it stands.  ``max_profiles`` above 0 replaces the
    job's limit of profiles; ``capped_profiles`` then lets as many more be visited as the
    limit exceeds those counted."""
    if max_profiles is not None and max_profiles > 0:
        state = state.withColumn("max_profiles", F.lit(max_profiles))
    if from_page is None:
        return state
    last = F.greatest(F.least(F.lit(from_page), F.greatest("total_pages", F.lit(1))), F.lit(1)) - 1
    rows = state.withColumn("last_completed_page", last.cast(state.schema["last_completed_page"].dataType)).withColumn("status", F.lit("Paused"))
    rows = rows.withColumn("failed_pages", F.filter("failed_pages", lambda p: p <= F.col("last_completed_page")))
    if "skips" in state.columns:
        rows = rows.withColumn("skips", F.filter("skips", lambda s: s["page"] <= F.col("last_completed_page")))
    if saved is None:
        return rows
    kept = saved.where("visited").join(rows.select("job_id", "last_completed_page"), "job_id").where("page <= last_completed_page").groupBy("job_id").agg(F.count(F.lit(1)).alias("profiles_visited"))
    return rows.drop("profiles_visited").join(kept, "job_id", "left").withColumn("profiles_visited", F.coalesce("profiles_visited", F.lit(0)))


def retried(state: DataFrame, retry: DataFrame) -> DataFrame:
    """State after a retry of failed pages (job_id, page, outcome, records; optionally
    detail), in page order: pages that came to Success leave the list and the skips, and
    their records count; a page that fails again has the new reason as its skip.  The
    last error is that of the last page that failed again, if any.  A job with none left
    and all pages done is Completed, others Paused.  A job without failed pages stays as
    it is."""
    ids = state.schema["failed_pages"].dataType
    detail = F.col("detail") if "detail" in retry.columns else F.lit("")
    reason = F.concat_ws(" \u2014 ", "outcome", F.when(detail != "", detail))
    records = F.col("records") if "records" in retry.columns else F.lit(0)
    # A page that is told twice counts once, as a success if one was.
    once = retry.groupBy("job_id", "page").agg(F.min(F.struct((F.col("outcome") != "Success").alias("failed"), reason.alias("reason"), records.alias("records"))).alias("r"))
    asked = once.select("job_id", "page", "r.*").join(state.select("job_id", F.explode("failed_pages").alias("page")), ["job_id", "page"])
    again = F.map_from_entries(F.collect_list(F.when(F.col("failed"), F.struct(F.col("page").cast("long"), "reason"))))
    error = F.max_by(F.when(F.col("failed"), F.concat(F.lit("Page "), "page", F.lit(": "), "reason")), F.when(F.col("failed"), F.col("page")))
    told = asked.groupBy("job_id").agg(F.collect_set(F.when(~F.col("failed"), F.col("page"))).alias("fixed"), F.sum(F.when(~F.col("failed"), F.col("records"))).alias("more"), again.alias("again"), error.alias("error"))
    rows = state.join(told, "job_id", "left").withColumn("fixed", F.coalesce(F.col("fixed").cast(ids), F.array().cast(ids)))
    touched = F.size("failed_pages") > 0
    left = F.array_except("failed_pages", "fixed")
    done = (F.size(left) == 0) & (F.col("last_completed_page") >= F.col("total_pages"))
    values = {"status": F.when(~touched, F.col("status")).when(done, "Completed").otherwise("Paused"), "failed_pages": left, "records_saved": F.col("records_saved") + F.coalesce("more", F.lit(0))}
    if "skips" in state.columns:
        renewed = F.transform("skips", lambda s: F.when(s["kind"] == "Page", s.withField("reason", F.coalesce(F.try_element_at("again", s["page"].cast("long")), s["reason"]))).otherwise(s))
        values["skips"] = F.filter(renewed, lambda s: ~F.array_contains("fixed", s["page"].cast(ids.elementType)))
    if "last_error" in state.columns:
        values["last_error"] = F.when(touched, F.col("error")).otherwise(F.col("last_error"))
    return rows.select(*(values[c].alias(c) if c in values else F.col(c) for c in state.columns))


def capped_profiles(rows: DataFrame, max_profiles: int, job: str = "job_id", state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Profiles (job, page, rec_idx, profile_url) a job visits, the first
    ``max_profiles`` in order, and the others as skip items (page, kind, url,
    reason): their records keep the listing's data.  With ``state`` (job, profiles_visited,
    max_profiles) a job's own limit counts, less the profiles it has visited before."""
    turn = F.row_number().over(Window.partitionBy(job).orderBy("page", "rec_idx"))
    placed = rows.where("profile_url is not null")
    if state is None:
        placed = placed.withColumn("_most", F.lit(max_profiles)).withColumn("_left", F.lit(max_profiles))
    else:
        most = F.coalesce("max_profiles", F.lit(max_profiles)) if "max_profiles" in state.columns else F.lit(max_profiles)
        had = F.coalesce("profiles_visited", F.lit(0)) if "profiles_visited" in state.columns else F.lit(0)
        placed = placed.join(state.select(job, most.alias("_most"), (most - had).alias("_left")), job, "left")
        placed = placed.withColumn("_most", F.coalesce("_most", F.lit(max_profiles))).withColumn("_left", F.coalesce("_left", F.lit(max_profiles)))
    placed = placed.withColumn("_r", turn)
    reason = F.format_string("Profile limit reached (%d) \u2014 only the listing data was saved", F.col("_most").cast("long"))
    over = placed.where(F.col("_r") > F.col("_left")).select(job, "page", F.lit("Profile").alias("kind"), F.col("profile_url").alias("url"), reason.alias("reason"))
    return placed.where(F.col("_r") <= F.col("_left")).drop("_r", "_most", "_left"), over


def save_state(state: DataFrame, path: str, stamp=None) -> None:
    """Job states as JSON lines, stamped; a reader sees the old or the new table,
    as the write is committed as a whole into a folder of its own."""
    state.withColumn("updated_at", F.current_timestamp() if stamp is None else stamp).write.mode("overwrite").json(path)


def load_state(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """Saved job states; of one job none or one row."""
    schema = "job_id string, status string, total_pages int, last_completed_page long, failed_pages array<long>, records_saved long, last_error string, skips array<struct<page:long,kind:string,reason:string>>, updated_at timestamp"
    out = spark.read.schema(schema).json(path)
    return out if job_id is None else out.where(F.col("job_id") == job_id)


def load_records(spark: SparkSession, path: str, schema: str = "key string, page long, fields map<string,string>, profile_url string") -> DataFrame:
    """Saved records from JSON lines; blank lines are left."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


class UpsertTable:
    """A table of the last row of each key, kept as the batches that made it.

    A batch is folded by key and appended as Parquet below ``batch=``, dealt to
    ``buckets`` by a hash of the key, so what is written follows the batch and not the
    table.  A batch that is replayed replaces its own partitions alone.  Reading folds
    the batches by key: the last batch's row, at the place where the key first came
    (``first_seq``).  ``compact`` writes that fold beside the batches and deletes them
    after; a crash in between, or a replay of an old batch after it, leaves the same
    rows."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key", order: str = "seq", buckets: int = 16):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, rows: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        dealt = rows.withColumn("batch", F.lit(number).cast("long")).withColumn("bucket", bucket).repartition(self.buckets, "bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(self.path)

    def append(self, n: int, rows: DataFrame) -> None:
        """Batch ``n`` of rows (key, order, ...)."""
        self._write(upsert(rows, self.key, self.order), 2 * n)  # odd numbers are compacted ones

    def batches(self) -> DataFrame | None:
        """The rows of all batches from the newest compacted one on, with ``batch`` and
        ``bucket``."""
        path, fs = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        numbers = [int(n.split("=")[1]) for n in names if n.startswith("batch=")]
        if not numbers:
            return None
        folded = max((n for n in numbers if n % 2), default=0)
        return self.spark.read.option("mergeSchema", True).parquet(self.path).where(F.col("batch") >= folded)

    def read(self, keys: DataFrame | None = None) -> DataFrame | None:
        """The table, or the rows of ``keys`` alone (one column; those that are few
        enough to broadcast then prune the buckets read)."""
        rows = self.batches()
        if rows is None:
            return None
        if keys is not None:
            wanted = keys.select(F.col(keys.columns[0]).alias(self.key)).distinct()
            rows = rows.join(wanted.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")), [self.key, "bucket"], "left_semi")
        return self._folded(rows)

    def _folded(self, rows: DataFrame) -> DataFrame:
        held = [c for c in rows.columns if c not in ("batch", "bucket", "first_seq")]
        last, first = F.max_by(F.struct(*held), "batch"), F.min_by("first_seq", "batch")
        return rows.groupBy(F.col(self.key).alias("_k")).agg(last.alias("_r"), first.alias("first_seq")).select("_r.*", "first_seq")

    def compact(self, n: int) -> None:
        """Fold the batches up to ``n`` into one, which readers then begin at."""
        rows = self.batches()
        old = [r.batch for r in rows.select("batch").distinct().collect() if r.batch <= 2 * n] if rows is not None else []
        if len(old) < 2:
            return
        self._write(self._folded(rows.where(F.col("batch") <= 2 * n)), 2 * n + 1)
        jvm = self.spark.sparkContext._jvm
        _, fs = self._files()
        for b in old:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={b}"), True)


def upsert_stream(source: DataFrame, table: UpsertTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, compact_every: int = 50, mode: str = "append"):
    """Start a stream that upserts ``prepare(batch)`` (key, order, ...) into a table;
    ends when the source is drained."""

    def batch(df: DataFrame, n: int) -> None:
        table.append(n, prepare(df))
        if n % compact_every == compact_every - 1:
            table.compact(n)

    return source.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a job's stream returns: job_state's columns, and a number that grows.
JOB_ROW = "job_id string, status string, total_pages int, last_completed_page long, failed_pages array<long>, records_saved long, last_error string, skips array<struct<page:long,kind:string,reason:string>>, version long"
_OPEN = "waiting array<struct<page:long,attempt:long,outcome:string,records:long,detail:string>>"
_FINAL = ("Success", "Forbidden", "UrlNotAllowed")


class JobPages(StatefulProcessor):
    """One job: its state as in ``job_state``, and the attempts of pages whose turn has
    not come.  Pages settle in order: a page by its first final attempt, or when it has
    used up its ``retries``; attempts may come in any order.  With ``patience_ms`` a timer
    settles a page that the job has waited for so long (by event time) as it stands.
    A job is one value, read and written once a batch, as every call goes over a socket."""

    def __init__(self, retries: int, stop_on_failure: bool, patience_ms: int | None):
        self.retries, self.stop_on_failure, self.patience_ms = retries, stop_on_failure, patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", f"{JOB_ROW}, {_OPEN}")

    def _load(self, key, total: int) -> tuple[dict, dict, bool]:
        """The job, the attempts of its open pages, and whether it is known."""
        told = self.job.get()
        if told is None:
            return {"job_id": key[0], "status": "Paused", "total_pages": min(total, C.MAX_JOB_PAGES), "last_completed_page": 0, "failed_pages": [], "records_saved": 0, "last_error": None, "skips": [], "version": 0}, {}, False
        names = [c.split()[0] for c in JOB_ROW.replace("struct<page:long,kind:string,reason:string>", "x").split(", ")]
        *values, waiting = told
        held = dict(zip(names, values, strict=True))
        pages: dict[int, list] = {}
        for page, *attempt in waiting:
            pages.setdefault(page, []).append(tuple(attempt))
        return held | {"failed_pages": list(held["failed_pages"]), "skips": [tuple(s) for s in held["skips"]]}, pages, True

    def _save(self, job: dict, waiting: dict) -> None:
        self.job.update((*job.values(), [(page, *a) for page, held in waiting.items() for a in held]))

    def _settled(self, held: list) -> tuple | None:
        """The attempt that counts, once it is known: all before it have come."""
        for i, a in enumerate(sorted(held)):
            if a[0] != i + 1:
                return None
            if a[1] in _FINAL or i + 1 == self.retries:
                return a
        return None

    def _settle(self, job: dict, page: int, attempt: tuple) -> None:
        _, outcome, records, detail = attempt
        job["version"] += 1
        if outcome == "Success":
            job["records_saved"] += records
        else:
            reason = f"{outcome} \u2014 {detail}" if detail else outcome
            job["failed_pages"].append(page)
            job["skips"].append((page, "Page", reason))
            job["last_error"] = f"Page {page}: {reason}"
        if outcome == "Forbidden" or (outcome != "Success" and self.stop_on_failure):
            job["status"] = "Blocked"
        else:
            job["last_completed_page"] = page
            job["status"] = "Completed" if page >= job["total_pages"] else "Paused"

    def _next(self, job: dict) -> int | None:
        return None if job["status"] in ("Blocked", "Completed") else job["last_completed_page"] + 1

    def _run(self, job: dict, waiting: dict, late: bool = False) -> list[Row]:
        """Settle what can be; with ``late`` the page waited for first, as it stands."""
        before = job["version"]
        while page := self._next(job):
            held = waiting.get(page, [])
            attempt = self._settled(held)
            if attempt is None and late:
                attempt = max(held, default=(0, "NetworkError", 0, "no attempt logged"))
            late = False
            if attempt is None:
                break
            self._settle(job, page, attempt)
            waiting.pop(page, None)
        if not self._next(job):
            waiting.clear()
        return [Row(**job)] if job["version"] > before else []

    def _wait(self, waiting: dict, now: int) -> None:
        if self.patience_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if waiting:
                self.handle.registerTimer(now + self.patience_ms)

    def handleInputRows(self, key, rows, timerValues):
        job, waiting, known, latest, came = None, {}, False, 0, {}
        for r in rows:
            if job is None:
                job, waiting, known = self._load(key, r.total_pages)
            latest = max(latest, int(r.ts.timestamp() * 1000)) if self.patience_ms is not None else 0
            due = self._next(job)
            if due is not None and due <= r.page <= job["total_pages"] and 1 <= r.attempt <= self.retries:
                came.setdefault(r.page, []).append((r.attempt, r.outcome, r.records, r.detail))
        for page, new in came.items():
            held = {a[0]: a for a in new} | {a[0]: a for a in waiting.get(page, [])}
            waiting[page] = list(held.values())
        if job is not None:
            out = self._run(job, waiting)
            if came or not known:  # a timer may come before any page settles
                self._save(job, waiting)
            self._wait(waiting, latest)
            yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        job, waiting, _ = self._load(key, 0)
        out = self._run(job, waiting, late=True) if self._next(job) else []
        if out:
            self._save(job, waiting)
        self._wait(waiting, timerValues.getCurrentWatermarkInMs())
        yield from out

    def close(self) -> None:
        pass


def job_stream(attempts: DataFrame, retries: int = 3, stop_on_failure: bool = False, patience: str | None = None, patience_ms: int | None = None) -> DataFrame:
    """Job states from a stream of attempts (job_id, page, attempt from 1, total_pages,
    outcome, records, detail; ts if late pages are to be given up): a row for each job
    and batch that settled a page.  ``patience_ms``: how long, by ``ts``, a job waits for
    a page while later ones are there; ``patience``: the watermark's delay ("10 minutes").
    An attempt that is told twice counts once.  State is a job's open pages, at most
    ``MAX_JOB_PAGES``."""
    spark = attempts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = ["job_id", "page", "attempt", "total_pages", "outcome", "records", "detail"]
    kinds = {"page": "long", "attempt": "long", "total_pages": "int", "records": "long"}
    rows = attempts.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in names), *(["ts"] if patience_ms is not None else []))
    retries = min(max(retries, 1), 10)
    if patience_ms is not None:
        rows = rows.withWatermark("ts", patience or "0 seconds")
    else:
        # Pages and attempts beyond the job's own never count, so they need not be sent to it; their times do.
        rows = rows.where(F.col("page").between(1, F.least("total_pages", F.lit(C.MAX_JOB_PAGES))) & F.col("attempt").between(1, retries))
    return rows.groupBy("job_id").transformWithState(JobPages(retries, stop_on_failure, patience_ms), JOB_ROW, "Update", "None" if patience_ms is None else "EventTime")
