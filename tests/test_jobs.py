"""Job streams, the upsert table, archives, addresses, walks and notices."""

import datetime
import gzip
import ipaddress
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.functions import catalog as C
from gleaner.operators import addresses, dom, export, strategies
from gleaner.plans import scrape as plan
from gleaner.sources import attempts, recorded, shred
from gleaner.streaming import jobs

ATTEMPT = "job_id string, page long, attempt long, total_pages int, outcome string, records long, detail string, ts timestamp"


def streamed(spark, folder, batches, **options):
    table = jobs.UpsertTable(spark, f"{folder}/states", "job_id", "version", 3)
    for rows in batches:
        spark.createDataFrame(rows, ATTEMPT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        jobs.upsert_stream(jobs.job_stream(source, **options), table, f"{folder}/log", mode="update").awaitTermination()
    return {r.job_id: r for r in table.read().collect()}


def at(minute):
    return datetime.datetime(2026, 1, 2, 3, minute)


def test_job_stream_is_the_fold(spark, tmp_path):
    r = random.Random(3)
    rows = []
    for j in range(12):
        for page in range(1, 8):
            for attempt in (1, 2, 3):
                outcome = r.choice(["Success", "Success", "ServerError", "RateLimited", "Forbidden" if j % 3 == 0 else "Success"])
                rows.append((f"j{j}", page, attempt, 6, outcome, 2, "x" if page % 2 else None, at(page)))
                if outcome in ("Success", "Forbidden"):
                    break
    r.shuffle(rows)
    cut = len(rows) // 2
    got = streamed(spark, tmp_path, [rows[:cut], rows[cut:], rows[:5]])
    df = spark.createDataFrame(rows, ATTEMPT)
    want = {x.job_id: x for x in jobs.job_state(attempts.settled(df)).collect()}
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert all(got[k][c] == x[c] for c in ("status", "total_pages", "last_completed_page", "failed_pages", "records_saved", "last_error")), k
        assert [tuple(s) for s in got[k].skips] == [tuple(s) for s in x.skips]


def test_job_stream_gives_up_a_page_in_time(spark, tmp_path):
    first = [("a", 1, 1, 3, "Success", 1, "", at(0)), ("a", 3, 1, 3, "Success", 1, "", at(1)), ("b", 2, 1, 2, "Success", 1, "", at(1))]
    got = streamed(spark, tmp_path, [first], patience_ms=120_000)
    assert (got["a"].last_completed_page, got["a"].status) == (1, "Paused") and "b" not in got
    later = [("c", 1, 1, 1, "Success", 1, "", at(30))]
    got = streamed(spark, tmp_path, [later, [("c", 2, 1, 1, "Success", 1, "", at(31))]], patience_ms=120_000)
    assert (got["a"].status, got["a"].failed_pages, got["a"].last_error) == ("Completed", [2], "Page 2: NetworkError — no attempt logged")
    assert (got["b"].status, got["b"].failed_pages, got["b"].records_saved) == ("Completed", [1], 1)


def written(path):
    return {d: sum(os.path.getsize(os.path.join(b, f)) for b, _, fs in os.walk(path / d) for f in fs if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("batch=")}


def test_upsert_writes_what_came(spark, tmp_path):
    table = jobs.UpsertTable(spark, str(tmp_path / "t"), buckets=4)
    assert table.read() is None
    many = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    table.append(0, many)
    few = spark.createDataFrame([("k5", 30_000, "new"), ("k5", 30_001, "newer"), ("z", 30_002, "z")], "key string, seq long, v string")
    table.append(1, few)
    sizes = written(tmp_path / "t")
    assert sizes["batch=2"] * 50 < sizes["batch=0"]

    def state(t):
        return {r.key: (r.v, r.seq, r.first_seq) for r in t.read().where("key in ('k5', 'z', 'k6')").collect()}

    want = state(table)
    assert want["k5"] == ("newer", 30_001, 5) and want["z"] == ("z", 30_002, 30_002) and table.read().count() == 20_001
    table.append(1, few)  # a replay
    assert state(table) == want and table.read().count() == 20_001
    table.compact(1)
    assert set(written(tmp_path / "t")) == {"batch=3"} and state(table) == want
    table.append(1, few)
    table.append(2, few.where("key = 'z'").withColumn("v", F.lit("zz")).withColumn("more", F.lit(1)))
    assert state(table)["z"][0] == "zz" and state(table)["k5"] == want["k5"]
    assert [r.key for r in table.read(spark.createDataFrame([("k6",), ("none",)], "k string")).collect()] == ["k6"]


def test_archives(spark, tmp_path):
    recorded.register(spark)
    when = datetime.datetime(2026, 1, 2, 3, 4, 5)
    rows = [(f"https://x.org/{i}", when, 200 if i % 2 else 404, "text/html", "utf-8" if i % 3 else None, (os.urandom(3000) + b"WARC/1.0\r\n\x1f\x8b\x08 \xc3\xa9") if i else b"") for i in range(300)]
    df = spark.createDataFrame(rows, "url string, fetched_at timestamp, status int, content_type string, charset string, body binary").repartition(3)
    folder = str(tmp_path / "w")
    df.write.format("warc").mode("append").save(folder)
    for split in (1 << 30, 50_000, 777):
        got = spark.read.format("warc").option("splitBytes", split).load(folder)
        assert sorted((r.url, r.fetched_at, r.status, r.content_type, r.charset, bytes(r.body)) for r in got.collect()) == sorted(rows)
    some = spark.read.format("warc").load(folder).where("status = 404 and url like 'https://x.org/1%'").select("url", "body")
    explained = some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == len([r for r in rows if r[2] == 404 and r[0].startswith("https://x.org/1")]) and "BatchScan warc" in explained
    assert "FilterExec" not in explained and "status" not in explained.split("BatchScan")[0], explained
    few = spark.read.format("warc").schema("status int, url string").load(folder)
    assert few.columns == ["status", "url"] and few.where("status < 300").count() == 150
    df.limit(2).write.format("warc").mode("overwrite").save(folder)
    assert spark.read.format("warc").load(folder).count() == 2


def test_archives_of_others(spark, tmp_path):
    recorded.register(spark)

    def record(kind, http, url="https://x.org/a"):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2026-01-02T03:04:05Z\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"

    zipped = gzip.compress(b"packed body")
    told = [
        record("warcinfo", b"software: x"), record("request", b"GET / HTTP/1.1\r\n\r\n"), record("response", b"HTTP/1.1 200 OK\r\nContent-Type: Text/HTML; charset=\"UTF-8\"\r\nContent-Encoding: gzip\r\n\r\n" + zipped),
        record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nabcd\r\n3;x\r\nefg\r\n0\r\n\r\n"), record("response", b"junk"), record("response", b"HTTP/1.1 200 OK\r\n\r\n" + b"y" * 500),
        record("response", b"HTTP/1.1 200 OK\r\nContent-Encoding: deflate\r\n\r\nnot packed"), record("response", b"HTTP/1.1 301 Moved\r\nLocation: /b\r\n\r\n"),
    ]
    want = [(200, "text/html", "utf-8", b"packed body"), (200, None, None, b"abcdefg"), (None, None, None, b""), (200, None, None, None), (200, None, None, None), (301, None, None, b"")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.warc").write_bytes(b"".join(told) + told[2][:60])  # cut short
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, told)) + gzip.compress(told[2])[:40])
    (tmp_path / "z" / "_SUCCESS").write_bytes(b"")
    (tmp_path / "z" / "empty.warc").write_bytes(b"")
    for folder in ("p", "z"):
        for split in (1 << 20, 300):
            got = spark.read.format("warc").option("splitBytes", split).option("maxBody", 100).load(str(tmp_path / folder)).orderBy("offset").collect()
            assert [(r.status, r.content_type, r.charset, None if r.body is None else bytes(r.body)) for r in got] == want
    assert zlib.decompress(zlib.compress(b"x")) == b"x"


def test_ip_bits(spark):
    r = random.Random(7)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1.2.3.4", "FE80::1%eth0", "64:ff9b::192.0.2.33"]
    bad = ["", "1.2.3", "1.2.3.256", "1:2:3", "1::2::3", ":1::", "1:::2", "12345::", "g::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "::1.2.3", "1.2.3.4:5", None]
    for _ in range(300):
        v = ipaddress.IPv6Address(r.getrandbits(128) & r.choice([(1 << 128) - 1, ((1 << 128) - 1) ^ (((1 << 64) - 1) << 32), 0xFFFF]))
        texts += [str(v), v.exploded.upper(), str(ipaddress.IPv4Address(r.getrandbits(32)))]
    df = spark.createDataFrame([(t,) for t in texts + bad], "ip string").withColumn("b", addresses.ip_bits(F.col("ip")))
    got = [x.b for x in df.collect()]

    def want(t):
        a = ipaddress.ip_address(t.split("%")[0])
        return f"{int(a) + (0xFFFF << 32 if a.version == 4 else 0):032x}"

    assert got == [want(t) for t in texts] + [None] * len(bad)
    blocks = [f"{r.getrandbits(32) & 0xFFFFFFFF:d}" for _ in range(0)] + ["0.0.0.0/0", "128.0.0.0/1", "10.9.8.7/29", "::/0", "2000::/3", "fe80::/10", "1.2.3.4", "9.9.9.9/33", "x/8", "::/129"]
    held = addresses.covering(df.select("ip"), spark.createDataFrame([(b,) for b in blocks], "block string"))
    mapped = {b: ipaddress.ip_network(b if ":" in b else f"::ffff:{b.split('/')[0]}/{int((b.split('/') + ['32'])[1]) + 96}", strict=False) for b in blocks[:-3]}
    for x in held.collect():
        inside = [b for b, n in mapped.items() if ipaddress.IPv6Address(int(want(x.ip), 16)) in n]
        assert x.block == max(inside, key=lambda b: mapped[b].prefixlen) and x.blocks == len(inside)
    assert held.count() == len(set(texts))


def test_walks_end(spark):
    rows = [("a", 1, 1, "Success"), ("a", 2, 1, "RateLimited"), ("a", 2, 2, "Success"), ("a", 3, 1, "ServerError"), ("a", 3, 2, "Success"), ("a", 4, 1, "Success")]
    rows += [("b", 1, 1, "RateLimited"), ("b", 1, 2, "Success"), ("c", 1, 1, "Success"), *(("c", 2, i, "RateLimited") for i in range(1, 5)), ("c", 2, 5, "Success"), ("d", 1, 1, "Success"), ("d", 3, 1, "Success")]
    df = spark.createDataFrame(rows, "walk string, page int, attempt int, outcome string")
    got = {r.walk: (r.pages, r.wait_ms, r.cooldowns, r.ended_by) for r in attempts.cooled(df).collect()}
    assert got == {"a": (2, 8600, 1, "ServerError"), "b": (0, 0, 0, "RateLimited"), "c": (1, 24_800, 3, "RateLimited"), "d": (1, 0, 0, None)}


def test_retry_keeps_the_newest_failure(spark):
    rows = spark.createDataFrame([("j", p, 5, "ServerError" if p in (3, 5) else "Success", 1, "HTTP 500") for p in range(1, 6)], "job_id string, page int, total_pages int, outcome string, records int, detail string")
    state = jobs.job_state(rows)
    again = spark.createDataFrame([("j", 3, "RateLimited", 0, "HTTP 429"), ("j", 5, "Success", 4, ""), ("j", 5, "ServerError", 0, "")], "job_id string, page int, outcome string, records int, detail string")
    r = jobs.retried(state, again).first()
    assert (r.last_error, r.failed_pages, r.status, r.records_saved) == ("Page 3: RateLimited — HTTP 429", [3], "Paused", 7)
    assert [(s.page, s.reason) for s in r.skips] == [(3, "RateLimited — HTTP 429")]
    more = jobs.resume_from(state, None, max_profiles=9).first()
    assert (more.max_profiles, more.last_completed_page) == (9, 5) and "max_profiles" not in jobs.resume_from(state, 2, max_profiles=0).columns


def cards(n, cls="card"):
    return "".join(f'<div class="{cls}"><h2><a href="/p/{i}">Dr Ann {chr(65 + i % 26)}{chr(97 + i // 26)}x</a></h2><p class="intro">Practice of long standing</p></div>' for i in range(n))


def test_large_groups_are_named(spark):
    pages = spark.createDataFrame([(1, "https://x.org/1", f"<section>{cards(301)}</section>"), (2, "https://x.org/2", f"<section>{cards(5)}</section>")], "page_id long, url string, html string")
    out = plan.scrape(pages, [plan.Field("Name")], max_records=None)
    assert {r.page_id: r.n for r in out.records.groupBy("page_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 5}
    assert [(r.page_id, r.warning) for r in out.notices().collect()] == [(1, "301 repeated elements are more than the 300 that may be records.")]
    every = plan.scrape(pages, [plan.Field("Name")], max_records=None, max_group=None)
    assert every.records.where("page_id = 1").count() == 301 and every.notices().count() == 0


def test_repeated_pages_are_one(spark):
    rows = [(1, "https://x.org/b", f"<section>{cards(6)}</section>"), (1, "https://x.org/a", f"<section>{cards(4)}</section>"), (1, "https://x.org/a", f"<section>{cards(4)}</section>"), (2, "https://x.org/c", f"<section>{cards(3)}</section>")]
    out = plan.scrape(spark.createDataFrame(rows, "page_id long, url string, html string"), [plan.Field("Name")])
    assert {r.page_id: r.n for r in out.records.groupBy("page_id").agg(F.count("*").alias("n")).collect()} == {1: 4, 2: 3}


def test_followed_listings_tell(spark):
    page = "<section>{}</section><nav><a href='?page={}'>Next</a></nav>"
    rows = [(1, "https://x.org/a", page.format(cards(9), 2)), (2, "https://x.org/b", page.format(cards(4), 2)), (3, "https://x.org/b?page=2", page.format(cards(4), 3)), (4, "https://x.org/c", "<p>none</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    starts = spark.createDataFrame([("a", "https://x.org/a"), ("b", "https://x.org/b"), ("c", "https://x.org/c"), ("d", "https://x.org/absent")], "root string, url string")
    out = plan.follow(pages, starts, [plan.Field("Name")], max_pages=5, max_records=7, record_selector=".card")
    assert {r.root: (r.pages_processed, r.n_records) for r in out.roots.collect()} == {"a": (1, 7), "b": (2, 7), "c": (1, 0)}
    assert sorted(tuple(r) for r in out.notices.collect()) == [("a", "Only the first 7 records were processed out of 9 found."), ("c", C.NO_MATCH)]


def test_requests_and_exports_are_checked(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>")], "page_id long, url string, html string")
    for bad in ({"max_records": 0}, {"max_records": 1001}, {"fields": []}):
        with pytest.raises(ValueError):
            plan.scrape(**{"pages": pages, "fields": [plan.Field("A")], **bad})
    with pytest.raises(ValueError):
        plan.follow(pages, pages.select(F.lit(1).alias("root"), "url"), [plan.Field("A")], max_pages=101)
    assert plan.validated_export(["url"], pages) == ["url"]
    for names in ([], ["url", "absent"]):
        with pytest.raises(ValueError):
            plan.validated_export(names, pages)
    with pytest.raises(ValueError):
        export.csv_rows(pages, [])


def test_selector_scopes(spark):
    html = "<p>x</p>" + "".join(f"<ul class='c'>{'<li>i</li>' * n}</ul>" for n in (200, 0, 301, 50))
    pages = spark.createDataFrame([(1, "u", html), (2, "u", "<ul><li>a</li></ul>" + "<li>b</li>" * 700)], "page_id long, url string, html string")
    nodes = shred.shred(pages)
    elems, texts = dom.elements(nodes), dom.visible_text(nodes)
    for record, want in (("ul.c", {1: (501, 5), 2: (0, 0)}), (None, {1: (551, 5), 2: (701, 5)}), (" ", {1: (551, 5), 2: (701, 5)})):
        got = {r.page_id: (r.matches, len(r.previews)) for r in dom.selector_test(elems, texts, "li", record_selector=record).collect()}
        assert got == want


def test_a_provider_that_fails_loses_its_own_text_alone():
    def ask(texts, names):
        if "bad" in texts:
            raise RuntimeError("no")
        return [{"a": t} for t in texts]

    with pytest.warns(UserWarning, match="provider failed"):
        assert strategies._told(ask, ["x", "bad", "y"], ["a"]) == [{"a": "x"}, {}, {"a": "y"}]
    with pytest.warns(UserWarning, match="once a text"):
        assert strategies._told(lambda t, n: [], ["x"], ["a"]) == [{}]


def test_a_job_is_read_and_written_once_a_batch():
    """every call on a state goes over a socket; 12 and more a job before."""
    import types

    class Value:
        calls, held = 0, None

        def exists(self):
            self.calls += 1
            return self.held is not None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls, self.held = self.calls + 1, value

    value = Value()
    run = jobs.JobPages(3, False, None)
    run.init(types.SimpleNamespace(getValueState=lambda *_: value, getMapState=None))

    def batch(*told):
        value.calls = 0
        rows = [types.SimpleNamespace(page=p, attempt=a, outcome=o, records=2, detail="", total_pages=4) for p, a, o in told]
        return [r.asDict() for r in run.handleInputRows(("a",), iter(rows), None)]

    assert batch((1, 2, "Success"), (2, 1, "Success"), (4, 1, "Success"), (3, 1, "ServerError")) == [] and value.calls == 2
    (got,) = batch((1, 1, "ServerError"), (3, 2, "Success"))
    assert value.calls == 2 and (got["status"], got["last_completed_page"], got["records_saved"], got["version"]) == ("Completed", 4, 8, 4)
    assert batch((4, 2, "Success")) == [] and value.calls == 1
