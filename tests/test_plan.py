"""Extraction, merging and jobs end to end on small inputs."""

from pyspark.sql import functions as F

from gleaner.operators import export, merge, resolve
from gleaner.plans.scrape import Field, deep, scrape
from gleaner.streaming import jobs

CARD = '<div class="card"><h2><a href="/p/{0}">Dr Ann {1}</a></h2><p class="intro">Consults in the town clinic</p><span class="fee">£{0}0</span></div>'


def listing(names):
    return "<body><nav><ul><li>Home</li></ul></nav><main>" + "".join(CARD.format(i + 1, n) for i, n in enumerate(names)) + "</main><footer>Fee £1</footer></body>"


def test_listing_profiles_and_whole_pages(spark):
    pages = spark.createDataFrame(
        [(1, "https://x.org/l", listing(["Able", "Baker", "Charlie"])), (2, "https://x.org/p/1", "<body><h1>Dr Ann Able</h1><dl><dt>Fee</dt><dd>£99</dd></dl><a href='mailto:a@x.org'>Mail</a></body>"), (3, "https://x.org/empty", None)],
        "page_id long, url string, html string",
    )
    fields = [Field("Name"), Field("Fee"), Field("Email", required=True)]
    out = scrape(pages, fields)
    rows = {(r.page_id, r.rec_idx): r for r in out.wide().collect()}
    assert [rows[1, i].Name for i in range(3)] == ["Dr Ann Able", "Dr Ann Baker", "Dr Ann Charlie"]
    assert [rows[1, i].Fee for i in range(3)] == ["£10", "£20", "£30"]
    assert (rows[2, 0].Name, rows[2, 0].Fee, rows[2, 0].Email) == ("Dr Ann Able", "£99", "a@x.org")
    assert rows[3, 0].Name is None
    assert {r.name for r in out.warnings().collect()} == {"Email"}
    merged = {(r.page_id, r.rec_idx, r.name): r for r in deep(out, pages, fields).collect()}
    assert merged[1, 0, "Fee"].value == "£99" and merged[1, 0, "Email"].value == "a@x.org" and merged[1, 0, "Fee"].visited
    assert merged[1, 1, "Fee"].value == "£20" and merged[1, 0, "Fee"].profile_url == "https://x.org/p/1"


def test_downgrade_and_contact_kinds(spark):
    asked = spark.createDataFrame([(1, "Currency"), (2, "Phone"), (3, "Text")], "id int, kind string")
    cands = spark.createDataFrame([(1, "Selector", "dear", 99), (1, "Pattern", "cheap", 65), (2, "Selector", "none", 99)], "id int, strategy string, value string, confidence int")
    got = {r.id: (r.value, r.confidence, r.level, r.is_missing) for r in resolve.resolve(asked, cands, ["id"]).collect()}
    assert got == {1: ("dear", 49, "Low", False), 2: (None, 0, "None", True), 3: (None, 0, "None", True)}


def test_upsert_in_place(spark):
    a = spark.createDataFrame([("k1", 1, "a"), ("k2", 2, "b"), ("k1", 3, "c")], "key string, seq int, v string")
    b = spark.createDataFrame([("k2", 4, "d"), ("k3", 5, "e")], "key string, seq int, v string")
    saved = merge.merge_into(merge.merge_into(None, a), b)
    assert [(r.key, r.v) for r in saved.orderBy("first_seq").collect()] == [("k1", "c"), ("k2", "d"), ("k3", "e")]


def test_upserts_follow_each_other_over_uneven_parts(spark):
    """Merges of merges where adaptive execution splits parts: F1."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.5", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(40000).select(F.concat(F.lit("k"), F.col("id") % 15000).alias("key"), F.col("id").alias("seq"))
        saved = None
        for i in range(4):
            saved = merge.merge_into(saved, rows.where(f"seq >= {i * 10000} and seq < {(i + 1) * 10000}"))
        assert saved.columns == ["key", "seq", "first_seq"]
        assert sorted((r.first_seq, r.seq) for r in saved.collect()) == [(k, k + 15000 * ((39999 - k) // 15000)) for k in range(15000)]
        odd = spark.createDataFrame([(None, 1), ("a", 2)], "key string, seq long")
        assert sorted((str(r.key), r.seq, r.first_seq) for r in merge.merge_into(merge.merge_into(None, odd), odd.where("key = 'a'").select("key", (F.col("seq") + 7).alias("seq"))).collect()) == [("None", 1, 1), ("a", 9, 2)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_stream_upsert_is_replayable(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "key string, seq int, v string").coalesce(1).write.json(src)
    table = jobs.UpsertTable(spark, str(tmp_path / "t"))

    def run():
        jobs.upsert_stream(spark.readStream.schema("key string, seq int, v string").json(src), table, str(tmp_path / "c")).awaitTermination()

    run()
    spark.createDataFrame([("a", 3, "z")], "key string, seq int, v string").write.mode("append").json(src)
    run()
    run()
    assert sorted((r.key, r.v) for r in table.read().collect()) == [("a", "z"), ("b", "y")]


def test_job_states(spark):
    rows = [("done", p, "Success") for p in (1, 2, 3)] + [("forbidden", 1, "Forbidden"), ("forbidden", 2, "Success")] + [("gap", 1, "ServerError"), ("gap", 2, "Success"), ("gap", 3, "Success")] + [("short", 1, "Success")]
    pages = spark.createDataFrame([(j, p, 3, o, 1) for j, p, o in rows], "job_id string, page int, total_pages int, outcome string, records int")
    got = {r.job_id: (r.status, r.last_completed_page, r.failed_pages, r.records_saved) for r in jobs.job_state(pages).collect()}
    assert got == {"done": ("Completed", 3, [], 3), "forbidden": ("Blocked", 0, [1], 0), "gap": ("Completed", 3, [1], 2), "short": ("Paused", 1, [], 1)}


def test_export(spark):
    df = spark.createDataFrame([(1, "é,b", None), (2, "c", "d")], "page int, x string, y string")
    data = export.csv_bytes(df, ["x", "y"], ["page"])
    assert data.startswith(b"\xef\xbb\xbf") and data.decode("utf-8-sig") == 'x,y\r\n"é,b",\r\nc,d\r\n'
    import io
    import zipfile

    assert zipfile.ZipFile(io.BytesIO(export.zip_bytes(df, ["x", "y"], "page", ["x"]))).namelist() == ["1.csv", "2.csv"]


def test_locations_and_degenerate(spark):
    df = spark.createDataFrame([(1, "A; B"), (2, "C"), (3, None)], "id int, loc string")
    assert sorted((r.id, r.loc) for r in merge.expand_locations(df, "loc").where("loc is not null").collect()) == [(1, "A"), (1, "B"), (2, "C")]
    r = spark.createDataFrame([(1, 0, "n", "x"), (1, 1, "n", "x"), (2, 0, "n", "x"), (2, 1, "n", "y")], "page_id int, rec_idx int, name string, value string")
    assert [x.page_id for x in merge.degenerate_pages(r).select(F.col("page_id")).collect()] == [1]


def test_walks_and_redirects(spark):
    from gleaner.operators import links

    hops = spark.createDataFrame([("https://x.org/A", "https://x.org/b"), ("https://x.org/B", "https://x.org/a"), ("https://x.org/c", None)], "url string, next_url string")
    start = spark.createDataFrame([(1, "https://x.org/a"), (2, "https://x.org/c"), (3, "https://x.org/b")], "root int, url string")
    assert sorted(tuple(r) for r in links.walk(start, hops).collect()) == [(1, 1, "https://x.org/a"), (1, 2, "https://x.org/b"), (2, 1, "https://x.org/c"), (3, 1, "https://x.org/b"), (3, 2, "https://x.org/a")]
    assert links.walk(start.where("false"), hops).count() == 0 and links.walk(start, hops, 1).count() == 3
    moved = spark.createDataFrame([("https://x.org/a", 301, "/a"), ("https://x.org/b", 200, "/c"), ("https://x.org/d", 308, "ftp://x.org/")], "url string, status int, location string")
    asked = spark.createDataFrame([(f"https://x.org/{c}",) for c in "abd"] + [("http://localhost/",)], "url string")
    got = {r.url[-2:]: (r.hops, r.reason) for r in links.redirected(asked, moved).collect()}
    assert got == {"/a": (6, "too many redirects"), "/b": (0, None), "/d": (1, "scheme"), "t/": (0, "blocked host")}


def test_resume_is_clamped(spark):
    rows = spark.createDataFrame([("j", p, 3, "Success" if p != 2 else "ServerError", 1) for p in (1, 2, 3)], "job_id string, page int, total_pages int, outcome string, records int")
    state = jobs.job_state(rows)
    assert state.first().last_error == "Page 2: ServerError"
    for page, last, failed in ((99, 2, [2]), (-4, 0, []), (3, 2, [2]), (2, 1, [])):
        r = jobs.resume_from(state, page).first()
        assert (r.last_completed_page, r.failed_pages, r.status, len(r.skips)) == (last, failed, "Paused", len(failed))
    fixed = jobs.retried(state, spark.createDataFrame([("j", 2, "Success", 4), ("j", 3, "Success", 9)], "job_id string, page int, outcome string, records int")).first()
    assert (fixed.status, fixed.failed_pages, fixed.records_saved, fixed.skips, fixed.last_error) == ("Completed", [], 6, [], None)


def test_requests_are_checked():
    import pytest

    from gleaner.plans.scrape import validated_request

    assert [f.ord for f in validated_request("https://x.org", [Field("A"), Field("B")])] == [0, 1]
    for bad in ({"url": "x" * 2049}, {"url": " "}, {"max_records": 1001}, {"max_pages": 0}, {"max_profiles": 1001}, {"timeout_s": 31}, {"fields": []}, {"fields": [Field("A"), Field(" a")]}, {"fields": [Field("A", selector="b", extraction_type="Attribute")]}):
        with pytest.raises(ValueError):
            validated_request(**{"url": "https://x.org", "fields": [Field("A")], **bad})


def test_files_and_empty_pages(spark, tmp_path):
    df = spark.createDataFrame([(1, " a ", 'q"'), (1, "b", None), (2, "é", "x\ny")], "page int, x string, y string")
    export.write_csv(df, ["x", "y"], str(tmp_path / "csv"), by_page="page", order=["x"])
    read = {p.parent.name: p.read_bytes().decode("utf-8-sig") for p in (tmp_path / "csv").glob("*/part-*")}
    assert read == {"page=1": 'x,y\r\n a ,"q"""\r\nb,\r\n', "page=2": 'x,y\r\né,"x\ny"\r\n'}
    pages = spark.createDataFrame([(1, None, None), (2, "u", "<![ x"), (3, "u", "&#&amp;")], "page_id long, url string, html string")
    assert scrape(pages, [Field("Name"), Field("Email")]).results.count() == 6
    none = scrape(pages.where("false"), [Field("Name")])
    assert none.results.count() == 0 and none.notices().count() == 0
