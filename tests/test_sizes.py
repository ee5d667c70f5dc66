"""What larger tables bring out, on inputs as small as show it."""

import pytest
from pyspark.sql import functions as F

from gleaner import value_queries as V
from gleaner.sources import shred


@pytest.fixture
def suppliers(spark, tmp_path):
    def made(n):
        spark.range(n).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
        return str(tmp_path)

    return made


def test_pages_of_a_long_listing_have_ids_of_their_own(spark, suppliers, monkeypatch):
    """the listings of follow_notices and scrape_paged, some beyond 1,000 pages."""
    sf, made, real = suppliers(28100), [], V._listing

    def seen(*args, **options):
        made.append(real(*args, **options))
        raise StopIteration

    monkeypatch.setattr(V, "_listing", seen)
    for query, roots in ((V.follow_notices, 7), (V.scrape_paged, 2)):
        with pytest.raises(StopIteration):
            query(spark, sf)
        ids = made[-1].agg(F.count("page_id").alias("n"), F.countDistinct("page_id").alias("d")).first()
        assert ids.n == ids.d > 1000 * roots
        assert sorted(r.root for r in V._starts(made[-1]).collect()) == list(range(roots))


def test_a_page_is_never_held_as_nodes():
    """the tokenizer's memory does not grow with a page's nodes."""
    import tracemalloc

    html = "<ul>" + "<li data-k='1'><b>x</b></li>" * 60_000 + "</ul>"
    tracemalloc.start()
    n = sum(b.num_rows for b in shred.page_batches(1, html))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 180_002 and peak < 40 << 20


def test_small_pages_share_a_batch():
    got = list(shred.batches_of((i, f"<p>{i}</p>") for i in range(100)))
    assert len(got) == 1
    rows = got[0].to_pylist()
    assert [(r["page_id"], r["pre"], r["size"], r["text"]) for r in rows] == [x for i in range(100) for x in ((i, 0, 2, ""), (i, 1, 1, ""), (i, 2, 0, str(i)))]


def test_addresses_are_worked_out_once(spark):
    """an address's rule names its parts once, not once a use (31,494 characters before)."""
    from gleaner.operators import addresses

    assert len(addresses.ip_bits(F.col("ip"))._jc.toString()) < 4000
    told = {"10.0.0.1": "0" * 20 + "ffff0a000001", "::ffff:10.0.0.1": "0" * 20 + "ffff0a000001", "[2A00::1%eth0]": "2a00" + "0" * 27 + "1", "1.2.3.999": None, "1::2::3": None, "": None, "h1.example.com": None, "beef": None}
    rows = spark.createDataFrame([(k,) for k in told], "ip string").select("ip", addresses.ip_bits(F.col("ip")).alias("b"))
    assert {r.ip: r.b for r in rows.collect()} == told


def test_redirects_are_resolved_once(spark):
    """F8: a new address is resolved once, not once for every mention in its check."""
    from gleaner.functions import urls
    from gleaner.operators import links

    assert len(urls.rejection(F.col("u"))._jc.toString()) < 4000  # 11,756 before
    hops = spark.createDataFrame([("https://x.org/a", 302, "b/../c"), ("https://x.org/c", 301, "http://[::ffff:10.1.1.1]/")], "url string, status int, location string")
    out = links.redirected(spark.createDataFrame([("https://x.org/a",), ("https://x.org/z",)], "url string"), hops)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 6 * 4
    assert sorted((r.url[-1], r.final_url, r.hops, r.reason) for r in out.collect()) == [("a", "http://[::ffff:10.1.1.1]/", 2, "blocked host"), ("z", "https://x.org/z", 0, None)]


def test_small_tables_are_dealt_before_much_is_made_of_them(spark, suppliers):
    """pages made of a small file are shredded in many tasks (one before)."""
    sf = suppliers(50)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert V._profiles(spark, sf, "<p>x</p>").rdd.getNumPartitions() == parts > 1


def test_resumed_jobs_are_not_one_task_of_all_sorts(spark, sf):
    """every sort and window of a task holds memory pages of its own, whatever its rows."""
    plan = V.resume_more_profiles(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") + plan.count("Window [") <= 12


def test_texts_are_cleaned_once_a_page(spark):
    """a text was cleaned once for every element around it."""
    import re
    import unicodedata

    from gleaner.functions import text as T
    from gleaner.operators import dom

    odd = ["a", " b ", "\t", "​", " \xad \t", "\n c \n", "　d\xa0", "e\t\tf  g", "  ", "\x85", "h ​ i"]
    html = "<div>" + "".join(f"<p>{a}<b>{b}</b>{a}</p>" for a in odd for b in odd) + "</div><i>\t</i>"
    nodes = shred.shred(spark.createDataFrame([(1, html)], "page_id long, html string"))
    told = dom.visible_text(nodes)
    assert "regexp_replace" not in told._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    rows = nodes.collect()
    texts = [r.text for r in rows if r.kind == "text"]
    want = {}
    for r in rows:
        if r.kind != "text" and r.text_to > r.text_from:
            whole = "".join(c for c in " ".join(texts[r.text_from : r.text_to]) if unicodedata.category(c) != "Cf")
            want[r.pre] = re.sub("[ \t]+", " ", whole).strip(T.WHITE_SPACE)
    assert {r.pre: r.vtext for r in told.collect()} == want


def test_trim_takes_the_white_space_of_patterns(spark):
    """ends are looked at, not all of a text; they are those of (?U)\\s."""
    from gleaner.functions import text as T

    rows = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c")).select(F.concat("c", F.lit("a"), "c", F.lit("b\n"), "c").alias("v"))
    assert "regexp" not in T.trim(F.col("v"))._jc.toString()
    assert rows.where(~F.regexp_replace("v", r"(?U)^\s+|\s+$", "").eqNullSafe(T.trim(F.col("v")))).count() == 0


def test_tokens_are_met_without_a_split_each(spark):
    """a text's words are split once, not once a token."""
    from gleaner.functions import text as T

    rows = spark.createDataFrame([("the fee box", True), ("coffee", False), ("consultation", True), ("feel a fees", False), ("", False), (None, False), ("long notice", False), ("my annual notice", True)], "v string, ok boolean")
    met = T.matches_token(F.lower("v"), F.array(F.lit("fee"), F.lit("consultation fee"), F.lit("annual x")))
    assert all(r.ok == r.met for r in rows.select("ok", met.alias("met")).collect())
    assert met._jc.toString().count("split(") <= 2


def test_elements_of_whole_pages_are_not_joined_to_find_their_record(spark):
    """of a page that is one record all elements are inside it."""
    from gleaner.plans import scrape as plan

    pages = spark.createDataFrame([(1, "https://x.org/", "<h1>Ann Lee</h1><p>x</p>"), (2, "https://x.org/b", None)], "page_id long, url string, html string")
    got = plan.scrape(pages, [plan.Field("Name")], whole_page=True)
    assert {(r.page_id, r.rec_idx, r.value) for r in got.results.collect()} == {(1, 0, "Ann Lee"), (2, 0, None)}
    text = got.scene.inner()._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") == 1 and "explode" not in text


def test_listings_are_dealt_before_their_pages_are_made(spark, suppliers):
    """pages of listings were made and shredded in one task."""
    pages = V._listing(spark, suppliers(200), F.floor(F.col("s_suppkey") / 10), 10)
    assert pages.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert pages.count() == 20


def test_a_page_may_come_in_pieces():
    """of markup cut anywhere the nodes are those of the whole page."""
    import random

    r = random.Random(3)
    bits = "< > </ /> <!-- --> <! -- ' \" = a &amp; &am p; t <a <p> </p> <ul><li> </ul> <td <script> </script> </script <title <textarea> </textarea\t> x='1' y=\"2 z=3 <br> <br/> <div é <p/".split(" ") + [" ", "\n", "\U0001f600"]
    for _ in range(3000):
        html = "".join(r.choices(bits, k=r.randrange(1, 30)))
        cuts = sorted(r.randrange(len(html) + 1) for _ in range(r.choice((1, 3, 40))))
        builder = shred._Builder()
        for _ in builder.parse([html[a:b] for a, b in zip([0, *cuts], [*cuts, len(html)], strict=True)]):
            pass
        assert sorted(builder.rows, key=lambda x: x[4]) == shred.page_nodes(html), html
    rows = [(1, "<p>a"), (1, None), (1, "b</"), (1, "p>"), (2, "<i"), (3, ""), (2, "<b>x")]
    got = [(x["page_id"], x["tag"], x["text"]) for b in shred.batches_of_pieces(rows) for x in b.to_pylist()]
    assert got == [(1, "#document", ""), (1, "p", ""), (1, "#text", "ab"), (2, "#document", ""), (3, "#document", ""), (2, "#document", ""), (2, "b", ""), (2, "#text", "x")]


def test_no_page_is_held_as_markup():
    """the tokenizer's memory does not grow with a page that comes in pieces (12 MB of markup here)."""
    import tracemalloc

    piece = "<li data-k='1'><b>" + "x" * 200 + "</b></li>"
    tracemalloc.start()
    n = sum(b.num_rows for b in shred.batches_of_pieces((1, piece) for _ in range(60_000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 180_001 and peak < 32 << 20


def test_pages_of_many_orders_are_never_one_value(spark, sf, monkeypatch):
    """xpath_axes made every page a list of all its orders, and then a text (up to 38 MB at 9,000,000 orders)."""
    made = []

    def seen(pieces):
        made.append(pieces)
        raise StopIteration

    monkeypatch.setattr(shred, "shred", seen)
    monkeypatch.setattr(shred, "shred_pieces", seen, raising=False)
    with pytest.raises(StopIteration):
        V.xpath_axes(spark, sf)
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_join" not in plan
    assert made[0].agg(F.max(F.length("html"))).first()[0] < 200
    assert made[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
