"""Scalar rules against tables of inputs and expected values."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import kinds as K
from gleaner.functions import text as T
from gleaner.functions import urls as U
from gleaner.operators import dom
from gleaner.sources import attempts, shred


def one(spark, make, *values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in rows.select(make(F.col("v"))).collect()]


def test_kind_by_name(spark):
    names = ["Name", "Full Name", "Specialist", "Location", "Address", "Fees", "Consultation Fee", "Treatment Price", "Cost", "Pricing", "Email", "Phone", "Website", "Rating", "Zorblax", "", None]
    kinds = ["Name"] * 3 + ["Location"] * 2 + ["Currency"] * 5 + ["Email", "Phone", "Url", "Rating", "Text", "Text", "Text"]
    assert one(spark, K.infer_kind, *names) == kinds


@pytest.mark.parametrize(("kind", "value", "ok"), [("Currency", "£150", True), ("Currency", "From £120", True), ("Currency", "150 GBP", True), ("Currency", "Manchester", False), ("Location", "Manchester", True), ("Location", "£150", False), ("Name", " ", False), ("Number", "12345", False), ("Rating", "4.9/5", True), ("Rating", "4.9", False), ("Url", "/a", True)])
def test_plausible(spark, kind, value, ok):
    assert one(spark, lambda v: K.plausible(F.lit(kind), v), value) == [ok]


def test_page_urls(spark):
    rows = [("https://x.org/list/page-1", 6, "https://x.org/list/page-6"), ("https://x.org/list/page/2/", 10, "https://x.org/list/page/10/"), ("https://x.org/list", 3, "https://x.org/list?page=3"), ("https://x.org/?a=1&page=2", 4, "https://x.org/?a=1&page=4")]
    got = spark.createDataFrame(rows, "u string, n int, want string").select(U.page_url(F.col("u"), F.col("n")), "want").collect()
    assert all(a == b for a, b in got)


def test_blocked_urls(spark):
    bad = ["ftp://x.org/", "file:///etc", "javascript:alert(1)", "http://localhost/", "http://127.0.0.1/", "http://0.0.0.0", "http://10.1.1.1", "http://172.16.0.1", "http://172.31.9.9", "http://192.168.1.1", "http://169.254.1.1", "http://[::1]/", "http://[fd00::1]/", "http://a.internal/", "", None]
    good = ["https://example.org/a", "http://172.15.255.255/", "http://172.32.0.1/", "http://8.8.8.8/"]
    assert all(r is not None for r in one(spark, U.rejection, *bad))
    assert one(spark, U.rejection, *good) == [None] * 4


def test_resolve(spark):
    from urllib.parse import urljoin

    base = "http://h.org/a/b/c?q#f"
    refs = ["d", "/x/../y", "../z", "./k", "//o.org/p", "https://q.org/", "?n=1", "#t", "../../../up", "e/f?g#h"]
    got = one(spark, lambda v: U.resolve(F.lit(base), v), *refs)
    assert got == [urljoin(base, r) for r in refs]


def test_multi_match(spark):
    text = "12.3 miles | 32 St Thomas St, London, SE1 9BSmore. Rated, review SE1 9BS"
    assert one(spark, lambda v: K.every_match("Location", v), text) == ["32 St Thomas St, London, SE1 9BS"]
    assert one(spark, lambda v: K.every_match("Currency", v), "£5, £6. £5") == ["£5; £6"]


def test_normal_forms(spark):
    assert one(spark, K.normal_number, "1,200", "20+ years here", "many") == ["1,200", "20+ years", None]
    assert one(spark, K.normal_currency, "£5", "x" * 300 + " £5 and £6", "call us", "y" * 61) == ["£5", "£5; £6", "call us", None]


def test_csv_cells(spark):
    assert one(spark, T.csv_cell, "a", None, "a,b", 'a"b', "a\nb", "") == ["a", "", '"a,b"', '"a""b"', '"a\nb"', ""]


def test_outcomes(spark):
    rows = [(200, "<p>x", "Success"), (403, "", "Forbidden"), (429, "", "RateLimited"), (500, "", "ServerError"), (503, "", "ServerError"), (200, " ", "EmptyResponse"), (200, "Just a Moment", "ChallengePage"), (None, None, "NetworkError")]
    got = spark.createDataFrame(rows, "s int, h string, want string").select(attempts.outcome(F.col("s"), F.col("h")), "want").collect()
    assert all(a == b for a, b in got)


def test_shred_repairs_and_decodes():
    tags = [n[1] for n in shred.page_nodes("<p>a<p>b<ul><li>c<li>d</ul><br>AT&T &amp; co &copy x")]
    assert tags.count("p") == 2 and tags.count("li") == 2
    assert shred.page_nodes("AT&T &amp; co &copy x")[1][3] == "AT&T & co &copy x"
    assert [n[1] for n in shred.page_nodes(None)] == ["#document"]


def test_entities():
    assert len(shred.entities_of('[{"@type":"Person"},{"@type":"ItemList","itemListElement":[{"item":{"@type":"Person","name":"A"}},{"name":"B"}]}]')) == 3
    assert shred.entities_of("{broken") == []
    leaves = shred.leaves_of({"Address": [{"streetAddress": "1 A St", "addressLocality": "B"}, "C"], "price": "4.90", "ok": True})
    assert leaves["address*"] == "1 A St, B; C" and leaves["address!"] == "1 A St, B" and leaves["price"] == "4.90" and leaves["ok"] == "True"


def test_selectors(spark):
    html = '<div class="a x"><p id="k">1</p><p>2</p></div><div class="b"><section><p data-q="zz">3</p></section></div>'
    nodes = shred.shred(spark.createDataFrame([(1, html)], "page_id long, html string"))
    e, t = dom.elements(nodes), dom.visible_text(nodes)

    def texts(sel, kind="Css"):
        return sorted(r.value for r in dom.select(e, sel, kind, texts=t).join(dom.extracted(e, t, "Text"), ["page_id", "pre"]).collect())

    assert texts("div.a > p") == ["1", "2"]
    assert texts("div p") == ["1", "2", "3"]
    assert texts("#k, [data-q^=z]") == ["1", "3"]
    assert texts("div.b > p") == [] and texts("") == [] and texts("p:::") == []
    assert texts("p:nth-child(2)") == ["2"]
    assert texts("//div[@class='b']//p", "XPath") == ["3"]
    assert texts("p + p") == ["2"] and texts("#k ~ p") == ["2"] and texts("p:not(#k)") == ["2", "3"] and texts("p:last-child") == ["2", "3"]
    assert texts("p:nth-child(odd)") == ["1", "3"] and texts("p:nth-child(2n)") == ["2"] and texts("p:nth-child(-n+1)") == ["1", "3"] and texts("div > p:only-of-type") == []
    assert texts("div:not(.a, .c) p") == ["3"] and texts("p:first-of-type") == ["1", "3"]
    assert texts("//p[last()]", "XPath") == ["2", "3"] and texts("//p[. = '2' or @data-q]", "XPath") == ["2", "3"] and texts("//p[not(@id) and contains(text(), '2')]", "XPath") == ["2"]
    assert texts("//p[@id='k']/following-sibling::p | //section/p[1]", "XPath") == ["2", "3"] and texts("//p[position()=2]", "XPath") == ["2"]
    assert texts("//p[", "XPath") == [] and texts("p + ") == []


def test_inner_markup(spark):
    html = "<div> <b>x</b> &amp; y<br> </div><p>open<p>next<script>var a;</script></p>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    nodes = shred.shred(pages)
    e = dom.elements(nodes)
    got = [r.value for r in dom.extracted(e.where("tag in ('div', 'p')"), None, "Html", pages=pages).orderBy("pre").collect()]
    assert got == ["<b>x</b> &amp; y<br>", "open", "next<script>var a;</script>"]
    assert [r.value for r in dom.extracted(e.where("tag = 'p'"), None, "Text", nodes=nodes).orderBy("pre").collect()] == ["open", "nextvar a;"]


def test_shredding_never_fails():
    import random

    r = random.Random(1)
    parts = [*"<>/!&#;=\"' abpx-[", "<p", "<div ", "</", "<!--", "-->", "<![", "<script>", "</script>", "&#", "&amp", "<?", "\x00", "\ud800", "é", "<li>", "</div>"]
    for _ in range(10_000):
        html = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        nodes = [b for x in shred.page_batches(1, html) for b in x.to_pylist()]
        assert nodes[0]["size"] == len(nodes) - 1 and all(n["inner_from"] <= n["inner_to"] or n["kind"] != "element" for n in nodes)
        assert all(n["pre"] <= n["pre"] + n["size"] < len(nodes) and (not n["ancestors"] or n["ancestors"][-1] == n["parent"]) for n in nodes)
    for html in ("<div>" * 100_000, "</p>" * 100_000, "<a href='" * 20_000, "<b>" * 500 + "<li>x" * 5000, "<p><b>" * 20_000):
        assert max(len(a) for x in shred.page_batches(1, html) for a in x.column("ancestors").to_pylist()) <= shred.MAX_DEPTH
    assert shred.entities_of("[" * 100_000) == [] and shred.entities_of("[" * 50_000 + "]" * 50_000) == []
    assert shred.page_nodes("x AT&T")[1][3] == "x AT&T"


def test_state_search_order():
    told = shred.state_texts('{"z": {"email": "first@x"}, "a": {"email": "second@x"}, "phone": 5, "tel": [" ", ["12"]], "b": [{"Email": "third@x"}]}')
    assert told == [("tel", "12"), ("email", "first@x"), ("email", "second@x"), ("email", "third@x")]
