"""More registered queries: strategies, followed pages, profiles and jobs, each
rendered from a relational table, extracted by the real operators, and compared with
what the table says."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import catalog as C
from .functions import leaves as L
from .functions import text as T
from .functions import urls as U
from .functions import kinds as K
from .operators import addresses, detect, dom, export, links, merge, strategies
from .plans import scrape as plan
from .queries import _dealt, _t, query
from .sources import attempts, recorded, shred
from .sources.stage import checkpoint_dir, staged
from .streaming import jobs

def _k():
    return F.col("s_suppkey")


def _say(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _profiles(spark, sf_dir, *body):
    """A page per supplier, its key as page_id."""
    html = _say("<html><body><h1>Dr Ann</h1>", *body, "</body></html>")
    return _dealt(_t(spark, sf_dir, "supplier"), _k()).select(_k().cast("long").alias("page_id"), _say("https://x.org/p/", _k()).alias("url"), html.alias("html"))


def _values(spark, sf_dir, fields, *body, **options):
    out = plan.scrape(_profiles(spark, sf_dir, *body), fields, whole_page=True, **options).results
    return out.select("page_id", "name", "value", "source", "confidence")


def _long(*fields):
    """SQL of (page_id, name, value, source, confidence) from expressions over k."""
    return " UNION ALL ".join(
        f"SELECT s_suppkey AS page_id, '{name}' AS name, {value} AS value, CASE WHEN {value} IS NULL THEN 'None' ELSE {source} END AS source, CAST(CASE WHEN {value} IS NULL THEN 0 ELSE {confidence} END AS INTEGER) AS confidence FROM supplier"
        for name, value, source, confidence in fields
    )


# --- strategies ------------------------------------------------------------------

@query(_long(
    ("Fee", "CASE s_suppkey % 6 WHEN 0 THEN '£' || s_suppkey || '; £' || (s_suppkey + 1) WHEN 5 THEN NULL ELSE '£' || s_suppkey END", "CASE WHEN s_suppkey % 6 = 4 THEN 'Pattern' ELSE 'SemanticHtml' END", "CASE s_suppkey % 6 WHEN 0 THEN 80 WHEN 1 THEN 82 WHEN 2 THEN 78 ELSE 65 END"),
    ("Website", "'/w/' || s_suppkey", "'SemanticHtml'", "80"),
    ("Role", "'Surgeon ' || s_suppkey", "'SemanticHtml'", "55"),
))
def semantic_values(spark, sf_dir):
    """A fee as labelled elements, definition list, heading label, label line, or
    in the text; a link by its label; a role by its place."""
    forms = [
        _say('<div class="box"><div class="fee">£', _k(), '</div><div class="the-price">£', _k() + 1, '</div><div class="fee">£', _k(), "</div></div>"), _say("<dl><dt>Hours</dt><dd>9</dd><dt>Fees</dt><!-- x --> <dd>£", _k(), "</dd></dl>"),
        _say("<h3>Consultation fee</h3><div><p>£", _k(), "</p></div>"), _say("<p>\nFee: £", _k(), "\n</p>"), _say("<p>it is £", _k(), " here</p>"), F.lit("<p>ask us</p>"),
    ]
    body = F.element_at(F.array(*forms), (_k() % 6 + 1).cast("int"))
    return _values(spark, sf_dir, [plan.Field("Fee"), plan.Field("Website"), plan.Field("Role")], "<p>Surgeon ", _k(), "</p>", body, '<a class="website" href="/w/', _k(), '">Site</a>')


_PERSON = [
    ("Name", "'Dr K ' || s_suppkey", 90), ("Location", "'Leeds ' || s_suppkey", 90), ("Email", "'s' || s_suppkey || '@example.com'", 90), ("Phone", "'+44 20 7946 ' || (1000 + s_suppkey % 9000)", 90), ("Website", "'https://x.org/' || s_suppkey", 90),
    ("Rating", "'4.' || (s_suppkey % 10) || '/5'", 90), ("Fee", "'£' || s_suppkey", 90), ("Biography", "'Has worked here for many years, ' || s_suppkey", 90), ("Role", "'Surgeon ' || s_suppkey", 85), ("Languages", "'English ' || s_suppkey", 75),
]


@query(_long(*((n, v, "'StructuredData'", str(c)) for n, v, c in _PERSON)))
def structured_values(spark, sf_dir):
    """Every kind's path in a page's one content entity, a role's path, and a
    property named like the field."""
    data = (
        '{"@context":"https://schema.org","@graph":[{"@type":"WebSite","name":"Site","a":1,"b":2,"c":3,"d":4,"e":5,"f":6,"g":7,"h":8,"i":9,"j":10,"k":11},{"@type":"Physician","name":"Dr K ', _k(), '","description":"Has worked here for many years, ', _k(), '","email":"s', _k(), '@example.com","telephone":"+44 20 7946 ', 1000 + _k() % 9000,
        '","address":[{"streetAddress":"1 High St","addressLocality":"Leeds ', _k(), '"}],"aggregateRating":{"ratingValue":"4.', _k() % 10, '/5"},"url":"https://x.org/', _k(), '","priceRange":"£', _k(), '","jobTitle":"Surgeon ', _k(), '","languages":["English ', _k(), '","French"]}]}',
    )
    body = [x.replace('[{"streetAddress"', '{"streetAddress"').replace('"}],"agg', '"},"agg') if isinstance(x, str) else x for x in data]
    return _values(spark, sf_dir, [plan.Field(n) for n, _, _ in _PERSON], '<script type="application/ld+json">', *body, "</script>")


@query(_long(("Email", "'s' || s_suppkey || '@example.com'", "'StructuredData'", "85"), ("Phone", "CASE WHEN s_suppkey % 2 = 0 THEN '020 7946 ' || (1000 + s_suppkey % 9000) END", "'StructuredData'", "85")))
def state_values(spark, sf_dir):
    """Contacts found in the application state, in its own order."""
    phone = F.when(_k() % 2 == 0, _say('"020 7946 ', 1000 + _k() % 9000, '"')).otherwise("1207946")
    return _values(spark, sf_dir, [plan.Field("Email"), plan.Field("Phone")], '<script id="__NEXT_DATA__" type="application/json">{"props":[1,{"zz":{"email":5,"emails":[" ","s', _k(), '@example.com"]},"aa":{"email":"late@example.com","PHONE":', phone, "}}]}</script>")


@query(_long(
    ("Email", "'s' || s_suppkey || '@example.com'", "'Pattern'", "CASE WHEN s_suppkey % 2 = 0 THEN 88 ELSE 65 END"),
    ("Phone", "CASE s_suppkey % 3 WHEN 0 THEN '+44 20 7946 ' || (1000 + s_suppkey % 9000) WHEN 1 THEN '020 7946 ' || (1000 + s_suppkey % 9000) ELSE '+442079460' || (100 + s_suppkey % 900) END", "'Pattern'", "CASE s_suppkey % 3 WHEN 0 THEN 88 WHEN 1 THEN 65 ELSE 55 END"),
))
def contact_patterns(spark, sf_dir):
    """mailto and tel links, shapes in the text, quoted numbers in scripts: the one
    nearest to the postcode."""
    mail = F.when(_k() % 2 == 0, _say('<a href="mailto:s', _k(), '%40example.com?subject=x">Mail</a>')).otherwise(_say("<p>write to s", _k(), "@example.com, or https://x.org/020-7946-0000</p>"))
    far = '"(+44)2079469999","x","y","some long stretch of other text in between","'
    script = _say("<script>var p=[", far, 'LS1 4AB","(+44)2079460', 100 + _k() % 900, '"]</script><script type="application/ld+json">{"@type":"Place","address":{"postalCode":"LS1 4AB"}}</script>')
    phone = F.when(_k() % 3 == 0, _say('<a href="tel:+44%2020%207946%20', 1000 + _k() % 9000, '">Call</a>')).when(_k() % 3 == 1, _say("<p>call 020 7946 ", 1000 + _k() % 9000, ".</p>")).otherwise(script)
    return _values(spark, sf_dir, [plan.Field("Email"), plan.Field("Phone")], mail, phone)


@query(_long(
    ("Rating", "CASE WHEN s_suppkey % 2 = 0 THEN '4.' || (s_suppkey % 10) || ' / 5' ELSE '3 stars' END", "'Pattern'", "65"),
    ("Experience", "(1 + s_suppkey % 50) || '+ years'", "'Pattern'", "55"), ("Website", "CAST(NULL AS VARCHAR)", "'Pattern'", "0"),
    ("Location", "(1 + s_suppkey % 90) || ' High Street, Leeds LS1 4AB; Mill Lane, York YO1 7HH'", "'Pattern'", "65"),
))
def text_patterns(spark, sf_dir):
    """Rating, years and postcode shapes in the text without footers; web addresses
    are taken out before the scan, so none is found."""
    rating = F.when(_k() % 2 == 0, _say("4.", _k() % 10, " / 5")).otherwise("3 stars")
    body = ("<p>has ", rating, " and ", 1 + _k() % 50, "+ years there</p>\n<p>\nsee https://x.org/", _k(), " now</p>\n<p>\n12.3 miles | ", 1 + _k() % 90, " High Street, Leeds LS1 4AB</p>\n<p>\n3 miles | Mill Lane, York YO1 7HH, </p><footer>5 stars, 99 years, Old Road, Bath BA1 1AA</footer>")
    return _values(spark, sf_dir, [plan.Field("Rating"), plan.Field("Experience"), plan.Field("Website"), plan.Field("Location")], *body)


@query(_long(("Location", "CASE s_suppkey % 3 WHEN 0 THEN 'North ' || s_suppkey || ', 1 A St; South, 2 B St, Leeds' WHEN 1 THEN 'Clinic ' || s_suppkey || ', Leeds LS1 4AB' ELSE 'Spa ' || s_suppkey || ', 7 High Road, Leeds LS1 4AB' END", "CASE WHEN s_suppkey % 3 = 2 THEN 'Pattern' ELSE 'StructuredData' END", "CASE WHEN s_suppkey % 3 = 2 THEN 65 ELSE 90 END")))
def clinic_values(spark, sf_dir):
    """Facilities of a page together; a clinic's name before its address, by its
    heading or by a marked element."""
    sites = _say('<script type="application/ld+json">[{"@type":"Clinic","name":"North ', _k(), '","address":"1 A St"},{"@type":"BreadcrumbList"},{"@type":"Hospital","name":"South","address":{"streetAddress":"2 B St","addressLocality":"Leeds"}},{"@type":"Clinic","name":"North ', _k(), '","address":"1 A St"}]</script>')
    headed = _say('<script type="application/ld+json">{"@type":"Physician","address":"Leeds LS1 4AB"}</script><h2>Clinic ', _k(), "</h2><p>5 Road, LS1 4AB</p>")
    marked = _say('<span class="clinic-name">Spa ', _k(), "</span>\n<p>\n7 High Road, Leeds LS1 4AB</p>")
    return _values(spark, sf_dir, [plan.Field("Location")], F.when(_k() % 3 == 0, sites).when(_k() % 3 == 1, headed).otherwise(marked))


@query(_long(
    ("Markup", "'<b>x</b> ' || s_suppkey || '<br>'", "'Selector'", "99"), ("Inner", "'ab' || s_suppkey", "'Selector'", "99"), ("Target", "'/t/' || s_suppkey", "'Selector'", "99"), ("Picture", "'/i/' || s_suppkey", "'Selector'", "99"),
    ("Data", "CASE WHEN s_suppkey % 2 = 0 THEN 'v' || s_suppkey END", "'Selector'", "99"), ("Last", "'c' || s_suppkey", "'Selector'", "99"),
))
def selector_values(spark, sf_dir):
    """A field's own selector, in every extraction mode, CSS and XPath."""
    f = plan.Field
    fields = [
        f("Markup", selector="div.m", extraction_type="Html"), f("Inner", selector="div.n"), f("Target", selector="//a[@rel='q' and not(@id)]", selector_type="XPath", extraction_type="Link"), f("Picture", selector="div + img", extraction_type="Link"),
        f("Data", kind="Auto", selector="div[data-v]", extraction_type="Attribute", attribute="data-v"), f("Last", kind="Auto", selector="//ul/li[last()]", selector_type="XPath"),
    ]
    fields = [f(**{**x.__dict__, "kind": "Auto"}) for x in fields]
    body = ('<div class="m"> <b>x</b> ', _k(), '<br> </div><div class="n">a<i>b</i>', _k(), '</div><a id="z" rel="q" href="/no">n</a><a rel="q" href="/t/', _k(), '">t</a><div', F.when(_k() % 2 == 0, _say(' data-v="v', _k(), '"')).otherwise(""), '>d</div><img src="/i/', _k(), '"><ul><li>a<li>b<li>c', _k(), "</ul>")
    return _values(spark, sf_dir, fields, *body)


@query(_long(("Phone", "CASE WHEN s_suppkey % 2 = 1 THEN '020 7946 1000' END", "'Pattern'", "88"), ("Fee", "'£5'", "'Pattern'", "65")))
def contact_barred(spark, sf_dir):
    """A profile that rules out contact has no contact values, but others."""
    barred = F.when(_k() % 2 == 0, "<p>It is Not possible to contact or book an appointment.</p>").otherwise("<p>Hello.</p>")
    return _values(spark, sf_dir, [plan.Field("Phone"), plan.Field("Fee")], barred, '<a href="tel:020%207946%201000">c</a><p>at £5 each</p>')


@query(_long(("Badge", "CASE WHEN s_suppkey % 3 = 0 THEN 'B' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'told ' || s_suppkey END", "CASE WHEN s_suppkey % 3 = 0 THEN 'Mark' ELSE 'Ai' END", "CASE WHEN s_suppkey % 3 = 0 THEN 70 ELSE 60 END")))
def strategy_hooks(spark, sf_dir):
    """A user's provider, and a strategy registered after the built-in ones."""

    def provider(asked):
        told = asked.withColumn("value", F.regexp_extract("text", "(told [0-9]+)", 1))
        return told.select("page_id", "rec_idx", F.explode("names").alias("name"), "value")

    def mark(scene):
        at = scene.elems.where("tag = 'mark'").join(scene.texts, ["page_id", "pre"]).select("page_id", "vtext")
        return scene.asked().join(at, "page_id").select("page_id", "rec_idx", "ord", F.col("vtext").alias("value"), F.lit(70).alias("confidence"))

    body = F.when(_k() % 3 == 0, _say("<mark>B", _k(), "</mark>")).when(_k() % 3 == 1, _say("<p>told ", _k(), "</p>")).otherwise("<p>none</p>")
    return _values(spark, sf_dir, [plan.Field("Badge", kind="Auto")], body, provider=provider, extra={"Mark": mark})


@query(_long(("Name", "CASE s_suppkey % 3 WHEN 0 THEN 'Dr Ann ' || s_suppkey WHEN 1 THEN 'Ann Smith' ELSE 'read about ' || s_suppkey || ' now' END", "'SemanticHtml'", "CASE s_suppkey % 3 WHEN 0 THEN 85 WHEN 1 THEN 75 ELSE 55 END")))
def name_values(spark, sf_dir):
    """A name as the first heading that is no cookie banner, as name-like text where
    the heading is initials, as a link where it is a question."""
    html = F.when(_k() % 3 == 0, _say("<h1>We use cookies</h1><h2>Necessary cookies</h2><h3>Dr Ann ", _k(), "</h3>")).when(_k() % 3 == 1, _say("<h1>NHS</h1><p>Ann Smith \u2014 surgeon ", _k(), "</p>")).otherwise(_say('<h2>Who are we?</h2><a href="/x">read about ', _k(), " now</a>"))
    pages = _t(spark, sf_dir, "supplier").select(_k().cast("long").alias("page_id"), F.lit("https://x.org/").alias("url"), html.alias("html"))
    return plan.scrape(pages, [plan.Field("Name")], whole_page=True).results.select("page_id", "name", "value", "source", "confidence")


# --- whole listings ----------------------------------------------------------------

#: Page ids from one long group to the next: more than a group has pages.
_SPAN = 1 << 32


def _listing(spark, sf_dir, group, size: int, ld: bool = False, tail=None, span: int = 1000):
    """Cards of suppliers in groups, ``size`` a page; groups of ``span`` pages or more
    would share page ids."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", group.cast("long").alias("g"))
    s = s.withColumn("at", (F.row_number().over(W.partitionBy("g").orderBy("s_suppkey")) - 1).cast("long")).withColumn("page", F.floor(F.col("at") / size) + 1)
    s = _dealt(s, "g", "page")  # pages are much larger than the rows they are made of
    card = _say('<div class="card"><h2><a href="/p/', _k(), '">Dr Ann ', F.translate(_k().cast("string"), "0123456789", "ABCDEFGHIJ"), '</a></h2><p class="intro">Practice of long standing</p><span class="fee">£', _k(), "</span></div>")
    item = _say('{"@type":"', F.when(_k() % 5 == 4, "Hospital").otherwise("Physician"), '","url":"https://l.example.com/P/', _k(), '/"}')
    rows = s.groupBy("g", "page").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", card.alias("c"))))["c"], "").alias("cards"), F.array_join(F.array_sort(F.collect_list(F.struct("at", item.alias("i"))))["i"], ",").alias("items"))
    script = _say('<script type="application/ld+json">[', F.col("items"), "]</script>") if ld else F.lit("")
    html = _say("<html><body><section>", F.col("cards"), "</section>", script, F.lit("") if tail is None else tail, "</body></html>")
    return rows.select((F.col("g") * span + F.col("page")).alias("page_id"), _say("https://l.example.com/g/", F.col("g"), "?page=", F.col("page")).alias("url"), html.alias("html"))


def _starts(pages):
    """The first page of every long group."""
    return pages.where(F.col("page_id") % _SPAN == 1).select(F.expr(f"page_id div {_SPAN}").alias("root"), "url")


_NAME = "'Dr Ann ' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"


@query(f"""
SELECT root, page_number, rec_idx, name FROM (SELECT *, count(*) OVER (PARTITION BY root, page_number) AS n FROM (
  SELECT s_suppkey % 2 AS root, CAST((i // 10) + 1 AS INTEGER) AS page_number, CAST(i % 10 AS INTEGER) AS rec_idx, i, {_NAME} AS name FROM (
    SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 2 ORDER BY s_suppkey) - 1 AS i FROM supplier) t) u) v
WHERE page_number <= 4 AND n >= 3 AND i < 35""")
def scrape_paged(spark, sf_dir):
    """Two listings followed over their next links, to the 4th page and the 35th
    record."""
    tail = _say('<nav><a href="?page=', F.col("page") + 1, '">Next</a></nav><a rel="next" href="https://other.example.com/g">x</a>')
    pages = _listing(spark, sf_dir, _k() % 2, 10, tail=tail, span=_SPAN)
    starts = _starts(pages)
    out = plan.crawl(pages, starts, [plan.Field("Name")], max_pages=4, max_records=35)
    return out.select("root", "page_number", "rec_idx", F.col("value").alias("name"))


_LISTED = """(SELECT g AS root, CAST(count(*) AS INTEGER) AS n, CAST(least(ceil(count(*) / 4.0), 3) AS INTEGER) AS walked FROM (SELECT s_suppkey % 7 AS g FROM supplier) t GROUP BY g)"""


@query(f"""
SELECT root, 'No match' AS warning, 1 AS pages_processed, CAST(0 AS BIGINT) AS n_records FROM {_LISTED} t WHERE root = 3
UNION ALL SELECT root, 'Email', CAST(least(walked, ceil(6 / 4.0)) AS INTEGER), CAST(least(n, 6) AS BIGINT) FROM {_LISTED} t WHERE root <> 3""")
def follow_notices(spark, sf_dir):
    """Followed listings of up to 3 pages of 4 cards and 6 records, with what they are
    told: a field that no card has, or a first page without a match, which ends the walk
    although later pages match."""
    tail = _say('<nav><a href="?page=', F.col("page") + 1, '">Next</a></nav>')
    pages = _listing(spark, sf_dir, _k() % 7, 4, tail=tail, span=_SPAN)
    pages = pages.withColumn("html", F.when(F.col("page_id") == 3 * _SPAN + 1, F.replace("html", F.lit('class="card"'), F.lit('class="other"'))).otherwise(F.col("html")))
    starts = _starts(pages)
    out = plan.follow(pages, starts, [plan.Field("Name"), plan.Field("Email", required=True)], max_pages=3, max_records=6, record_selector=".card")
    said = F.when(F.col("warning") == C.NO_MATCH, "No match").when(F.col("warning").contains("'Email'"), "Email").otherwise(F.col("warning"))
    return out.roots.join(out.notices, "root", "left").select("root", said.alias("warning"), "pages_processed", "n_records")


@query(f"""
SELECT s_suppkey // 10 * 1000 + 1 AS page_id, CAST(row_number() OVER (PARTITION BY s_suppkey // 10 ORDER BY s_suppkey) - 1 AS INTEGER) AS rec_idx, {_NAME} AS name FROM supplier WHERE s_suppkey % 5 <> 4""")
def scrape_majority(spark, sf_dir):
    """Cards whose entity (by its url) has another type than most are left out."""
    out = plan.scrape(_listing(spark, sf_dir, F.floor(_k() / 10), 10, ld=True), [plan.Field("Name")])
    return out.results.select("page_id", "rec_idx", F.col("value").alias("name"))


@query("""
SELECT s_suppkey AS page_id, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_records,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Only the first 2 records were processed out of 3 found.' ELSE 'The record selector did not match any elements.' END AS warning FROM supplier""")
def selector_no_match(spark, sf_dir):
    """A record selector: no records where it does not match, and what is cut off."""
    row = F.when(_k() % 2 == 0, "<tr class='r'><td>a</td></tr>").otherwise("<tr class='s'><td>a</td></tr>")
    pages = _profiles(spark, sf_dir, "<table>", row, row, row, "</table>")
    out = plan.scrape(pages, [plan.Field("Text", selector="td")], record_selector="//tr[@class='r']", selector_type="XPath", max_records=2)
    n = out.records.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_records"))
    return out.notices().join(n, "page_id", "left").select("page_id", F.coalesce("n_records", F.lit(0)).alias("n_records"), "warning")


@query("""
SELECT page_id, rec_idx, CASE WHEN turn <= 4 AND here THEN '£' || (s_suppkey + 1000) ELSE '£' || s_suppkey END AS fee, turn <= 4 AND here AS visited,
  CASE WHEN NOT here THEN 'Profile page not loaded' WHEN turn > 4 THEN 'Profile limit reached (4)' END AS reason FROM (
  SELECT s_suppkey, s_suppkey // 10 * 1000 + 1 AS page_id, CAST(s_suppkey % 10 AS INTEGER) AS rec_idx, s_suppkey % 3 <> 0 AS here,
    row_number() OVER (PARTITION BY s_suppkey // 10, s_suppkey % 3 <> 0 ORDER BY s_suppkey) AS turn FROM supplier) t""")
def profile_deep(spark, sf_dir):
    """Records merged with their profile pages, four a listing; the others as skips."""
    listings = _listing(spark, sf_dir, F.floor(_k() / 10), 10)
    profiles = _dealt(_t(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0"), _k()).select((-1 - _k()).cast("long").alias("page_id"), _say("https://l.example.com/p/", _k()).alias("url"), _say("<h1>Dr</h1><dl><dt>Fee</dt><dd>£", _k() + 1000, "</dd></dl>").alias("html"))
    fields = [plan.Field("Name"), plan.Field("Fee")]
    listed = plan.scrape(listings, fields)
    pages = listings.union(profiles)
    skips = plan.profile_plan(listed, pages, 4)[2]
    out = plan.deep(listed, pages, fields, 4).where("name = 'Fee'")
    return out.join(skips, ["page_id", "rec_idx"], "left").select("page_id", "rec_idx", F.col("value").alias("fee"), "visited", "reason")


@query(f"""
SELECT s_suppkey // 10 * 1000 + 1 AS page_id, CAST(s_suppkey % 10 AS INTEGER) AS rec_idx, {_NAME} AS "Name", 'https://l.example.com/p/' || s_suppkey AS "Profile URL" FROM supplier""")
def profile_column(spark, sf_dir):
    """The profile link of a record as a column of its own."""
    listings = _listing(spark, sf_dir, F.floor(_k() / 10), 10)
    listed = plan.scrape(listings, [plan.Field("Name")])
    return plan.with_profile_url(listed.wide(), plan.profile_plan(listed, listings)[0])


# --- page and text rules -----------------------------------------------------------

@query("""
SELECT s_suppkey AS page_id, 'Longer text ' || s_suppkey || chr(10) || chr(10) || 'Other ' || s_suppkey AS ptext, 'v' || s_suppkey AS beside,
  'box area k' || s_suppkey || ' t id the label' AS words FROM supplier""")
def page_texts(spark, sf_dir):
    """Paragraph text, the next element sibling, and attribute words."""
    pages = _profiles(spark, sf_dir, '<section class="box-area" id="k', _k(), '" data-testid="t_id" aria-label="The Label"><p>Longer text ', _k(), "</p><p>Other ", _k(), "</p><p>text ", _k(), "</p></section><dl><dt>T</dt> words <!-- c --><dd>v", _k(), "</dd></dl>")
    nodes = shred.shred(pages)
    e, t = dom.elements(nodes), dom.visible_text(nodes)
    box = e.where("tag = 'section'").select("page_id", "pre", "words")
    beside = e.where("tag = 'dt'").select("page_id", F.col("next_pre").alias("pre")).join(t, ["page_id", "pre"]).select("page_id", F.col("vtext").alias("beside"))
    return dom.paragraph_text(e, t, box).join(box, ["page_id", "pre"]).join(beside, "page_id").select("page_id", "ptext", "beside", "words")


@query("""
SELECT p_partkey, p_name || chr(10) || 'x' || p_size AS lines, p_partkey % 4 IN (0, 2) AS token, p_name || ' x' AS clean, '+44 20 ' || p_size AS phone,
  CASE WHEN p_partkey % 3 = 0 THEN 'job' ELSE 'a_b_' || p_partkey END AS folder, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS label, 'Leeds, ' || p_name AS places, 'see   or ' AS scanned FROM part""")
def text_rules(spark, sf_dir):
    """Number lines, label tokens, cleaning, phone form, folder names, first value,
    repeated parts, web addresses before a scan."""
    k, name = F.col("p_partkey"), F.col("p_name")
    # A short token as a whole word; a long one anywhere; a long word of a token.
    words = F.element_at(F.array(*map(F.lit, ("the fee box", "coffee box", "consultation box", "feel box"))), (k % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", T.without_number_lines(_say(" ", name, " \n 1,2 . 3\n\nx", F.col("p_size"))).alias("lines"), T.matches_token(words, F.array(F.lit("fee"), F.lit("consultation fee"))).alias("token"), T.clean_text(_say(" ", name, "​ \t x ")).alias("clean"),
        T.international_phone(_say(" (+44) 20 ", F.col("p_size"))).alias("phone"), T.job_folder(F.when(k % 3 == 0, "  ").otherwise(_say("a/b:", k))).alias("folder"), T.record_label(F.when(k % 2 == 0, name).otherwise(" "), F.col("p_type")).alias("label"),
        L.without_repeats(_say("Leeds, ", name, ",Leeds , ")).alias("places"), K.scannable(_say("see https://x.org/", name.substr(1, 1), " or ")).alias("scanned"),
    )


_SHAPES = [  # kind, value by k, whether plausible
    ("Email", "'a' || p_partkey || '@x.org'", "'a' || p_partkey || '@x'"), ("Phone", "'020 7946 ' || (1000 + p_partkey % 9000)", "'x' || p_name"), ("Url", "'https://x.org/' || p_partkey", "p_name"), ("Rating", "(p_partkey % 5) || '.5/5'", "'9.5/10'"),
    ("Number", "p_partkey % 9000 || ' of them'", "'1' || (10000 + p_partkey)"), ("Name", "p_name", "'x'"), ("Biography", "'A longer text about ' || p_name", "'Short'"), ("Text", "p_name", "''"), ("Location", "p_name || ' town'", "'£5 ' || p_name"), ("Currency", "'From £' || p_size", "p_size || ' pounds'"),
]


@query(" UNION ALL ".join(f"SELECT p_partkey, '{k}' AS kind, CASE WHEN p_partkey % 2 = 0 THEN {good} ELSE {bad} END AS value, p_partkey % 2 = 0 AS ok FROM part" for k, good, bad in _SHAPES))
def plausible_kinds(spark, sf_dir):
    """Every kind's plausibility rule, met and missed."""
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    good = {"Email": _say("a", k, "@x.org"), "Phone": _say("020 7946 ", 1000 + k % 9000), "Url": _say("https://x.org/", k), "Rating": _say(k % 5, ".5/5"), "Number": _say(k % 9000, " of them"), "Name": name, "Biography": _say("A longer text about ", name), "Text": name, "Location": _say(name, " town"), "Currency": _say("From £", size)}
    bad = {"Email": _say("a", k, "@x"), "Phone": _say("x", name), "Url": name, "Rating": F.lit("9.5/10"), "Number": _say("1", 10000 + k), "Name": F.lit("x"), "Biography": F.lit("Short"), "Text": F.lit(""), "Location": _say("£5 ", name), "Currency": _say(size, " pounds")}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.when(k % 2 == 0, good[n]).otherwise(bad[n]).alias("value")) for n in good)))
    return _t(spark, sf_dir, "part").select("p_partkey", each.alias("e")).select("p_partkey", "e.*").withColumn("ok", K.plausible(F.col("kind"), F.col("value")))


@query("""
SELECT s_suppkey AS page_id, '1 High St, Leeds, LS1 4AB' AS address, 'A ' || s_suppkey || '; 1 High St, Leeds, LS1 4AB' AS several, 'True' AS flag, '4.90' AS price, 'Org ' || s_suppkey AS org FROM supplier""")
def entity_leaves(spark, sf_dir):
    """Values of an entity as text: objects by name or parts, lists by their first
    or all items, numbers as written."""
    address = '{"streetAddress":"1 High St","addressLocality":"Leeds","addressRegion":"leeds","postalCode":"LS1 4AB"}'
    pages = _profiles(spark, sf_dir, '<script type="application/LD+json">{"@type":"Person","address":' + address + ',"places":["A ', _k(), '",' + address + ',"A ', _k(), '"," "],"ok":true,"price":4.90,"Works":{"name":" ","text":"Org ', _k(), '"}}</script><script type="application/ld+json">{broken</script>')
    leaves = F.col("leaves")
    return shred.entities(shred.shred(pages)).select("page_id", L.text_of(leaves, "address").alias("address"), L.list_text(leaves, "places").alias("several"), L.text_of(leaves, "ok").alias("flag"), L.text_of(leaves, "price").alias("price"), L.text_of(leaves, "works").alias("org"))


@query("""
SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN url END AS normal, CASE WHEN page_id % 3 = 0 THEN 'a' || page_id || '@x.org' END AS mail FROM pages""")
def url_forms(spark, sf_dir):
    """The form in which an allowed URL is fetched, and a scheme link's value."""
    k, u = F.col("page_id"), F.col("url")
    host = F.upper(U.part(u, "host"))
    rest = F.regexp_extract(u, "^[a-z]+://[^/?#]*(.*)$", 1)
    given = F.when(k % 5 == 0, _say("ftp://", host, rest)).when(U.part(u, "scheme") == "https", _say(" HTTPS://", host, ":443", rest)).otherwise(_say("Http://", host, ":80", rest, " "))
    href = F.when(k % 3 == 0, _say("mailto:a", k, "%40x.org?subject=q")).otherwise("tel:1")
    return _t(spark, sf_dir, "pages").select("page_id", U.normalized(given).alias("normal"), U.scheme_value(href, "mailto:").alias("mail"))


# --- fetching and jobs ---------------------------------------------------------------

@query("""
SELECT 'https://x.org/a' || s_suppkey || '/0' AS url, 'https://x.org/a' || s_suppkey || '/' || CASE WHEN s_suppkey % 9 = 8 THEN 6 ELSE least(s_suppkey % 9, 6) END AS final_url, CAST(least(s_suppkey % 9, 6) AS INTEGER) AS hops,
  CASE WHEN s_suppkey % 9 > 5 THEN 'too many redirects' END AS reason FROM supplier WHERE s_suppkey % 10 <> 0
UNION ALL SELECT 'https://x.org/a' || s_suppkey || '/0', 'http://127.0.0.1/', 1, 'blocked host' FROM supplier WHERE s_suppkey % 10 = 0""")
def redirect_walk(spark, sf_dir):
    """Logged redirects followed to their end, five at most, each address checked."""
    s = _dealt(_t(spark, sf_dir, "supplier").select("s_suppkey"), _k())
    base = _say("https://x.org/a", _k(), "/")
    i = F.col("i")
    to = F.when(_k() % 10 == 0, "http://127.0.0.1/").when(i % 3 == 0, _say(i + 1)).when(i % 3 == 1, _say("../a", _k(), "/", i + 1)).otherwise(_say(base, i + 1))
    length = F.when(_k() % 10 == 0, 1).otherwise(_k() % 9)
    hops = s.withColumn("n", length).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(_say(base, i).alias("url"), F.lit(302).alias("status"), to.alias("location"))
    return links.redirected(s.select(_say(base, "0").alias("url")), hops)


@query("""
SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN least((event_id % 20) * 1000, 8000) WHEN 1 THEN CASE WHEN event_id % 12 > 4 THEN least((event_id % 12 - 4) * 1000, 8000) ELSE least(power(2, event_id % 3) * 1000, 8000) END ELSE least(power(2, event_id % 3) * 1000, 8000) END AS BIGINT) AS wait_ms,
  CAST(round(least(power(2.0, event_id % 4) * 30.0, 120.0) * (1 + 0.2 * (event_id % 10) / 10.0) * 1000) AS BIGINT) AS backoff_ms,
  CAST(round(CASE WHEN event_id % 30 <= 1 THEN 0 ELSE 5.0 + (event_id % 10) / 10.0 * 10.0 + CASE WHEN event_id % 10 = 0 THEN 45.0 ELSE 0 END END * 1000) AS BIGINT) AS delay_ms FROM events""")
def pacing(spark, sf_dir):
    """Waits that a server asks for in seconds or by a date, backoff with its random
    part, and pauses before pages."""
    e = F.col("event_id")
    now = F.lit("2026-01-02 03:04:05").cast("timestamp")
    header = F.when(e % 3 == 1, F.date_format(F.timestamp_add("SECOND", (e % 12 - 4).cast("int"), now), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    wait = attempts.retry_wait_ms(e % 3, F.when(e % 3 == 0, (e % 20).cast("double")), attempts.retry_date(header), now)
    draw = (e % 10) / 10.0
    return _t(spark, sf_dir, "events").select("event_id", wait.alias("wait_ms"), F.round(attempts.backoff_s(e % 4 + 1, jitter=draw) * 1000).cast("long").alias("backoff_ms"), F.round(attempts.page_delay_s(e % 30, draw) * 1000).cast("long").alias("delay_ms"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 2 THEN s_name ELSE 'é ' || s_name END AS html FROM supplier WHERE s_suppkey % 10 <> 9")
def readable_body(spark, sf_dir):
    """Bodies within the size limit, by their charset, else as UTF-8."""
    k, text = _k(), F.concat(F.lit("é "), F.col("s_name"))
    body = F.when(k % 10 == 9, F.encode(F.repeat(F.lit("x"), 10 * 1024 * 1024 + 1), "UTF-8")).when(k % 4 == 0, F.encode(text, "UTF-8")).when(k % 4 == 1, F.encode(text, "ISO-8859-1")).when(k % 4 == 2, F.encode("s_name", "US-ASCII")).otherwise(F.encode(text, "UTF-16BE"))
    charset = F.element_at(F.array(F.lit("x-unknown"), F.lit("iso-8859-1"), F.lit("us-ascii"), F.lit("utf-16be")), (k % 4 + 1).cast("int"))
    return attempts.readable(_t(spark, sf_dir, "supplier").select("s_suppkey", body.alias("body"), charset.alias("charset"))).select("s_suppkey", "html")


def _states(spark, sf_dir):
    """A job per customer of ten pages; page p fails if (key + p) % 4 is 0."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("job_id"))
    # Dealt by job before its pages are made: windows and sums over a job need no other dealing, which would go by packed size.
    c = _dealt(c, "job_id").withColumn("page", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))))
    rows = c.select("job_id", "k", "page", F.lit(10).alias("total_pages"), F.when((F.col("k") + F.col("page")) % 4 == 0, "ServerError").otherwise("Success").alias("outcome"), F.lit(3).alias("records"), F.lit("HTTP 503").alias("detail"))
    return rows, jobs.job_state(rows)


_PAGES = "SELECT c_custkey AS k, unnest(range(1, 11)) AS page FROM customer"
_STATE = """CAST(k AS VARCHAR) AS job_id, CAST(10 AS INTEGER) AS total_pages"""


@query(f"""
SELECT {_STATE}, 'Paused' AS status, CAST(6 AS BIGINT) AS last_completed_page, string_agg(CASE WHEN (k + page) % 4 = 0 AND page <= 6 THEN CAST(page AS VARCHAR) END, ',' ORDER BY page) AS failed_pages,
  CAST(count(CASE WHEN (k + page) % 4 = 0 AND page <= 6 THEN 1 END) AS INTEGER) AS n_skips, CAST(count(CASE WHEN page % 2 = 0 AND page <= 6 THEN 1 END) AS BIGINT) AS profiles_visited FROM ({_PAGES}) t GROUP BY k""")
def resume_jobs(spark, sf_dir):
    """Jobs rewound to page 7: failures, skips and visits of later pages go."""
    rows, state = _states(spark, sf_dir)
    saved = rows.select("job_id", "page", (F.col("page") % 2 == 0).alias("visited"))
    out = jobs.resume_from(state, 7, saved)
    return out.select("job_id", F.col("total_pages").cast("int"), "status", F.col("last_completed_page").cast("long"), F.array_join("failed_pages", ",").alias("failed_pages"), F.size("skips").alias("n_skips"), F.col("profiles_visited").cast("long"))


_AGAIN = f"""(SELECT k, page, CASE WHEN (k + page) % 4 = 0 AND k % 2 = 1 AND page > 5 THEN 1 ELSE 0 END AS lost, CASE WHEN (k + page) % 4 = 0 AND k % 2 = 1 AND page > 5 AND page < 9 THEN 'RateLimited — HTTP 429'
  WHEN (k + page) % 4 = 0 THEN 'NetworkError' END AS reason FROM ({_PAGES}) t)"""


@query(f"""
SELECT {_STATE}, CASE WHEN k % 2 = 0 THEN 'Completed' ELSE 'Paused' END AS status, coalesce(string_agg(CASE WHEN lost = 1 THEN CAST(page AS VARCHAR) END, ',' ORDER BY page), '') AS failed_pages,
  CAST(sum(CASE WHEN lost = 0 THEN 3 ELSE 0 END) AS BIGINT) AS records_saved, coalesce(string_agg(CASE WHEN lost = 1 THEN page || '/' || reason END, ';' ORDER BY page), '') AS skips,
  arg_max('Page ' || page || ': ' || reason, page) FILTER (lost = 1) AS last_error FROM {_AGAIN} t GROUP BY k""")
def retry_failed(spark, sf_dir):
    """Failed pages tried again: in every other job only those up to page 5 load; the
    others fail for another reason, which their skips and the last error then tell."""
    rows, state = _states(spark, sf_dir)
    lost = (F.col("k") % 2 == 1) & (F.col("page") > 5)
    outcome = F.when(~lost, "Success").when(F.col("page") < 9, "RateLimited").otherwise("NetworkError")
    again = rows.where("outcome <> 'Success'").withColumn("outcome", outcome).withColumn("detail", F.when(F.col("page") < 9, "HTTP 429").otherwise(""))
    out = jobs.retried(state, again)
    skips = F.array_join(F.transform("skips", lambda s: F.concat_ws("/", s["page"].cast("string"), s["reason"])), ";")
    return out.select("job_id", F.col("total_pages").cast("int"), "status", F.array_join("failed_pages", ",").alias("failed_pages"), "records_saved", skips.alias("skips"), "last_error")


@query(f"""
SELECT CAST(k AS VARCHAR) AS job_id, page, CASE WHEN n > 4 - had THEN 'Profile limit reached (4) — only the listing data was saved' END AS reason FROM (
  SELECT k, page, row_number() OVER (PARTITION BY k ORDER BY page) AS n, k % 3 AS had FROM ({_PAGES}) t WHERE page > 2 * (k % 3) AND page % 2 = 0) t""")
def resume_more_profiles(spark, sf_dir):
    """Jobs resumed with a new limit of profiles: every second page names one, and those
    visited before the page to start from count."""
    rows, state = _states(spark, sf_dir)
    state = staged(state)  # read three times
    told = rows.select("job_id", "page", "k", (F.col("page") % 2 == 0).alias("visited"))
    start = [jobs.resume_from(state.where(F.col("job_id").cast("long") % 3 == i), 2 * i + 1, told, max_profiles=4) for i in range(3)]
    resumed = staged(start[0].unionByName(start[1]).unionByName(start[2]))  # else every sort of all three runs in one task
    again = told.where(F.col("page") > 2 * (F.col("k") % 3)).select("job_id", "page", F.lit(0).alias("rec_idx"), F.when(F.col("visited"), "/p").alias("profile_url"))
    visits, skips = jobs.capped_profiles(again, 2, state=resumed)
    return visits.select("job_id", "page", F.lit(None).cast("string").alias("reason")).union(skips.select("job_id", "page", "reason"))


@query("""
SELECT job_id, page, url, CASE WHEN r > 7 THEN 'Profile limit reached (7) — only the listing data was saved' END AS reason FROM (
  SELECT CAST(o_custkey % 50 AS VARCHAR) AS job_id, o_custkey % 5 AS page, '/p/' || o_orderkey AS url, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_custkey % 5, o_orderkey) AS r FROM orders) t""")
def profile_cap(spark, sf_dir):
    """A job's profiles up to its limit, the others as skip items."""
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("string").alias("job_id"), (F.col("o_custkey") % 5).alias("page"), F.col("o_orderkey").alias("rec_idx"), _say("/p/", F.col("o_orderkey")).alias("profile_url"))
    visits, skips = jobs.capped_profiles(o, 7)
    return visits.select("job_id", "page", F.col("profile_url").alias("url"), F.lit(None).cast("string").alias("reason")).union(skips.select("job_id", "page", "url", "reason"))


def _place(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/gleaner-stage-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query(f"""
SELECT {_STATE}, 'Completed' AS status, max(CASE WHEN (k + page) % 4 = 0 THEN 'Page ' || page || ': ServerError — HTTP 503' END) AS last_error, TIMESTAMP '2026-01-02 03:04:05' AS updated_at, CAST(2 AS BIGINT) AS n_records
FROM (SELECT * FROM ({_PAGES}) u WHERE page < 10 OR (k + 10) % 4 <> 0) t GROUP BY k HAVING k % 4 <> 2""")
def job_files(spark, sf_dir):
    """Job states and records saved as lines and read again."""
    _, state = _states(spark, sf_dir)
    path, lines = _place(spark, "state"), _place(spark, "records")
    jobs.save_state(state, path, F.lit("2026-01-02 03:04:05").cast("timestamp"))
    held = _t(spark, sf_dir, "customer").select(F.explode(F.array(*(F.to_json(F.struct(_say(F.col("c_custkey"), f"-{i}").alias("key"), F.lit(i).alias("page"))) for i in (1, 2)), F.lit("  "))).alias("value"))
    held.write.text(lines)
    n = jobs.load_records(spark, lines).groupBy(F.split("key", "-")[0].alias("job_id")).agg(F.count(F.lit(1)).alias("n_records"))
    # A tenth page that failed makes a longer number than the text order expects.
    return jobs.load_state(spark, path).where("cast(job_id as long) % 4 <> 2").join(n, "job_id").select("job_id", "total_pages", "status", "last_error", "updated_at", "n_records")


@query('''
SELECT n_regionkey AS page, chr(65279) || 'page,name' || chr(13) || chr(10) || string_agg(n_regionkey || ',"' || n_name || ', ""q"""' || chr(13) || chr(10), '' ORDER BY n_name) AS text FROM nation GROUP BY n_regionkey''')
def csv_files(spark, sf_dir):
    """CSV files by page: byte-order mark, header, quoted cells."""
    rows = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page"), _say(F.col("n_name"), ', "q"').alias("name"))
    path = _place(spark, "csv")
    export.write_csv(rows, ["page", "name"], path, by_page="page", order=["name"])
    return spark.read.format("binaryFile").option("recursiveFileLookup", False).option("pathGlobFilter", "part-*").load(path).select(F.col("page").cast("int"), F.decode("content", "UTF-8").alias("text"))


@query("""
SELECT n_regionkey || '.csv' AS entry, chr(65279) || 'page,name' || chr(13) || chr(10) || string_agg(n_regionkey || ',' || n_name || chr(13) || chr(10), '' ORDER BY n_name) AS text FROM nation GROUP BY n_regionkey""")
def csv_zip(spark, sf_dir):
    """The same as one ZIP for a person."""
    rows = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page"), F.col("n_name").alias("name"))
    with zipfile.ZipFile(io.BytesIO(export.zip_bytes(rows, ["page", "name"], "page", ["name"]))) as z:
        return spark.createDataFrame([(n, z.read(n).decode()) for n in z.namelist()], "entry string, text string")


@query("SELECT 'url:' || o_custkey AS key, arg_max(o_totalprice, o_orderkey) AS price, min(o_orderkey) AS first_seq FROM orders GROUP BY o_custkey")
def stream_upsert(spark, sf_dir):
    """Orders as a stream of two batches, upserted by customer."""
    o = _t(spark, sf_dir, "orders").select(_say("url:", F.col("o_custkey")).alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))
    half = o.agg(F.floor((F.min("seq") + F.max("seq")) / 2).alias("h")).first().h
    source, path = _place(spark, "orders"), _place(spark, "upserted")
    table = jobs.UpsertTable(spark, path)
    for part in (o.where(F.col("seq") <= half), o.where(F.col("seq") > half)):
        part.write.mode("append").parquet(source)
        jobs.upsert_stream(spark.readStream.schema(o.schema).parquet(source), table, path + "-log").awaitTermination()
    return table.read().select("key", "price", "first_seq")


@query("SELECT 'url:https://x.org/p/' || s_suppkey AS key, '\u00a3' || s_suppkey AS fee, s_suppkey AS first_seq FROM supplier")
def stream_scrape(spark, sf_dir):
    """Pages as a stream of two batches: each extracted, then upserted by its URL."""
    pages = _profiles(spark, sf_dir, "<dl><dt>Fee</dt><dd>\u00a3", _k(), "</dd></dl>")
    source, path = _place(spark, "pages"), _place(spark, "scraped")
    table = jobs.UpsertTable(spark, path)

    def prepare(batch):
        out = plan.scrape(batch, [plan.Field("Fee")], whole_page=True).wide().join(batch.select("page_id", "url"), "page_id")
        return out.select(merge.dedupe_key(F.col("url"), F.create_map(F.lit("Fee"), F.col("Fee"))).alias("key"), F.col("Fee").alias("fee"), F.col("page_id").alias("seq"))

    for part in (pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1")):
        part.write.mode("append").parquet(source)
        jobs.upsert_stream(spark.readStream.schema(pages.schema).parquet(source), table, path + "-log", prepare).awaitTermination()
    return table.read().select("key", "fee", "first_seq")


# --- recorded fetches, addresses, walks -----------------------------------------------


@query("""
SELECT url, CAST([200, 404, 503][CAST(page_id % 3 AS INTEGER) + 1] AS INTEGER) AS status, CAST(strlen(html) AS BIGINT) AS n_bytes, md5(html) AS digest,
  TIMESTAMP '2026-01-02 03:04:05' + to_seconds(page_id) AS fetched_at FROM pages WHERE page_id % 3 < 2 AND page_id >= 20""")
def recorded_fetches(spark, sf_dir):
    """Pages recorded as web archives and read from them; what is asked for is tested in
    the archive reader."""
    recorded.register(spark)
    p, path = _t(spark, sf_dir, "pages"), _place(spark, "archive")
    at = F.timestamp_add("SECOND", F.col("page_id").cast("int"), F.lit("2026-01-02 03:04:05").cast("timestamp"))
    status = F.element_at(F.array(F.lit(200), F.lit(404), F.lit(503)), (F.col("page_id") % 3 + 1).cast("int"))
    p.repartition(4, "page_id").select("url", at.alias("fetched_at"), status.alias("status"), F.lit("utf-8").alias("charset"), F.encode("html", "UTF-8").alias("body")).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").option("splitBytes", 1 << 20).load(path).where(F.col("status").isin(200, 404) & (F.col("fetched_at") >= F.lit("2026-01-02 03:04:25").cast("timestamp")))
    return read.select("url", "status", F.octet_length("body").cast("long").alias("n_bytes"), F.md5("body").alias("digest"), F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))


_ADDRESS = "[CAST(user_id * 7 % 224 AS BIGINT), CAST(event_id * 13 % 256 AS BIGINT), CAST(event_id // 256 % 256 AS BIGINT), CAST(event_id % 256 AS BIGINT)]"
_NET = "s_suppkey * 5 % 224 * 16777216 + s_suppkey * 13 % 256 * 65536 + s_suppkey * 31 % 256 * 256"


@query(f"""
WITH i AS (SELECT DISTINCT array_to_string(a, '.') AS ip, a[1] * 16777216 + a[2] * 65536 + a[3] * 256 + a[4] AS n FROM (SELECT {_ADDRESS} AS a FROM events) t),
b AS (SELECT {_NET} AS n, s_suppkey % 21 + 4 AS len, (s_suppkey * 5 % 224) || '.' || (s_suppkey * 13 % 256) || '.' || (s_suppkey * 31 % 256) || '.0/' || (s_suppkey % 21 + 4) AS block FROM supplier),
j AS (SELECT ip, block, len, (b.n >> (32 - len)) << (32 - len) AS lo, i.n AS n FROM i JOIN b ON i.n BETWEEN (b.n >> (32 - len)) << (32 - len) AND ((b.n >> (32 - len)) << (32 - len)) + (1 << (32 - len)) - 1)
SELECT ip, min(block) FILTER (len = m) AS block, count(DISTINCT (len, lo)) AS blocks FROM (SELECT *, max(len) OVER (PARTITION BY ip) AS m FROM j) t GROUP BY ip""")
def address_blocks(spark, sf_dir):
    """The narrowest block that holds each address, of blocks that nest and overlap."""
    e, k = F.col("event_id"), F.col("s_suppkey")
    ips = _t(spark, sf_dir, "events").select(F.concat_ws(".", *((x).cast("string") for x in (F.col("user_id") * 7 % 224, e * 13 % 256, F.floor(e / 256) % 256, e % 256))).alias("ip"))
    cidrs = _t(spark, sf_dir, "supplier").select(_say(k * 5 % 224, ".", k * 13 % 256, ".", k * 31 % 256, ".0/", k % 21 + 4).alias("block"))
    return addresses.covering(ips, cidrs)


@query("""
SELECT 'h' || c_custkey || '.example.com' AS host, c_custkey % 9 < 5 OR c_custkey % 9 = 8 AS blocked,
  CASE c_custkey % 9 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'in 10.0.0.0/8' WHEN 2 THEN 'in 172.16.0.0/12' WHEN 3 THEN 'in fc00::/7' WHEN 4 THEN 'in 192.168.0.0/16' WHEN 8 THEN 'in fe80::/10' END AS reason FROM customer""")
def resolved_hosts(spark, sf_dir):
    """Hosts against the addresses they resolve to: one reserved address among several,
    also of version 6 or mapped, bars a host; so does none."""
    k = F.col("c_custkey")
    host = _say("h", k, ".example.com")
    low = F.lower(F.lpad(F.hex(k % 65536), 4, "0"))
    c = _dealt(_t(spark, sf_dir, "customer").select("c_custkey"), k)
    ips = F.when(k % 9 == 1, F.array(F.lit("93.184.216.34"), _say("10.", k % 256, ".0.1"))).when(k % 9 == 2, F.array(_say("172.", 16 + k % 16, ".9.9"))).when(k % 9 == 3, F.array(_say("fd00::", low), F.lit("2001:db8::1")))
    ips = ips.when(k % 9 == 4, F.array(_say("::FFFF:192.168.0.", k % 256))).when(k % 9 == 5, F.array(_say("172.32.0.", k % 256), F.lit("::ffff:8.8.8.8"))).when(k % 9 == 6, F.array(_say("2a00:1450:", low, "::200e"), F.lit("no address"))).when(k % 9 == 7, F.array(_say("169.253.0.", k % 256)))
    ips = ips.when(k % 9 == 8, F.array(_say("febf::", low, "%eth0"))).otherwise(F.array(F.lit("bad"), F.lit("1.2.3.999"), F.lit("1::2::3"), F.lit("")))
    return addresses.resolved(c.select(host.alias("host")), c.select(F.upper(host).alias("host"), F.explode(ips).alias("ip")))


_WALKED = """(SELECT user_id AS walk, i // 4 + 1 AS page, i % 4 + 1 AS attempt, event_id, CASE WHEN event_id % 5 < 2 THEN 'RateLimited' WHEN event_id % 41 = 0 THEN 'ServerError' ELSE 'Success' END AS outcome
  FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) t)"""


@query(f"""
WITH a AS (SELECT *, coalesce(bool_or(outcome <> 'RateLimited' OR page = 1) OVER (PARTITION BY walk, page ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM {_WALKED} t),
p AS (SELECT walk, page, arg_max(outcome, attempt) AS outcome, count(*) AS tries FROM a WHERE NOT done GROUP BY ALL),
w AS (SELECT *, coalesce(bool_or(outcome <> 'Success') OVER (PARTITION BY walk ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM p)
SELECT walk, count(*) FILTER (outcome = 'Success') AS pages, CAST(coalesce(sum(tries * 200 + (tries - 1) * 8000) FILTER (page > 1), 0) AS BIGINT) AS wait_ms,
  CAST(coalesce(sum(tries - 1) FILTER (page > 1), 0) AS BIGINT) AS cooldowns, max(outcome) FILTER (outcome <> 'Success') AS ended_by FROM w WHERE NOT gone AND page <= 100 GROUP BY walk""")
def page_cooldowns(spark, sf_dir):
    """Walks over next pages from logged attempts, four a page: rate limits are waited
    out, other failures end a walk."""
    e = _t(spark, sf_dir, "events")
    i = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    outcome = F.when(F.col("event_id") % 5 < 2, "RateLimited").when(F.col("event_id") % 41 == 0, "ServerError").otherwise("Success")
    rows = e.select(F.col("user_id").alias("walk"), (F.floor(i / 4) + 1).alias("page"), (i % 4 + 1).alias("attempt"), outcome.alias("outcome"))
    return attempts.cooled(rows)


@query(_long(("Badge", "CASE WHEN s_suppkey % 4 < 2 AND s_suppkey % 10 <> 7 THEN 'badge ' || s_suppkey END", "'Ai'", "60")))
def provider_batches(spark, sf_dir):
    """A model that reads batches of texts, set up once a partition; it fails on any batch
    that holds a certain text, and answers some texts with nothing."""

    def make():
        def ask(texts, names):
            if any("poison" in t for t in texts):
                raise RuntimeError("no")
            return [{names[0]: t.split("says ")[1], "Other": "x"} if "says" in t else None for t in texts]

        return ask

    body = F.when(_k() % 10 == 7, _say("<p>poison says ", _k(), "</p>")).when(_k() % 4 < 2, _say("<p>it says badge ", _k(), "</p>")).otherwise("<p>silent</p>")
    return _values(spark, sf_dir, [plan.Field("Badge", kind="Auto")], body, provider=strategies.batched(make, 16))


# --- axes ----------------------------------------------------------------------------

_PATHS = {
    "ancestor": "//li[@data-k='1']/ancestor::section", "parent": "//li[@data-k='1']/parent::ul", "up": "//b[@data-k='2']/../..", "descendant": "//section[@data-r='1']/descendant::b", "following": "//li[@data-k='1']/following::h2",
    "preceding": "//li[@data-k='1']/preceding::b", "next": "//li[@data-k='1']/following-sibling::li[1]", "before": "//li[@data-k='1']/preceding-sibling::li[2]", "attribute": "//ul/li/@data-k", "count": "//section[count(.//li) > 9 and count(*) = 2]/h2",
}


@query("""
WITH o AS (SELECT o_custkey % 20 AS page, o_custkey AS c, o_orderkey AS o, o_orderkey % 5 AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_custkey, o_orderkey) AS r FROM orders),
s AS (SELECT page, c, count(*) AS n, min(r) - 1 AS r, row_number() OVER (PARTITION BY page ORDER BY c) - 1 AS t FROM o GROUP BY page, c),
e AS (SELECT page, 'section' AS tag, c AS i, c % 3 AS k, 3 * t + 2 * r AS pre, 2 + 2 * n AS size, -1 AS parent, n AS items FROM s
  UNION ALL SELECT page, 'h2', c, 9, 3 * t + 2 * r + 1, 0, 3 * t + 2 * r, 0 FROM s UNION ALL SELECT page, 'ul', c, 9, 3 * t + 2 * r + 2, 2 * n, 3 * t + 2 * r, n FROM s
  UNION ALL SELECT o.page, 'li', o, k, 3 * s.t + 2 * s.r + 1 + 2 * o.t, 1, 3 * s.t + 2 * s.r + 2, 0 FROM o JOIN s USING (c) UNION ALL SELECT o.page, 'b', o, k, 3 * s.t + 2 * s.r + 2 + 2 * o.t, 0, 3 * s.t + 2 * s.r + 1 + 2 * o.t, 0 FROM o JOIN s USING (c)),
x AS (SELECT * FROM e WHERE tag = 'li' AND k = 1),
b AS (SELECT page, min(pre + size) AS first, max(pre) AS last FROM x GROUP BY page),
w AS (SELECT *, lag(k) OVER w AS k1, lead(k, 2) OVER w AS k2 FROM e WHERE tag = 'li' WINDOW w AS (PARTITION BY page, parent ORDER BY pre)),
hits AS (
  SELECT DISTINCT 'ancestor' AS axis, e.* FROM e JOIN x ON e.page = x.page AND e.tag = 'section' AND e.pre < x.pre AND x.pre <= e.pre + e.size
  UNION ALL SELECT DISTINCT 'parent', e.* FROM e JOIN x ON e.page = x.page AND e.pre = x.parent
  UNION ALL SELECT DISTINCT 'up', u.* FROM e JOIN e l ON e.page = l.page AND l.pre = e.parent JOIN e u ON u.page = l.page AND u.pre = l.parent WHERE e.tag = 'b' AND e.k = 2
  UNION ALL SELECT DISTINCT 'descendant', e.* FROM e JOIN e s ON s.tag = 'section' AND s.k = 1 AND e.page = s.page AND e.tag = 'b' AND e.pre > s.pre AND e.pre <= s.pre + s.size
  UNION ALL SELECT 'following', e.* FROM e JOIN b USING (page) WHERE e.tag = 'h2' AND e.pre > first
  UNION ALL SELECT 'preceding', e.* FROM e JOIN b USING (page) WHERE e.tag = 'b' AND e.pre + e.size < last
  UNION ALL SELECT 'next', * EXCLUDE (k1, k2) FROM w WHERE k1 = 1 UNION ALL SELECT 'before', * EXCLUDE (k1, k2) FROM w WHERE k2 = 1
  UNION ALL SELECT 'attribute', * FROM e WHERE tag = 'li' UNION ALL SELECT 'count', h.* FROM e h JOIN e s ON h.page = s.page AND h.parent = s.pre WHERE h.tag = 'h2' AND s.tag = 'section' AND s.items > 9)
SELECT axis, page AS page_id, count(*) AS hits, CAST(sum(i) AS BIGINT) AS ids FROM hits GROUP BY ALL""")
def xpath_axes(spark, sf_dir):
    """Every axis over pages that list customers' orders, against intervals of pre-order
    numbers that the oracle makes of the tables."""
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("page_id"), F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))
    k = (F.col("o") % 5).cast("string")
    item = _say("<li data-i='", F.col("o"), "' data-k='", k, "'><b data-i='", F.col("o"), "' data-k='", k, "'>x</b></li>")
    begin = _say("<section data-i='", F.col("c"), "' data-r='", F.col("c") % 3, "'><h2 data-i='", F.col("c"), "'>h</h2><ul data-i='", F.col("c"), "'>")
    ends = o.select("page_id", "c").distinct().select("page_id", "c", F.explode(F.array(F.lit(0), F.lit(2))).alias("turn"), F.lit(None).cast("long").alias("o"))
    # A page is too long to be a value: its pieces are put in order as keys, and written on their way to the tokenizer.
    pieces = _dealt(o.select("page_id", "c", F.lit(1).alias("turn"), "o").union(ends), "page_id").sortWithinPartitions("page_id", "c", "turn", "o")
    html = F.when(F.col("turn") == 0, begin).when(F.col("turn") == 1, item).otherwise("</ul></section>")
    elems = staged(dom.elements(shred.shred_pieces(pieces.select("page_id", html.alias("html")))).select("page_id", "pre", "size", "parent", "tag", "attrs"))
    hits = None
    for name, path in _PATHS.items():
        one = dom.select(elems, path, "XPath").select(F.lit(name).alias("axis"), "page_id", "pre")
        hits = one if hits is None else hits.union(one)
    met = hits.join(elems.select("page_id", "pre", F.col("attrs")["data-i"].cast("long").alias("i")), ["page_id", "pre"])
    return met.groupBy("axis", "page_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("i").alias("ids"))


# --- rules on texts ------------------------------------------------------------------


@query("""
WITH o AS (SELECT o_custkey % 30 AS page, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT page AS page_id, CAST(i AS INTEGER) AS rec_idx, CASE WHEN k % 3 > 0 THEN 'c' || k END AS code, CASE WHEN k % 4 > 0 THEN '/t/' || k END AS link,
  CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS warnings FROM o WHERE i < 9
UNION ALL SELECT page, NULL, NULL, NULL, 1 FROM o GROUP BY page HAVING count(*) > 9""")
def selector_records(spark, sf_dir):
    """Records and fields by selectors alone: every record that lacks a required field has
    a warning of its own, and pages with more records than asked for have one."""
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).alias("page_id"), F.col("o_orderkey").alias("k"))
    row = _say("<tr><td>", F.when(F.col("k") % 3 > 0, _say("<b>c", F.col("k"), "</b>")).otherwise("<b> </b>"), "</td><td>", F.when(F.col("k") % 4 > 0, _say("<a href='/t/", F.col("k"), "'>t</a>")).otherwise("none"), "</td></tr>")
    pages = o.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", row.alias("r"))))["r"], "").alias("rows"))
    pages = pages.select("page_id", F.lit("https://x.org/").alias("url"), _say("<table>", F.col("rows"), "</table>").alias("html"))
    fields = [plan.Field("Code", selector="b", required=True), plan.Field("Link", selector=".//a[@href]", selector_type="XPath", extraction_type="Link", required=True)]
    values, notes = plan.by_selectors(pages, fields, "tr", max_records=9)
    wide = values.groupBy("page_id", "rec_idx").pivot("name", ["Code", "Link"]).agg(F.first("value"))
    said = notes.groupBy("page_id", "rec_idx").agg(F.count(F.lit(1)).alias("n"))
    both = wide.join(said.where("rec_idx is not null"), ["page_id", "rec_idx"], "left").select("page_id", "rec_idx", F.col("Code").alias("code"), F.col("Link").alias("link"), F.coalesce("n", F.lit(0)).cast("int").alias("warnings"))
    return both.union(said.where("rec_idx is null").select("page_id", "rec_idx", F.lit(None), F.lit(None), F.col("n").cast("int")))


_RUN = "'([A-Z][a-zA-Z''-]*[ \\t\\n\\r\\f\\v]+){1,4}[A-Z][a-zA-Z''-]*'"


@query(f"""
SELECT doc_id, w AS heading, length(w) > 0 AND NOT ends_with(w, '?') AND lower(w) NOT IN ({", ".join(f"'{h}'" for h in C.GENERIC_HEADINGS)})
  AND (named OR (length(w) <= 4 AND regexp_matches(substr(text, 1, 200), {_RUN}))) AS hit
FROM (SELECT doc_id, text, w, len(list_filter(string_split_regex(w, '\\s+'), lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= 2
  OR (len(list_filter(string_split_regex(w, '\\s+'), lambda x: x <> '')) BETWEEN 2 AND 5 AND regexp_replace(lower(string_split_regex(w, '\\s+')[1]), '[.]+$', '') IN ({", ".join(f"'{h}'" for h in C.HONORIFICS)})) AS named
  FROM (SELECT doc_id, coalesce(text, '') AS text, trim(CASE doc_id % 7 WHEN 0 THEN 'Fees' WHEN 1 THEN ' Frequently Asked Questions ' WHEN 2 THEN 'Who Is It?' WHEN 3 THEN 'NHS' WHEN 4 THEN 'dr. ann of leeds' WHEN 5 THEN substr(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), 1, 18) ELSE '' END) AS w FROM documents) t) u""")
def heading_rule(spark, sf_dir):
    """Which headings seem to be names, before the texts of documents: generic ones,
    questions, honorifics, and short ones before a run of capitalised words."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = F.substring(F.regexp_replace("text", r"\s+", " "), 1, 18)
    heads = F.array(F.lit("Fees"), F.lit(" Frequently Asked Questions "), F.lit("Who Is It?"), F.lit("NHS"), F.lit("dr. ann of leeds"), own, F.lit(""))
    h = F.trim(F.element_at(heads, (F.col("doc_id") % 7 + 1).cast("int")))
    return d.select("doc_id", h.alias("heading"), detect.heading_names(h, F.col("text")).alias("hit"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 8 = 7 THEN NULL WHEN c_custkey % 8 < 6 THEN '12 Mill Lane, Leeds LS1 ' || (c_custkey % 9) || 'AB; 4 Park Row, York YO1 ' || (c_custkey % 7) || 'XY' ELSE '12 Mill Lane, Leeds LS1 ' || (c_custkey % 9) || 'AB' END AS places FROM customer""")
def location_noise(spark, sf_dir):
    """Locations in a text without the noisy ones, which tell of reviews and bookings."""
    k = F.col("c_custkey")
    noise = F.element_at(F.array(*map(F.lit, C.LOCATION_NOISE)), (k % len(C.LOCATION_NOISE) + 1).cast("int"))
    good = _say("12 Mill Lane, Leeds LS1 ", k % 9, "AB\n4 Park Row, York YO1 ", k % 7, "XY")
    one = _say("12 Mill Lane, Leeds LS1 ", k % 9, "AB\nThe ", noise, " of Park Row, York YO1 ", k % 7, "XY")
    text = F.when(k % 8 == 7, _say("Our ", noise, " by Mill Lane LS1 ", k % 9, "AB")).when(k % 8 == 6, one).otherwise(good)
    return _t(spark, sf_dir, "customer").select("c_custkey", K.every_match("Location", text).alias("places"))
