"""Registered queries of the page-extraction engine and their DuckDB oracles.

Where an operator needs markup, the query renders it from a relational table, runs
the real operators over it, and the oracle selects the same values from the
table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import catalog as C
from .functions import kinds as K
from .functions import text as T
from .functions import urls as U
from .operators import detect, dom, export, links, merge, resolve
from .plans import scrape as plan
from .sources import attempts, shred
from .sources.stage import checkpoint_dir, staged
from .streaming import jobs

_QUERIES: dict = {}
_ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_ORACLES)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame, *keys) -> DataFrame:
    """The rows of a small file over all tasks: for queries that make much of each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# --- pages -------------------------------------------------------------------

_DECODE = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query(f"""
SELECT page_id, trim({_DECODE.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}) AS name, 'SemanticHtml' AS source,
       CAST(85 AS INTEGER) AS confidence, 'High' AS level FROM pages""")
def page_name(spark, sf_dir):
    """The name on every page: the flagship query, the whole chain on one field."""
    out = plan.scrape(_t(spark, sf_dir, "pages"), [plan.Field("Name")], whole_page=True).results
    return out.select("page_id", F.col("value").alias("name"), "source", "confidence", "level")


@query("""
SELECT page_id, href, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || href ELSE href END AS target FROM (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) t""")
def page_links(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    nodes = shred.shred(pages)
    e = dom.elements(nodes)
    found = links.anchors(e, dom.visible_text(nodes, e.where("tag in ('a', 'link')")), pages)
    return found.where("tag = 'a'").select("page_id", "href", "target")


@query("""
SELECT page_id, CAST(count(*) AS BIGINT) AS n_items FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS href FROM pages) t GROUP BY page_id""")
def selector_css(spark, sf_dir):
    nodes = shred.shred(_t(spark, sf_dir, "pages"))
    return dom.select(dom.elements(nodes), "nav > ul > li > a[href]").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_items"))


@query("""
SELECT page_id, trim(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1)) AS ad FROM pages""")
def selector_xpath(spark, sf_dir):
    nodes = shred.shred(_t(spark, sf_dir, "pages"))
    e = dom.elements(nodes)
    hits = dom.select(e, "//body/div[@class='ad']", "XPath")
    return hits.join(dom.extracted(e, dom.visible_text(nodes, hits), "Text"), ["page_id", "pre"]).select("page_id", F.col("value").alias("ad"))


@query("""
SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INTEGER) AS matches,
       array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1)[1:5], ' ') AS previews FROM pages""")
def selector_test(spark, sf_dir):
    nodes = shred.shred(_t(spark, sf_dir, "pages"))
    out = dom.selector_test(dom.elements(nodes), dom.visible_text(nodes), "a", how="Link")
    return out.select("page_id", F.col("matches").cast("int"), F.array_join("previews", " ").alias("previews"))


@query("""
WITH o AS (SELECT o_custkey % 3 AS page_id, o_custkey, o_orderkey FROM orders),
  s AS (SELECT page_id, o_custkey, count(*) AS n FROM o GROUP BY ALL),
  r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY page_id ORDER BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
  p AS (SELECT page_id, o_orderkey, o_custkey, row_number() OVER (PARTITION BY page_id ORDER BY o_custkey, o_orderkey) AS t FROM o)
SELECT r.page_id, CAST(sum(n) FILTER (before <= 500) AS BIGINT) AS matches, any_value(v) AS previews
FROM r JOIN (SELECT page_id, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY t) AS v FROM p WHERE t <= 5 GROUP BY page_id) USING (page_id) GROUP BY r.page_id
UNION ALL SELECT 9, 0, ''""")
def selector_scopes(spark, sf_dir):
    """A selector tested inside record scopes: whole scopes in order, up to the one that
    passes 500 matches.  Three pages with a list a customer and an item an order, one
    page without a scope."""
    o = _t(spark, sf_dir, "orders")
    item = F.concat(F.lit("<li>"), F.col("o_orderkey").cast("string"), F.lit("</li>"))
    lists = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("i"))))["i"], "").alias("items"))
    scope = F.concat(F.lit("<ul class='c'>"), "items", F.lit("</ul>"))
    pages = lists.groupBy((F.col("o_custkey") % 3).alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("o_custkey", scope.alias("s"))))["s"], "<p>x</p>").alias("html"))
    pages = pages.select("page_id", F.concat(F.lit("https://x.org/"), F.col("page_id").cast("string")).alias("url"), "html").unionByName(o.limit(1).select(F.lit(9).cast("long").alias("page_id"), F.lit("https://x.org/9").alias("url"), F.lit("<ul><li>1</li></ul>").alias("html")))
    nodes = staged(shred.shred(pages))
    out = dom.selector_test(staged(dom.elements(nodes)), staged(dom.visible_text(nodes)), "li", record_selector="ul.c")
    return out.select("page_id", "matches", F.array_join("previews", " ").alias("previews"))


@query("""
SELECT page_id, CAST(length(html) - length(replace(html, '<p>', '..')) AS BIGINT) AS n_p,
       CAST(length(html) - length(replace(html, '<li>', '...')) AS BIGINT) AS n_li FROM pages""")
def shredded_nodes(spark, sf_dir):
    nodes = shred.shred(_t(spark, sf_dir, "pages"))
    return nodes.groupBy("page_id").agg(F.count_if(F.col("tag") == "p").alias("n_p"), F.count_if(F.col("tag") == "li").alias("n_li"))


@query("""
SELECT page_id, url, CASE WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'scheme' END AS reason,
       lower(rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/')) AS compare_key,
       lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host FROM pages""")
def url_rules(spark, sf_dir):
    u = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", "url", U.rejection(u).alias("reason"), U.compare_key(u).alias("compare_key"), U.part(u, "host").alias("host"))


@query("""
SELECT s_suppkey AS k, host, (a = 10 OR a = 127 OR a = 0 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254)) AS blocked FROM (
  SELECT s_suppkey, [10, 127, 0, 172, 192, 169, 8, 100][CAST(s_suppkey % 8 AS INTEGER) + 1] AS a, [16, 31, 168, 254, 15, 32][CAST(s_suppkey % 6 AS INTEGER) + 1] AS b,
         CAST([10, 127, 0, 172, 192, 169, 8, 100][CAST(s_suppkey % 8 AS INTEGER) + 1] AS VARCHAR) || '.' || CAST([16, 31, 168, 254, 15, 32][CAST(s_suppkey % 6 AS INTEGER) + 1] AS VARCHAR) || '.7.9' AS host FROM supplier) t""")
def url_blocked_host(spark, sf_dir):
    k = F.col("s_suppkey")
    a = F.element_at(F.array(*map(F.lit, (10, 127, 0, 172, 192, 169, 8, 100))), (k % 8 + 1).cast("int"))
    b = F.element_at(F.array(*map(F.lit, (16, 31, 168, 254, 15, 32))), (k % 6 + 1).cast("int"))
    host = F.concat(a.cast("string"), F.lit("."), b.cast("string"), F.lit(".7.9"))
    return _t(spark, sf_dir, "supplier").select(k.alias("k"), host.alias("host")).withColumn("blocked", U.is_blocked_host(F.col("host")))


@query("""
SELECT page_id, CASE WHEN url LIKE '%?%' THEN
   regexp_extract(url, '^([^?#]*)', 1) || '?' || array_to_string(list_concat(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'page=')), ['page=' || CAST(page_id % 9 AS VARCHAR)]), '&')
   ELSE regexp_extract(url, '^([^?#]*)', 1) || '?page=' || CAST(page_id % 9 AS VARCHAR) END AS next_url FROM pages""")
def paged_url(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", U.page_url(F.col("url"), F.col("page_id") % 9).alias("next_url"))


@query("""
SELECT a.page_id, b.page_id AS other_id, lower(regexp_extract(a.url, '^[a-zA-Z]+://([^/?#:]*)', 1)) = lower(regexp_extract(b.url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS same
FROM pages a JOIN pages b ON b.page_id = a.page_id + 1""")
def same_host(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    b = p.select((F.col("page_id") - 1).alias("page_id"), F.col("page_id").alias("other_id"), F.col("url").alias("other"))
    return p.join(b, "page_id").select("page_id", "other_id", U.same_host(F.col("url"), F.col("other")).alias("same"))


# --- value rules ---------------------------------------------------------------

@query("""
SELECT doc_id, array_to_string(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}'), ' ') AS emails FROM documents WHERE regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')""")
def email_pattern(spark, sf_dir):
    p = C.PATTERNS["Email"][0]
    return _t(spark, sf_dir, "documents").where(F.col("text").rlike(p)).select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(p), F.lit(0)), " ").alias("emails"))


_PHONE_RE2 = r"(?:\+?[0-9]{1,3}[\s.-]?)?\(?[0-9]{2,5}\)?[\s.-]?[0-9]{3,4}[\s.-]?[0-9]{3,4}"


@query(f"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '{_PHONE_RE2}'), '; ') AS phones FROM documents WHERE regexp_matches(text, '{_PHONE_RE2}')""")
def phone_pattern(spark, sf_dir):
    p = C.PATTERNS["Phone"][0]
    return _t(spark, sf_dir, "documents").where(F.col("text").rlike(p)).select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(p), F.lit(0)), "; ").alias("phones"))


_NAMES = ["Name", "Full Name", "Specialist", "Location", "Address", "Fees", "Consultation Fee", "Treatment Price", "Cost", "Pricing", "Email", "Phone", "Website", "Rating", "Zorblax", "", "Children", "Years", "Biography", "About us"]
_SYN = ", ".join(f"('{k}', '{t.replace(chr(39), chr(39) * 2)}', {i})" for i, (k, t) in enumerate((k, t) for k, ts in C.SYNONYMS.items() for t in ts))


@query(f"""
WITH f(name) AS (VALUES {", ".join(f"('{n}')" for n in _NAMES)} UNION SELECT p_name || ' ' || lower(p_type) FROM part UNION SELECT n_name FROM nation), s(kind, token, ord) AS (VALUES {_SYN}),
m AS (SELECT f.name, s.kind, row_number() OVER (PARTITION BY f.name ORDER BY (lower(trim(f.name)) = s.token) DESC, CASE WHEN lower(trim(f.name)) = s.token THEN 0 ELSE -length(s.token) END, s.ord) AS r
  FROM f JOIN s ON trim(f.name) <> '' AND (contains(lower(trim(f.name)), s.token) OR contains(s.token, lower(trim(f.name)))))
SELECT f.name, coalesce(m.kind, 'Text') AS kind FROM f LEFT JOIN m ON m.name = f.name AND m.r = 1""")
def kind_inference(spark, sf_dir):
    given = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    held = _t(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), F.lower("p_type"))).union(_t(spark, sf_dir, "nation").select("n_name"))
    return given.union(held).distinct().withColumn("kind", K.infer_kind(F.col("name")))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '£' || CAST(p_size AS VARCHAR) WHEN p_partkey % 3 = 1 THEN p_name ELSE CAST(p_size AS VARCHAR) || ' GBP' END AS value,
       (p_partkey % 3 <> 1) AS as_currency, (p_partkey % 3 = 1) AS as_location FROM part""")
def plausibility(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    v = F.when(k % 3 == 0, F.concat(F.lit("£"), n)).when(k % 3 == 1, F.col("p_name")).otherwise(F.concat(n, F.lit(" GBP")))
    rows = _t(spark, sf_dir, "part").select("p_partkey", v.alias("value"))
    # A bare amount is no place, a part's name no amount.
    return rows.select("p_partkey", "value", K.plausible(F.lit("Currency"), F.col("value")).alias("as_currency"), K.plausible(F.lit("Location"), F.col("value")).alias("as_location"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) || '+ years' END AS number,
       CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'over ' || CAST(p_size AS VARCHAR) || '+ years here' ELSE 'none' END AS currency FROM part""")
def normal_forms(spark, sf_dir):
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    v = F.when(k == 0, n).when(k == 1, F.concat(F.lit("over "), n, F.lit("+ years here"))).otherwise("none")
    return _t(spark, sf_dir, "part").select("p_partkey", K.normal_number(v).alias("number"), K.normal_currency(v).alias("currency"))


@query("""
SELECT p_partkey, '£' || CAST(p_size AS VARCHAR) || '; £' || CAST(p_size + 1 AS VARCHAR) AS amounts, CAST(CASE WHEN p_size >= 40 THEN 'High' WHEN p_size >= 25 THEN 'Medium' ELSE 'Low' END AS VARCHAR) AS level FROM part""")
def pattern_multi_join(spark, sf_dir):
    n = F.col("p_size")
    text = F.concat(F.lit("First £"), n.cast("string"), F.lit(". Later £"), (n + 1).cast("string"), F.lit(", again £"), n.cast("string"), F.lit("."))
    return _t(spark, sf_dir, "part").select("p_partkey", K.every_match("Currency", text).alias("amounts"), T.confidence_level(n * 2).alias("level"))


@query("""
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, trim(regexp_extract(line, '^([A-Za-z][A-Za-z \\-]{1,40}?)\\s*[:\\-]\\s*(.+)$', 1)) AS label, trim(regexp_extract(line, '^([A-Za-z][A-Za-z \\-]{1,40}?)\\s*[:\\-]\\s*(.+)$', 2)) AS value FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) t
WHERE regexp_matches(line, '^[A-Za-z][A-Za-z \\-]{1,40}?\\s*[:\\-]\\s*.+$')""")
def label_value_lines(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(C.LABEL_LINE))
    return lines.select("doc_id", "line_no", *(F.trim(F.regexp_extract("line", C.LABEL_LINE, i)).alias(n) for i, n in ((1, "label"), (2, "value"))))


# --- the chain ---------------------------------------------------------------

def _chain_rows(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    asked = c.withColumn("kind", F.lit("Currency"))
    good, bad = F.concat(F.lit("£"), F.col("id").cast("string")), F.concat(F.lit("x"), F.col("id").cast("string"))
    one = c.select("id", F.lit("StructuredData").alias("strategy"), F.when(F.col("id") % 2 == 0, good).otherwise(bad).alias("value"), F.lit(90).alias("confidence"))
    two = c.where("id % 5 <> 0").select("id", F.lit("Pattern").alias("strategy"), F.when(F.col("id") % 3 == 0, good).otherwise(bad).alias("value"), F.lit(65).alias("confidence"))
    return resolve.resolve(asked, one.union(two).where("id % 7 <> 0"), ["id"])


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 OR (c_custkey % 3 = 0 AND c_custkey % 5 <> 0) THEN '£' || CAST(c_custkey AS VARCHAR) ELSE 'x' || CAST(c_custkey AS VARCHAR) END AS value,
  CASE WHEN c_custkey % 7 = 0 THEN 'None' WHEN c_custkey % 2 = 0 THEN 'StructuredData' WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 'Pattern' ELSE 'StructuredData' END AS source,
  CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 90 WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 65 ELSE 45 END AS INTEGER) AS confidence,
  CASE WHEN c_custkey % 7 = 0 THEN 'None' WHEN c_custkey % 2 = 0 THEN 'High' WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 'Medium' ELSE 'Low' END AS level, c_custkey % 7 = 0 AS is_missing FROM customer""")
def chain_resolve(spark, sf_dir):
    """First plausible candidate wins; a lone implausible one comes at half."""
    return _chain_rows(spark, sf_dir).select("id", "value", "source", "confidence", "level", "is_missing")


# --- render, extract, compare --------------------------------------------------

def _money(c):
    return F.concat(F.lit("£"), F.round(F.abs(c), 0).cast("long").cast("string"))


def _cards(spark, sf_dir, wrap: int = 0, ld: bool = False, constant: bool = False):
    """Listing pages of a nation's suppliers, up to 100 a page, a card each:
    heading, fee, link."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.concat(F.lit("Dr Ann "), F.regexp_replace("s_name", "[^A-Za-z]", ""), F.lit(" "), F.translate(F.col("s_suppkey").cast("string"), "0123456789", "ABCDEFGHIJ")).alias("name"), _money(F.col("s_acctbal")).alias("fee"))
    turn = F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    s = s.withColumn("s_nationkey", F.col("s_nationkey").cast("long") * 100000 + F.floor(turn / 100))
    if constant:
        s = s.withColumn("name", F.lit("Dr Ann Same")).withColumn("fee", F.lit("£7"))
    card = F.concat(F.lit('<div class="card"><h2><a href="/p/'), F.col("s_suppkey"), F.lit('">'), F.col("name"), F.lit('</a></h2><p class="intro">Practice of long standing in town</p><span class="fee">'), F.col("fee"), F.lit("</span></div>"))
    rows = s.select("s_nationkey", "s_suppkey", "name", "fee", card.alias("card"))
    if wrap:
        rows = rows.withColumn("i", F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1)
        rows = rows.groupBy("s_nationkey", F.floor(F.col("i") / wrap).alias("row")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("s_suppkey", "card")))["card"], "").alias("card"), F.min("s_suppkey").alias("s_suppkey"))
        rows = rows.withColumn("card", F.concat(F.lit('<div class="row">'), "card", F.lit("</div>")))
    item = F.concat(F.lit('{"@type":"Person","url":"/p/'), F.col("s_suppkey"), F.lit('","name":"'), F.col("name"), F.lit('","email":"s'), F.col("s_suppkey"), F.lit('@example.com"}'))
    held = [F.array_join(F.array_sort(F.collect_list(F.struct("s_suppkey", "card")))["card"], "").alias("cards")]
    if ld:
        held.append(F.array_join(F.array_sort(F.collect_list(F.struct("s_suppkey", item.alias("i"))))["i"], ",").alias("items"))
    p = rows.groupBy("s_nationkey").agg(*held)
    script = F.concat(F.lit('<script type="application/ld+json">{"@type":"ItemList","itemListElement":['), F.col("items"), F.lit("]}</script>")) if ld else F.lit("")
    html = F.concat(F.lit("<html><body><nav><ul><li>Home</li><li>All</li><li>More</li></ul></nav><main><section>"), F.col("cards"), F.lit("</section></main>"), script, F.lit("<footer>Fee £1</footer></body></html>"))
    return p.select(F.col("s_nationkey").cast("long").alias("page_id"), F.concat(F.lit("https://list.example.com/n/"), F.col("s_nationkey")).alias("url"), html.alias("html"))

_PAGE = "s_nationkey::BIGINT * 100000 + (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 100"
_SUPP = f"""(SELECT s_suppkey, page_id, 'Dr Ann ' || regexp_replace(s_name, '[^A-Za-z]', '', 'g') || ' ' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS name,
  '£' || CAST(CAST(round(abs(s_acctbal), 0) AS BIGINT) AS VARCHAR) AS fee, CAST(row_number() OVER (PARTITION BY page_id ORDER BY s_suppkey) - 1 AS INTEGER) AS rec_idx, count(*) OVER (PARTITION BY page_id) AS n FROM (SELECT *, {_PAGE} AS page_id FROM supplier) p)"""
_FIELDS = [plan.Field("Name"), plan.Field("Fee")]


@query(f"""SELECT page_id, rec_idx, name AS "Name", fee AS "Fee" FROM {_SUPP} s WHERE n >= 3""")
def record_detect(spark, sf_dir):
    out = plan.scrape(_cards(spark, sf_dir), _FIELDS)
    return out.wide().join(out.records.where("not is_document").select("page_id", "rec_idx"), ["page_id", "rec_idx"])


@query(f"""SELECT page_id, rec_idx, name AS "Name", fee AS "Fee" FROM {_SUPP} s WHERE n >= 9 AND rec_idx < n - n % 3""")
def wrapper_elimination(spark, sf_dir):
    """Cards in rows of three: the cards are found, not the rows.  A row that holds
    fewer than three is no group of siblings."""
    out = plan.scrape(_cards(spark, sf_dir, wrap=3), _FIELDS)
    many = out.records.where("not is_document and n_recs >= 9").select("page_id", "rec_idx")
    return out.wide().join(many, ["page_id", "rec_idx"])


@query(f"""SELECT page_id, rec_idx, 's' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS email, 'StructuredData' AS source, CAST(90 AS INTEGER) AS confidence FROM {_SUPP} s WHERE n >= 3""")
def entity_match(spark, sf_dir):
    """Embedded entities paired with cards."""
    out = plan.scrape(_cards(spark, sf_dir, ld=True), [plan.Field("Name"), plan.Field("Email")])
    r = out.results.where("name = 'Email'").join(out.records.where("not is_document").select("page_id", "rec_idx"), ["page_id", "rec_idx"])
    return r.select("page_id", "rec_idx", F.col("value").alias("email"), "source", "confidence")


@query(f"""SELECT page_id, CAST(count(*) AS BIGINT) AS n, min(name) AS first_name FROM {_SUPP} s GROUP BY page_id""")
def jsonld_flatten(spark, sf_dir):
    e = shred.entities(shred.shred(_cards(spark, sf_dir, ld=True)))
    return e.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("leaves")["name"]).alias("first_name"))


@query(f"""SELECT page_id, CAST(1 AS BIGINT) AS n_records FROM {_SUPP} s GROUP BY page_id""")
def degenerate_collapse(spark, sf_dir):
    """Cards that all say the same are one whole-page record."""
    out = plan.scrape(_cards(spark, sf_dir, constant=True), _FIELDS)
    return out.results.groupBy("page_id").agg(F.countDistinct("rec_idx").alias("n_records"))


@query(f"""SELECT page_id, rec_idx, 'https://list.example.com/p/' || CAST(s_suppkey AS VARCHAR) AS profile_url FROM {_SUPP} s WHERE n >= 3""")
def profile_link(spark, sf_dir):
    pages = _cards(spark, sf_dir)
    nodes = shred.shred(pages)
    e, t = dom.elements(nodes), dom.visible_text(nodes)
    return links.profile_links(detect.detect(e, t), e, links.anchors(e, t, pages))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS page_id, 'Fee ' || CAST(s_suppkey AS VARCHAR) || ' body' AS main FROM supplier""")
def boilerplate_removed(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    html = F.concat(F.lit("<body><nav>Menu "), k, F.lit("</nav><div>Fee "), k, F.lit("<script>x()</script></div><p>body</p><div class='site-footer'>Old</div><footer>End</footer></body>"))
    pages = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("page_id"), html.alias("html"))
    nodes = shred.shred(pages)
    return dom.main_text(nodes, pages.select("page_id", F.lit(0).alias("pre"))).select("page_id", F.col("mtext").alias("main"))


@query("""
SELECT page_id, rec_idx, type FROM (SELECT *, max(CASE WHEN k * 2 > m AND m >= 2 THEN type END) OVER (PARTITION BY page_id) AS top FROM (
  SELECT CAST(s_nationkey AS BIGINT) AS page_id, CAST(s_suppkey AS INTEGER) AS rec_idx, CASE WHEN s_suppkey % 5 < 3 THEN 'Physician' WHEN s_suppkey % 5 = 3 THEN 'Product' END AS type,
    count(CASE WHEN s_suppkey % 5 < 4 THEN 1 END) OVER (PARTITION BY s_nationkey) AS m,
    count(*) OVER (PARTITION BY s_nationkey, CASE WHEN s_suppkey % 5 < 3 THEN 'Physician' WHEN s_suppkey % 5 = 3 THEN 'Product' END) AS k FROM supplier) t) u
WHERE top IS NULL OR type IS NULL OR type = top""")
def majority_type_filter(spark, sf_dir):
    k = F.col("s_suppkey") % 5
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("page_id"), F.col("s_suppkey").cast("int").alias("rec_idx"), F.when(k < 3, "Physician").when(k == 3, "Product").alias("type"))
    return links.majority_type(rows)


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 AND c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 0 OR c_custkey % 4 = 1 AND c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 3 <> 0 THEN 'L' END ELSE 'P' END AS value FROM customer""")
def profile_merge(spark, sf_dir):
    """Profile values override, unless missing or of low confidence, or barred."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    listed = F.col("id") % 3 != 0
    listing = c.select("id", F.lit("Tel").alias("name"), F.lit("Phone").alias("kind"), F.when(listed, "L").alias("value"), F.lit("Pattern").alias("source"), F.lit(65).alias("confidence"), F.lit("Medium").alias("level"), (~listed).alias("is_missing"))
    missing, low = F.col("id") % 4 == 0, F.col("id") % 4 == 1
    profile = c.select("id", F.lit("Tel").alias("name"), F.when(~missing, "P").alias("value"), F.lit("Pattern").alias("source"), F.lit(88).alias("confidence"), F.when(low, "Low").otherwise("High").alias("level"), missing.alias("is_missing"), (F.col("id") % 6 == 0).alias("unavailable"))
    return merge.merge_profiles(listing, profile, ["id"]).select("id", "value")


@query("""
WITH RECURSIVE w(root, page_number, url) AS (
  SELECT r_regionkey, 1, 'u' || CAST(r_regionkey AS VARCHAR) || '_1' FROM region
  UNION ALL SELECT root, page_number + 1, 'u' || CAST(root AS VARCHAR) || '_' || CAST(page_number + 1 AS VARCHAR) FROM w WHERE page_number < 3 + root)
SELECT CAST(root AS INTEGER) AS root, CAST(page_number AS INTEGER) AS page_number, url FROM w""")
def pagination_recursive(spark, sf_dir):
    """Next links to the end of each chain; the last page points back to the first."""
    r = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("root"))
    pages = r.select("root", F.explode(F.sequence(F.lit(1), 3 + F.col("root"))).alias("i"), (3 + F.col("root")).alias("n"))
    name = F.concat(F.lit("u"), F.col("root"), F.lit("_"))
    hops = pages.select(F.concat(name, "i").alias("url"), F.concat(name, F.when(F.col("i") < F.col("n"), F.col("i") + 1).otherwise(1)).alias("next_url"))
    return links.walk(r.select("root", F.concat(name, F.lit("1")).alias("url")), hops)


@query("""
SELECT page_id, rec_idx, profile_url FROM (SELECT *, row_number() OVER (PARTITION BY lower(profile_url) ORDER BY page_id, rec_idx) AS r FROM (
  SELECT CAST(o_custkey % 50 AS BIGINT) AS page_id, o_orderkey AS rec_idx, CASE WHEN o_orderkey % 2 = 0 THEN '/P/' ELSE '/p/' END || CAST(o_custkey AS VARCHAR) AS profile_url FROM orders) t) u WHERE r = 1""")
def frontier_dedupe(spark, sf_dir):
    url = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "/P/").otherwise("/p/"), F.col("o_custkey"))
    return links.frontier(_t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("long").alias("page_id"), F.col("o_orderkey").alias("rec_idx"), url.alias("profile_url")))


@query("""
SELECT 'url:' || CAST(o_custkey AS VARCHAR) AS key, arg_max(o_totalprice, o_orderkey) AS price, min(o_orderkey) AS first_seq, max(o_orderkey) AS seq FROM orders GROUP BY o_custkey""")
def record_upsert(spark, sf_dir):
    """Four batches merged one after another: last value, first place."""
    rows = _t(spark, sf_dir, "orders").select(merge.dedupe_key(F.col("o_custkey").cast("string"), F.create_map(F.lit("a"), F.lit("b"))).alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))
    cuts = rows.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    saved, step = None, (cuts.b - cuts.a) // 4 + 1
    for i in range(4):
        saved = merge.merge_into(saved, rows.where((F.col("seq") >= cuts.a + i * step) & (F.col("seq") < cuts.a + (i + 1) * step)))
    return saved.select("key", "price", "first_seq", "seq")


@query("""
SELECT c_custkey, 'fields:' || upper(sha256('Fee=' || CAST(c_nationkey AS VARCHAR) || '|Name=' || c_name)) AS key FROM customer""")
def dedupe_key(spark, sf_dir):
    fields = F.create_map(F.lit("Name"), F.col("c_name"), F.lit("Fee"), F.col("c_nationkey").cast("string"))
    return _t(spark, sf_dir, "customer").select("c_custkey", merge.dedupe_key(F.lit(None).cast("string"), fields).alias("key"))


# --- jobs ----------------------------------------------------------------------

_ATTEMPTS = """(SELECT CAST(user_id AS VARCHAR) AS job_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS i,
  [200, 403, 429, 503, 200, 500, NULL][CAST(event_id % 7 AS INTEGER) + 1] AS status FROM events)"""
_OUTCOME = "CASE WHEN status IS NULL THEN 'NetworkError' WHEN status = 403 THEN 'Forbidden' WHEN status = 429 THEN 'RateLimited' WHEN status >= 500 THEN 'ServerError' WHEN event_id % 14 = 0 THEN 'EmptyResponse' WHEN event_id % 14 = 4 THEN 'ChallengePage' ELSE 'Success' END"


def _attempts(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    i = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    status = F.element_at(F.array(*(F.lit(x).cast("int") for x in (200, 403, 429, 503, 200, 500, None))), (F.col("event_id") % 7 + 1).cast("int"))
    html = F.when(F.col("event_id") % 14 == 0, " ").when(F.col("event_id") % 14 == 4, "<title>Just a moment</title>").otherwise("<p>ok</p>")
    rows = e.select(F.col("user_id").cast("string").alias("job_id"), "event_id", i.cast("long").alias("i"), status.alias("status"), html.alias("html"))
    return rows.withColumn("outcome", attempts.outcome(F.col("status"), F.col("html"))).withColumn("page", (F.floor(F.col("i") / 3) + 1).cast("long")).withColumn("attempt", (F.col("i") % 3 + 1).cast("long"))


@query(f"SELECT event_id, {_OUTCOME} AS outcome FROM {_ATTEMPTS} a")
def fetch_outcome(spark, sf_dir):
    return _attempts(spark, sf_dir).select("event_id", "outcome")


_SETTLED = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page ORDER BY attempt DESC) AS r FROM (
  SELECT *, coalesce(max(CASE WHEN outcome IN ('Success', 'Forbidden') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, page ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM (
    SELECT job_id, event_id, i // 3 + 1 AS page, i % 3 + 1 AS attempt, {_OUTCOME} AS outcome FROM {_ATTEMPTS} a) b) c WHERE done = 0) d WHERE r = 1)"""


@query(f"SELECT job_id, CAST(page AS BIGINT) AS page, CAST(attempt AS BIGINT) AS attempt, outcome FROM {_SETTLED} s")
def fetch_retry(spark, sf_dir):
    return attempts.settled(_attempts(spark, sf_dir)).select("job_id", "page", "attempt", "outcome")


@query(f"""
SELECT job_id, CASE WHEN max(CASE WHEN outcome = 'Forbidden' THEN 1 ELSE 0 END) = 1 THEN 'Blocked' WHEN max(page) >= 4 THEN 'Completed' ELSE 'Paused' END AS status,
  CAST(coalesce(max(CASE WHEN outcome <> 'Forbidden' THEN page END), 0) AS BIGINT) AS last_completed_page, coalesce(string_agg(CASE WHEN outcome <> 'Success' THEN CAST(page AS VARCHAR) END, ',' ORDER BY page), '') AS failed_pages,
  CAST(sum(CASE WHEN outcome = 'Success' THEN 2 ELSE 0 END) AS BIGINT) AS records_saved, arg_max('Page ' || page || ': ' || outcome, page) FILTER (outcome <> 'Success') AS last_error,
  CAST(count(*) FILTER (outcome <> 'Success') AS INTEGER) AS n_skips
FROM (SELECT *, coalesce(max(CASE WHEN outcome = 'Forbidden' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM {_SETTLED} s WHERE page <= 4) t WHERE stopped = 0 GROUP BY job_id""")
def job_state(spark, sf_dir):
    rows = attempts.settled(_attempts(spark, sf_dir)).withColumn("total_pages", F.lit(4)).withColumn("records", F.lit(2))
    return jobs.job_state(rows).select("job_id", "status", "last_completed_page", F.array_join("failed_pages", ",").alias("failed_pages"), "records_saved", "last_error", F.size("skips").alias("n_skips"))


_IN_TURN = f"""(SELECT *, max(page) FILTER (settled = 0) OVER (PARTITION BY job_id) AS open FROM (
  SELECT *, CASE WHEN outcome IN ('Success', 'Forbidden') OR attempt = 3 THEN 1 ELSE 0 END AS settled FROM {_SETTLED} s) t)"""


@query(f"""
SELECT job_id, CASE WHEN max(CASE WHEN outcome = 'Forbidden' THEN 1 ELSE 0 END) = 1 THEN 'Blocked' WHEN max(page) >= 4 THEN 'Completed' ELSE 'Paused' END AS status,
  CAST(coalesce(max(CASE WHEN outcome <> 'Forbidden' THEN page END), 0) AS BIGINT) AS last_completed_page, coalesce(string_agg(CASE WHEN outcome <> 'Success' THEN CAST(page AS VARCHAR) END, ',' ORDER BY page), '') AS failed_pages,
  CAST(sum(CASE WHEN outcome = 'Success' THEN 2 ELSE 0 END) AS BIGINT) AS records_saved, arg_max('Page ' || page || ': ' || outcome, page) FILTER (outcome <> 'Success') AS last_error,
  coalesce(string_agg(CASE WHEN outcome <> 'Success' THEN page || ' ' || outcome END, ';' ORDER BY page), '') AS skips, count(*) AS version
FROM (SELECT *, coalesce(max(CASE WHEN outcome = 'Forbidden' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped
  FROM {_IN_TURN} s WHERE page <= 4 AND page < coalesce(open, 5)) t WHERE stopped = 0 GROUP BY job_id""")
def job_stream(spark, sf_dir):
    """The fold of job_state as a stateful stream of single attempts, in two runs with a
    restart between them: two thirds of the attempts come first, so that pages come
    before their turn and wait.  What settled is upserted by job; a page whose attempts
    are not all logged holds its job up."""
    rows = _attempts(spark, sf_dir).select("job_id", "page", "attempt", F.lit(4).alias("total_pages"), "outcome", F.lit(2).alias("records"), F.lit("").alias("detail"), "event_id")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/gleaner-stage-{spark.sparkContext.applicationId}/job-stream-{uuid.uuid4().hex}"
    table = jobs.UpsertTable(spark, folder + "/states", key="job_id", order="version")
    for part in (rows.where("event_id % 3 <> 1"), rows.where("event_id % 3 = 1")):
        part.write.mode("append").parquet(folder + "/attempts")
        stream = jobs.job_stream(spark.readStream.schema(rows.schema).parquet(folder + "/attempts"))
        jobs.upsert_stream(stream, table, folder + "/log", mode="update").awaitTermination()
    skips = F.array_join(F.transform("skips", lambda s: F.concat_ws(" ", s["page"].cast("string"), s["reason"])), ";")
    return table.read().select("job_id", "status", "last_completed_page", F.array_join("failed_pages", ",").alias("failed_pages"), "records_saved", "last_error", skips.alias("skips"), "version")


@query("""
SELECT event_id, CAST(least(coalesce(CASE WHEN event_id % 3 = 0 THEN (event_id % 20) * 1000.0 END, power(2.0, event_id % 5) * 1000.0), 8000.0) AS BIGINT) AS wait_ms,
       least(power(2.0, event_id % 5) * 30.0, 120.0) AS backoff_s, CAST(CASE WHEN event_id % 10 = 0 THEN 0 ELSE round((event_id % 7) / (event_id % 10)::DOUBLE * 100) END AS INTEGER) AS progress FROM events""")
def retry_waits(spark, sf_dir):
    e = F.col("event_id")
    wait = attempts.retry_wait_ms(e % 5, F.when(e % 3 == 0, (e % 20).cast("double")))
    return _t(spark, sf_dir, "events").select("event_id", wait.alias("wait_ms"), attempts.backoff_s(e % 5 + 1).alias("backoff_s"), T.progress(e % 7, e % 10).alias("progress"))


_LOG = """(SELECT CASE WHEN event_id % 3 = 0 THEN 'Page' ELSE 'Profile' END AS kind, user_id % 40 AS page, 'u' || CAST(user_id % 7 AS VARCHAR) AS url, CASE WHEN event_id % 25 > 0 AND event_id % 26 > 0 THEN 'r' || CAST(event_id % 4 AS VARCHAR) END AS reason, event_id AS seq FROM events)"""


@query(f"""
WITH e AS {_LOG}, s AS (SELECT *, row_number() OVER (PARTITION BY kind, page, url ORDER BY seq DESC) AS r FROM e WHERE reason IS NOT NULL)
SELECT kind, page, url, reason, seq FROM s WHERE r = 1
  AND NOT EXISTS (SELECT 1 FROM e WHERE e.reason IS NULL AND e.kind = 'Page' AND e.page = s.page AND e.seq > s.seq)
  AND NOT EXISTS (SELECT 1 FROM e WHERE e.reason IS NULL AND e.kind = 'Profile' AND s.kind = 'Profile' AND e.url = s.url AND e.seq > s.seq)""")
def skip_log(spark, sf_dir):
    e = F.col("event_id")
    reason = F.when((e % 25 > 0) & (e % 26 > 0), F.concat(F.lit("r"), (e % 4).cast("string")))
    rows = _t(spark, sf_dir, "events").select(F.when(e % 3 == 0, "Page").otherwise("Profile").alias("kind"), (F.col("user_id") % 40).alias("page"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("url"), reason.alias("reason"), e.alias("seq"))
    return merge.skip_log(rows)


# --- export --------------------------------------------------------------------

@query("""
SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['A ' || s_name, 'B'] WHEN s_suppkey % 3 = 1 THEN [s_name] ELSE [' '] END) AS location FROM supplier""")
def expand_location(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    v = F.when(k == 0, F.concat(F.lit("A "), "s_name", F.lit("; ;B;"))).when(k == 1, F.col("s_name")).otherwise(" ")
    return merge.expand_locations(_t(spark, sf_dir, "supplier").select("s_suppkey", v.alias("location")), "location")


@query('''
SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) || ',' || CASE s_suppkey % 3 WHEN 0 THEN '"' || s_name || ', ""x"""' WHEN 1 THEN '' ELSE s_name END AS csv FROM supplier''')
def csv_rows(spark, sf_dir):
    v = F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit(', "x"'))).when(F.col("s_suppkey") % 3 == 2, F.col("s_name"))
    return export.csv_rows(_t(spark, sf_dir, "supplier").select("s_suppkey", v.alias("v")), ["s_suppkey", "v"]).select("s_suppkey", "csv")


@query(f"""SELECT page_id, 'Rating' AS name FROM {_SUPP} s GROUP BY page_id""")
def required_warnings(spark, sf_dir):
    out = plan.scrape(_cards(spark, sf_dir), [*_FIELDS, plan.Field("Rating", required=True)])
    return out.warnings()


from . import value_queries  # noqa: E402, F401  registers its queries here
