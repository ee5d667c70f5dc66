"""Cases in which an operator once did less than its whole job."""

import contextlib

import pytest
from pyspark.sql import functions as F

from gleaner.llm import htmltext, mixing, pii


def test_mixing_keeps_its_share_beside_a_rare_cell(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rare = spark.createDataFrame([(-1, "one two three four five six seven eight nine ten", "zz", "new", 49)], docs.schema)
    expected = F.sum(F.col("mix_tokens") * F.col("mix_probability"))
    for df in (docs, docs.union(rare)):
        with pytest.warns(UserWarning, match="raking") if df is not docs else contextlib.nullcontext():
            for k in (100_000, 0) if df is docs else (100_000,):
                all_, kept = mixing.mix(df, max_local_cells=k).agg(F.sum("mix_tokens"), expected).first()
                assert kept == pytest.approx(all_ / 2, rel=1e-6)
        assert mixing.mix(df, budget=5000).agg(expected).first()[0] == pytest.approx(5000, rel=1e-6)
    assert mixing.mix(docs, share=1.0).where("mix_kept").count() == docs.count()


LONG = "A sentence of the article that is long enough to count. "


@pytest.mark.parametrize(
    ("source", "want", "unwanted"),
    [
        ('<div class="elementor-widget elementor-widget-text-editor"><p>ONE</p></div><div class="x"><p>TWO</p></div>', ("ONE", "TWO"), ()),
        ('<div class="site-content no-sidebar"><p>ONE</p><div class="widget-area"><p>Ours</p></div></div>', ("ONE",), ("Ours",)),
        ('<div class="has-sidebar"><div class="legal notice"><p>ONE</p><p>TWO</p></div><div class="share-buttons">Send</div></div>', ("ONE", "TWO"), ("Send",)),
        ('<div class="widget"><p>ONE</p></div><div class="widget"><p>TWO</p></div><div class="rest">By us</div>', ("ONE", "TWO"), ()),
        ('<div class="comments"><p>ONE</p></div>', ("ONE",), ()),
        ('<div class="post"><p>ONE</p></div><div class="comments"><p>REPLY</p><p>REPLY</p><p>REPLY</p></div>', ("ONE",), ("REPLY",)),
        ('<div class="ad">REPLY</div><article><p>Few words.</p></article>', ("Few",), ("REPLY",)),
        ('<div><svg-icon name="a"></svg-icon><title-block>Head</title-block><p>ONE</p></div>', ("ONE",), ()),
        ('<div><p><svg class="i" />ONE</p><p>TWO<svg><text>Drawn</text></svg></p></div>', ("ONE", "TWO"), ("Drawn",)),
        ('<div><object data="a"><p>ONE</p><select><p>TWO</p></div>', ("ONE", "TWO"), ()),
    ],
)
def test_html_keeps_the_article(source, want, unwanted):
    for w in ("ONE", "TWO", "REPLY"):
        source = source.replace(w, f"{w} {LONG}")
    page = htmltext.Page(f"<html><body><header>Top</header>{source}</body></html>")
    text = page.text({page.best()[0]})
    assert all(w in text for w in want) and not any(w in text for w in unwanted), text


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "content no-comments", "page promo-off", "side-by-side", "theme-menu-open", "with-banner", "is-search-hidden"])
def test_html_wrappers_keep_the_article(wrapper):
    page = htmltext.Page(f'<div class="{wrapper}"><article><p>ONE {LONG}</p></article></div>')
    assert page.text({page.best()[0]}).startswith("ONE")


def test_html_deep_hot_and_odd_pages(spark):
    deep = "<div>" * 20_000 + "deep text here" + "</p>" * 20_000 + "</div>" * 20_000
    rows = [(i, "http://hot.org/p", f"<div class='x'><p>Text {i} {LONG}</p></div>") for i in range(40)] + [(100, "http://hot.org/d", deep), (1, "http://hot.org/p", f"<div class='x'><p>Text 1 {LONG}</p></div>"), (None, None, "<p>a</p>"), (101, "http://o.org", "x" * 400_000)]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    near, far = ({(r.page_id, r.text, r.n_chars) for r in htmltext.extract(pages, max_broadcast_hosts=k).collect()} for k in (20_000, 0))
    assert near == far and len(near) == 43
    texts = {p: t for p, t, _ in near}
    assert texts[100] == "deep text here" and texts[7].startswith("Text 7") and texts[None] == "a" and len(texts[101]) == 400_000
    assert htmltext.extract(pages.where(F.lit(False))).count() == 0


@pytest.mark.parametrize(("left", "right"), [("ID:", ""), ("(", ")"), ("#", ""), ('"id":"', '"'), ("no. ", ", ok")])
def test_pii_discovers_glued_identifiers(spark, left, right):
    rows = [(i, f"w{'abcdef'[i]} {left}u{'abcdef'[i]}@x.org{right} v{'abcdef'[i]}") for i in range(6)]
    rows += [(9, f"seen {left}QX99812{right} then"), (10, "room QX99813 stays"), (11, ". , : . , : . , : . , : . , : id once id alone")]
    got = {x.doc_id: x.spans for x in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    at = 5 + len(left)
    assert got[9] == f"context:{at}:{at + 7}" and got[10] == "" and got[11] == ""


def test_pii_scores_by_brute_force(spark):
    """Pattern scores recomputed from the scanned hits by plain loops."""
    import random
    import re

    r = random.Random(5)
    forms = ["id: {}", "ref={};", "({})", "account {} now", "see {}"]
    rows = []
    for i in range(120):
        hit = r.choice([f"u{i % 40}@x.org", f"QX{i % 25}9812", f"A{i % 7}-1234"])
        rows.append((i, f"{r.choice(['the', 'a', 'id', 'ref'])} {r.choice(forms).format(hit)} {r.choice(['and', 'or', 'id:', 'account'])}"))
    docs = spark.createDataFrame([*rows, (None, None), (3, rows[3][1])], "doc_id long, text string")
    met = pii.scan(docs).select(F.explode("met").alias("m")).select("m.*")
    got = {x.pattern: x.score for x in pii.learn(met, docs).collect()}
    edges, seeds = {}, set()
    for m in met.collect():
        for p in m.patterns:
            if len(p) > 2:
                edges.setdefault(p, {}).setdefault(m.value, 0)
                edges[p][m.value] += 1
        if m.seed:
            seeds.add(m.value)
    mark = r"[^\sA-Za-z0-9]"
    words = {}
    for x in docs.collect():
        low = (x.text or "").lower()
        for pattern in [rf"[a-z]+|[0-9]+|{mark}", *(rf"[a-z]+{mark}{{{k}}}" for k in (1, 2, 3))]:
            for w in re.findall(pattern, low):
                words[w] = words.get(w, 0) + 1
    edges = {p: e for p, e in edges.items() if len(e) >= 3 and p[2:] in words}
    trust = {v: float(v in seeds) for e in edges.values() for v in e}
    for _ in range(3):
        scores = {p: min(sum(trust[v] * n for v, n in e.items()) / words[p[2:]], 0.99) for p, e in edges.items() if sum(trust[v] >= 0.5 for v in e) >= 3}
        miss = dict.fromkeys(trust, 1.0)
        for p, e in edges.items():
            for v in e:
                miss[v] *= 1 - scores.get(p, 0.0)
        trust = {v: 1.0 if v in seeds else 1 - m for v, m in miss.items()}
    want = {p: s for p, s in scores.items() if s >= 0.5}
    assert want and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_many_hits_in_one_text(spark):
    """Over several chunks of matches: offsets, overlaps and redaction stay right."""
    text = " ".join(f"log {i * 7919 % 99991}ab u{i}@x.org" for i in range(1500))
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    row = pii.scan(docs).first()
    assert len(row.email) == 1500 and all(text[s.start : s.end].endswith("@x.org") for s in row.email)
    loose = [m for m in row.met if not m.seed]
    assert all(text[m.start : m.end].lower() == m.value for m in loose) and len(loose) == sum(len(w) >= 4 and w.endswith("ab") for w in text.split())
    told = [r.text for r in pii.redact(docs, floor=2.0).collect()]
    assert told == [" ".join("<EMAIL>" if w.endswith("@x.org") else w for w in text.split(" "))] * 2


def extracted(spark, sources):
    rows = [(i, f"https://h.org/{i}", s) for i, s in enumerate(sources)]
    return [r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def body(*parts):
    return "<html><body><nav><a href='/'>Home</a></nav>" + "".join(parts) + "<footer>Foot</footer></body></html>"


def test_html_host_vote_does_not_override_a_page(spark):
    pages = [body(f'<div class="main"><p>Page {i}. {LONG * 6}</p></div>') for i in range(20)]
    pages.append(body('<div class="main">Teaser only.</div>', f'<div class="story"><p>STORY {LONG * 8}</p></div>'))
    got = extracted(spark, pages)
    assert got[20].split("\n\n")[-1].startswith("STORY") and got[20].endswith((LONG * 8).strip())
    assert all(t == f"Page {i}. {LONG * 6}".strip() for i, t in enumerate(got[:20]))


@pytest.mark.parametrize("outer", [("<main>", "</main>"), ("<div role='main'>", "</div>"), ("<div class='page'>", "</div>"), ("", "")])
def test_html_keeps_titles_and_uneven_parts(spark, outer):
    titled = body(outer[0], "<h1>Title</h1>", f'<div class="body"><p>ONE {LONG * 9}</p></div>', outer[1])
    parts = body(outer[0], f'<div class="intro"><p>ONE {LONG * 2}</p></div><div class="story"><p>TWO {LONG * 9}</p></div><div class="end"><p>THREE {LONG}</p></div>', outer[1])
    for many in (1, 6):  # alone and with the host's votes
        got = extracted(spark, [titled] * many)
        assert set(got) == {f"Title\n\nONE {LONG * 9}".strip()}
        (text,) = set(extracted(spark, [parts] * many))
        assert [t.split()[0] for t in text.split("\n\n")] == ["ONE", "TWO", "THREE"]


@pytest.mark.parametrize("name", ['class="post about-cookies"', 'id="single-sponsored"', 'class="gdpr-explained"', 'class="entry sponsored-by"'])
def test_html_does_not_trust_words_that_would_take_the_article(spark, name):
    page = body(f"<div {name}><h1>Title</h1><p>ONE {LONG * 9}</p></div>", "<p>Printed here.</p>")
    for many in (1, 6):
        (text,) = set(extracted(spark, [page] * many))
        assert "Title" in text and "ONE" in text


def test_html_tied_votes_and_unlinked_nothing(spark):
    a, b = body(f'<div class="a"><p>{LONG * 3}</p></div>'), body(f'<div class="b"><p>{LONG * 3}</p></div>')
    assert extracted(spark, [a, b, a, b]) == [(LONG * 3).strip()] * 4
    assert extracted(spark, ["<p><a href='/'>only a link</a></p>", "<h1>only a title</h1>"]) == ["only a link", "only a title"]


def test_html_drops_what_is_no_article(spark):
    page = body('<div class="cookie-banner"><p>We use cookies. ' + LONG * 2 + "</p></div>", f'<div class="post"><h1>Title</h1><p>ONE {LONG * 4}</p></div>', f'<div class="ad-box">Buy. {LONG}</div>', f'<div id="comments"><p>REPLY {LONG * 30}</p></div>')
    (text,) = extracted(spark, [page])
    assert text == f"Title\n\nONE {LONG * 4}".strip()
