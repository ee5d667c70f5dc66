"""Relational operators on the node table: texts of elements, siblings and
selectors.  A scope is a row (page_id, pre); results are keyed by it."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.text import clean_text, signature_words, trim, without_runs
from ..sources.stage import staged
from . import axes


def elements(nodes: DataFrame) -> DataFrame:
    """Element rows with ``words`` (their attribute words) and ``next_pre`` (the
    element that follows under the same parent)."""
    follow = Window.partitionBy("page_id", "parent").orderBy("pre")
    return nodes.where("kind = 'element'").select("page_id", "pre", "size", "parent", "depth", "tag", "attrs", "ancestors", "inner_from", "inner_to", signature_words(F.col("attrs")).alias("words"), F.lead("pre").over(follow).alias("next_pre"))


def _texts(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'text'").where(~F.col("parent_tag").isin(C.HIDDEN_PARENTS))


def visible_text(nodes: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """(page_id, pre, vtext) of every scope (default: all) that holds text: its text nodes in
    page order, joined by a space and cleaned: a slice of the page's list of texts.  A text is
    cleaned once, not once a scope; one of spaces alone is null, which a join leaves out."""
    text = F.btrim(without_runs(F.col("text")), F.lit(" \t"))
    held = _texts(nodes).select("page_id", "pre", F.nullif(text, F.lit("")).alias("text")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pre", "text")))["text"].alias("held"))
    spans = nodes.where("kind <> 'text' and text_to > text_from").select("page_id", "pre", "text_from", "text_to")
    if scopes is not None:
        spans = spans.join(scopes.select("page_id", "pre").distinct(), ["page_id", "pre"], "left_semi")
    joined = F.array_join(F.slice("held", F.col("text_from") + 1, F.col("text_to") - F.col("text_from")), " ")
    return spans.join(held, "page_id").select("page_id", "pre", trim(joined).alias("vtext"))


def inner_text(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """(page_id, pre, itext): all text nodes below a scope, scripts' too, as they
    follow each other, cleaned."""
    inside = nodes.where("kind = 'text'").select("page_id", F.col("pre").alias("at"), "text", F.explode("ancestors").alias("pre")).join(scopes.select("page_id", "pre").distinct(), ["page_id", "pre"], "left_semi")
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("at", "text")))["text"], "")
    return inside.groupBy("page_id", "pre").agg(clean_text(joined).alias("itext"))


def inner_html(elems: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, pre, value): the markup inside elements, as it stands in the page."""
    source = pages.select(F.col("page_id").cast("long"), "html")
    return elems.join(source, "page_id").select("page_id", "pre", trim(F.substring("html", F.col("inner_from") + 1, F.col("inner_to") - F.col("inner_from"))).alias("value"))


def main_text(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """``visible_text`` without what lies in a footer or nav element (the scope
    too) or, below the scope, in one that has "footer" among its words."""
    marked = nodes.where("kind = 'element'").select("page_id", "pre", F.col("tag").isin("footer", "nav", *C.HIDDEN_PARENTS).alias("always"), F.array_contains(F.split(signature_words(F.col("attrs")), " +"), "footer").alias("below")).where("always or below")
    above = _texts(nodes).select("page_id", F.col("pre").alias("at"), "text", "ancestors")
    inside = above.select("page_id", "at", "text", F.explode("ancestors").alias("pre")).join(scopes.select("page_id", "pre").distinct(), ["page_id", "pre"], "left_semi")
    barred = above.select("page_id", "at", F.explode("ancestors").alias("bar")).join(marked.select("page_id", F.col("pre").alias("bar"), "always", "below"), ["page_id", "bar"])
    bad = inside.select("page_id", "pre", "at").join(barred, ["page_id", "at"]).where("bar >= pre and (always or bar > pre)").select("page_id", "pre", "at").distinct()
    kept = inside.join(bad, ["page_id", "pre", "at"], "left_anti")
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("at", "text")))["text"], " ")
    return kept.groupBy("page_id", "pre").agg(clean_text(joined).alias("mtext"))


def paragraph_text(elems: DataFrame, texts: DataFrame, scopes: DataFrame) -> DataFrame:
    """(page_id, pre, ptext): the distinct texts of block elements in a scope that
    are not contained in a longer one, else the scope's visible text."""
    wanted = scopes.select("page_id", "pre").distinct()
    # Staged, so that where blocks are few they are sent to the texts and those stay where they are.
    blocks = staged(elems.where(F.col("tag").isin(C.PARAGRAPH_TAGS)).select("page_id", F.col("pre").alias("at"), F.explode("ancestors").alias("pre")).join(wanted, ["page_id", "pre"], "left_semi"))
    blocks = blocks.join(texts.select("page_id", F.col("pre").alias("at"), "vtext"), ["page_id", "at"]).where("vtext <> ''")
    held = F.array_distinct(F.array_sort(F.collect_list(F.struct("at", "vtext")))["vtext"])
    grouped = blocks.groupBy("page_id", "pre").agg(held.alias("held"))
    longest = F.filter("held", lambda p: ~F.exists("held", lambda o: (F.length(o) > F.length(p)) & o.contains(p)))
    own = wanted.join(texts.join(wanted, ["page_id", "pre"], "left_semi"), ["page_id", "pre"], "left").join(grouped, ["page_id", "pre"], "left")
    return own.select("page_id", "pre", F.coalesce(F.array_join(longest, "\n\n"), "vtext", F.lit("")).alias("ptext"))


# --- selectors ---------------------------------------------------------------


@dataclass
class Step:
    """One compound selector, and how it hangs on the one before: "" below it, ">"
    its child, "+" next to it, "~" after it, or the name of an axis."""

    tests: list = field(default_factory=list)
    link: str = ""


class SelectorError(ValueError):
    """The text is not a selector of the supported subset."""


_NTH = re.compile(r"(?:(?P<odd>odd)|(?P<even>even)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<n>\d+))$")
_CSS = re.compile(
    r"\s*(?:(?P<link>[>+~])|(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:\"(?P<q>[^\"]*)\"|'(?P<a>[^']*)'|(?P<v>[^\]\s]+)))?\s*\]"
    r"|:(?P<end>first|last|only)-(?P<what>child|of-type)|:nth-(?P<last>last-)?(?P<kind>child|of-type)\(\s*(?P<nth>[^)]*?)\s*\)|:(?P<empty>empty)|:not\(\s*(?P<no>[^()]+(?:\([^()]*\))?[^()]*)\))"
)
_XSTEP = re.compile(
    r"(?P<axis>//?)(?:(?P<up>\.\.)|@(?P<at>\*|[A-Za-z][\w-]*)|(?:(?P<side>[a-z]+(?:-[a-z]+)*)::)?(?P<tag>\*|[A-Za-z][\w-]*))(?P<preds>(?:\[(?:[^\[\]\"']|\"[^\"]*\"|'[^']*')*\])*)"
)
_XATOM = re.compile(
    r"\s*(?:count\(\s*(?P<caxis>\.//|descendant::|child::|@)?(?P<ctag>\*|[A-Za-z][\w-]*)\s*\)\s*(?P<cop>!=|<=|>=|=|<|>)\s*(?P<cn>\d+)|@(?P<attr>[\w-]+)(?:\s*=\s*(?P<eq>\"[^\"]*\"|'[^']*'))?|(?P<fn>contains|starts-with)\(\s*(?:@(?P<fattr>[\w-]+)|text\(\)|\.|normalize-space\([.]?\))\s*,\s*(?P<fv>\"[^\"]*\"|'[^']*')\s*\)"
    r"|(?:text\(\)|\.|normalize-space\((?:text\(\)|\.)?\))\s*=\s*(?P<text>\"[^\"]*\"|'[^']*')|(?:position\(\)\s*=\s*)?(?P<n>\d+)|(?P<end>last\(\)))"
)


def _nth(text: str) -> tuple[int, int]:
    m = _NTH.match(text)
    if not m:
        raise SelectorError(text)
    if m["odd"] or m["even"]:
        return 2, int(bool(m["odd"]))
    if m["n"]:
        return 0, int(m["n"])
    a = m["a"]
    return int(a + "1" if a in ("", "+", "-") else a), int((m["sign"] or "+") + (m["b"] or "0"))


def parse_css(text: str) -> list[list[Step]]:
    """Comma lists of compounds with the four combinators: tags, classes, ids,
    attribute tests, places among siblings (first-, last-, only-, nth-, nth-last-,
    by child or of-type), :empty and :not(compound)."""
    out = []
    for one in re.split(r",(?![^\[(]*[\])])", text):
        steps, at, link, fresh = [], 0, "", True
        one = one.strip()
        while at < len(one):
            m = _CSS.match(one, at)
            if not m:
                raise SelectorError(text)
            spaced = one[at : m.end()][:1].isspace()
            at = m.end()
            if m["link"]:
                if not steps and not out and link:
                    raise SelectorError(text)
                link, fresh = m["link"], True
                continue
            if fresh or spaced:
                steps.append(Step(link=link))
                link, fresh = "", False
            tests = steps[-1].tests
            if m["tag"]:
                tests += [("tag", m["tag"].lower())] if m["tag"] != "*" else []
            elif m["id"]:
                tests.append(("=", "id", m["id"]))
            elif m["cls"]:
                tests.append(("~=", "class", m["cls"]))
            elif m["attr"]:
                tests.append((m["op"] or "has", m["attr"].lower(), m["q"] or m["a"] or m["v"] or ""))
            elif m["end"]:
                of_type = m["what"] == "of-type"
                tests += [("nth", 0, 1, last, of_type) for last in {"first": (False,), "last": (True,), "only": (False, True)}[m["end"]]]
            elif m["kind"]:
                tests.append(("nth", *_nth(m["nth"]), bool(m["last"]), m["kind"] == "of-type"))
            elif m["empty"]:
                tests.append(("empty",))
            else:
                inner = parse_css(m["no"])
                if any(len(steps_) > 1 for steps_ in inner):
                    raise SelectorError(text)
                tests.append(("not", ("or", *(("and", *steps_[0].tests) for steps_ in inner))))
        if link or not steps:
            raise SelectorError(text)
        out.append(steps)
    return out


def _predicate(text: str) -> tuple:
    """and, or, not( ) and brackets over tests of attributes, text and place."""
    at = 0

    def word(w: str) -> bool:
        nonlocal at
        m = re.compile(rf"\s*{w}").match(text, at)
        at = m.end() if m else at
        return bool(m)

    def joined(name: str, part) -> tuple:
        parts = [part()]
        while word(rf"{name}\b"):
            parts.append(part())
        return parts[0] if len(parts) == 1 else (name, *parts)

    def either() -> tuple:
        return joined("or", lambda: joined("and", atom))

    def atom() -> tuple:
        nonlocal at
        negated = word(r"not\s*\(")
        if negated or word(r"\("):
            inner = either()
            if not word(r"\)"):
                raise SelectorError(text)
            return ("not", inner) if negated else inner
        m = _XATOM.match(text, at)
        if not m:
            raise SelectorError(text)
        at = m.end()
        if m["cn"]:
            axis = {"@": "attribute", ".//": "descendant", "descendant::": "descendant"}.get(m["caxis"], "child")
            return ("count", axis, m["ctag"].lower(), m["cop"], int(m["cn"]))
        if m["attr"]:
            return ("=", m["attr"].lower(), m["eq"][1:-1]) if m["eq"] else ("has", m["attr"].lower(), "")
        if m["fn"]:
            return ({"contains": "*=", "starts-with": "^="}[m["fn"]], m["fattr"].lower() if m["fattr"] else None, m["fv"][1:-1])
        if m["text"]:
            return ("=", None, m["text"][1:-1])
        return ("nth", 0, 1, True, True) if m["end"] else ("nth", 0, int(m["n"]), False, True)

    out = either()
    if text[at:].strip():
        raise SelectorError(text)
    return out


def parse_xpath(text: str) -> list[list[Step]]:
    """Paths of named steps with predicates, on any axis of ``axes.AXES``, ``..``, and
    attribute steps, which give the elements that have the attribute; unions with
    ``|``."""
    out = []
    for one in re.split(r"\|(?![^\[]*\])", text):
        one = one.strip().removeprefix(".")
        steps, at = [], 0
        while at < len(one):
            m = _XSTEP.match(one, at)
            if not m or (m["side"] and m["side"] not in axes.AXES):
                raise SelectorError(text)
            at = m.end()
            below = m["axis"] == "//"
            if m["at"]:
                has = ("attrs",) if m["at"] == "*" else ("has", m["at"].lower(), "")
                s = Step([has], "descendant-or-self" if below else "self")
            elif m["up"] or m["side"]:
                if below:  # from any node below
                    steps.append(Step([], "descendant-or-self"))
                side = "parent" if m["up"] else m["side"]
                s = Step([("tag", m["tag"].lower())] if m["tag"] and m["tag"] != "*" else [], ">" if side == "child" else side)
            else:
                s = Step([("tag", m["tag"].lower())] if m["tag"] != "*" else [], "" if below else ">")
            for p in re.findall(r"\[((?:[^\[\]\"']|\"[^\"]*\"|'[^']*')*)\]", m["preds"]):
                s.tests.append(_predicate(p))
            if s.link in ("following", "preceding") and any(t[0] == "nth" for t in _flat(s.tests)):
                raise SelectorError(f"{text}: a place on the axis {s.link}")
            if s.link in axes.AXES and any(t[0] == "nth" for u in s.tests if u[0] in ("not", "and", "or") for t in _flat([u])):
                raise SelectorError(f"{text}: a place inside a condition")
            steps.append(s)
        if not steps:
            raise SelectorError(text)
        out.append(steps)
    return out


def _test(t: tuple) -> Column:
    if t[0] == "tag":
        return F.col("tag") == t[1]
    if t[0] == "empty":
        return F.col("size") == 0
    if t[0] == "attrs":
        return F.coalesce(F.size("attrs") > 0, F.lit(False))
    if t[0] == "count":
        n = _count(t)
        return {"=": n == t[4], "!=": n != t[4], "<": n < t[4], "<=": n <= t[4], ">": n > t[4], ">=": n >= t[4]}[t[3]]
    if t[0] == "not":
        return ~_test(t[1])
    if t[0] in ("and", "or"):
        out = F.lit(t[0] == "and")
        for x in t[1:]:
            out = out & _test(x) if t[0] == "and" else out | _test(x)
        return out
    if t[0] == "nth":
        _, a, b, last, of_type = t
        place = F.col(_place(last, of_type))
        return place == b if a == 0 else (place - b) % a == 0 if b <= 1 and a > 0 else ((place - b) % a == 0) & ((place - b) * (1 if a > 0 else -1) >= 0)
    op, name, value = t
    c = F.col("attrs")[name] if name else F.col("vtext")
    test = {
        "has": c.isNotNull(), "=": c == value, "~=": F.array_contains(F.split(c, r"\s+"), value), "^=": c.startswith(value), "$=": c.endswith(value),
        "*=": c.contains(value), "|=": (c == value) | c.startswith(value + "-"),
    }[op]
    return F.coalesce(test, F.lit(False))


def _count(t: tuple) -> Column:
    _, axis, tag = t[:3]
    if axis != "attribute":
        return F.coalesce(F.col(f"count_{axis}_{tag}"), F.lit(0))
    return F.greatest(F.size("attrs"), F.lit(0)) if tag == "*" else F.col("attrs")[tag].isNotNull().cast("int")


def _place(last: bool, of_type: bool) -> str:
    return f"place_{'last' if last else 'first'}_{'type' if of_type else 'child'}"


def _flat(tests: list) -> list[tuple]:
    """Tests with those inside not, and, or."""
    return [x for t in tests for x in ([t, *_flat(list(t[1:]))] if t[0] in ("not", "and", "or") else [t])]


def _along(found: DataFrame, pool: DataFrame, s: Step) -> DataFrame:
    """A step on a named axis: its places count along the axis, from each node."""
    k = next((k for k, t in enumerate(s.tests) if t[0] == "nth"), len(s.tests))
    rows = pool
    for t in s.tests[:k]:
        rows = rows.where(_test(t))
    placed = s.link.endswith("sibling") and k < len(s.tests)
    met = axes.step(found, rows, s.link, pool, s.tests[k][2:4] if placed else None)
    for t in s.tests[k + placed :]:
        if t[0] == "nth":
            back = (s.link in axes.REVERSE) != t[3]
            turn = F.row_number().over(Window.partitionBy("page_id", "scope", "origin").orderBy(F.desc("pre") if back else "pre"))
            met = met.withColumn("_n", turn).where(F.col("_n") == t[2]).drop("_n")
        else:
            met = met.join(pool.where(_test(t)).select("page_id", "pre"), ["page_id", "pre"], "left_semi")
    return _once(met)


def _once(met: DataFrame) -> DataFrame:
    """Each (page_id, scope, pre) once, with its size and parent."""
    return met.groupBy("page_id", "scope", "pre").agg(F.first("size").alias("size"), F.first("parent").alias("parent"))


def _counting(paths: list[list[Step]], pool: DataFrame, axis: str, tag: str) -> DataFrame:
    """The elements that steps with this count look at: those of their tags."""
    tags = [next((t[1] for t in s.tests if t[0] == "tag"), None) for path in paths for s in path if any(t[:3] == ("count", axis, tag) for t in _flat(s.tests))]
    return pool if None in tags else pool.where(F.col("tag").isin(tags))


def select(elems: DataFrame, selector: str, kind: str = "Css", scopes: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(page_id, scope, pre) of the elements a selector finds inside each scope;
    without scopes the document (0) is the scope, and an XPath always begins at it
    unless it begins with a dot.  Tests of text look at the visible text in
    ``texts``.  A selector that is blank, invalid or outside the subset finds
    nothing and warns."""
    everything = elems.select("page_id", F.lit(0).alias("scope")).distinct() if scopes is None else scopes.select("page_id", F.col("pre").alias("scope")).distinct()
    try:
        paths = parse_xpath(selector) if kind == "XPath" else parse_css(selector)
        tests = _flat([t for path in paths for s in path for t in s.tests])
        if texts is None and any(len(t) == 3 and t[1] is None for t in tests):
            raise SelectorError(f"{selector}: no texts to test")
    except SelectorError as e:
        warnings.warn(f"selector finds nothing: {e}", stacklevel=2)
        return everything.join(elems.select("page_id", "pre").where("false"), "page_id")
    pool = elems.select("page_id", "pre", "size", "parent", "tag", "attrs")
    for axis, tag in {t[1:3] for t in tests if t[0] == "count" and t[1] != "attribute"}:
        counted = elems.select("page_id", "pre", "size", "parent", "tag")
        pool = pool.join(axes.counts(counted, axis, tag, _counting(paths, counted, axis, tag)).withColumnRenamed("n", f"count_{axis}_{tag}"), ["page_id", "pre"], "left")
    for last, of_type in {t[3:] for t in tests if t[0] == "nth"}:
        beside = Window.partitionBy("page_id", "parent", *(["tag"] if of_type else [])).orderBy(F.desc("pre") if last else "pre")
        pool = pool.withColumn(_place(last, of_type), F.row_number().over(beside))
    if any(len(t) == 3 and t[1] is None for t in tests):
        pool = pool.join(texts.select("page_id", "pre", "vtext"), ["page_id", "pre"], "left")
    out = None
    for path in paths:
        found = everything.withColumn("pre", F.col("scope"))
        if kind == "XPath" and not selector.strip().startswith("."):
            found = found.withColumn("pre", F.lit(0))
        for i, s in enumerate(path):
            if s.link in axes.AXES:
                found = _along(found, pool, s)
                continue
            rows = pool
            for t in s.tests:
                rows = rows.where(_test(t))
            if s.link in ("+", "~"):
                here = pool.select("page_id", "pre", "parent")
                turn = found.select("page_id", "scope", "pre").join(here, ["page_id", "pre"]).withColumnRenamed("pre", "left")
                met = turn.join(rows.select("page_id", "parent", "pre"), ["page_id", "parent"]).where(F.col("pre") > F.col("left"))
                if s.link == "+":
                    follow = pool.select("page_id", F.col("pre").alias("left"), F.lead("pre").over(Window.partitionBy("page_id", "parent").orderBy("pre")).alias("pre"))
                    met = turn.join(follow, ["page_id", "left"]).join(rows.select("page_id", "pre"), ["page_id", "pre"], "left_semi")
                found = met.select("page_id", "scope", "pre").distinct()
                continue
            child = s.link == ">" and (i > 0 or kind == "XPath")
            if not child and i == 0 and scopes is None:
                found = rows.select("page_id", F.lit(0).alias("scope"), "pre", "size", "parent")  # all lies in the document
                continue
            found = _once(axes.step(found, rows, "child" if child else "descendant", pool))
        found = found.select("page_id", "scope", "pre")
        out = found if out is None else out.union(found)
    return out.distinct()


def extracted(elems: DataFrame, texts: DataFrame, how: str, attribute: str | None = None, nodes: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(page_id, pre, value): Text, Html (needs ``pages``), Link (href, else src) or
    Attribute of every element.  With ``nodes`` Text is the inner text, scripts'
    too; otherwise the visible text."""
    if how == "Html":
        return inner_html(elems, pages)
    e = elems.select("page_id", "pre", "attrs")
    if how == "Text":
        told, name = (texts, "vtext") if nodes is None else (inner_text(nodes, e), "itext")
        return e.join(told, ["page_id", "pre"], "left").select("page_id", "pre", F.coalesce(name, F.lit("")).alias("value"))
    value = F.coalesce(F.col("attrs")["href"], F.col("attrs")["src"]) if how == "Link" else F.col("attrs")[attribute or ""]
    return e.select("page_id", "pre", value.alias("value"))


def selector_test(
    elems: DataFrame, texts: DataFrame, selector: str, kind: str = "Css", how: str = "Text", attribute: str | None = None, pages: DataFrame | None = None,
    record_selector: str | None = None, record_kind: str = "Css",
) -> DataFrame:
    """(page_id, matches, previews) of every page with elements: how often a selector
    matches and the first values.  The scopes of ``record_selector``, else the document,
    are taken in order, whole, up to the one with which the matches pass
    ``MAX_MATCHES``.  Without a scope there is no match."""
    scopes = select(elems, record_selector, record_kind, texts=texts) if record_selector and record_selector.strip() else None
    hits = select(elems, selector, kind, scopes, texts)
    per = hits.groupBy("page_id", "scope").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("page_id").orderBy("scope").rowsBetween(Window.unboundedPreceding, -1)
    asked = per.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).where(F.col("before") <= C.MAX_MATCHES)
    turn = F.row_number().over(Window.partitionBy("page_id").orderBy("scope", "pre"))
    shown = hits.withColumn("turn", turn).where(F.col("turn") <= C.MAX_PREVIEWS)
    found = elems.join(shown.select("page_id", "pre").distinct(), ["page_id", "pre"], "left_semi")
    shown = shown.join(extracted(found, texts, how, attribute, pages=pages), ["page_id", "pre"])
    previews = shown.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("value", F.lit("")).alias("value"))))["value"].alias("previews"))
    totals = asked.groupBy("page_id").agg(F.sum("n").alias("matches"))
    out = elems.select("page_id").distinct().join(totals, "page_id", "left").join(previews, "page_id", "left")
    return out.select("page_id", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("previews", F.array().cast("array<string>")).alias("previews"))
