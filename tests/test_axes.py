"""Axes of the node table against plain loops over intervals."""

import random

import pytest

from gleaner.operators import axes, dom


def trees(seed):
    """Pages of random trees: (page_id, pre, size, parent, tag, attrs)."""
    r, out = random.Random(seed), []
    for page in range(3):
        parents = [0] + [0 if r.random() < 0.1 else r.randrange(max(0, i - 6), i) for i in range(1, 90)]
        kids = {}
        for i, p in enumerate(parents[1:], 1):
            kids.setdefault(p, []).append(i)
        nodes, stack = [], [(0, -1)]

        def walk(i, up):
            at = len(nodes)
            nodes.append([page, at, 0, up, r.choice("abc"), {"x": str(i % 3)} if i % 4 else {}])
            for k in kids.get(i, []):
                walk(k, at)
            nodes[at][2] = len(nodes) - 1 - at

        walk(0, -1)
        out += [tuple(n) for n in nodes[1:]]  # the first is the document
        assert stack
    return out


def on_axis(axis, a, n):
    """Whether node n lies on an axis of node a: (page, pre, size, parent, ...)."""
    inside = n[1] <= a[1] <= n[1] + n[2]
    below = a[1] <= n[1] <= a[1] + a[2]
    return {
        "self": n[1] == a[1], "child": n[3] == a[1], "parent": n[1] == a[3], "descendant": below and n[1] != a[1], "descendant-or-self": below, "ancestor": inside and n[1] != a[1], "ancestor-or-self": inside,
        "following": n[1] > a[1] + a[2], "following-sibling": n[3] == a[3] and n[1] > a[1], "preceding": n[1] + n[2] < a[1], "preceding-sibling": n[3] == a[3] and n[1] < a[1],
    }[axis]


@pytest.fixture(scope="module")
def elems(spark):
    rows = trees(5)
    return spark.createDataFrame(rows, "page_id long, pre int, size int, parent int, tag string, attrs map<string,string>").cache(), rows


@pytest.mark.parametrize("axis", axes.AXES)
def test_axis(spark, elems, axis):
    df, rows = elems
    context = [(n[0], scope, n[1]) for n in rows for scope in (1, 2) if n[1] % 5 == scope]
    got = axes.step(spark.createDataFrame(context, "page_id long, scope int, pre int"), df.where("tag = 'b'"), axis, df)
    by = {(n[0], n[1]): n for n in rows}
    want = {(p, s, n[1]) for p, s, at in context for n in rows if n[0] == p and n[4] == "b" and on_axis(axis, by[p, at], n)}
    assert {(r.page_id, r.scope, r.pre) for r in got.collect()} == want


@pytest.mark.parametrize(
    ("path", "axis", "place", "backwards"),
    [("//a/ancestor::b[1]", "ancestor", 1, True), ("//a/ancestor::b[last()]", "ancestor", 1, False), ("//a/preceding-sibling::b[2]", "preceding-sibling", 2, True), ("//a/following-sibling::b[position()=1]", "following-sibling", 1, False), ("//a/descendant::b[2]", "descendant", 2, False)],
)
def test_places_along_an_axis(elems, path, axis, place, backwards):
    df, rows = elems
    want = set()
    for a in rows:
        if a[4] == "a":
            met = sorted((n[1] for n in rows if n[0] == a[0] and n[4] == "b" and on_axis(axis, a, n)), reverse=backwards)
            want |= {(a[0], x) for x in met[place - 1 : place]}
    assert {(r.page_id, r.pre) for r in dom.select(df, path, "XPath").collect()} == want


def test_counts_attributes_and_scopes(elems, spark):
    df, rows = elems

    def hits(path, scopes=None):
        return {(r.page_id, r.scope, r.pre) for r in dom.select(df, path, "XPath", scopes).collect()}

    for test, holds in (("count(b) = 2", lambda n: sum(on_axis("child", n, m) and m[4] == "b" for m in rows if m[0] == n[0]) == 2), ("count(.//*) >= 4", lambda n: n[2] >= 4), ("count(@x) = 0", lambda n: not n[5]), ("not(count(c) < 1)", lambda n: any(on_axis("child", n, m) and m[4] == "c" for m in rows if m[0] == n[0]))):
        assert hits(f"//a[{test}]") == {(n[0], 0, n[1]) for n in rows if n[4] == "a" and holds(n)}, test
    assert hits("//b/@x") == hits("//b[@x]") == {(n[0], 0, n[1]) for n in rows if n[4] == "b" and n[5]} and hits("//b/@*") == hits("//b/@x")
    assert hits("//a/..") == {(n[0], 0, n[3]) for n in rows if n[4] == "a" and n[3] > 0}
    scopes = spark.createDataFrame([(n[0], n[1]) for n in rows if n[1] in (1, 7)], "page_id long, pre int")
    by = {(n[0], n[1]): n for n in rows}
    assert hits(".//b", scopes) == {(p, s, n[1]) for p, s in [(n[0], n[1]) for n in rows if n[1] in (1, 7)] for n in rows if n[0] == p and n[4] == "b" and on_axis("descendant", by[p, s], n)}
    with pytest.warns(UserWarning, match="finds nothing"):
        assert hits("//a/following::b[1]") == hits("//a/nowhere::b") == hits("//a/ancestor::b[not(2)]") == set()


@pytest.mark.parametrize("axis", ["following-sibling", "preceding-sibling"])
@pytest.mark.parametrize("place", ["1", "2", "position()=3", "last()", "0"])
def test_places_beside_a_node(elems, axis, place):
    """the children of a parent are counted through once; each node met each before."""
    df, rows = elems
    for tag, after in (("b", ""), ("*", "[@x='1']"), ("a", "[1]"), ("a", "[2]")):
        want = set()
        for a in rows:
            met = sorted((n[1] for n in rows if a[4] == "a" and n[0] == a[0] and tag in (n[4], "*") and on_axis(axis, a, n)), reverse=axis[0] == "p")
            met = met[-1:] if place == "last()" else met[int(place[-1]) - 1 :][:1] if place != "0" else []
            want |= {(a[0], x) for x in met if after == "[1]" or not after or (after == "[@x='1']" and next(n for n in rows if n[:2] == (a[0], x))[5].get("x") == "1")}
        assert {(r.page_id, r.pre) for r in dom.select(df, f"//a/{axis}::{tag}[{place}]{after}", "XPath").collect()} == want


def most_rows(df):
    """The rows that any join of a query that has run gave."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_a_long_list_makes_no_pairs(spark):
    """each of a list's items met all others on the sibling axes, 2,000,000 pairs here."""
    columns = "1L as page_id", "cast(id + 1 as int) as pre", "0 as size", "1 as parent", "'li' as tag", "map('k', string(id % 2)) as attrs"
    items = spark.range(1, 2001).selectExpr(*columns).cache()
    for path, n in (("//li/following-sibling::li[1]", 1999), ("//li[@k='1']/preceding-sibling::li[last()]", 1), ("//li/preceding-sibling::li", 1999)):
        found = dom.select(items, path, "XPath")
        assert len(found.collect()) == n and most_rows(found) <= 2000
    items.unpersist()
