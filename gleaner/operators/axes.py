"""Axes of the node table as joins on the plane of pre-order number and subtree size.

A node's subtree is the interval [pre, pre + size].  "Inside" is an interval join: the
intervals are cut into buckets of ``BUCKET`` numbers, points fall into one each, and both
meet by (page, bucket), so no list of ancestors is read, and what moves is a row for
each bucket that an interval touches.  What follows or precedes any node of a scope is
decided by one bound a scope, and what lies beside a node by one bound a parent, so no
pairs are made; a place beside a node is a number among its parent's children.

``step`` takes a context (page_id, scope, pre; with size and parent, if known) and the rows
to reach (page_id, pre, size, parent, ...), which hold elements but not the document (0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 32
#: Axes whose nodes come nearest first when counted backwards.
REVERSE = ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling", "parent")
AXES = ("self", "child", "parent", "descendant", "descendant-or-self", "ancestor", "ancestor-or-self", "following", "following-sibling", "preceding", "preceding-sibling")


def inside(outer: DataFrame, inner: DataFrame, or_self: bool = False) -> DataFrame:
    """All pairs of an ``outer`` row (page_id, lo, hi, ...) and an ``inner`` one
    (page_id, at, ...) with lo < at <= hi, or lo <= at with ``or_self``."""
    def bucket(c: Column) -> Column:
        return F.floor(c / BUCKET).cast("int")

    cut = outer.withColumn("_b", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    met = cut.join(inner.withColumn("_b", bucket(F.col("at"))), ["page_id", "_b"])
    low = F.col("at") >= F.col("lo") if or_self else F.col("at") > F.col("lo")
    return met.where(low & (F.col("at") <= F.col("hi"))).drop("_b")


def step(context: DataFrame, rows: DataFrame, axis: str, pool: DataFrame, place: tuple[int, bool] | None = None) -> DataFrame:
    """(page_id, scope, origin, pre, size, parent) of the ``rows`` on an axis of each context
    node; ``origin`` is the context node, null on the axes following and preceding, which
    have none of their own, and beside a node without a ``place``.  ``pool``: all elements,
    with size and parent.  ``place``, of the sibling axes alone: the number of the one row
    to take along the axis, and whether it counts from the far end."""
    if axis not in AXES:
        raise ValueError(axis)
    reach = rows.select("page_id", F.col("pre").alias("next"), F.col("size").alias("next_size"), F.col("parent").alias("next_parent"))
    reached = (F.col("next").alias("pre"), F.col("next_size").alias("size"), F.col("next_parent").alias("parent"))
    if axis == "child":
        met = context.select("page_id", "scope", F.col("pre").alias("next_parent")).join(reach, ["page_id", "next_parent"])
        return met.select("page_id", "scope", F.col("next_parent").alias("origin"), *reached)
    placed = context if {"size", "parent"} <= {*context.columns} else context.join(pool.select("page_id", "pre", "size", "parent"), ["page_id", "pre"], "left")
    whole, held = placed.where("pre = 0"), placed.where("pre > 0")
    if axis in ("self", "parent"):
        key = "pre" if axis == "self" else "parent"
        met = held.select("page_id", "scope", F.col("pre").alias("origin"), F.col(key).alias("next")).join(reach, ["page_id", "next"])
    elif axis.endswith("sibling") and place:
        met = _beside(held, reach, axis == "following-sibling", *place)
    elif axis.endswith("sibling"):
        after = axis == "following-sibling"
        edge = held.groupBy("page_id", "scope", F.col("parent").alias("next_parent")).agg((F.min if after else F.max)("pre").alias("edge"))
        met = edge.join(reach, ["page_id", "next_parent"]).where("next > edge" if after else "next < edge").withColumn("origin", F.lit(None).cast("int"))
    elif axis.startswith("descendant"):
        spans = held.select("page_id", "scope", F.col("pre").alias("origin"), F.col("pre").alias("lo"), (F.col("pre") + F.col("size")).alias("hi"))
        met = inside(spans, reach.withColumn("at", F.col("next")), axis.endswith("self")).drop("lo", "hi", "at")
        every = whole.select("page_id", "scope", F.col("pre").alias("origin")).join(reach, "page_id")
        met = met.unionByName(every)  # all elements lie in the document
    elif axis.startswith("ancestor"):
        spans = reach.select("*", F.col("next").alias("lo"), (F.col("next") + F.col("next_size")).alias("hi"))
        met = inside(spans, held.select("page_id", "scope", F.col("pre").alias("origin"), F.col("pre").alias("at")), axis.endswith("self"))
    elif axis == "following":
        first = held.groupBy("page_id", "scope").agg(F.min(F.col("pre") + F.col("size")).alias("end"))
        met = first.join(reach, "page_id").where("next > end").withColumn("origin", F.lit(None).cast("int"))
    else:
        last = held.groupBy("page_id", "scope").agg(F.max("pre").alias("start"))
        met = last.join(reach, "page_id").where("next + next_size < start").withColumn("origin", F.lit(None).cast("int"))
    return met.select("page_id", "scope", "origin", *reached)


def _beside(held: DataFrame, reach: DataFrame, after: bool, n: int, far: bool) -> DataFrame:
    """The n-th of the ``reach`` rows beside each ``held`` node, from the far end with
    ``far``: rows and nodes of a parent are counted through once, so a list of any length
    costs a sort."""
    nodes = held.select("page_id", "scope", F.col("pre").alias("origin"), F.col("parent").alias("next_parent"), F.col("pre").alias("at"))
    both = reach.withColumn("at", F.col("next")).unionByName(nodes, allowMissingColumns=True)
    is_row = F.col("next").isNotNull()
    beside = Window.partitionBy("page_id", "next_parent")
    # A row that is the node itself comes before it when what follows is asked for, else after.
    so_far = beside.orderBy("at", is_row.desc() if after else is_row.asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_n", F.count("next").over(so_far))
    if after and far:
        both = both.withColumn("_all", F.count("next").over(beside))
    turn = {(True, False): F.col("_n") + n, (True, True): F.col("_all") - n + 1 if after and far else None, (False, False): F.col("_n") - n + 1, (False, True): F.lit(n)}[after, far]
    asked = both.where(~is_row).withColumn("_turn", turn.cast("long")).where("_turn > _n" if after else "_turn > 0 and _turn <= _n")
    told = both.where(is_row).select("page_id", "next_parent", F.col("_n").alias("_turn"), "next", "next_size")
    return asked.select("page_id", "scope", "origin", "next_parent", "_turn").join(told, ["page_id", "next_parent", "_turn"])


def counts(pool: DataFrame, axis: str, tag: str, of: DataFrame | None = None) -> DataFrame:
    """(page_id, pre, n): how many children or descendants of a tag (``*``: any) the
    elements (those in ``of`` at least) have that have one."""
    some = pool if tag == "*" else pool.where(F.col("tag") == tag)
    if axis == "child":
        return some.groupBy("page_id", F.col("parent").alias("pre")).agg(F.count(F.lit(1)).alias("n"))
    spans = (pool if of is None else of).where("size > 0").select("page_id", "pre", F.col("pre").alias("lo"), (F.col("pre") + F.col("size")).alias("hi"))
    return inside(spans, some.select("page_id", F.col("pre").alias("at"))).groupBy("page_id", "pre").agg(F.count(F.lit(1)).alias("n"))
