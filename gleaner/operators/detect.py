"""Record detection: repeated sibling groups, scored, tested against the fields
asked for, and ranked, as grouped aggregates over the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.kinds import has_shape, looks_like_name
from ..functions.text import matches_token, trim
from ..sources.stage import staged


def signature(elems: DataFrame) -> DataFrame:
    """Groupable elements with ``sig``: tag, sorted classes and test id; without
    either only list and table items have one (``bare``)."""
    classes = F.array_join(F.array_sort(F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), lambda c: c != "")), ".")
    testid = F.coalesce(F.col("attrs")["data-testid"], F.lit(""))
    plain = (classes == "") & (testid == "")
    bare = plain & F.col("tag").isin("li", "tr", "dd", "option")
    out = elems.where(~F.col("tag").isin(C.IGNORED_TAGS) & (F.col("parent") > 0)).where(~plain | bare)
    return out.withColumn("sig", F.concat_ws("|", "tag", classes, testid)).withColumn("bare", bare)


def groups(elems: DataFrame, texts: DataFrame, max_group: int | None = C.MAX_GROUP) -> DataFrame:
    """(page_id, parent, sig, bare, n, score, members): sibling groups of 3 to
    ``max_group`` (None: any) with enough text and structure; members are in page
    order."""
    early = elems.select("page_id", F.col("pre").alias("parent"), F.row_number().over(Window.partitionBy("page_id").orderBy("pre")).alias("turn")).where(F.col("turn") <= C.MAX_PARENTS)
    rows = signature(elems).join(early.select("page_id", "parent"), ["page_id", "parent"], "left_semi").join(texts, ["page_id", "pre"], "left")
    n, text, below = F.count(F.lit(1)), F.avg(F.length(F.coalesce("vtext", F.lit("")))), F.avg("size")
    made = rows.groupBy("page_id", "parent", "sig", "bare").agg(n.alias("n"), text.alias("avg_text"), below.alias("avg_below"), F.array_sort(F.collect_list("pre")).alias("members"))
    made = made.where((F.col("n") >= C.MIN_SIBLINGS) & (F.col("avg_text") >= 15) & (F.col("avg_below") >= 2))
    if max_group is not None:
        made = made.where(F.col("n") <= max_group)
    return made.select("page_id", "parent", "sig", "bare", "n", (F.col("n") * F.log(F.col("avg_text") + 1) * F.log(F.col("avg_below") + 1)).alias("score"), "members")


def _any_shape(kind: Column, text: Column) -> Column:
    out = F.lit(False)
    for k in C.PATTERNS:
        out = out | ((kind == k) & has_shape(k, text))
    return out


def heading_names(heading: Column, text: Column) -> Column:
    """Whether a node's heading seems to be a name: name-like, or too short to tell while
    the node's text begins with a run of capitalised words; no question and no heading
    that any page has."""
    h = trim(heading)
    short = (F.length(h) <= 4) & F.substring(text, 1, 200).rlike(C.TITLE_RUN)
    return (h != "") & ~h.endswith("?") & ~F.lower(h).isin(C.GENERIC_HEADINGS) & (looks_like_name(h) | short)


def hit_rates(found: DataFrame, elems: DataFrame, texts: DataFrame, fields: DataFrame) -> DataFrame:
    """(page_id, parent, sig, hit, name_hit): over each group's first nodes the
    share that seems to hold a field, averaged over the best two fields, and the
    share that seems to hold a name.  ``fields``: name, kind, tokens (bounded by
    the field limit)."""
    sample = found.select("page_id", "parent", "sig", F.explode(F.slice("members", 1, C.SAMPLE)).alias("scope"))
    scopes = sample.select("page_id", "scope").distinct()
    inner = staged(elems.select("page_id", "pre", "tag", "words", F.explode("ancestors").alias("scope")).join(scopes, ["page_id", "scope"], "left_semi").join(texts, ["page_id", "pre"], "left"))
    fields = F.broadcast(fields.select("name", "kind", "tokens"))
    own = scopes.join(texts.select("page_id", F.col("pre").alias("scope"), F.col("vtext").alias("all")), ["page_id", "scope"], "left").withColumn("all", F.coalesce("all", F.lit("")))
    labelled = inner.join(fields.where("kind <> 'Name'"), matches_token(F.col("words"), F.col("tokens"))).select("page_id", "scope", "name").distinct().withColumn("labelled", F.lit(True))
    plain = own.join(fields.where("kind <> 'Name'")).join(labelled, ["page_id", "scope", "name"], "left")
    plain = plain.select("page_id", "scope", "name", "kind", F.coalesce("labelled", _any_shape(F.col("kind"), F.col("all"))).alias("hit"))
    headed = F.min_by(F.struct("vtext"), F.when(F.col("tag").isin(C.HEADINGS), F.col("pre")))["vtext"]
    titled = F.min_by(F.struct("vtext"), F.when(F.array_contains(F.split("words", " +"), "title"), F.col("pre")))["vtext"]
    named = own.join(inner.groupBy("page_id", "scope").agg(headed.alias("headed"), titled.alias("titled")), ["page_id", "scope"], "left")
    names = named.withColumn("hit", heading_names(F.coalesce("headed", "titled", F.lit("")), F.col("all"))).join(fields.where("kind = 'Name'")).select("page_id", "scope", "name", "kind", "hit")
    rates = sample.join(plain.union(names), ["page_id", "scope"]).groupBy("page_id", "parent", "sig", "name", "kind").agg(F.avg(F.col("hit").cast("double")).alias("rate"))
    best = F.slice(F.sort_array(F.collect_list("rate"), asc=False), 1, 2)
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)
    return rates.groupBy("page_id", "parent", "sig").agg(mean.alias("hit"), F.max(F.when(F.col("kind") == "Name", F.col("rate"))).alias("name_hit"))


def wrappers(found: DataFrame, elems: DataFrame) -> DataFrame:
    """The groups all of whose inner group's nodes lie inside their own nodes."""
    members = found.select("page_id", "parent", "sig", "n", F.explode("members").alias("pre"))
    above = members.join(elems.select("page_id", "pre", "ancestors"), ["page_id", "pre"]).select("page_id", F.col("parent").alias("ip"), F.col("sig").alias("is"), F.col("n").alias("inn"), "pre", F.explode("ancestors").alias("above"))
    inside = above.join(members.select("page_id", F.col("pre").alias("above"), "parent", "sig"), ["page_id", "above"])
    held = inside.groupBy("page_id", "parent", "sig", "ip", "is", "inn").agg(F.countDistinct("pre").alias("k"))
    return held.where("k = inn").select("page_id", "parent", "sig").distinct()


def detect(elems: DataFrame, texts: DataFrame, fields: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(page_id, rec_idx, pre): the record nodes of every page on which a group is
    accepted.  ``found``: staged ``groups``, if they are at hand."""
    found = staged(groups(elems, texts)) if found is None else found
    first = F.element_at("members", 1)
    if fields is None:
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), first))).where("rank = 1")
        return _numbered(best)
    has_name = not fields.where("kind = 'Name'").isEmpty()
    scored = found.join(hit_rates(found, elems, texts, fields), ["page_id", "parent", "sig"])
    scored = staged(scored.withColumn("fits", F.col("hit") > F.when(F.col("bare"), 0.65).otherwise(0.4)))
    qualified = scored.where("fits")
    outer = wrappers(qualified, elems)
    # Where wrapping leaves a page no group, all its scored groups stand again.
    left = qualified.join(outer, ["page_id", "parent", "sig"], "left_anti")
    pool = left.union(scored.join(left.select("page_id").distinct(), "page_id", "left_anti"))
    merged = pool.groupBy("page_id", "sig").agg(
        F.sum("score").alias("score"), F.avg("hit").alias("hit"), F.min_by("name_hit", first).alias("name_hit"), F.min_by("bare", first).alias("bare"), F.array_sort(F.flatten(F.collect_list("members"))).alias("members")
    )
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc(F.col("score") * (0.5 + F.col("hit"))), first))
    best = merged.withColumn("rank", rank).where("rank = 1").where(F.col("hit") > F.when(F.col("bare"), 0.65).otherwise(0.4))
    if has_name:
        best = best.where(F.coalesce("name_hit", F.lit(0.0)) >= 0.5)
    return _numbered(best)


def _numbered(best: DataFrame) -> DataFrame:
    return best.select("page_id", F.posexplode("members").alias("rec_idx", "pre"))


def with_whole_pages(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Records, and the document as the one record of every page without any:
    adds is_document and n_recs."""
    whole = pages.select(F.col("page_id").cast("long")).join(records.select("page_id").distinct(), "page_id", "left_anti").select("page_id", F.lit(0).alias("rec_idx"), F.lit(0).alias("pre"), F.lit(True).alias("is_document"))
    return _counted(records.withColumn("is_document", F.lit(False)).union(whole))


def numbered(records: DataFrame) -> DataFrame:
    """Records alone: adds is_document and n_recs."""
    return _counted(records.withColumn("is_document", F.lit(False)))


def _counted(records: DataFrame) -> DataFrame:
    return records.withColumn("n_recs", F.count(F.lit(1)).over(Window.partitionBy("page_id")))
