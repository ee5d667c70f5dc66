"""Extraction strategies: each turns records and fields into candidate rows
(page_id, rec_idx, ord, strategy, sub, value, confidence); ``sub`` orders the ways
within a strategy, of which the first that gives a value counts."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import kinds as K
from ..functions import leaves as L
from ..functions import text as T
from ..functions import urls as U
from ..sources.stage import staged
from . import dom

KEY = ["page_id", "rec_idx", "ord"]


@dataclass
class Scene:
    """What strategies see: ``records`` (page_id, rec_idx, pre, is_document,
    n_recs), ``fields`` (ord, name, kind, tokens and selector columns; at most
    ``MAX_FIELDS`` rows), and the page tables."""

    records: DataFrame
    fields: DataFrame
    nodes: DataFrame
    elems: DataFrame
    texts: DataFrame
    entities: DataFrame
    kinds: frozenset = frozenset()
    names: frozenset = frozenset()
    pages: DataFrame | None = None
    whole: bool = False  # whether every page is one record, its document

    def asked(self, *kinds: str, but: bool = False) -> DataFrame:
        """Records times fields of the given kinds (or all others)."""
        f = self.fields
        if kinds:
            f = f.where(~F.col("kind").isin(*kinds) if but else F.col("kind").isin(*kinds))
        return self.records.join(F.broadcast(f.select("ord", "name", "kind", "tokens")))

    def inner(self) -> DataFrame:
        """Elements inside each record, with their text; where names alone are asked for,
        without attributes."""
        told = [] if self.kinds == {"Name"} else ["attrs", "words"]
        e = self.elems.select("page_id", F.col("pre").alias("at"), "parent", "tag", *told, "next_pre", F.lit(0).alias("rec_idx") if self.whole else F.explode("ancestors").alias("pre"))
        if not self.whole:
            e = e.join(self.records.select("page_id", "rec_idx", "pre"), ["page_id", "pre"]).drop("pre")
        return e.join(self.texts.select("page_id", F.col("pre").alias("at"), "vtext"), ["page_id", "at"], "left").withColumn("vtext", F.coalesce("vtext", F.lit("")))

    def own(self) -> DataFrame:
        """(page_id, pre, vtext): texts among which are those of all records."""
        return self.texts.where("pre = 0") if self.whole else self.texts


def _candidates(rows: DataFrame, strategy: str, sub: int, value: Column, confidence: int | Column) -> DataFrame:
    confidence = F.lit(confidence) if isinstance(confidence, int) else confidence
    out = rows.select(*KEY, F.lit(strategy).alias("strategy"), F.lit(sub).alias("sub"), value.alias("value"), confidence.cast("int").alias("confidence"))
    return out.where(~T.is_blank(F.col("value")))


def by_selector(scene: Scene, fields: list) -> DataFrame | None:
    """The first match of each field's own selector (99)."""
    out = None
    for f in fields:
        if not f.selector:
            continue
        hits = dom.select(scene.elems, f.selector, f.selector_type, scene.records, scene.texts)
        first = staged(hits.groupBy("page_id", F.col("scope").alias("pre")).agg(F.min(F.col("pre")).alias("hit")))
        at = scene.elems.join(first.select("page_id", F.col("hit").alias("pre")).distinct(), ["page_id", "pre"], "left_semi")
        value = dom.extracted(at, scene.texts, f.extraction_type, f.attribute, scene.nodes, scene.pages).select("page_id", F.col("pre").alias("hit"), "value")
        rows = scene.asked().where(F.col("ord") == f.ord).join(first, ["page_id", "pre"]).join(value, ["page_id", "hit"])
        one = _candidates(rows, "Selector", 0, F.col("value"), 99)
        out = one if out is None else out.union(one)
    return out


def matched_entities(records: DataFrame, entities: DataFrame) -> DataFrame:
    """(page_id, rec_idx, leaves, type, ent): the entity of each record.  One
    record takes the content entity with most keys; equal counts pair by place;
    a single entity serves all; otherwise none.  Navigation types never match."""
    content = entities.where(~F.coalesce("type", F.lit("")).isin(C.NON_CONTENT_TYPES))
    counts = entities.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_ents"))
    r = records.select("page_id", "rec_idx", "n_recs").join(counts, "page_id")
    richest = content.groupBy("page_id").agg(F.max_by(F.struct("ent", "type", "leaves"), F.struct("n_keys", (-F.col("ent")).alias("first"))).alias("e"))
    single = r.where("n_recs = 1").join(richest, "page_id").select("page_id", "rec_idx", "e.*")
    paired = r.where("n_recs > 1 and (n_recs = n_ents or n_ents = 1)").withColumn("ent", F.when(F.col("n_recs") == F.col("n_ents"), F.col("rec_idx")).otherwise(0))
    paired = paired.join(content.select("page_id", "ent", "type", "leaves"), ["page_id", "ent"]).select("page_id", "rec_idx", "ent", "type", "leaves")
    return single.union(paired)


def clinics(scene: Scene) -> DataFrame:
    """(page_id, pairs): headings of at most 150 characters whose next sibling
    ends in a postcode, in page order, with that sibling's text."""
    heads = scene.elems.where(F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6")).select("page_id", "pre", F.col("next_pre").alias("to"))
    t = scene.texts
    named = heads.join(t, ["page_id", "pre"]).select("page_id", "pre", F.col("vtext").alias("name"), "to").join(t.select("page_id", F.col("pre").alias("to"), F.col("vtext").alias("beside")), ["page_id", "to"])
    named = named.where((F.length("name") <= 150) & (F.col("name") != "") & (F.length("beside") <= 200) & F.col("beside").rlike(C.POSTCODE_END))
    return named.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pre", "name", "beside"))).alias("pairs"))


def enriched(value: Column, pairs: Column) -> Column:
    """Addresses joined by "; " with their clinic's name in front: paired by
    place where the counts agree, else by the postcode."""
    parts = F.filter(F.transform(F.split(value, ";"), T.trim), lambda p: p != "")

    def named(p: Column, i: Column) -> Column:
        code = F.regexp_extract(p, C.POSTCODE_END, 0)
        by_code = F.try_element_at(F.filter(pairs, lambda x: (code != "") & F.upper(x["beside"]).contains(F.upper(code))), F.lit(1))["name"]
        name = F.when(F.size(pairs) == F.size(parts), F.try_element_at(pairs, i + 1)["name"]).otherwise(by_code)
        return F.when(name.isNull() | F.lower(p).contains(F.lower(name)), p).otherwise(F.concat(name, F.lit(", "), p))

    return F.when(pairs.isNull() | (F.size(pairs) == 0), value).otherwise(F.array_join(F.transform(parts, named), "; "))


def by_structured_data(scene: Scene) -> DataFrame:
    """Facilities (90), the kind's paths (90), the role's paths (85), a property
    named like the field (75), other entities of a single record (80)."""
    leaves = F.col("leaves")
    rows = scene.asked().join(matched_entities(scene.records, scene.entities), ["page_id", "rec_idx"])
    others = scene.asked().where("n_recs = 1").join(scene.entities.where(~F.coalesce("type", F.lit("")).isin(C.NON_CONTENT_TYPES)), "page_id")
    out = []

    def first(paths: list[str]) -> Column:
        texts = [F.coalesce(L.list_text(leaves, p), L.text_of(leaves, p)) if p == "address" else L.text_of(leaves, p) for p in paths]
        return T.clean_text(F.coalesce(*(F.when(~T.is_blank(t), t) for t in texts)))

    if "Location" in scene.kinds:
        place = F.concat_ws(", ", leaves["name"], L.text_of(leaves, "address"))
        sites = scene.entities.where(F.col("type").isin(C.FACILITY_TYPES)).where(leaves["name"].isNotNull() & L.text_of(leaves, "address").isNotNull())
        sites = sites.groupBy("page_id").agg(F.array_join(F.slice(F.array_distinct(F.array_sort(F.collect_list(F.struct("ent", place.alias("p"))))["p"]), 1, 10), "; ").alias("value"))
        out.append(_candidates(scene.asked("Location").where("n_recs = 1").join(sites, "page_id"), "StructuredData", 0, F.col("value"), 90))
        found = rows.where("kind = 'Location'").withColumn("v", L.without_repeats(first(C.PATHS["Location"]))).join(clinics(scene), "page_id", "left")
        out.append(_candidates(found, "StructuredData", 1, enriched(F.col("v"), F.col("pairs")), 90))
    for kind, paths in C.PATHS.items():
        if kind in scene.kinds and kind != "Location":
            out.append(_candidates(rows.where(F.col("kind") == kind), "StructuredData", 1, first(paths), 90))
        if kind in scene.kinds and kind != "Name":
            out.append(_first(others.where(F.col("kind") == kind), first(paths), F.col("ent"), "StructuredData", 4, 80))
    for name, paths in C.ROLE_PATHS.items():
        if name in scene.names:
            out.append(_candidates(rows.where(F.lower(T.trim(F.col("name"))) == name), "StructuredData", 2, first(paths), 85))
    key = F.lower(T.trim(F.col("name")))
    direct = F.coalesce(*(F.try_element_at(leaves, F.concat(k, F.lit("!"))) for k in (key, F.replace(key, F.lit(" "), F.lit("")))))
    out.append(_candidates(rows, "StructuredData", 3, T.clean_text(direct), 75))
    return _union(out)


def _first(rows: DataFrame, value: Column, order: Column, strategy: str, sub: int, confidence: int) -> DataFrame:
    """The first non-blank value per record and field, by ``order``."""
    held = rows.select(*KEY, value.alias("value"), order.alias("_o")).where(~T.is_blank(F.col("value")))
    return _candidates(held.groupBy(*KEY).agg(F.min_by("value", "_o").alias("value")), strategy, sub, F.col("value"), confidence)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def by_state(scene: Scene, state: DataFrame) -> DataFrame:
    """Email and Phone of a single record from the page's application state (85).
    ``state``: (page_id, told)."""
    rows = scene.asked("Email", "Phone").where("n_recs = 1").join(state, "page_id")
    value = F.when(F.col("kind") == "Email", L.search(F.col("told"), C.STATE_KEYS["Email"])).otherwise(L.search(F.col("told"), C.STATE_KEYS["Phone"]))
    return _candidates(rows, "NextData", 0, value, 85)


def _cookie(text: Column) -> Column:
    return text.rlike(C.COOKIE_HEADING) | F.lower(text).isin(C.COOKIE_CATEGORIES)


def by_semantics(scene: Scene) -> DataFrame:
    """Headings, labelled elements, definition lists, heading labels, label lines,
    links and subtitles."""
    inner = staged(scene.inner())
    fields = F.broadcast(scene.fields.select("ord", "name", "kind", "tokens"))
    out = []

    def ask(rows: DataFrame, *kinds: str, but: bool = False) -> DataFrame:
        f = F.col("kind").isin(*kinds) if kinds else F.lit(True)
        return rows.join(fields.where(~f if but else f))

    if "Name" in scene.kinds:
        _names(inner, ask, out)
    _labels(scene, inner, ask, out)
    _beside(scene, inner, ask, fields, out)
    return _union(out)


def _names(inner: DataFrame, ask, out: list) -> None:
    text, tag, at = F.col("vtext"), F.col("tag"), F.col("at")
    # The first heading that is no question or cookie banner; failing that, name-like text.
    heads = inner.where(tag.isin(C.HEADINGS) & ~_cookie(T.trim(text)) & ~F.rtrim(text).endswith("?"))
    head = heads.groupBy("page_id", "rec_idx").agg(F.min_by("vtext", "at").alias("vtext"))
    out.append(_candidates(ask(head.where(~T.is_blank(text) & ~text.rlike(C.INITIALS)), "Name"), "SemanticHtml", 0, text, 85))
    like = ask(inner.where(~tag.isin(C.HEADINGS) & F.length(text).between(1, 200) & text.rlike(C.NAME_PREFIX)), "Name")
    out.append(_first(like, T.trim(F.regexp_extract("vtext", C.NAME_PREFIX, 1)), at, "SemanticHtml", 1, 75))
    out.append(_first(ask(inner.where((tag == "a") & F.length(text).between(3, 150)), "Name"), text, at, "SemanticHtml", 6, 55))


def _labels(scene: Scene, inner: DataFrame, ask, out: list) -> None:
    text, at = F.col("vtext"), F.col("at")
    if scene.kinds == {"Name"}:
        return
    # Labelled elements; a leaf has no labelled element inside.
    labelled = ask(inner, "Name", but=True).where(T.matches_token(F.col("words"), F.col("tokens")))
    above = labelled.select("page_id", "rec_idx", "ord", F.col("at").alias("below")).join(scene.elems.select("page_id", F.col("pre").alias("below"), F.explode("ancestors").alias("at")), ["page_id", "below"])
    leaves = labelled.join(above.select("page_id", "rec_idx", "ord", "at").distinct(), ["page_id", "rec_idx", "ord", "at"], "left_anti")

    def joined(rows: DataFrame, value: Column, longest: Column, most: int | None) -> DataFrame:
        rows = rows.select(*KEY, "at", value.alias("v"), longest.alias("longest")).where(F.length("v") <= F.col("longest"))
        held = F.array_distinct(F.array_sort(F.collect_list(F.struct("at", "v")))["v"])
        rows = rows.groupBy(*KEY).agg(held.alias("held"), F.first("longest").alias("longest"))
        whole = F.array_join(F.slice("held", 1, most) if most else F.col("held"), "; ")
        # Several values count only if together they are not too long either.
        return rows.withColumn("value", F.when((F.size("held") == 1) | F.lit(most is None) | (F.length(whole) <= F.col("longest")), whole))

    long_ = leaves.where(F.col("kind").isin("Biography", "Text"))
    if scene.kinds & {"Biography", "Text"}:
        _paragraphs(scene, long_, joined, out)
    if "Currency" in scene.kinds:
        out.append(_candidates(joined(leaves.where((F.col("kind") == "Currency") & (text != "")), text, F.lit(200), None), "SemanticHtml", 2, F.col("value"), 80))
    if scene.kinds - {"Biography", "Text", "Currency", "Name"}:
        short = labelled.where(~F.col("kind").isin("Biography", "Text", "Currency")).where(F.length(text).between(1, 200)).where((F.col("kind") != "Location") | ~K.has_shape("Phone", text))
        value = F.when(F.col("kind") == "Url", F.coalesce(F.col("attrs")["href"], text)).otherwise(text)
        out.append(_first(short, value, F.struct(F.length(text), at), "SemanticHtml", 2, 80))


def _paragraphs(scene: Scene, long_: DataFrame, joined, out: list) -> None:
    paragraphs = dom.paragraph_text(scene.elems, scene.texts, long_.select("page_id", F.col("at").alias("pre")))
    long_ = long_.join(paragraphs.withColumnRenamed("pre", "at"), ["page_id", "at"])
    tidy = T.without_number_lines(F.col("ptext"))
    out.append(_candidates(joined(long_.where(F.length(tidy) >= 2), tidy, F.when(F.col("kind") == "Biography", 8000).otherwise(3000), 20), "SemanticHtml", 2, F.col("value"), 80))


def _beside(scene: Scene, inner: DataFrame, ask, fields: DataFrame, out: list) -> None:
    text, tag = F.col("vtext"), F.col("tag")
    # Definition lists, then headings that are the label themselves.
    marks = ask(inner.where(tag.isin("dt", "strong", "b", *C.HEADINGS)))
    marks = marks.where(T.matches_token(F.lower(T.trim(text)), F.col("tokens"))).select(*KEY, "at", "tag", "parent", "next_pre", "kind")
    # Staged, so that where marks are few they are sent to the page tables and those stay where they are.
    marks = staged(marks)
    nexts = scene.elems.select("page_id", F.col("pre").alias("to"), F.col("tag").alias("to_tag"))
    terms = marks.where(tag == "dt").groupBy(*KEY).agg(F.min_by("next_pre", "at").alias("to")).join(nexts, ["page_id", "to"]).where("to_tag = 'dd'").select(*KEY, "to")
    terms = staged(terms)
    t = scene.texts.select("page_id", F.col("pre").alias("to"), F.col("vtext").alias("value"))
    out.append(_candidates(terms.join(t, ["page_id", "to"]), "SemanticHtml", 3, F.col("value"), 82))
    label = marks.groupBy(*KEY).agg(F.min_by(F.struct("next_pre", "parent", "kind"), "at").alias("m")).select(*KEY, "m.*")
    above = scene.elems.select("page_id", F.col("pre").alias("parent"), F.col("next_pre").alias("over"))
    over = above.join(marks.select("page_id", "parent"), ["page_id", "parent"], "left_semi")
    spots = label.join(over, ["page_id", "parent"], "left").select(*KEY, "kind", F.posexplode(F.array("next_pre", "over")).alias("turn", "to")).where("to is not null")
    spots = staged(spots)
    told = dom.paragraph_text(scene.elems, scene.texts, spots.select("page_id", F.col("to").alias("pre"))).select("page_id", F.col("pre").alias("to"), "ptext")
    most = F.when(F.col("kind") == "Biography", 8000).when(F.col("kind") == "Text", 3000).otherwise(200)
    spots = spots.join(told, ["page_id", "to"]).where(F.length("ptext").between(1, most))
    out.append(_first(spots, F.col("ptext"), F.col("turn"), "SemanticHtml", 4, 78))

    # "Label: value" lines of the record's text.
    lines = scene.asked().join(scene.own(), ["page_id", "pre"]).select(*KEY, "tokens", F.posexplode(F.split("vtext", "\n")).alias("turn", "line"))
    lines = lines.withColumn("line", T.trim(F.col("line"))).where(F.col("line").rlike(C.LABEL_LINE)).where(T.matches_token(F.lower(F.regexp_extract("line", C.LABEL_LINE, 1)), F.col("tokens")))
    out.append(_first(lines, T.trim(F.regexp_extract("line", C.LABEL_LINE, 2)), F.col("turn"), "SemanticHtml", 5, 65))

    # A role: the line under the first heading, unless it is an address.
    if scene.names & set(C.ROLE_PATHS):
        roles = fields.where(F.lower(F.trim("name")).isin(*C.ROLE_PATHS))
        under = inner.where(tag.isin(C.HEADINGS) & ~_cookie(T.trim(text))).groupBy("page_id", "rec_idx").agg(F.min_by(F.struct("next_pre", "parent"), "at").alias("m")).select("page_id", "rec_idx", "m.*")
        under = under.join(above, ["page_id", "parent"], "left").select("page_id", "rec_idx", F.coalesce("next_pre", "over").alias("to")).join(t, ["page_id", "to"]).join(roles)
        v = F.col("value")
        out.append(_candidates(under.where((F.length(v) <= 200) & ~K.has_shape("Location", v)), "SemanticHtml", 7, v, 55))


def by_patterns(scene: Scene) -> DataFrame | None:
    """mailto and tel links (88), value shapes in the text (65, numbers 55), phone
    numbers in scripts (55)."""
    out = []
    if scene.kinds & {"Email", "Phone"}:
        out.append(_schemes(scene))
    if "Phone" in scene.kinds:
        out.append(_candidates(nearest_phone(scene), "Pattern", 2, F.col("value"), 55))
    if kinds := [k for k in C.PATTERNS if k in scene.kinds]:
        out.append(_shapes(scene, kinds))
    return _union(out) if out else None


def _schemes(scene: Scene) -> DataFrame:
    inner = scene.elems.where("tag = 'a'").select("page_id", F.col("pre").alias("at"), F.col("attrs")["href"].alias("href"), F.explode("ancestors").alias("pre"))
    links = inner.join(scene.asked("Email", "Phone"), ["page_id", "pre"])
    scheme = F.when(F.col("kind") == "Email", "mailto:").otherwise("tel:")
    links = links.where(F.lower("href").startswith(scheme)).groupBy(*KEY, "kind").agg(F.min_by("href", "at").alias("href"))
    value = F.when(F.col("kind") == "Email", U.scheme_value(F.col("href"), "mailto:")).otherwise(U.scheme_value(F.col("href"), "tel:"))
    return _candidates(links, "Pattern", 0, value, 88)


def _shapes(scene: Scene, kinds: list[str]) -> DataFrame:
    told = scene.asked(*kinds).join(dom.main_text(scene.nodes, scene.records), ["page_id", "pre"]).withColumn("mtext", K.scannable(F.col("mtext")))
    found = F.coalesce(*(F.when(F.col("kind") == k, K.every_match(k, F.col("mtext")) if k in ("Location", "Currency") else K.first_match(k, F.col("mtext"))) for k in kinds))
    told = told.withColumn("value", found)
    confidence = F.when(F.col("kind") == "Number", 55).otherwise(65)
    if "Location" not in kinds:
        return _candidates(told, "Pattern", 1, F.col("value"), confidence)
    marks = scene.elems.where(F.exists(F.array(*map(F.lit, C.CLINIC_MARKERS)), lambda m: F.col("words").contains(m))).select("page_id", F.col("pre").alias("at"), F.explode("ancestors").alias("pre"))
    marks = marks.join(scene.texts.select("page_id", F.col("pre").alias("at"), F.trim("vtext").alias("clinic")), ["page_id", "at"]).groupBy("page_id", "pre").agg(F.min_by("clinic", "at").alias("clinic")).where(F.length("clinic").between(1, 150))
    told = told.join(marks, ["page_id", "pre"], "left")
    prefixed = F.array_join(F.transform(F.split("value", "; "), lambda a: F.when(F.lower(a).contains(F.lower("clinic")), a).otherwise(F.concat("clinic", F.lit(", "), a))), "; ")
    value = F.when((F.col("kind") == "Location") & F.col("clinic").isNotNull(), prefixed).otherwise(F.col("value"))
    return _candidates(told, "Pattern", 1, value, confidence)


def nearest_phone(scene: Scene) -> DataFrame:
    """The quoted international number in a record's scripts that stands nearest to the
    page's postal code, else the first; of the first script that has any."""
    scripts = scene.nodes.where("kind = 'text' and parent_tag = 'script'").select("page_id", F.col("pre").alias("at"), "text", F.explode("ancestors").alias("pre")).where(F.col("text").rlike(C.QUOTED_PHONE))
    scripts = scripts.join(scene.asked("Phone"), ["page_id", "pre"]).groupBy(*KEY).agg(F.min_by("text", "at").alias("text"))
    postal = scene.entities.where(F.col("leaves")["address{}"].isNotNull() & (F.col("leaves")["address.postalcode"] != "")).groupBy("page_id").agg(F.min_by(F.col("leaves")["address.postalcode"], "ent").alias("postal"))
    rows = scripts.join(postal, "page_id", "left")
    gaps, hits = F.split("text", C.QUOTED_PHONE, -1), F.regexp_extract_all("text", F.lit(C.QUOTED_PHONE), F.lit(0))
    spot = F.instr(F.lower("text"), F.lower("postal")) - 1
    starts = F.transform(hits, lambda h, i: F.struct((F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice(hits, 1, i), F.lit(0), lambda a, g: a + F.length(g))).alias("at"), h.alias("v")))
    ranked = F.array_sort(F.transform(starts, lambda s: F.struct(F.when(spot >= 0, F.abs(s["at"] - spot)).otherwise(0).alias("far"), s["at"].alias("at"), s["v"].alias("v"))))
    return rows.select(*KEY, T.international_phone(F.replace(ranked[0]["v"], F.lit('"'), F.lit(""))).alias("value"))


def by_hook(scene: Scene, provider) -> DataFrame:
    """A user's provider (60): ``provider(DataFrame of page_id, rec_idx, text, names)``
    -> DataFrame (page_id, rec_idx, name, value)."""
    names = [r.name for r in scene.fields.select("name").collect()]
    asked = scene.records.join(scene.own(), ["page_id", "pre"], "left").select("page_id", "rec_idx", F.coalesce("vtext", F.lit("")).alias("text"), F.array(*map(F.lit, names)).alias("names"))
    rows = provider(asked).join(F.broadcast(scene.fields.select("ord", "name")), "name")
    return _candidates(rows, "Ai", 0, F.col("value"), 60)


def batched(make, batch_rows: int = 64):
    """A provider for ``by_hook`` from a model that works on batches.

    ``make()`` is called once a partition, where the model runs, and returns a function
    (texts, names) -> a dict or None a text, of the same length.  A batch that fails is
    tried again text by text, so that only the texts that fail stay without a value; names
    that were not asked for, and values that are not text, are left."""

    def provider(asked: DataFrame) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            ask = None
            for batch in batches:
                for i in range(0, batch.num_rows, batch_rows):
                    part = batch.slice(i, batch_rows)
                    ask = ask or make()
                    texts, names = part.column(2).to_pylist(), part.column(3)[0].as_py()
                    out = []
                    for keys, told in zip(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True), _told(ask, texts, names), strict=True):
                        out += [(*keys, n, told[n]) for n in names if isinstance(told.get(n), str)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["page_id", "rec_idx", "name", "value"])

        rows = asked.select(F.col("page_id").cast("long"), F.col("rec_idx").cast("int"), "text", "names")
        return rows.mapInArrow(run, "page_id long, rec_idx int, name string, value string")

    return provider


def _told(ask, texts: list[str], names: list[str]) -> list[dict]:
    try:
        told = list(ask(texts, names))
        if len(told) != len(texts):
            raise ValueError("a provider answers once a text")
        return [t or {} for t in told]
    except Exception as e:
        if len(texts) == 1:
            warnings.warn(f"a provider failed: {e}", stacklevel=2)
            return [{}]
        return [t for text in texts for t in _told(ask, [text], names)]


def by_extra(name: str, rows: DataFrame) -> DataFrame:
    """A registered strategy's rows (page_id, rec_idx, ord, value, confidence)."""
    return _candidates(rows, name, 0, F.col("value"), F.col("confidence"))


def first_way(candidates: DataFrame) -> DataFrame:
    """One candidate per record, field and strategy: its first way."""
    return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY, "strategy").orderBy("sub"))).where("_r = 1").drop("_r")
