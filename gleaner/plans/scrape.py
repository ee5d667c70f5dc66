"""The extraction plan: pages and field definitions in, typed records out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import kinds as K
from ..functions import urls as U
from ..operators import detect, dom, links, merge, resolve, strategies
from ..sources import shred
from ..sources.stage import staged


@dataclass(frozen=True)
class Field:
    """A field to extract.  ``kind`` is inferred from the name unless given; the kind
    Auto is untyped text."""

    name: str
    kind: str | None = None
    required: bool = False
    selector: str | None = None
    selector_type: str = "Css"
    extraction_type: str = "Text"
    attribute: str | None = None
    ord: int = 0


@dataclass
class Result:
    """``results``: long form, one row per page, record and field; the page tables
    that led there come along.  ``found``: (page_id, found) records before the cap."""

    results: DataFrame
    records: DataFrame
    scene: strategies.Scene
    names: list[str] = field(default_factory=list)
    found: DataFrame | None = None
    notes: DataFrame | None = None

    def wide(self) -> DataFrame:
        return resolve.wide(self.results, self.names)

    def warnings(self) -> DataFrame:
        """(page_id, name): required fields that some record lacks."""
        return resolve.required_warnings(self.results)

    def notices(self) -> DataFrame:
        """(page_id, warning): selectors without a match, records left out, required
        fields missing."""
        lacking = self.warnings().select("page_id", _lacks("name").alias("warning"))
        return lacking.union(self.notes)


def validated(fields: list[Field]) -> list[Field]:
    """Fields in order, or ValueError."""
    names = [f.name.strip().lower() for f in fields]
    if not 1 <= len(fields) <= C.MAX_FIELDS:
        raise ValueError(f"1 to {C.MAX_FIELDS} fields")
    if len(set(names)) < len(names) or not all(names):
        raise ValueError("field names must be unique and not blank")
    for f in fields:
        if len(f.name) > 100 or len(f.selector or "") > 500:
            raise ValueError(f"{f.name[:20]}: name or selector too long")
        if f.selector and f.extraction_type == "Attribute" and not f.attribute:
            raise ValueError(f"{f.name}: an attribute is needed")
    return [Field(**{**f.__dict__, "ord": i}) for i, f in enumerate(fields)]


def validated_request(url: str, fields: list[Field], max_records: int = 200, max_pages: int = 1, max_profiles: int = 50, timeout_s: int = 20) -> list[Field]:
    """The fields of a scrape request in order, or ValueError: URL length and the
    ranges of its numbers."""
    if not url.strip() or len(url) > C.MAX_URL:
        raise ValueError(f"a URL of at most {C.MAX_URL} characters")
    in_range(max_records=max_records, max_pages=max_pages, max_profiles=max_profiles, timeout_s=timeout_s)
    return validated(fields)


def in_range(**numbers: int | None) -> None:
    """ValueError for a number of a request that is out of its range; None is left."""
    most = {"max_records": C.MAX_RECORDS, "max_pages": C.MAX_PAGES, "max_profiles": C.MAX_PROFILES, "timeout_s": 30}
    for name, value in numbers.items():
        if value is not None and not 1 <= value <= most[name]:
            raise ValueError(f"{name}: 1 to {most[name]}")


def validated_export(field_names: list[str], df: DataFrame | None = None) -> list[str]:
    """The field names of an export in order, or ValueError: there is one at least,
    and with ``df`` it has a column for each."""
    if not field_names:
        raise ValueError("an export needs field names")
    if df is not None and (lacking := [n for n in field_names if n not in df.columns]):
        raise ValueError(f"no such field: {lacking[0]}")
    return list(field_names)


def fields_table(spark: SparkSession, fields: list[Field]) -> DataFrame:
    """Fields as rows, kinds inferred, with their label tokens."""
    import pyarrow as pa

    # From Arrow, so that these few rows stand in the plan and no task reads them.
    ords, names = pa.array([f.ord for f in fields], pa.int32()), pa.array([f.name for f in fields], pa.string())
    named = spark.createDataFrame(pa.table({"ord": ords, "name": names, "kind": pa.array([f.kind for f in fields], pa.string())}))
    kinds = {r.ord: r.kind for r in named.select("ord", F.coalesce("kind", K.infer_kind(F.col("name"))).alias("kind")).collect()}
    held = [kinds[f.ord] for f in fields]
    tokens = [K.tokens_of(f.name, k) for f, k in zip(fields, held, strict=True)]
    return spark.createDataFrame(pa.table({"ord": ords, "name": names, "kind": pa.array(held, pa.string()), "required": pa.array([f.required for f in fields], pa.bool_()), "tokens": pa.array(tokens, pa.list_(pa.string()))}))


def one_row_a_page(pages: DataFrame) -> DataFrame:
    """``pages`` with one row a page_id.  Only ids are looked at, and only pages that
    repeat are moved."""
    again = staged(pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page_id"))
    if again.isEmpty():
        return pages
    one = pages.join(again, "page_id", "left_semi").groupBy("page_id").agg(F.min(F.struct("url", "html")).alias("p")).select("page_id", "p.url", "p.html")
    return pages.join(again, "page_id", "left_anti").select("page_id", "url", "html").unionByName(one)


def scrape(
    pages: DataFrame, fields: list[Field], record_selector: str | None = None, max_records: int | None = 200, whole_page: bool = False, provider=None, collapse: bool = True,
    selector_type: str = "Css", majority: bool = True, extra: dict | None = None, max_group: int | None = C.MAX_GROUP,
) -> Result:
    """Shred, find records, run every strategy and choose values.

    ``pages``: page_id, url, html; of rows that repeat a page_id the one of smallest url
    (then html) counts.  Records come from ``record_selector`` (a page
    without a match has none, and a notice), else detection, else the whole page;
    ``whole_page`` forces the last (profiles).  ``max_records`` a page, None for all.
    ``majority`` drops records of another entity type than most.  ``extra``: name ->
    strategy (a function of the scene that returns candidate rows), tried after the
    others in this order.  ``max_group``: siblings beyond which a group is not taken for
    records (None: any number); a notice names pages that have such a group."""
    spark = pages.sparkSession
    fields = validated(fields)
    in_range(max_records=max_records)
    large = None
    pages = one_row_a_page(pages)
    table = fields_table(spark, fields)
    nodes = staged(shred.shred(pages))
    elems = staged(dom.elements(nodes))
    texts = staged(dom.visible_text(nodes))
    entities = staged(shred.entities(nodes))
    if whole_page:
        found = elems.select("page_id", F.lit(0).alias("rec_idx"), "pre").where("false")
    elif record_selector:
        hits = dom.select(elems, record_selector, selector_type, texts=texts)
        found = hits.groupBy("page_id").agg(F.array_sort(F.collect_list("pre")).alias("m")).select("page_id", F.posexplode("m").alias("rec_idx", "pre"))
    else:
        made = staged(detect.groups(elems, texts, None))
        small = made if max_group is None else made.where(F.col("n") <= max_group)
        large = None if max_group is None else made.where(F.col("n") > max_group).groupBy("page_id").agg(F.max("n").alias("n"))
        found = detect.detect(elems, texts, table, small)
    found = staged(found)
    counts = found.groupBy("page_id").agg(F.count(F.lit(1)).alias("found"))
    most = C.MAX_RECORDS if max_records is None else min(max_records, C.MAX_RECORDS)
    kept = found if max_records is None else found.where(F.col("rec_idx") < most)
    if majority and not whole_page:
        kept = _of_majority(kept, elems, texts, entities, pages)
    records = staged(detect.with_whole_pages(kept, pages) if not record_selector or whole_page else detect.numbered(kept))
    scene = strategies.Scene(records, table, nodes, elems, texts, entities, frozenset(r.kind for r in table.collect()), frozenset(f.name.strip().lower() for f in fields), pages, whole_page)
    results = staged(_extract(scene, fields, provider, extra or {}))
    if collapse and not whole_page and not record_selector:
        flat = staged(merge.degenerate_pages(results))
        again = pages.join(flat, pages["page_id"].cast("long") == flat["page_id"], "left_semi")
        if not flat.isEmpty():
            redone = scrape(again, fields, whole_page=True, provider=provider, extra=extra)
            results = results.join(flat, "page_id", "left_anti").unionByName(redone.results)
            records = records.join(flat, "page_id", "left_anti").unionByName(redone.records)
            counts = counts.join(flat, "page_id", "left_anti")
    notes = counts.where(F.col("found") > most).select("page_id", _over(most).alias("warning")) if max_records is not None else counts.select("page_id", F.lit("").alias("warning")).where("false")
    if record_selector and not whole_page:
        missed = pages.select(F.col("page_id").cast("long")).join(counts, "page_id", "left_anti")
        notes = notes.union(missed.select("page_id", F.lit(C.NO_MATCH).alias("warning")))
        none = counts.join(records.select("page_id").distinct(), "page_id", "left_anti")
        notes = notes.union(none.select("page_id", F.lit(C.NO_RECORDS).alias("warning")))
    if large is not None:
        told = F.format_string(f"%d repeated elements are more than the {max_group} that may be records.", F.col("n"))
        notes = notes.union(large.select("page_id", told.alias("warning")))
    return Result(results, records, scene, [f.name for f in fields], counts, notes)


def by_selectors(pages: DataFrame, fields: list[Field], record_selector: str | None = None, max_records: int = 200, selector_type: str = "Css") -> tuple[DataFrame, DataFrame]:
    """(values, warnings) by the fields' own selectors alone.  values: (page_id, rec_idx,
    ord, name, value, is_missing), the first match of each field in each record (the
    document without ``record_selector``).  warnings: (page_id, rec_idx, warning), one for
    every record that lacks a required field, and one for a page, with a null record,
    whose selector finds no record or more than ``max_records``."""
    fields = validated(fields)
    in_range(max_records=max_records)
    spark = pages.sparkSession
    pages = one_row_a_page(pages)
    nodes = staged(shred.shred(pages))
    elems = staged(dom.elements(nodes))
    texts = staged(dom.visible_text(nodes))
    if record_selector and record_selector.strip():
        hits = dom.select(elems, record_selector, selector_type, texts=texts)
        found = hits.groupBy("page_id").agg(F.array_sort(F.collect_list("pre")).alias("m")).select("page_id", F.posexplode("m").alias("rec_idx", "pre"))
        found = staged(found)
    else:
        found = pages.select(F.col("page_id").cast("long"), F.lit(0).alias("rec_idx"), F.lit(0).alias("pre"))
    records = staged(detect.numbered(found.where(F.col("rec_idx") < max_records)))
    scene = strategies.Scene(records, fields_table(spark, fields), nodes, elems, texts, None, pages=pages)
    told = strategies.by_selector(scene, fields)
    required = F.broadcast(spark.createDataFrame([(f.ord, f.name, f.required) for f in fields], "ord int, name string, required boolean"))
    asked = records.select("page_id", "rec_idx").join(required)
    values = asked.withColumn("value", F.lit(None).cast("string")) if told is None else asked.join(told.select(*strategies.KEY, "value"), strategies.KEY, "left")
    values = staged(values.withColumn("is_missing", F.col("value").isNull()))
    notes = values.where("required and is_missing").select("page_id", "rec_idx", _lacks("name").alias("warning"))
    counts = found.groupBy("page_id").agg(F.count(F.lit(1)).alias("found"))
    none = F.lit(None).cast("int").alias("rec_idx")
    notes = notes.union(counts.where(F.col("found") > max_records).select("page_id", none, _over(max_records)))
    missed = pages.select(F.col("page_id").cast("long")).join(counts, "page_id", "left_anti")
    return values.drop("required"), notes.union(missed.select("page_id", none, F.lit(C.NO_MATCH)))


def _of_majority(found: DataFrame, elems: DataFrame, texts: DataFrame, entities: DataFrame, pages: DataFrame) -> DataFrame:
    """Records without those whose profile's entity has another type than most, in
    order and numbered anew; pages whose entities have no url stay as they are."""
    url = F.coalesce(F.col("leaves")["url"], F.col("leaves")["@id"])
    told = staged(entities.where(url.isNotNull()))
    if told.isEmpty():
        return found.select("page_id", "rec_idx", "pre")
    with_urls = told.select("page_id").distinct()
    asked = found.join(with_urls, "page_id", "left_semi")
    near = elems.join(with_urls, "page_id", "left_semi")
    profiles = links.profile_links(asked, near, links.anchors(near, texts, pages))
    typed = links.entity_by_url(asked.join(profiles, ["page_id", "rec_idx"], "left"), told)
    kept = links.majority_type(typed).select("page_id", "rec_idx", "pre")
    turn = (F.row_number().over(Window.partitionBy("page_id").orderBy("rec_idx")) - 1).alias("rec_idx")
    return found.join(with_urls, "page_id", "left_anti").select("page_id", "rec_idx", "pre").union(kept.select("page_id", turn, "pre"))


def _extract(scene: strategies.Scene, fields: list[Field], provider, extra: dict) -> DataFrame:
    state = strategies.by_state(scene, shred_state(scene.nodes)) if scene.kinds & {"Email", "Phone"} else None
    parts = [strategies.by_selector(scene, fields), strategies.by_structured_data(scene), state, strategies.by_semantics(scene), strategies.by_patterns(scene)]
    if provider is not None:
        parts.append(strategies.by_hook(scene, provider))
    parts += [strategies.by_extra(name, make(scene)) for name, make in extra.items()]
    parts = [staged(p) for p in parts if p is not None]
    candidates = parts[0]
    for p in parts[1:]:
        candidates = candidates.unionByName(p)
    asked = scene.records.join(F.broadcast(scene.fields.select("ord", "name", "kind", "required"))).select(*strategies.KEY, "name", "kind", "required", "is_document")
    # A profile page that rules out contact has no contact values at all.
    barred = scene.records.where("is_document").join(scene.texts.where("pre = 0"), ["page_id", "pre"]).where(F.lower("vtext").contains(C.CONTACT_UNAVAILABLE)).select("page_id", "rec_idx").withColumn("unavailable", F.lit(True))
    asked = asked.join(barred, ["page_id", "rec_idx"], "left").withColumn("unavailable", F.coalesce("unavailable", F.lit(False)))
    candidates = strategies.first_way(candidates).join(asked.where("unavailable").where(F.col("kind").isin(C.CONTACT_KINDS)).select(*strategies.KEY), strategies.KEY, "left_anti")
    return resolve.resolve(asked, candidates, strategies.KEY, [*C.STRATEGIES, *extra])


def shred_state(nodes: DataFrame) -> DataFrame:
    """(page_id, told): the texts of the application state in each page's first
    script#__NEXT_DATA__, in visiting order."""
    held = nodes.where("kind = 'element' and tag = 'script'").where(F.col("attrs")["id"] == "__NEXT_DATA__").groupBy("page_id").agg(F.min("pre").alias("parent"))
    texts = nodes.where("kind = 'text'").join(held, ["page_id", "parent"]).select("page_id", "text")

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
        for batch in batches:
            for page_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                told = [{"key": k, "value": v} for k, v in shred.state_texts(text)]
                yield pa.RecordBatch.from_arrays([pa.array([page_id], pa.int64()), pa.array([told], kind)], names=["page_id", "told"])

    return texts.mapInArrow(run, "page_id long, told array<struct<key:string,value:string>>")


def next_hops(pages: DataFrame) -> DataFrame:
    """(url, next_url): where each page's next link leads, if that may be fetched."""
    nodes = staged(shred.shred(pages))
    elems = dom.elements(nodes).where("tag in ('a', 'link')")
    found = links.next_links(links.anchors(elems, dom.visible_text(nodes, elems), pages))
    urls = pages.select(F.col("page_id").cast("long"), "url")
    return found.join(urls, "page_id").where(U.rejection(F.col("next_url")).isNull()).select("url", "next_url")


@dataclass
class Followed:
    """``results``: (root, page_number) with the columns of ``scrape``'s results.
    ``roots``: (root, pages_processed, n_records).  ``notices``: (root, warning)."""

    results: DataFrame
    roots: DataFrame
    notices: DataFrame


def follow(pages: DataFrame, starts: DataFrame, fields: list[Field], max_pages: int = 1, max_records: int = 200, **options) -> Followed:
    """Listings followed over their next links within ``pages``.  ``starts``: root, url.
    A root keeps its first ``max_records`` records over all its pages and ends with the
    page that reaches them.  A first page without a match of ``record_selector`` ends
    its root, with that notice alone; a later page without records has none."""
    in_range(max_pages=max_pages, max_records=max_records)
    reached = staged(links.walk(starts, next_hops(pages), max_pages))
    at = pages.select("page_id", F.lower("url").alias("_u")).groupBy("_u").agg(F.min("page_id").cast("long").alias("page_id"))
    placed = staged(reached.join(at.withColumnRenamed("_u", "_v"), F.lower("url") == F.col("_v")).select("root", "page_number", "page_id"))
    out, first_found, ended = None, None, None
    for first in (True, False):
        turn = placed.where("page_number = 1" if first else "page_number > 1")
        if ended is not None:
            turn = turn.join(ended, "root", "left_anti")
        if first or not turn.isEmpty():
            some = pages.join(turn.select(F.col("page_id").alias("_p")).distinct(), pages["page_id"].cast("long") == F.col("_p"), "left_semi")
            got = scrape(some, fields, max_records=None, collapse=first, **options)
            records = got.records if first else got.records.where("not is_document")
            rows = got.results.join(records.select("page_id", "rec_idx"), ["page_id", "rec_idx"], "left_semi").join(turn, "page_id")
            out = rows if out is None else out.unionByName(rows)
            if first:
                first_found = staged(turn.join(got.found, "page_id", "left").select("root", F.coalesce("found", F.lit(0)).alias("found")))
                if options.get("record_selector"):
                    ended = first_found.where("found = 0").select("root")
    out = staged(out)
    each = out.select("root", "page_number", "rec_idx").distinct()
    kept = staged(each.withColumn("_r", F.row_number().over(Window.partitionBy("root").orderBy("page_number", "rec_idx"))).where(F.col("_r") <= max_records))
    results = out.join(kept.drop("_r"), ["root", "page_number", "rec_idx"], "left_semi")
    # The page that reached max_records is the last; without one it is the last of the walk.
    full = kept.where(F.col("_r") == max_records).select("root", F.col("page_number").alias("_last"))
    walked = placed if ended is None else placed.join(ended, "root", "left_anti").union(placed.where("page_number = 1").join(ended, "root", "left_semi"))
    counts = kept.groupBy("root").agg(F.count(F.lit(1)).alias("n_records"))
    roots = walked.groupBy("root").agg(F.max("page_number").alias("_n")).join(full, "root", "left").join(counts, "root", "left")
    roots = staged(roots.select("root", F.coalesce("_last", "_n").cast("int").alias("pages_processed"), F.coalesce("n_records", F.lit(0)).alias("n_records")))
    lacking = results.where("required").groupBy("root", "name").agg(F.max("is_missing").alias("lacking")).where("lacking")
    notices = lacking.select("root", _lacks("name").alias("warning"))
    told = roots.join(first_found, "root")
    missed = told.where("found = 0") if ended is not None else told.where("false")
    notices = notices.union(missed.select("root", F.lit(C.NO_MATCH)))
    notices = notices.union(told.join(missed.select("root"), "root", "left_anti").where("n_records = 0").select("root", F.lit(C.NO_RECORDS)))
    over = told.where((F.col("pages_processed") == 1) & (F.col("n_records") > 0) & (F.col("found") > max_records))
    return Followed(results, roots, notices.union(over.select("root", _over(max_records))))


def crawl(pages: DataFrame, starts: DataFrame, fields: list[Field], max_pages: int = 1, max_records: int = 200, **options) -> DataFrame:
    """The results of ``follow``."""
    return follow(pages, starts, fields, max_pages, max_records, **options).results


def _lacks(name: str) -> Column:
    return F.format_string("Required field '%s' could not be extracted for one or more records.", name)


def _over(most: int) -> Column:
    return F.format_string(f"Only the first {most} records were processed out of %d found.", F.col("found"))


def profile_plan(listing: Result, pages: DataFrame, max_profiles: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(urls, visits, skips) of a listing's profiles.  urls: (page_id, rec_idx,
    profile_url) of all records.  visits: of every page, its own scrape, the first
    record to name each URL that ``pages`` holds, ``max_profiles`` at most.  skips:
    the others with a reason; their records keep the listing's data."""
    in_range(max_profiles=max_profiles)
    s = listing.scene
    urls = staged(links.profile_links(listing.records.where("not is_document"), s.elems, links.anchors(s.elems, s.texts, pages)))
    first = F.row_number().over(Window.partitionBy("page_id", F.lower("profile_url")).orderBy("rec_idx"))
    own = urls.withColumn("_r", first).where("_r = 1").drop("_r")
    held = own.join(pages.select(F.lower("url").alias("_u")).distinct(), F.lower("profile_url") == F.col("_u"), "left").withColumn("here", F.col("_u").isNotNull()).drop("_u")
    most = min(max_profiles, C.MAX_PROFILES)
    turn = F.row_number().over(Window.partitionBy("page_id", "here").orderBy("rec_idx"))
    placed = staged(held.withColumn("_r", turn))
    reason = F.when(~F.col("here"), "Profile page not loaded").otherwise(f"Profile limit reached ({most})")
    skips = placed.where(~F.col("here") | (F.col("_r") > most)).select("page_id", "rec_idx", F.lit("Profile").alias("kind"), F.col("profile_url").alias("url"), reason.alias("reason"))
    return urls, placed.where(F.col("here") & (F.col("_r") <= most)).select("page_id", "rec_idx", "profile_url"), skips


def deep(listing: Result, pages: DataFrame, fields: list[Field], max_profiles: int = 50, provider=None) -> DataFrame:
    """Listing results merged with their profile pages, found in ``pages`` by URL:
    adds profile_url and visited.  ``profile_plan`` says which are visited, and
    lists the others as skips."""
    urls, visits, _ = profile_plan(listing, pages, max_profiles)
    wanted = pages.join(visits.select(F.lower("profile_url").alias("_u")).distinct(), F.lower(pages["url"]) == F.col("_u"), "left_semi")
    found = scrape(wanted, fields, whole_page=True, provider=provider)
    one = pages.groupBy(F.lower("url").alias("_u")).agg(F.min("page_id").cast("long").alias("page_id"))
    by_url = found.results.join(one, "page_id").drop("page_id", "rec_idx")
    profile = visits.select("page_id", "rec_idx", F.lower("profile_url").alias("_u")).join(by_url, "_u")
    merged = merge.merge_profiles(listing.results.drop("unavailable"), profile, ["page_id", "rec_idx"])
    return merged.join(urls, ["page_id", "rec_idx"], "left")


def with_profile_url(wide: DataFrame, urls: DataFrame) -> DataFrame:
    """Wide results with the column "Profile URL", where any record has one."""
    if urls.where("profile_url is not null").isEmpty():
        return wide
    return wide.join(urls.select("page_id", "rec_idx", F.col("profile_url").alias("Profile URL")), ["page_id", "rec_idx"], "left")
