"""HTML pages as relations: the node table and the structured-data table.

The tokenizer is the only Python here; all that follows works on rows.  A node
has its pre-order number, the size of its subtree, its parent and the list of its
ancestors, so "inside" is an equi-join on (page_id, ancestor), and the places of its
visible texts among those of the page, so its text is a slice of one list a page.
"""

from __future__ import annotations

import json
import re
from html import unescape
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import ADDRESS_PARTS, HIDDEN_PARENTS

NODES = "page_id long, pre int, size int, parent int, depth int, kind string, tag string, parent_tag string, attrs map<string,string>, text string, ancestors array<int>, inner_from int, inner_to int, text_from int, text_to int"
ENTITIES = "page_id long, ent int, type string, n_keys int, leaves map<string,string>"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
#: An opening tag ends an open element of these tags (implied end tags).
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | {
    t: ("p",) for t in "p div ul ol dl table h1 h2 h3 h4 h5 h6 section article main header footer nav aside form pre blockquote hr".split()
}
_FENCE = frozenset("ul ol dl table div section article main body td th form".split())


def decoded(text: str) -> str:
    """References that end with a semicolon as characters."""
    return _REFERENCE.sub(lambda m: unescape(m[0]), text) if "&" in text else text


_TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*([\"']|[^\s\"'>][^\s>]*)?)?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title")}
_TARGETS = frozenset(t for ends in _ENDS.values() for t in ends)
#: Deeper elements hang on the ancestor at this depth, as in browsers.
MAX_DEPTH = 256
#: Node rows, list items and characters of one Arrow batch, about.
_ROWS, _ITEMS, _CHARS = 20_000, 1 << 20, 8 << 20
#: Characters of a page's pieces that are read together, about.
_READ = 1 << 18
_LONE = re.compile("[\ud800-\udfff]")
_COLUMNS = {
    "kind": pa.string(), "tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string(), "pre": pa.int32(), "size": pa.int32(), "parent": pa.int32(), "depth": pa.int32(), "parent_tag": pa.string(),
    "ancestors": pa.list_(pa.int32()), "inner_from": pa.int32(), "inner_to": pa.int32(), "text_from": pa.int32(), "text_to": pa.int32(), "page_id": pa.int64(),
}
_ORDER = "page_id pre size parent depth kind tag parent_tag attrs text ancestors inner_from inner_to text_from text_to".split()


class _Open:
    """An element whose end is not met yet."""

    __slots__ = ("after", "attrs", "parent", "parent_tag", "path", "pre", "tag", "told")

    def __init__(self, tag, attrs, pre, parent, parent_tag, path, after, told):
        self.tag, self.attrs, self.pre, self.parent, self.parent_tag, self.path, self.after, self.told = tag, attrs, pre, parent, parent_tag, path, after, told


class _Builder:
    """Any text as nodes, in one pass of linear time: an unclosed comment reaches to
    the end of the page, an unclosed quote to the end of its tag, an unclosed tag
    is dropped with what follows, and a stray end tag is ignored.

    A node is a row (``_COLUMNS``) as soon as it ends, so of a page only the open elements
    are held, ``MAX_DEPTH`` at most, and the rows not taken yet; of its markup, the piece
    at hand, with those before it that a tag, comment or script begun in them reaches from."""

    def __init__(self, page_id=None):
        self.page_id = page_id
        self.rows: list[tuple] = []
        self.begin = self.items = self.chars = 0  # of these rows: the page's first, list items, characters
        self.next = 1
        self.told = 0  # visible texts so far
        self.at = self.after = 0
        self.base = 0  # where in the page the markup at hand begins
        self.open = [_Open("#document", {}, 0, -1, "", (), 0, 0)]
        self.marks: list[int] = []  # places in ``open`` that implied end tags look at
        self.count: dict[str, int] = {}
        self.flat: dict[str, int] = {}
        self.held: list[str] = []

    def _row(self, kind, tag, attrs, text, pre, parent, parent_tag, path, first, last, told):
        attrs = list(attrs.items())
        self.items += len(path) + len(attrs)
        self.chars += len(text) + sum(len(v) for _, v in attrs)
        self.rows.append((kind, tag, attrs, text, pre, self.next - 1 - pre, parent, len(path), parent_tag, path, first, last, told, self.told, self.page_id))

    def _ended(self, x: _Open, last: int):
        self._row("element" if x.pre else "document", x.tag, x.attrs, "", x.pre, x.parent, x.parent_tag, x.path, x.after, last, x.told)

    def _flush(self):
        if self.held:
            text = "".join(self.held)
            self.held = []
            raw = self.open[-1].tag in ("script", "style")
            self._leaf("text", "#text", {}, text if raw else decoded(text))

    def _path(self) -> tuple:
        return (*self.open[-1].path, self.open[-1].pre)

    def _leaf(self, kind, tag, attrs, text):
        up, told = self.open[-1], self.told
        self.told += kind == "text" and up.tag not in HIDDEN_PARENTS
        pre, self.next = self.next, self.next + 1
        self._row(kind, tag, attrs, text, pre, up.pre, up.tag, self._path(), self.after, self.after, told)

    def _cut(self, place: int):
        while len(self.open) > place:
            x = self.open.pop()
            self.count[x.tag] -= 1
            self._ended(x, self.at)
        while self.marks and self.marks[-1] >= place:
            self.marks.pop()

    def start(self, tag: str, attrs: dict, closed: bool) -> None:
        self._flush()
        ends = _ENDS.get(tag, ())
        if any(self.count.get(t) for t in ends):
            for place in reversed(self.marks):
                here = self.open[place].tag
                if here in ends:
                    self._cut(place)
                    break
                if here in _FENCE:
                    break
        flat = len(self.open) >= MAX_DEPTH
        if tag in _VOID or closed or flat:
            self._leaf("element", tag, attrs, "")
            if flat and not (tag in _VOID or closed):
                self.flat[tag] = self.flat.get(tag, 0) + 1
            return
        if tag in _FENCE or tag in _TARGETS:
            self.marks.append(len(self.open))
        up = self.open[-1]
        self.open.append(_Open(tag, attrs, self.next, up.pre, up.tag, self._path(), self.after, self.told))
        self.next += 1
        self.count[tag] = self.count.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        self._flush()
        if self.flat.get(tag):
            self.flat[tag] -= 1
        elif self.count.get(tag):
            place = len(self.open) - 1
            while self.open[place].tag != tag:
                place -= 1
            self._cut(place)

    def parse(self, pieces):
        """Yields when the rows at hand fill a batch; takes what is left at the end.
        ``pieces``: the page's markup in order, cut anywhere."""
        pieces = iter(pieces)
        html, ahead, at = next(pieces, ""), next(pieces, None), 0
        unclosed: set[str] = set()
        while at < len(html) or ahead is not None:
            if self.full():
                yield
            lt = html.find("<", at)
            stop = len(html) if lt < 0 else lt
            if stop > at:
                self.held.append(html[at:stop])
            at = stop if lt < 0 else self._token(html, lt, ahead is None, unclosed)
            if ahead is not None and (at < 0 or at == len(html)):
                at = lt if at < 0 else at
                kept = [html[at:]]
                size = wanted = len(kept[0])
                while ahead is not None and size <= 2 * wanted:  # twice what was looked at in vain, so all looks together are linear
                    kept.append(ahead)
                    size, ahead = size + len(ahead), next(pieces, None)
                html, self.base, at = "".join(kept), self.base + at, 0
        self._flush()
        while self.open:
            self._ended(self.open.pop(), self.base + len(html))

    def _token(self, html: str, lt: int, last: bool, unclosed: set) -> int:
        """Take what begins at ``lt``; where it ends, -1 if more of the page (there is, unless
        ``last``) must be known to tell."""
        if not last and lt + 3 > len(html):
            return -1
        self.at = self.base + lt
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            if stop < 0 and not last:
                return -1
            self._flush()
            self._leaf("comment", "#comment", {}, html[lt + 4 : len(html) if stop < 0 else stop])
            return len(html) if stop < 0 else stop + 3
        if html[lt + 1 : lt + 2] in ("!", "?") or (html.startswith("</", lt) and html[lt + 2 : lt + 3].isalpha()):
            stop = html.find(">", lt)
            if stop < 0:
                return len(html) if last else -1
            if html[lt + 1] == "/" and (m := _TAG_NAME.match(html, lt + 2)):
                self.end(m[0].lower())
            return stop + 1
        if m := _TAG_NAME.match(html, lt + 1):
            return self._opened(html, m, last, unclosed)
        self.held.append("<")
        return lt + 1

    def full(self) -> bool:
        return len(self.rows) >= _ROWS or self.items >= _ITEMS or self.chars >= _CHARS

    def taken(self) -> pa.RecordBatch:
        """The rows at hand, a page's in order, which are let go."""
        self._sort()
        cols = dict(zip(_COLUMNS, zip(*self.rows, strict=True), strict=True))
        self.rows, self.begin, self.items, self.chars = [], 0, 0, 0
        return pa.RecordBatch.from_arrays([pa.array(cols[c], _COLUMNS[c]) for c in _ORDER], names=_ORDER)

    def _sort(self):
        self.rows[self.begin :] = sorted(self.rows[self.begin :], key=lambda r: r[4])
        self.begin = len(self.rows)

    def turn(self, page_id) -> None:
        """On to the next page; the rows at hand stay."""
        self._sort()
        rows, items, chars = self.rows, self.items, self.chars
        self.__init__(page_id)
        self.rows, self.begin, self.items, self.chars = rows, len(rows), items, chars

    def _opened(self, html: str, name: re.Match, last: bool, unclosed: set) -> int:
        """Take an opening tag; where it, or the raw text it holds, ends (-1 as in ``_token``)."""
        tag, at, attrs = name[0].lower(), name.end(), {}
        while m := _ATTRIBUTE.match(html, at):
            at, value = m.end(), m[2] or ""
            if value in ("'", '"'):
                stop = -1 if value in unclosed else html.find(value, at)
                if stop < 0 and not last:
                    return -1
                if stop < 0:
                    unclosed.add(value)
                    stop = html.find(">", at)
                    stop = len(html) if stop < 0 else stop
                    value, at = html[at:stop], stop
                else:
                    value, at = html[at:stop], stop + 1
            attrs.setdefault(m[1].lower(), decoded(value))
        stop = html.find(">", at)
        if stop < 0:
            return len(html) if last else -1
        closed, to = html[stop - 1] == "/", stop + 1
        raw = tag in _RAW_END and not closed
        if raw:
            end = _RAW_END[tag].search(html, to)
            if not end and not last:
                return -1
            to = end.start() if end else len(html)
        self.after = self.base + stop + 1
        self.start(tag, attrs, closed)
        if raw:
            self.held.append(html[stop + 1 : to])
        return to


def page_nodes(html: str | None) -> list[tuple]:
    """A page's nodes in order: kind, tag, attributes, text, and the rest of the row."""
    builder = _Builder()
    for _ in builder.parse([html or ""]):
        pass
    return sorted(builder.rows, key=lambda r: r[4])


def batches_of(pages):
    """Arrow batches of the nodes of (page_id, html) pairs: small pages share a batch, large
    ones take several, and no page's nodes are held together."""
    return _batches((page_id, [html]) for page_id, html in pages)


def _batches(pages):
    """``batches_of`` (page_id, pieces of markup) pairs."""
    builder = _Builder()
    for page_id, pieces in pages:
        builder.turn(page_id)
        for _ in builder.parse(map(_valid, pieces)):
            yield builder.taken()
    if builder.rows:
        yield builder.taken()


def _valid(html: str | None) -> str:
    html = html or ""
    return html.encode("utf-8", "replace").decode("utf-8") if _LONE.search(html) else html


def batches_of_pieces(rows):
    """``batches_of`` (page_id, piece of markup) pairs, a page's one after another."""
    return _batches((page_id, map(itemgetter(1), read)) for page_id, read in groupby(_read(rows), itemgetter(0)))


def _read(rows):
    """The pieces with short ones of a page joined."""
    for page_id, pieces in groupby(rows, itemgetter(0)):
        held, size = [], 0
        for _, piece in pieces:
            held.append(piece or "")
            size += len(held[-1])
            if size >= _READ:
                yield page_id, "".join(held)
                held, size = [], 0
        yield page_id, "".join(held)


def page_batches(page_id, html: str | None):
    """Arrow batches of a page's nodes."""
    return batches_of([(page_id, html)])


def shred(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> the node table.  Null or empty pages have their
    document node alone; no text fails."""

    def run(batches):
        yield from batches_of((b.column(0)[i].as_py(), b.column(1)[i].as_py()) for b in batches for i in range(b.num_rows))

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, NODES)


def shred_pieces(pieces: DataFrame) -> DataFrame:
    """pieces (page_id, html) -> the node table of the pages that they make up: for pages too
    long to be a value each.  A page's pieces must lie in one partition, one after another, in
    order (``repartition`` and ``sortWithinPartitions``); they may be cut anywhere.  A page
    without a piece has no node."""

    def run(batches):
        yield from batches_of_pieces(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

    return pieces.select(F.col("page_id").cast("long"), "html").mapInArrow(run, NODES)


#: Structured data is read to this depth.
MAX_JSON_DEPTH = 40


def parsed_json(text: str):
    """A JSON text with numbers as text; None if malformed or nested too deep."""
    try:
        return json.loads(text, parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        return None


def entities_of(block: str) -> list[dict]:
    """The entities of one JSON-LD block: array items, members of @graph, and the
    items of an ItemList; a malformed block has none."""
    out: list[dict] = []
    todo = [parsed_json(decoded(block).strip())]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            low = {k.lower(): v for k, v in x.items()}
            if isinstance(low.get("@graph"), list):
                todo += reversed([y for y in low["@graph"] if isinstance(y, dict)])
            elif low.get("@type") == "ItemList" and isinstance(low.get("itemlistelement"), list):
                for y in low["itemlistelement"]:
                    if isinstance(y, dict):
                        item = {k.lower(): v for k, v in y.items()}.get("item")
                        out.append(item if isinstance(item, dict) else y)
            else:
                out.append(x)
    return out


def _object_text(x: dict) -> str | None:
    """An object's name, text or value, else its address parts, each part once."""
    low = {k.lower(): v for k, v in x.items()}
    for k in ("name", "text", "value"):
        if isinstance(low.get(k), str) and low[k].strip():
            return low[k]
    kept: list[str] = []
    for k in ADDRESS_PARTS:
        part = low.get(k)
        part = part.strip() if isinstance(part, str) else ""
        if part and not any(part.lower() in seen.lower() for seen in kept):
            kept.append(part)
    return ", ".join(kept) or None


def _told(x) -> str | None:
    """A value as text: a list by its first item, an object by its parts."""
    while isinstance(x, list):
        x = x[0] if x else None
    if isinstance(x, dict):
        return _object_text(x)
    return x if x is None or isinstance(x, str) else str(x)


def leaves_of(x) -> dict:
    """Dotted lower-case paths to scalars, with list items as ``a[0]``, down to
    ``MAX_JSON_DEPTH``.  ``a!`` is the value at ``a`` as text; ``a*`` the distinct
    texts of a list's first items, joined; ``a{}`` marks an object."""
    out: dict = {}
    todo = [("", x, 0)]
    while todo:
        path, x, depth = todo.pop()
        if path and (text := _told(x)) is not None:
            out[path + "!"] = text
        if isinstance(x, dict):
            if path:
                out[path + "{}"] = ""
            if depth < MAX_JSON_DEPTH:
                todo += reversed([(f"{path}.{k.lower()}" if path else k.lower(), v, depth + 1) for k, v in x.items()])
        elif isinstance(x, list):
            texts = dict.fromkeys(t for t in map(_told, x) if t and t.strip())
            if texts:
                out[path + "*"] = "; ".join(list(texts)[:10])
            if depth < MAX_JSON_DEPTH:
                todo += reversed([(f"{path}[{i}]", v, depth + 1) for i, v in enumerate(x)])
        elif x is not None:
            out[path] = x if isinstance(x, str) else str(x)
    return out


def _first_text(x, depth: int = 0) -> str | None:
    """A string, or the first one in a list, that is not blank."""
    if isinstance(x, _Number):
        return None
    if isinstance(x, str):
        return x if x.strip() else None
    if isinstance(x, list) and depth < MAX_JSON_DEPTH:
        return next((t for t in (_first_text(y, depth + 1) for y in x) if t), None)
    return None


class _Number(str):
    """A JSON number, kept as its text."""


def state_texts(text: str) -> list[tuple[str, str]]:
    """(lower-case property name, text) of an application state, in the order in
    which a search meets them: an object's own texts, then its values, each with
    all it holds, to ``MAX_JSON_DEPTH``."""
    try:
        todo = [(json.loads(text, parse_int=_Number, parse_float=_Number), 0)]
    except (ValueError, RecursionError):
        return []
    out = []
    while todo:
        x, depth = todo.pop()
        if depth > MAX_JSON_DEPTH:
            continue
        if isinstance(x, dict):
            out += [(k.lower(), t) for k, v in x.items() if (t := _first_text(v))]
            todo += reversed([(v, depth + 1) for v in x.values()])
        elif isinstance(x, list):
            todo += reversed([(v, depth + 1) for v in x])
    return out


def entities(nodes: DataFrame) -> DataFrame:
    """The structured-data table: a row per JSON-LD entity of a page, in page
    order, its scalars as a map of paths."""
    holders = nodes.where("kind = 'element' and tag = 'script'").where(F.lower(F.trim(F.col("attrs")["type"])) == "application/ld+json").select("page_id", F.col("pre").alias("parent"))
    blocks = nodes.where("kind = 'text'").join(holders, ["page_id", "parent"], "left_semi").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pre", "text"))).alias("blocks"))

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [e for b in blocks for e in entities_of(b)]
                for i, e in enumerate(found):
                    leaves = leaves_of(e)
                    kind = leaves.get("@type") or leaves.get("@type[0]")
                    rows.append((page_id, i, kind, len(e), list(leaves.items())))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "ent", "type", "n_keys", "leaves"])

    return blocks.select("page_id", F.col("blocks.text").alias("blocks")).mapInArrow(run, ENTITIES)
