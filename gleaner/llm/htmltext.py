"""Main text of web pages by consensus host paths.

Every page is cut into blocks under the elements that hold them.  An element's
score is the unlinked text of its own blocks plus half of that one container
below.  From the best one the page's container is the ``article`` or else the ``main``
around it, else the lowest ancestor that holds ``NEARLY`` all of the page's unlinked
text, and then the one above if that adds a heading and little else.  Its
generalised path (tags and class names without
digits, from the root, kept as a 64-bit digest) gets the page's vote, weighted by its share of the page.
Spark sums the votes per host, and every page is read again under the host's
``PATHS`` highest paths: the first that the page has, and that holds at least ``SHARE``
of the unlinked text in the page's own container, is taken, else that container; so a
page whose article lies elsewhere than its host's keeps it.

Menus, page headers and footers, sidebars, notices, adverts, forms, comments and
code are known by tag, role or class words and left out of both passes.  A class
word counts as a whole class name, as its last part, or beside parts that only
say place or shape.  It is not trusted where it would take the article: elements
of one path that hold over half of the page's unlinked text are kept (but for
comments, and for adverts and consent whose names say nothing else); if without adverts and
consent less than a tenth is left they are kept, and if nothing is left, class words are left
aside for that page.

Edge cases: null or empty pages give an empty text; a null or odd url counts as
one host of its own; broken markup never fails (an unclosed tag ends with its
parent, an unclosed comment, script, style, textarea or title with the page, the
tag of an unclosed frame, drawing or list of choices is passed over); repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches

#: Paths of a host that are tried; ones beyond won fewer votes, and the page's own
#: best container stands behind them, so no page is left empty by this.
PATHS = 5
#: Share of the page's own container that a host path must hold to be taken.
SHARE = 0.5
#: Share of a page's unlinked text at which a container holds the article.
NEARLY = 0.9
#: What an ancestor with a heading may add, of the container's text.
ADDED = 0.15
_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*)"
    r"|<(script|style|textarea|title)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</\1\s*+>|.*)"
    r"|<[!?][^>]*+>"
    r"|</([a-z][^\s/>]*+)[^>]*+>"
    r"|<([a-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<([a-z][^\s/>]*+)([^<>]*+)>",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|aria-label|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements left out with all they hold.
_SEALED = {t: re.compile(rf"</{t}\s*+>", re.I) for t in "noscript template iframe svg math object select".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr data input".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption summary address tr ul ol dl table tbody thead tfoot figure details hr".split())
_NOISE_TAGS = frozenset("nav footer aside form dialog button fieldset menu head audio video canvas map".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login nav navbar navigation "
    "menu menus breadcrumb breadcrumbs sidebar side aside rail footer foot masthead topbar toolbar comment comments respond disqus replies share sharing social related recommended recommendations widget widgets pagination pager search skip copyright legal".split()
)
#: Noise words that are no noise at the end of a longer name.
_WEAK = frozenset("widget widgets".split())
#: Words of adverts and consent, and of readers' own text: not the article, though often longer.
_PAID = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr".split())
_READERS = frozenset("comment comments respond disqus replies".split())
_NOT = frozenset("no not has have with without hide hides".split())
_NEUTRAL = frozenset("area bar block bottom box btn button buttons container content form group holder icon icons inner item items left line links list message outer panel post posts right row section text title top us wrap wrapper".split())
_CLOSES = {  # an opening tag ends these open ones
    **dict.fromkeys("p div ul ol dl table h1 h2 h3 h4 h5 h6 pre blockquote form section article main header footer nav aside figure address hr fieldset".split(), frozenset(["p"])),
    "li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]),
    "tr": frozenset(["p", "td", "th", "tr"]), "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]), "option": frozenset(["option"]),
}
_SCOPE = frozenset("ul ol dl table div section article main body td th blockquote aside nav form".split())
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"[0-9]+")


def _named(name: str) -> int:
    """1 if a class name, id or label tells noise, 2 if it tells adverts or consent and
    nothing else, 3 if readers' comments, else 0."""
    parts = [w.lower() for w in _SPLIT.split(name) if w]
    noisy = [w for w in parts if w in _NOISE_WORDS]
    if not noisy or not _NOT.isdisjoint(parts[:-1]):
        return 0
    last = parts[-1] in _NOISE_WORDS and parts[-1] not in _WEAK
    alone = all(w in _NOISE_WORDS or w in _NEUTRAL for w in parts)
    if not last and not alone:
        return 0
    return 3 if not _READERS.isdisjoint(noisy) else 2 if alone and not _PAID.isdisjoint(noisy) else 1


class Page:
    """Elements (parallel lists, parents before children) and the blocks of
    text in them: (element, text, characters in links)."""

    def __init__(self, source: str):
        self.tag, self.path, self.parent, self.noise, self.named, self.main = ["#"], [0], [-1], [False], [0], [False]
        self.count: dict[str, int] = {}
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(source)
        if any(self.named):
            self._drop_named()

    def _parse(self, source: str) -> None:
        stack, buffer, at, inside, links = [0], [], 0, [0], [0]

        def flush() -> None:
            if buffer:
                text = " ".join(_html.unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    holder = stack[-1]
                    while self.tag[holder] in _INLINE:
                        holder = self.parent[holder]
                    self.blocks.append((holder, text, min(links[0], len(text))))
            links[0] = 0

        def take(text: str) -> None:
            if text and not self.noise[stack[-1]]:
                buffer.append(text)
                if inside[0]:
                    links[0] += len(text)

        def close(tag: str) -> None:
            if not self.count.get(tag):
                return
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] == tag:
                    if tag not in _INLINE:
                        flush()
                    for x in stack[i:]:
                        inside[0] -= self.tag[x] == "a"
                        self.count[self.tag[x]] -= 1
                    del stack[i:]
                    return
                if tag in _INLINE and self.tag[stack[i]] not in _INLINE:
                    return  # a stray end of an inline element

        unclosed = set()
        while m := _TOKEN.search(source, at):
            take(source[at : m.start()])
            at = m.end()
            end, tag, attrs = m[2], m[3] or m[5], m[4] or m[6]
            if tag and (sealed := _SEALED.get(tag.lower())):
                if not (tag.lower() in ("svg", "math") and (attrs or "").endswith("/")) and tag.lower() not in unclosed:
                    if shut := sealed.search(source, at):
                        at = shut.end()
                    else:
                        unclosed.add(tag.lower())
                if buffer and not self.noise[stack[-1]]:
                    buffer.append(" ")
            elif end:
                close(end.lower())
            elif tag:
                tag = tag.lower()
                if tag not in _INLINE:
                    flush()
                    ends = _CLOSES.get(tag)
                    while ends and any(self.count.get(t) for t in ends) and (hit := next((i for i in range(len(stack) - 1, 0, -1) if self.tag[stack[i]] in ends or self.tag[stack[i]] in _SCOPE), 0)) and self.tag[stack[hit]] in ends:
                        close(self.tag[stack[hit]])
                elif tag == "br":
                    take(" ")
                if tag not in _VOID:
                    self._open(tag, attrs or "", stack)
                    inside[0] += tag == "a"
            elif not self.noise[stack[-1]] and buffer:
                buffer.append(" " if m[1] else "")
        take(source[at:])
        flush()

    def _open(self, tag: str, attrs: str, stack: list[int]) -> None:
        up = stack[-1]
        name, noise, named, main = tag, self.noise[up], 0, tag == "main"
        if tag in _NOISE_TAGS or (tag == "header" and not any(self.tag[x] in ("article", "main") for x in stack)):
            noise = True
        if attrs.strip():
            for key, *values in _ATTR.findall(attrs):
                key, value = key.lower(), values[0] or values[1] or values[2]
                if key == "class":
                    name = ".".join([tag, *sorted({_DIGITS.sub("", c) for c in value.lower().split()})])
                if key == "role":
                    noise |= value.lower() in _NOISE_ROLES
                    main |= value.lower() == "main"
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                    noise = True
                elif key in ("class", "id", "aria-label") and tag not in ("html", "body", "article", "main") and tag not in _INLINE:
                    named = max(named, *(_named(x) for x in ([value] if key == "aria-label" else value.split())), 0)
        self.tag.append(tag)
        self.path.append(self.path[up] if tag in _INLINE else xxhash.xxh3_64_intdigest(name.encode("utf-8", "replace"), seed=self.path[up]))
        self.parent.append(up)
        self.noise.append(noise)
        self.named.append(named)
        self.main.append(main)
        stack.append(len(self.tag) - 1)
        self.count[tag] = self.count.get(tag, 0) + 1

    def _drop_named(self) -> None:
        """Blocks in elements that are noise by name go, unless the article would."""
        n = len(self.tag)
        sure, text, held = [False] * n, [0] * n, {}
        for i in range(n):
            sure[i] = self.named[i] >= 2 or (i > 0 and sure[self.parent[i]])
        for node, t, linked in self.blocks:
            if not sure[node]:
                text[node] += max(len(t) - linked, 0)
        for i in range(n - 1, 0, -1):
            text[self.parent[i]] += text[i]
            if self.named[i] == 1:
                held[self.path[i]] = held.get(self.path[i], 0) + text[i]
        total = sum(max(len(t) - linked, 0) for _, t, linked in self.blocks)
        for least in (2, 3):  # adverts and consent go too, or comments alone
            gone = [False] * n
            for i in range(1, n):
                gone[i] = gone[self.parent[i]] or self.named[i] >= least or (self.named[i] == 1 and 2 * held[self.path[i]] <= text[0])
            left = [b for b in self.blocks if not gone[b[0]]]
            if 10 * sum(max(len(t) - linked, 0) for _, t, linked in left) >= total:
                break
        self.blocks = left or self.blocks

    def container(self, node: int) -> int:
        while self.tag[node] in _TEXT or self.tag[node] in _INLINE:
            node = self.parent[node]
        return node

    def best(self) -> tuple[int, float]:
        """The page's container (0: the document) and its share of the page's text."""
        n = len(self.tag)
        own: dict[int, float] = {}
        text, heads = [0] * n, [0] * n
        for node, t, linked in self.blocks:
            c, free = self.container(node), max(len(t) - linked, 0)
            own[c] = own.get(c, 0) + free
            text[node] += free
            heads[node] += free * (self.tag[node] in ("h1", "h2"))
        if not own:
            return 0, 0.0
        for i in range(n - 1, 0, -1):
            text[self.parent[i]] += text[i]
            heads[self.parent[i]] += heads[i]
        score = dict(own)
        for c, free in own.items():
            if c:
                up = self.container(self.parent[c])
                score[up] = score.get(up, 0) + free / 2
        top = max(score, key=lambda c: (score[c], -c))
        return (node := self._around(top, text, heads)), text[node] / max(text[0], 1)

    def _around(self, top: int, text: list[int], heads: list[int]) -> int:
        for wanted in (lambda i: self.tag[i] == "article", lambda i: self.main[i]):
            node = top
            while node > 0 and not wanted(node):
                node = self.parent[node]
            if node > 0:
                return node
        node = top
        while node > 0 and text[node] < NEARLY * text[0]:
            node = self.parent[node]
        up = self.parent[node]
        while up > 0 and text[up] == text[node]:
            up = self.parent[up]
        if up >= 0 and heads[up] > heads[node] and text[up] - text[node] <= ADDED * text[node]:
            return up
        return node

    def weight(self, roots: set[int]) -> int:
        """Unlinked characters at or below ``roots``."""
        return sum(max(len(t) - linked, 0) for _, t, linked in self._below(roots))

    def _below(self, roots: set[int]) -> list[tuple[int, str, int]]:
        inside = [False] * len(self.tag)
        for i in range(len(inside)):
            inside[i] = i in roots or (i > 0 and inside[self.parent[i]])
        return [b for b in self.blocks if inside[b[0]]]

    def text(self, roots: set[int]) -> str:
        """The blocks at or below ``roots``, in page order."""
        return "\n\n".join(t for _, t, _ in self._below(roots))


def host_of(url) -> "F.Column":
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, vote): each page's best container, summed per host."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                held: dict = {}
                for host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    page = Page(source or "")
                    node, share = page.best()
                    if node:
                        key = host, page.path[node] - (1 << 63)
                        held[key] = held.get(key, 0.0) + share
                if held:
                    yield pa.RecordBatch.from_pydict({"host": [h for h, _ in held], "path": [p for _, p in held], "vote": list(held.values())})

    return pages.select("host", "html").mapInArrow(run, "host string, path long, vote double").groupBy("host", "path").agg(F.sum("vote").alias("vote"))


def extract(pages: DataFrame, max_broadcast_hosts: int = 20_000) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages``."""
    small_batches(pages.sparkSession)
    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("vote"), "path"))
    # Votes come summed by host and path, so the window sees few rows a host.
    ranked = votes(keyed).withColumn("place", place).where(F.col("place") <= PATHS)
    winners = materialize(ranked.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("paths")).select("host", F.col("paths.path").alias("paths")), "page-winners")
    if winners.count() <= max_broadcast_hosts:
        winners = F.broadcast(winners)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                texts = []
                for source, paths in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    page = Page(source or "")
                    own = {page.best()[0]}
                    least, text = SHARE * page.weight(own), ""
                    for path in paths or []:
                        roots = {i for i, p in enumerate(page.path) if p == path + (1 << 63)}
                        if roots and page.weight(roots) >= least and (text := page.text(roots)):
                            break
                    texts.append(text or page.text(own))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return keyed.join(winners, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
