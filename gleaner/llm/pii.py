"""Personal data: four shape rules, and contextual extraction bootstrapped from
what they find.  Built from DataFrame functions alone.

1.  The base rules find e-mail addresses, IP addresses, card and phone numbers
    by shape, leftmost and non-overlapping per kind, with code point offsets.
2.  These hits are the seeds.  Digit-bearing tokens of identifier shape that no
    base span touches are candidates.  The word before and the word after a
    seed or candidate are its lexical patterns.  Words are runs of letters, runs
    of digits and single marks, in patterns and totals alike; the word before
    takes up to ``GLUE`` marks that follow its letters ("id:", 'id":"').
3.  Over the graph of patterns and instances, scores pass to and fro: a pattern
    scores the confidence of the instances it meets, over all the times its
    word occurs in the whole corpus, seeds count as 1; an instance is confident
    as its patterns are (noisy or).  Patterns met by too few different confident
    instances are left out, so a frequent word never becomes one.
4.  A candidate next to a pattern of high score is a discovered identifier, kind
    ``context``.

Java's engine recurses on repeated groups, so single separators between digits
(and dots between domain characters) are first rewritten to one private-use
code point; each rule is then a run of one character class, linear and of flat
depth on any text.  Private-use code points already in a text are moved aside.
Offsets, contexts and overlaps of a text's matches come from scans in chunks of
``CHUNK`` (``running``), so a text with very many matches costs little more than
its length.  The context of a match reaches to the match before and after.

Edge cases: null or empty texts have no span; a null doc_id is kept; repeated
rows give repeated results; extra columns are dropped by ``find`` and kept by
``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
_SEP, _DOT, _ASIDE = "\ue000", "\ue002", "\ue001"
_LOCAL = f"[A-Za-z0-9._%+{_DOT}-]"
_EMAIL = f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = f"[0-9][0-9{_SEP}]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
#: An identifier: up to four letters, a digit, then letters, digits and joiners.
_CANDIDATE = r"(?<![0-9A-Za-z_.+@/=-])[A-Za-z]{0,4}[0-9][0-9A-Za-z/.-]{3,38}(?<=[0-9A-Za-z])(?![0-9A-Za-z_@/=-])"
#: Marks that a word before a span may bring along.
GLUE = 3
_MARK = r"[^\s\p{L}\p{N}]"
_WORD = rf"\p{{L}}+|\p{{N}}+|{_MARK}"
_SPANS = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
#: Matches that are scanned together, and characters of context on either side.
CHUNK, CONTEXT = 512, 60


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, state: Column, step, kind: str) -> Column:
    """What ``step`` emits over an array: step(state, item) -> (next state, array
    of ``kind`` to emit).  An array grows by copying, so what a chunk emits is kept
    apart until the end."""

    def chunk(part: Column, at: Column) -> Column:
        def one(acc: Column, item: Column) -> Column:
            after, told = step(acc["at"], item)
            return F.struct(after.alias("at"), F.concat(acc["out"], told).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), one)

    def chunked(all_: Column) -> Column:
        def one(acc: Column, c: Column) -> Column:
            return let(chunk(F.slice(all_, c * CHUNK + 1, CHUNK), acc["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        turns = F.sequence(F.lit(0), ((F.size(all_) - 1) / CHUNK).cast("int"))
        return F.flatten(F.aggregate(turns, F.struct(state.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), one, lambda acc: acc["out"]))

    return let(items, lambda all_: F.when(F.size(all_) <= CHUNK, chunk(all_, state)["out"]).otherwise(chunked(all_)))


def located(text: Column, pattern: str) -> Column:
    """The matches of ``pattern``: array of (start, end, value, left, right), in
    code points, with up to ``CONTEXT`` characters on either side.  Matched and
    unmatched stretches alternate, so their lengths give offsets."""

    def zipped(hits: Column, gaps: Column) -> Column:
        pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.concat(F.array(F.lit("")), hits).alias("before"), F.slice(gaps, 2, F.size(gaps)).alias("next"), F.slice(hits, 2, F.size(gaps)).alias("after"))
        return F.filter(pairs, lambda p: p["hit"].isNotNull())

    def step(at: Column, p: Column):
        start = at + F.length(p["gap"])
        end = start + F.length(p["hit"])
        left = F.right(F.concat(F.right(p["before"], F.lit(CONTEXT)), F.right(p["gap"], F.lit(CONTEXT))), F.lit(CONTEXT))
        right = F.left(F.concat(F.left(p["next"], F.lit(CONTEXT)), F.left(F.coalesce(p["after"], F.lit("")), F.lit(CONTEXT))), F.lit(CONTEXT))
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("value"), left.alias("left"), right.alias("right")))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(_SPANS)
    return let(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(running(let(F.split(text, pattern, -1), lambda g: zipped(h, g)), F.lit(0), step, _SPANS)))


def free(found: Column, spans: Column) -> Column:
    """The items of ``found`` (start, end, ...; in order) that touch no span."""

    def apart(f: Column, s: Column) -> Column:
        spots = F.transform(s, lambda x: F.struct(x["start"].alias("start"), F.lit(-1).alias("i"), x["end"].alias("end")))
        asked = F.transform(f, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x["end"].alias("end")))
        nothing, ids = F.array().cast("array<int>"), "array<int>"

        def past(furthest: Column, x: Column):
            is_span = x["i"] < 0
            return F.when(is_span, F.greatest(furthest, x["end"])).otherwise(furthest), F.when(~is_span & (x["start"] < furthest), F.array(x["i"])).otherwise(nothing)

        def ahead(nearest: Column, x: Column):
            is_span = x["i"] < 0
            return F.when(is_span, x["start"]).otherwise(nearest), F.when(~is_span & (x["end"] > nearest), F.array(x["i"])).otherwise(nothing)

        def kept(line: Column) -> Column:
            met = F.concat(running(line, F.lit(0), past, ids), running(F.reverse(line), F.lit(2147483647), ahead, ids))
            return F.transform(F.array_except(F.sequence(F.lit(0), F.size(f) - 1), met), lambda i: F.get(f, i))

        return let(F.array_sort(F.concat(spots, asked)), kept)

    return let(found, lambda f: let(spans, lambda s: F.when((F.size(f) == 0) | (F.size(s) == 0), f).otherwise(apart(f, s))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The sum over the digits, every second from the right doubled, is a
    multiple of ten."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """An array of (start, end, value) per kind, failing matches dropped.  The
    cheap test in front of each rule only skips texts that cannot match."""
    plain = F.translate(F.coalesce(text, F.lit("")), _SEP + _DOT, _ASIDE + _ASIDE)
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    joined = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", _SEP)
    none = F.array().cast(_SPANS)

    def parts_fit(v: Column) -> Column:
        return v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")

    def is_card(v: Column) -> Column:
        d = _digits(v)
        return F.length(d).between(14, 19) & _luhn(d)

    return {
        "email": F.when(plain.contains("@"), located(dotted, _EMAIL)).otherwise(none),
        "ip": F.when(plain.rlike(r"[0-9]\.[0-9]"), F.filter(located(plain, _IP), lambda s: parts_fit(s["value"]))).otherwise(none),
        "card": F.when(plain.rlike("[0-9]"), F.filter(located(joined, _CARD), lambda s: is_card(s["value"]))).otherwise(none),
        "phone": F.when(plain.contains("+"), F.filter(located(plain, _PHONE), lambda s: F.length(_digits(s["value"])).between(10, 15))).otherwise(none),
    }


def _word(text: Column, value: Column, before: bool) -> Column:
    """The nearest word of a short stretch of text, lower-cased; none where the
    span begins or ends inside it."""
    if before:
        cut = F.concat(F.substring(text, -1, 1), F.substring(value, 1, 1))
        near = F.regexp_extract(F.lower(text), rf"(\p{{L}}+{_MARK}{{0,{GLUE}}}|\p{{N}}+|{_MARK})\s*$", 1)
    else:
        cut = F.concat(F.substring(value, -1, 1), F.substring(text, 1, 1))
        near = F.regexp_extract(F.lower(text), rf"^\s*({_WORD})", 1)
    return F.when(cut.rlike(r"^(?:\p{L}\p{L}|\p{N}\p{N})$"), "").otherwise(near)


def _words(text: Column) -> Column:
    """Every word of a text that ``_word`` can give, as often as it occurs."""
    low = F.lower(text)
    glued = (rf"\p{{L}}+{_MARK}{{{k}}}" for k in range(1, GLUE + 1))
    return F.concat(*(F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in (_WORD, *glued)))


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, mark (a hash that tells rows of one doc_id
    apart), an array of spans per kind, and the candidates and seeds with the
    words around them."""
    text = F.coalesce("text", F.lit(""))
    spans = base_spans(F.col("text"))
    df = docs.select(F.col("doc_id").cast("long"), "text").select("doc_id", "text", F.xxhash64("text").alias("mark"), *(c.alias(k) for k, c in spans.items()))
    loose = F.when(text.rlike("[0-9]"), located(text, _CANDIDATE)).otherwise(F.array().cast(_SPANS))

    def around(s: Column, seed: bool) -> Column:
        left, right = F.translate(s["left"], _DOT, "."), F.translate(s["right"], _DOT, ".")
        words = F.array(F.concat(F.lit("L "), _word(left, s["value"], True)), F.concat(F.lit("R "), _word(right, s["value"], False)))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"), F.lit(seed).alias("seed"), words.alias("patterns"))

    every = F.concat(*(F.col(k) for k in KINDS))
    met = F.concat(F.transform(every, lambda s: around(s, True)), F.transform(free(loose, every), lambda s: around(s, False)))
    plain = (F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS)
    return df.select("doc_id", "mark", *plain, met.alias("met"))


def learn(met: DataFrame, docs: DataFrame, rounds: int = 3, support: int = 3, floor: float = 0.5) -> DataFrame:
    """(pattern, score) of the patterns accepted after ``rounds`` passes over the
    graph: at least ``support`` different confident instances, and a score of
    ``floor`` or more."""
    edges = met.select("value", "seed", F.explode("patterns").alias("pattern")).where(F.length("pattern") > 2)
    edges = materialize(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")), "pii-edges")
    # How often each pattern's word occurs in all texts; only patterns with
    # enough different instances can ever be accepted.
    words = docs.select(F.explode(_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("total"))
    asked = edges.groupBy("pattern").agg(F.countDistinct("value").alias("values")).where(F.col("values") >= support).withColumn("word", F.substring("pattern", 3, 1 << 30))
    totals = materialize(asked.join(words, "word").select("pattern", "total"), "pii-totals")
    edges = materialize(edges.join(totals, "pattern"), "pii-graph")
    trust = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    scores = None
    for _ in range(rounds):
        scores = (
            edges.join(trust, "value").groupBy("pattern")
            .agg((F.sum(F.col("trust") * F.col("n")) / F.first("total")).alias("score"), F.sum((F.col("trust") >= floor).cast("int")).alias("firm"))
            .where(F.col("firm") >= support).select("pattern", F.least("score", F.lit(0.99)).alias("score"))
        )
        scores = materialize(scores, "pii-scores")
        gained = edges.join(scores, "pattern", "left").groupBy("value").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log1p(-F.coalesce("score", F.lit(0.0)))))).alias("noisy"))
        trust = materialize(gained.select("value", F.when(F.col("seed"), 1.0).otherwise(F.col("noisy")).alias("trust")), "pii-trust")
    return scores.where(F.col("score") >= floor)


def find(docs: DataFrame, rounds: int = 3, support: int = 3, floor: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark, base (array of kind, start,
    end) and all (base and discovered spans), both ordered by start and kind."""
    rows = materialize(scan(docs), "pii-scan")
    met = rows.select("doc_id", "mark", F.explode("met").alias("m")).select("doc_id", "mark", "m.*")
    accepted = learn(met, docs, rounds, support, floor)
    loose = met.where("not seed").select("doc_id", "mark", "start", "end", F.explode("patterns").alias("pattern")).join(accepted, "pattern", "left_semi")
    # Rows that repeat hold the same spans, so a set is enough.
    new = loose.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("new")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "new")
    out = rows.join(new, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    kinds = [*KINDS, "context"]

    def tagged(spans: Column, k: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("ord"), s["end"].alias("end"), F.lit(kinds[k]).alias("kind")))

    base = F.array_sort(F.concat(*(tagged(F.col(k), i) for i, k in enumerate(KINDS))))
    every = F.array_sort(F.concat(base, tagged(F.coalesce("new", F.array().cast("array<struct<start:int,end:int>>")), len(KINDS))))
    return out.select("doc_id", "mark", base.alias("base"), every.alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle
    brackets; overlapping spans are replaced together under the first's kind."""
    found = find(docs, **options).groupBy("doc_id", "mark").agg(F.first("spans").alias("_spans"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "_spans").where(F.size("_spans") > 0)
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark")), "left")
    text = docs["text"]

    def chunk(at: Column, spans: Column) -> Column:
        """Text from ``at`` to the end of a chunk of spans, replaced."""
        seg = F.substring(text, at + 1, F.array_max(F.transform(spans, lambda s: s["end"])) - at)

        def replaced(seg: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                gap = F.substring(seg, acc["at"] - at + 1, s["start"] - acc["at"])
                grown = F.concat(acc["out"], F.array(gap, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], grown).otherwise(acc["out"]).alias("out"))

            return F.aggregate(spans, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), step)

        return let(seg, replaced)

    def grow(acc: Column, c: Column) -> Column:
        return let(chunk(acc["at"], F.slice("_spans", c * CHUNK + 1, CHUNK)), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(r["out"], ""))).alias("out")))

    turns = F.sequence(F.lit(0), ((F.size("_spans") - 1) / CHUNK).cast("int"))
    done = F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), grow, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.col("_spans").isNull(), text).otherwise(done)
    return joined.select(*((clean.alias("text") if c == "text" else docs[c]) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """The result columns of the registered query."""

    def told(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"), F.size(F.filter("spans", lambda s: s["kind"] == "context")).cast("long").alias("n_context"))
