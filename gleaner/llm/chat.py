"""Chat formatting of reply trees.

A message names the message it answers.  Paths from the roots to the leaves are
enumerated by iterative self-joins that double in reach: round i joins the table of
messages to itself, so that each message knows the one 2**i answers above it, and how
many messages and how much score lie on the way; log2 of the deepest path rounds are
enough.  The leaves then know their whole branch's depth and score, the best
``branches`` of a tree are kept, and the same tables of reaches, from the longest to
the shortest, unroll each chosen leaf into its path.  No array of a path is held, and
joins are on (tree, message); messages with very many answers meet them by a
broadcast of at most ``HUB_SHARE`` rows.

A branch's score is the mean of its messages' scores (null: 0); ties go to the longer
branch, then to the smaller leaf.  Each chosen path is one conversation, written as
pieces that end with a turn once they hold ``piece_chars`` characters, so that a task
holds one piece at a time; an ordinary conversation is one piece.

The template is ``<|turn|>role<|text|>text<|end|>`` a turn.  In roles and texts every
backslash is doubled, and a backslash follows the first character of each control
string (those of the template and those in ``CONTROL``), which makes none of
them appear in a formatted text but as a mark; taking backslashes away again gives the
exact text.  ``mask`` lists the spans of assistant texts, as code points of the piece.

Edge cases: a null text or role is empty; an answer to a message that is not there
is a root; rows that repeat a message are one (the smallest role and text); messages
that answer each other in a ring, and those below, have no root and are in no path;
rows without tree or message take no part; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HUB_SHARE, materialize, release, small_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Marks of this and of other common templates (fixed values).
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<pad>", "<unk>")
_KEY = ["tree", "message"]


def escape(text: Column) -> Column:
    """Text in which no control string stands; reversible."""
    marks = "|".join(re.escape(c) for c in CONTROL)
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), f"(?=(?:{marks}))([\\[<])", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _follow(rows: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """``rows`` with an ``up`` that ``table`` holds, and that row of it as ``t``."""
    held = table.select("tree", F.col("message").alias("up"), F.struct("up", "depth", "score").alias("t"))
    asked = rows.where("up is not null")
    busy = asked.groupBy("tree", "up").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(64, total // HUB_SHARE))
    hot = F.broadcast(held.join(F.broadcast(busy.drop("_n")), ["tree", "up"]).withColumnRenamed("t", "_hot"))
    told = asked.join(hot, ["tree", "up"], "left")
    cold = told.where("_hot is null").drop("_hot").join(held, ["tree", "up"])
    return cold.unionByName(told.where("_hot is not null").withColumnRenamed("_hot", "t"))


def _reaches(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(whole, steps): every message with a root and its branch's depth and score,
    and step i: (tree, message, up), the message 2**i answers above."""
    own = F.min(F.struct(F.col("parent").alias("up"), F.col("score")))
    rows = messages.where("tree is not null and message is not null").groupBy(*_KEY).agg(own.alias("o"))
    rows = materialize(rows.select(*_KEY, "o.up", F.lit(1).alias("depth"), F.coalesce("o.score", F.lit(0.0)).cast("double").alias("score")), "chat-links")
    total = rows.count()
    # An answer to a message that is not there is a root.
    known = _follow(rows, rows, total).select(*_KEY, "up")
    first = rows.drop("up").join(known, _KEY, "left").select(*_KEY, "up", "depth", "score")
    now, steps, left = materialize(first, "chat-reach"), [], None
    release(rows)
    while (open_ := now.where("up is not null").count()) and open_ != left:
        left = open_
        steps.append(now)
        far = _follow(now, now, total).select(*_KEY, F.col("t.up").alias("up"), (F.col("depth") + F.col("t.depth")).alias("depth"), (F.col("score") + F.col("t.score")).alias("score"))
        now = materialize(far.unionByName(now.where("up is null")), "chat-reach")
    return now.where("up is null").drop("up"), [s.where("up is not null").select(*_KEY, "up") for s in steps]


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, message, depth): the messages of each tree's best
    ``branches`` paths (None: all, without rank), ``depth`` from 1 at the root.
    ``messages``: tree, message, parent, role, text, and score if there is one."""
    if "score" not in messages.columns:
        messages = messages.withColumn("score", F.lit(0.0))
    whole, steps = _reaches(messages)
    answered = (steps[0] if steps else whole.withColumn("up", F.lit(None).cast(whole.schema["message"].dataType)).where("false")).select("tree", F.col("up").alias("message")).distinct()
    leaves = whole.join(answered, _KEY, "left_anti").select("tree", F.col("message").alias("leaf"), (F.col("score") / F.col("depth")).alias("score"), "message", F.col("depth").cast("long").alias("depth"))
    # A tree's leaves are cut to the first ones before they move, so no tree is too large.
    turn = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "leaf"))
    best = leaves.withColumn("rank", F.lit(None).cast("int")) if branches is None else leaves.withColumn("rank", turn).where(F.col("rank") <= branches)
    out = materialize(best.select("tree", "leaf", "rank", "score", "message", "depth"), "chat-paths")
    for i in reversed(range(len(steps))):
        above = out.join(steps[i], _KEY).select("tree", "leaf", "rank", "score", F.col("up").alias("message"), (F.col("depth") - 2**i).alias("depth"))
        out = out.unionByName(materialize(above, "chat-paths"))
    return out


def format_paths(messages: DataFrame, chosen: DataFrame, piece_chars: int = 1 << 20) -> DataFrame:
    """(tree, leaf, rank, score, piece, text, mask): ``chosen`` paths as conversations.
    The pieces of one are next to each other and in order."""
    small_batches(messages.sparkSession)
    said = messages.select(*_KEY, F.struct(escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("own")).alias("said"))
    rows = chosen.join(said.groupBy(*_KEY).agg(F.min("said").alias("said")), _KEY)
    dealt = rows.select("tree", "leaf", "rank", "score", "depth", "said.*").repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "depth")
    kind = {c: chosen.schema[c].dataType.simpleString() for c in ("tree", "leaf")}

    def run(batches):
        key, piece, parts, mask, size = None, 0, [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [*(pa.array([v], t) for v, t in zip(key, types, strict=True)), pa.array([piece], pa.int32()), pa.array(["".join(parts)]), pa.array([mask], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["tree", "leaf", "rank", "score", "piece", "text", "mask"],
            )

        for batch in batches:
            types = [f.type for f in batch.schema][:4]
            for tree, leaf, rank, score, _, role, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is not None and (key[:2] != (tree, leaf) or size >= piece_chars):
                    yield flush()
                    piece, parts, mask, size = piece + 1 if key[:2] == (tree, leaf) else 0, [], [], 0
                key = tree, leaf, rank, score
                head = f"{TURN}{role}{TEXT}"
                parts += [head, text, END]
                if own:
                    mask.append({"start": size + len(head), "end": size + len(head) + len(text)})
                size += len(head) + len(text) + len(END)
        if key is not None:
            yield flush()

    return dealt.mapInArrow(run, f"tree {kind['tree']}, leaf {kind['leaf']}, rank int, score double, piece int, text string, mask array<struct<start:long,end:long>>")


_READ = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _READ.findall(text)]


def digest(formatted: DataFrame) -> DataFrame:
    """(tree, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars),
    read back from the formatted pieces as they come."""
    names = ["tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        key, held = None, None

        def told():
            n, said, chars, lost, size = held
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key, types, strict=True)), *(pa.array([v]) for v in (n, said.hexdigest(), chars, lost.hexdigest(), size))], names=names)

        for batch in batches:
            types = [f.type for f in batch.schema][:2]
            for tree, leaf, text, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (tree, leaf):
                    if key is not None:
                        yield told()
                    key, held = (tree, leaf), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns(text):
                    held[0] += 1
                    held[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in mask:
                    lost = unescape(text[span["start"] : span["end"]])
                    held[2] += len(lost)
                    held[3].update(lost.encode("utf-8", "surrogatepass"))
                held[4] += len(text)
        if key is not None:
            yield told()

    kind = {c: formatted.schema[c].dataType.simpleString() for c in ("tree", "leaf")}
    return formatted.select("tree", "leaf", "text", "mask").mapInArrow(run, f"tree {kind['tree']}, leaf {kind['leaf']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations as trees without branches: each row, in order of turn (ties: role,
    then a 128-bit digest of the text, so that joins of links need not carry texts),
    answers the row before it.  Rows that repeat are turns of their own."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "_h", "_g")
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), "turn", "role", "text", F.xxhash64("text").alias("_h"), F.xxhash64(F.lit(1), "text").alias("_g"))
    placed = rows.withColumn("message", F.row_number().over(order).cast("long"))
    return placed.select("tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text")
