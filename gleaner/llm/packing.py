"""Packing token sequences: concatenate and cut.

Pass one tokenizes every document once, appends the separator id and notes, per
partition, each document's offset and the partition's total.  A prefix sum over
the partition totals gives every document its global offset.  Pass two cuts the
stream at multiples of the window; a document across a boundary leaves one
record in either window.  All sequences but the last are full.

Ids are those of the ``tokenizers`` file.  Byte-level BPE splits a text into
pieces that never reach from a non-space over a following space, so a text is
encoded word by word (each with the space before it) through a bounded cache;
texts where white space precedes a space, or that hold a special token's
string, go through the ``tokenizers`` library whole.

Edge cases: null or empty texts are the separator alone; a null doc_id stays
null; repeated rows are packed each; a text of any length is cut into as many
pieces as it needs; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches

WINDOW = 1024
SEPARATOR = 0
_CACHE = 400_000
#: Encoders of this Python worker, by (file, words); kept from task to task.
_ENCODERS: dict = {}


class WordCache(dict):
    """word -> its ids as bytes, for words that follow a space."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHE:
            self.clear()
        ids = np.array(self.encode(" " + word), np.uint32).tobytes()
        if len(word) <= 40:
            self[word] = ids
        return ids


class Encoder:
    """Ids of a tokenizers file, quickly, where it is byte-level BPE without
    normalisation and a rank file of the same vocabulary lies beside it."""

    def __init__(self, tokenizer_file: str, ranks_file: str | None, pattern: str | None):
        self.file, self._library = tokenizer_file, None
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.slow = re.compile("|".join([r"\s ", *map(re.escape, special)]))
        self.words = None
        if ranks_file and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] and spec.get("normalizer") is None:
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.words = WordCache(self.plain)

    def library(self, text: str) -> list[int]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.file)
        return self._library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        if self.words is None or self.slow.search(text):
            return np.array(self.library(text), np.uint32)
        first, *rest = text.split(" ")
        head = np.array(self.plain(first), np.uint32).tobytes()
        return np.frombuffer(head + b"".join(map(self.words.__getitem__, rest)), np.uint32)


def encoder(tokenizer: str) -> Encoder:
    """The encoder of a public tokenizer file, by name."""
    if tokenizer not in _ENCODERS:
        import public_tokenizers as public

        ranks = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}.get(tokenizer)
        _ENCODERS[tokenizer] = Encoder(public.path(tokenizer), ranks and public.path(ranks), public.PATTERN)
    return _ENCODERS[tokenizer]


def tokenize(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(part, first, doc_id, n_tokens, ids): the ids (little-endian unsigned, two
    bytes where they fit) with the separator, and ``first``, the number of ids
    before them in their partition.  Written to the shared folder, so offsets
    and ids stay the same in later passes."""
    small_batches(docs.sparkSession)

    def run(batches):
        enc, part, first = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([SEPARATOR], np.uint32)
        for batch in batches:
            for rows in slices(batch, 1):
                ids = [np.concatenate([enc.ids(t or ""), end]) for t in rows.column(1).to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(ids), part, np.int32)), "first": first + np.cumsum(sizes) - sizes, "doc_id": rows.column(0), "n_tokens": sizes,
                    "wide": pa.array([bool(x.max() > 0xFFFF) for x in ids]), "ids": pa.array([x.tobytes() if x.max() > 0xFFFF else x.astype("<u2").tobytes() for x in ids], pa.binary()),
                })
                first += int(sizes.sum())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "part int, first long, doc_id long, n_tokens long, wide boolean, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): a row per
    piece; ``ids`` holds its token ids as little-endian unsigned 32-bit."""
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, tokenizer), "pack-tokens")
    # One number per partition of the input.
    totals = tokens.groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("n")).orderBy("part").collect()
    bases, base = {}, 0
    for r in totals:
        bases[r.part] = base
        base += r.n
    shared = spark.sparkContext.broadcast(bases)

    def cut(batches):
        bases = shared.value
        for batch in batches:
            for rows in slices(batch, 5):
                out = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
                for part, first, doc, n, wide, ids in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    ids = np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4")
                    at, start = bases[part] + first, 0
                    while start < n:
                        take = min(n - start, window - (at + start) % window)
                        for k, v in zip(out, (doc, start, take, n, (at + start) // window, (at + start) % window, ids[start : start + take].tobytes()), strict=True):
                            out[k].append(v)
                        start += take
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})

    return tokens.select("part", "first", "doc_id", "n_tokens", "wide", "ids").mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def pieces(packed: DataFrame) -> DataFrame:
    """The result columns of the registered query: ids as their CRC-32."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc_of(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
