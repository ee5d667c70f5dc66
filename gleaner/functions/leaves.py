"""Reading structured-data entities, held as maps of dotted paths to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, trim


def text_of(leaves: Column, path: str) -> Column:
    """The value at a path as text."""
    return leaves[path + "!"]


def list_text(leaves: Column, path: str) -> Column:
    """The distinct texts of the list at a path, joined; null if there is none."""
    return leaves[path + "*"]


def without_repeats(c: Column) -> Column:
    """Comma-separated parts, each once; unchanged if none repeats."""
    parts = F.filter(F.transform(F.split(c, ","), trim), lambda p: p != "")
    return F.when(F.size(F.array_distinct(parts)) < F.size(parts), F.array_join(F.array_distinct(parts), ", ")).otherwise(c)


def search(texts: Column, keys: list[str]) -> Column:
    """The first text under any of the keys; ``texts``: (key, value) in visiting
    order."""
    return F.try_element_at(F.filter(texts, lambda e: e["key"].isin(*keys)), F.lit(1))["value"]
