"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog as C


#: White space of any script: what a regular expression's (?U)\s matches.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    """Without white space of any script at either end, which is all that is looked at."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim(c) == "")


def without_runs(c: Column) -> Column:
    """No format characters, runs of spaces and tabs as one space."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{Cf}", ""), r"[ \t]{2,}|\t", " ")


def clean_text(c: Column) -> Column:
    """No format characters, runs of spaces and tabs as one space, trimmed; line
    ends stay.  Character references were decoded when the page was shredded."""
    return trim(without_runs(c))


def signature_words(attrs: Column) -> Column:
    """class, id, data-testid and aria-label in one lower-case string."""
    parts = [F.coalesce(attrs[k], F.lit("")) for k in ("class", "id", "data-testid", "aria-label")]
    return F.lower(F.translate(F.concat_ws(" ", *parts), "-_", "  "))


def matches_token(text: Column, tokens: Column) -> Column:
    """Short tokens as whole words, longer ones anywhere; failing both, a word of
    four or more letters of any token as a whole word."""
    parts = F.split(F.array_join(tokens, " "), " ")

    def met(x: Column) -> Column:
        text, words = x["text"], x["words"]
        direct = F.exists(tokens, lambda t: F.when(F.length(t) <= 5, F.array_contains(words, t)).otherwise(text.contains(t)))
        return direct | F.arrays_overlap(F.filter(words, lambda w: F.length(w) >= 4), parts)

    # Text and words are worked out once, not once a token.
    told = once(text, lambda x: F.struct(x.alias("text"), F.split(x, " +").alias("words")))
    return F.coalesce(once(told, met), F.lit(False))


def without_number_lines(c: Column) -> Column:
    """Trimmed lines that are not numbers alone."""
    lines = F.filter(F.transform(F.split(c, "\n"), trim), lambda x: (x != "") & ~x.rlike(C.BARE_NUMBER))
    return F.array_join(lines, "\n")


def confidence_level(c: Column) -> Column:
    return F.when(c >= C.HIGH, "High").when(c >= C.MEDIUM, "Medium").when(c > 0, "Low").otherwise("None")


def international_phone(c: Column) -> Column:
    return trim(F.translate(c, "()", ""))


def job_folder(c: Column) -> Column:
    """A job id as a file name."""
    return F.when(is_blank(c), "job").otherwise(F.regexp_replace(c, r'[\x00-\x1f"<>|:*?\\/]', "_"))


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done / total * 100)).otherwise(0).cast("int")


def record_label(*values: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*(F.when(~is_blank(v), v) for v in values))


def challenge_marker(html: Column) -> Column:
    """The first marker of a challenge page in the first 20,000 characters."""
    head = F.lower(F.substring(html, 1, 20_000))
    return F.coalesce(*(F.when(head.contains(m), F.lit(m)) for m in C.CHALLENGE_MARKERS))


def csv_cell(c: Column) -> Column:
    """Quoted only where a comma, quote or line end asks for it."""
    return F.when(c.isNull(), "").when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *map(csv_cell, values))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]
