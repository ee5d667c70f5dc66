"""CSV export: one distributed writer, and a single file or a ZIP per page for
results small enough to hand to a person."""

from __future__ import annotations

import io
import itertools
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Rows that a file made on the driver may hold.
MAX_ROWS = 200_000


def csv_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``csv``: the row as a CSV line in the order asked for; ValueError
    without columns."""
    if not columns:
        raise ValueError("an export needs field names")
    return df.withColumn("csv", T.csv_line(*(F.col(c).cast("string") for c in columns)))


def write_csv(df: DataFrame, columns: list[str], path: str, by_page: str | None = None, order: list[str] | None = None) -> None:
    """Text files of CSV lines as ``csv_rows`` makes them, each begun by a
    byte-order mark and the header and never without rows; a folder per page with
    ``by_page``, its rows ordered by ``order``."""
    from ..sources.stage import staged

    head = F.concat(F.lit("\ufeff"), T.csv_line(*map(F.lit, columns)), F.lit("\r\n"))
    keys = [by_page] if by_page else []
    rows = csv_rows(df, columns)
    if by_page:
        rows = rows.repartition(by_page)
    rows = staged(rows.sortWithinPartitions(*keys, *(order or [])).select(*keys, "csv", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    first = rows.groupBy("_part", *keys).agg(F.min("_at").alias("_at")).withColumn("_first", F.lit(True))
    told = rows.join(first, ["_part", "_at", *keys], "left").repartition("_part").sortWithinPartitions("_part", "_at")
    line = F.concat(F.when(F.col("_first"), head).otherwise(""), F.col("csv")).alias("value")
    out = told.select(*keys, line).write.option("lineSep", "\r\n")
    (out.partitionBy(by_page) if by_page else out).text(path)


def _document(header: str, lines) -> bytes:
    return ("\r\n".join([header, *lines]) + "\r\n").encode("utf-8-sig")


def _small(df: DataFrame, max_rows: int) -> None:
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows: use write_csv")


def _header(df: DataFrame, columns: list[str]) -> str:
    return df.sparkSession.range(1).select(T.csv_line(*map(F.lit, columns)).alias("h")).first().h


def csv_bytes(df: DataFrame, columns: list[str], order: list[str], max_rows: int = MAX_ROWS) -> bytes:
    """One file with a byte-order mark, read from the cluster row by row; for at
    most ``max_rows`` rows."""
    _small(df, max_rows)
    return _document(_header(df, columns), (r.csv for r in csv_rows(df, columns).orderBy(*order).select("csv").toLocalIterator()))


def zip_bytes(df: DataFrame, columns: list[str], page: str, order: list[str], max_rows: int = MAX_ROWS) -> bytes:
    """A ZIP with one {page}.csv per page, ascending, in one sorted pass; for at
    most ``max_rows`` rows."""
    _small(df, max_rows)
    header = _header(df, columns)
    out = io.BytesIO()
    rows = csv_rows(df, columns).orderBy(page, *order).select(page, "csv").toLocalIterator()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for key, held in itertools.groupby(rows, key=lambda r: r[0]):
            z.writestr(f"{key}.csv", _document(header, (r[1] for r in held)))
    return out.getvalue()
