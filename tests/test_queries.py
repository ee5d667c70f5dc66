"""Every cheap registered query against its DuckDB oracle."""

import duckdb
import pytest

import __spark_entry__ as entry
from gleaner import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose smallest table has no row to show.
LARGER = {"profile_link", "record_detect", "wrapper_elimination", "entity_match"}


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_oracle(spark, sf, name):
    if name in LARGER:  # the smallest tables have no nation with three suppliers
        sf = sf.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert mine == theirs and mine


def test_entry_is_registered():
    assert "page_name" in entry.queries()
