"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from weftline import catalog


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def shown(v):
    return None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, db, name):
    df = catalog.QUERIES[name](spark, data)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    found = db.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted([tuple(shown(r[c]) for c in order) for r in rows], key=str)
    theirs = sorted([tuple(shown(r[columns.index(c)]) for c in order) for r in found.fetchall()], key=str)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
