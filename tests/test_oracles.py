"""Every core query on the smallest tables against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from pagemill.plans.queries import QUERIES, SQL


def cell(v):
    return "None" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, db, name):
    df = QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    told = db.execute(SQL[name])
    cols = [c[0] for c in told.description]
    assert sorted(cols) == names
    assert got == sorted(tuple(cell(r[cols.index(c)]) for c in names) for r in told.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
