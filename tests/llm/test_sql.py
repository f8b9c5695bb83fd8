"""The text queries that SQL can say, on the smallest tables against DuckDB; the others run to their end there."""

from pathlib import Path

import duckdb
import pytest

from pagemill.llm.queries import SQL, queries


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, name):
    c = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = queries()[name](spark, small)
    told = c.execute(SQL[name])
    names = [x[0] for x in told.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[k] for k in names) for r in df.collect()))) == sorted(map(str, told.fetchall()))


def test_cuts_leave_other_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert queries()["p9_cut"](spark, small).count() == docs.count()
    kept = queries()["p6_kept_elements"](spark, small)
    assert 0 < kept.count() <= spark.read.parquet(f"{small}/visual_elements.parquet").count()
