"""Every query with SQL gives the rows of that SQL; the others run."""

from pathlib import Path

import duckdb
import pytest

from parchment.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name not in SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    assert rows(got) == rows(con.sql(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
