import duckdb
import pytest

from bytetree.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def cells(rows):
    return sorted((tuple(x if x is None or isinstance(x, (str, bool)) else round(float(x), 6) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    got = queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = got.select(*cols).collect()
    assert rows
    if name in oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages"):
            con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
        assert cells(map(tuple, rows)) == cells(con.sql(oracle_sql()[name]).select(*cols).fetchall())
