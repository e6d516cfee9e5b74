"""The llm queries that have SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from legajo.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    res = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in res.description]
    df = queries.QUERIES[name](spark, DATA)
    assert set(columns) == set(df.columns)
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(df.select(*columns).collect()) == plain(res.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
