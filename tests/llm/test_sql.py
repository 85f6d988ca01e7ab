import duckdb
import pytest

from tessera.llm import registry


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS FROM '{small}/{table}.parquet'")
    df = registry.queries()[name](spark, small)
    columns = sorted(df.columns)
    found = con.execute(registry.oracle_sql()[name])
    assert sorted(d[0] for d in found.description) == columns
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    key = lambda row: [(v is not None, str(v)) for v in row]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted(want, key=key)
