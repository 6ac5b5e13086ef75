"""The corpus queries that have an SQL twin give the same rows."""

import duckdb
import pytest

from keepwell.llm import queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'").fetchall()
    df = queries.QUERIES[name](spark, sf_dir)
    cur = con.execute(queries.ORACLE_SQL[name])
    heads = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert sorted(heads) == cols
    want = [tuple(r[heads.index(c)] for c in cols) for r in cur.fetchall()]
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
