"""Every named query with an SQL twin gives the same rows in DuckDB."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    yield c
    c.close()


def test_names():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    cur = con.execute(SQL[name])
    heads = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert sorted(heads) == cols
    want = [tuple(r[heads.index(c)] for c in cols) for r in cur.fetchall()]
    got = [tuple(r[c] for c in cols) for r in df.collect()]

    def key(row):
        return tuple((x is None, str(x)) for x in row)

    assert sorted(got, key=key) == sorted(want, key=key)
