"""Every registered query of the media part against DuckDB over the same tables."""

import os

import duckdb
import pytest

from cuemill.jobs import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows):
    return sorted(tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    if name in catalog.ORACLE_SQL:
        expected = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(expected.columns) == columns
        assert plain(got) == plain(expected.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    else:
        assert got
