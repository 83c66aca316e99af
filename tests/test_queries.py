"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math

import duckdb
import pytest

from gneiss import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    return str(v)


def same(spark, sf, name, query, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(names)
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall())
    ours = sorted(tuple(plain(row[c]) for c in sorted(names)) for row in df.collect())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf, name):
    same(spark, sf, name, registry.QUERIES[name], registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
