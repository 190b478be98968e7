"""Every registered query of the segment engine that SQL can express, against DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

import cadenza.plans  # noqa: F401
from cadenza.plans.catalogue import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES.split():
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5)
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, sf_dir, con, name):
    df = queries()[name](spark, sf_dir)
    got = df.collect()
    cur = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs_without_sql(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0
