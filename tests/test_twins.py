"""Every registered query against its SQL twin on the smallest test tables."""

import os

import duckdb
import pytest

from plantgauge.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.001")
TABLES = "lineitem part events embeddings labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


def settled(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(ORACLES[name])
    got = settled(df.columns, [tuple(r) for r in df.collect()])
    assert got == settled([d[0] for d in cur.description], cur.fetchall())


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
