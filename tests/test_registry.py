"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from linkloom import catalog

DATA = "/root/testdata/sf0.001"
#: Loops over documents' graphs, each a minute of small jobs here; their parts are tested in test_operators.
SLOW = {"G9_screened_chains", "G11_masked_nodes", "G5_document_forest"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query(spark, db, name):
    rows = catalog.queries()[name](spark, DATA)
    got = [[plain(r[c]) for c in sorted(rows.columns)] for r in rows.collect()]
    if name in catalog.oracle_sql():
        want = db.execute(catalog.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        assert sorted(rows.columns) == sorted(columns)
        order = [columns.index(c) for c in sorted(columns)]
        assert sorted(map(repr, got)) == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())
