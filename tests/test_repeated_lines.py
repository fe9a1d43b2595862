"""Order lines that agree in key, line, position and CIGAR, against the SQL."""

import os

import duckdb
import pytest

from linkloom import catalog

DATA = "/root/testdata/sf0.001"
NAMES = ["P5_cigar_ops", "P7_read1_position", "P8_first_match", "J1_alignments", "A2_barcode_positions"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The smallest tables, a tenth of the order lines twice and some three times, with another part and supplier."""
    folder = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    again = "SELECT * REPLACE (l_partkey + 2000 AS l_partkey, l_suppkey + 1 AS l_suppkey) FROM lines WHERE l_orderkey % {} = 1"
    con.execute(f"COPY (WITH lines AS (SELECT * FROM '{DATA}/lineitem.parquet') SELECT * FROM lines UNION ALL {again.format(10)} UNION ALL {again.format(30)}) TO '{folder}/lineitem.parquet'")
    con.execute(f"COPY (FROM '{DATA}/orders.parquet') TO '{folder}/orders.parquet'")
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_lines_alike_count_as_in_the_sql(spark, tables, name):
    folder, db = tables
    rows = catalog.queries()[name](spark, folder)
    want = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, rows.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
