"""Each query of the library against its SQL in DuckDB on the smallest tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from evidencelake.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float | Decimal) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    a = sorted(str([plain(r[c]) for c in order]) for r in got.collect())
    b = sorted(str([plain(r[columns.index(c)]) for c in order]) for r in want.fetchall())
    assert a == b


def test_every_query_has_sql_but_those_that_other_tests_hold():
    assert set(QUERIES) - set(ORACLES) == {"porter_search", "linked_packet"} and set(ORACLES) <= set(QUERIES)
