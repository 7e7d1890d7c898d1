"""The operators that SQL can express, against it."""

from pathlib import Path

import duckdb
import pytest

from evidencelake.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_operator_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == columns
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    a = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    frame = con.execute(ORACLES[name]).to_arrow_table().to_pylist()
    assert a == sorted(str([plain(r[c]) for c in columns]) for r in frame)
