"""Folding and tokens, letter by letter."""

import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from evidencelake.functions import text as T

ALL = [n for n in range(1, 0x110000) if not 0xD800 <= n <= 0xDFFF]


def test_every_code_point_folds_as_lower_case_without_accents(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?::INTEGER[]) AS c", [ALL])
    want = dict(con.execute("SELECT c, strip_accents(lower(chr(c))) FROM t").fetchall())
    rows = spark.createDataFrame([(n, chr(n)) for n in ALL if chr(n) in T.MARKED or n < 0x3000 or n % 97 == 0], "n int, c string")
    got = {r.n: r.f for r in rows.select("n", T.fold(F.col("c")).alias("f")).collect()}
    assert {chr(n): f for n, f in got.items() if f != want[n]} == {}
    # What is not in the table folds to itself, there as here.
    table = set(T.MARKED)
    assert [n for n in ALL if chr(n) not in table and want[n] != chr(n)] == []


@pytest.mark.parametrize(
    ("said", "folded"),
    [
        ("où Žižek Łódź šťastný řeka ğül ýÿ", "ou zizek łodz stastny reka gul yy"),
        ("ÀÉÎÕÜ ø Ø æ ß ẞ", "aeiou ø ø æ ß ß"),
        ("İzmir IŞIK ılık", "izmir isik ılık"),
        ("e\u0301te\u0301 nai\u0308ve", "ete naive"),
        ("Ελλάς ΟΔΟΣ Ϋ", "ελλας οδοσ υ"),
        ("Ёлка Й ЩЁ", "елка и ще"),
        ("ﬁn ＡＢ ①", "ﬁn ａｂ ①"),
    ],
)
def test_words_of_several_scripts(spark, said, folded):
    row = spark.createDataFrame([(said,)], "x string").select(T.fold(F.col("x")).alias("f"), T.tokens(F.col("x")).alias("t")).first()
    assert row.f == folded and row.t == folded.split()
    assert duckdb.execute("SELECT strip_accents(lower(?))", [said]).fetchone()[0].replace("ς", "σ") == folded.replace("ς", "σ")


def test_the_table_is_one_to_one():
    assert len(T.PLAIN) < len(T.MARKED) == len(set(T.MARKED))
    assert all(unicodedata.category(c)[0] == "M" for c in T.MARKED[len(T.PLAIN) :])
