"""Stems against the published examples and against SQLite's stemmer, over all terms of the documents; the search over stems."""

import sqlite3

import duckdb
import pytest

from evidencelake.functions.stems import stem
from evidencelake.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Examples of the publication (fixed values).
PAIRS = (
    "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan "
    "falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit conformabli conform radicalli radic differentli differ "
    "vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit "
    "sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin "
    "gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ "
    "angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll"
).split()


@pytest.fixture(scope="module")
def lite():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE d USING fts5(body, tokenize='porter unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search in this SQLite")
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    con.executemany("INSERT INTO d(rowid, body) VALUES (?, ?)", [(i, x or "") for i, x in rows])
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(d, 'row')")
    return con


def test_published_examples():
    assert [(w, stem(w)) for w in PAIRS[::2]] == list(zip(PAIRS[::2], PAIRS[1::2], strict=True))
    assert [stem(w) for w in ("", "as", "is", "été", "x2s", "y", "yes", "skies")] == ["", "as", "is", "été", "x2s", "y", "ye", "ski"]


def test_all_terms_stem_as_in_sqlite(lite):
    words = [r[0] for r in duckdb.sql(f"SELECT DISTINCT unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z]+')) FROM '{FOLDER}/documents.parquet'").fetchall()]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE d USING fts5(body, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(d, 'instance')")
    words += PAIRS + "controlling rolled hoping hopped bleed agreeing ion onion nation stations ties dies dyed saying boxes fully skis news ability abilities generously logically psychologies".split()
    con.executemany("INSERT INTO d(rowid, body) VALUES (?, ?)", list(enumerate(words)))
    want = dict(con.execute("SELECT doc, term FROM v").fetchall())
    wrong = {w: (stem(w), want[k]) for k, w in enumerate(words) if stem(w) != want[k]}
    assert len(words) > 5000 and wrong == {}


def test_porter_search_ranks_as_sqlite(spark, lite):
    from evidencelake.plans import prompts
    from evidencelake.plans.base import Tables

    got = {}
    for r in QUERIES["porter_search"](spark, FOLDER).collect():
        got.setdefault(r.conv_id, []).append((r.rank, r.doc_id, r.score))
    asked = {}
    for r in prompts._asked(Tables(spark, FOLDER)).collect():
        asked.setdefault(r.conv_id, set()).add(r.term)
    assert got.keys() <= asked.keys()
    for conv, terms in asked.items():
        one = {stem(x): x for x in terms}  # two words of one stem count once
        match = " OR ".join(f'"{x}"' for x in one.values())
        want = lite.execute("SELECT rowid, round(-bm25(d), 6) FROM d WHERE d MATCH ? ORDER BY 2 DESC, 1 LIMIT 3", [match]).fetchall()
        mine = [(d, s) for _, d, s in sorted(got.get(conv, []))]
        assert [d for d, _ in mine] == [d for d, _ in want] and [s for _, s in mine] == pytest.approx([s for _, s in want], abs=2e-6)
