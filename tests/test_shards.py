"""Tokens of Arrow columns against the column expression; the search over shards against a plain loop; what it moves."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.functions.split import alphabet
from evidencelake.operators import index, shards, topk

WORDS = [f"w{k}" for k in range(60)] + ["Été", "naïve", "ΣΑΣ", "x́y", "日本"]


def moved(spark):
    """Rows that all stages so far have sent to others."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_split_gives_the_tokens_of_the_expression(spark):
    rng = random.Random(1)
    marks = "aZ0é́ \n-_'ßİıΣſﬁ日กิ़𝔸 ²½\U0001f600‍"
    texts = [None, "", "ab", "cd", " x", "́", *("".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(300))]
    want = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").orderBy("k").select(T.tokens(F.col("x"))).collect()]
    tokens, counts = alphabet(spark).split(pa.array(texts, pa.string()))
    tokens, got = tokens.to_pylist(), []
    for n in counts.tolist():
        got, tokens = [*got, tokens[:n]], tokens[n:]
    assert got == want and not tokens
    part, n = alphabet(spark).split(pa.array(texts, pa.string()).slice(7, 90))
    assert n.tolist() == [len(x) for x in want[7:97]] and part.to_pylist() == [w for x in want[7:97] for w in x]


def _notes(rng, n):
    say = lambda k: " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(len(WORDS))], k=k))
    return {k * 3 - 50: "\n".join(say(rng.randint(0, 30)) for _ in range(rng.randint(0, 3))) if k % 17 else (say(40) + "\n") * 60 for k in range(n)}


def _plain(lists, asked, k, allowed):
    """lists: (note, chunk) -> tokens."""
    n, avg = len(lists), sum(map(len, lists.values())) / len(lists)
    df = Counter(t for x in lists.values() for t in set(x))
    out = {}
    for q, terms in asked.items():
        best = {}
        for (note, _), x in lists.items():
            tf = Counter(x)
            has = [t for t in set(terms) if tf[t]]
            if has and note in allowed:
                score = sum(max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(x) / avg)) for t in has)
                old = best.get(note, (0, 0))
                best[note] = max(old[0], score), max(old[1], len(has))
        rows = sorted((-round(s, 6), note, m) for note, (s, m) in best.items())[:k]
        out[q] = [(note, pytest.approx(-s, abs=2e-6), m) for s, note, m in rows]
    return {q: x for q, x in out.items() if x}


@pytest.mark.parametrize("some", [False, True])
def test_top_notes_equal_a_plain_loop_over_many_shards_and_blocks(spark, tmp_path, monkeypatch, some):
    rng = random.Random(5)
    notes = _notes(rng, 160)
    for name, value in (("SHARD", 300), ("RECORDS", 40), ("SLICE", 7), ("BLOCK", 9)):
        monkeypatch.setattr(shards, name, value)
    docs = spark.createDataFrame(sorted(notes.items()), "doc_id long, text string").repartition(3)
    index.build(docs, f"file://{tmp_path}/i")
    own = index.Index(spark, f"file://{tmp_path}/i")
    assert own.shards.count() > 12
    lists = {(r.doc_id, r.chunk): r.all for r in own.records.select("doc_id", "chunk", T.tokens(F.col("content")).alias("all")).collect()}
    assert max(c for _, c in lists) > 0
    folded = sorted({t for x in lists.values() for t in x}) + ["nowhere"]
    asked = {q: rng.sample(folded, rng.randint(1, 12)) for q in range(40)}
    rows = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "q int, term string")
    allowed = {k for k in notes if not some or k % 2}
    only = spark.createDataFrame([(k,) for k in allowed], "doc_id long") if some else None
    got = {}
    for r in topk.top_notes(own, rows, 4, "q", only).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.doc_id, r.score, r.n_terms))
    assert got == _plain(lists, asked, 4, allowed)


def test_common_terms_move_k_rows_a_query_and_not_one_for_each_note(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"alpha beta gamma d{k}") for k in range(600)], "doc_id long, text string")
    index.build(docs, f"file://{tmp_path}/i")
    own = index.Index(spark, f"file://{tmp_path}/i")
    asked = spark.createDataFrame([(q, t) for q in range(60) for t in ("alpha", "beta", f"d{q}")], "q int, term string")
    before = moved(spark)
    assert [(r.q, r.doc_id) for r in topk.top_notes(own, asked, 1, "q").orderBy("q").collect()] == [(q, q) for q in range(60)]
    assert moved(spark) - before < 600 * 60 / 4


def test_building_the_index_does_not_exchange_postings(spark, tmp_path):
    docs = spark.createDataFrame([(k, " ".join(f"t{(k * 7 + j) % 50}" for j in range(50))) for k in range(400)], "doc_id long, text string")
    before = moved(spark)
    index.build(docs, f"file://{tmp_path}/i")
    assert moved(spark) - before < 400 * 50 / 4


def test_pages_found_equal_a_plain_loop(spark):
    from evidencelake.plans import packets, prompts
    from evidencelake.plans.base import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    asked, lines = prompts._asked(t), packets._lines(t)
    terms, rows, want = {}, lines.collect(), set()
    for r in asked.collect():
        terms.setdefault(r.conv_id, set()).add(r.term)
    for conv, ts in terms.items():
        pages, best = {}, {}
        for r in rows:
            if has := ts & set(r.words):
                pages.setdefault(r.path, set()).update(has)
                best[r.path] = max(best.get(r.path, (0, 0)), (len(has), -r.lo))
        want |= {(conv, p, -best[p][1], float(len(pages[p]))) for p in sorted(pages, key=lambda p: (-len(pages[p]), p))[:3]}
    assert {tuple(r) for r in packets._found(packets._shards(t), lines, asked).collect()} == want and want
