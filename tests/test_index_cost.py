"""What queries write and exchange when they are the first to read an index."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_shards import moved

from evidencelake.functions import text as T
from evidencelake.functions.split import alphabet
from evidencelake.operators.index import Index, write
from evidencelake.plans import QUERIES


def opened(spark, path, docs):
    """An index of docs below path, and the names of the tables of it that are written so far."""
    made = []

    def folder(own, name):
        if name not in made:
            write(own, docs, name, f"{path}/{name}")
            made.append(name)
        return f"{path}/{name}"

    return Index(spark, None, made=folder), made


def test_scores_need_the_lists_alone(spark, tmp_path):
    texts = {1: "one two two", 2: None, 3: "two three", 4: "", 5: "four"}
    own, made = opened(spark, str(tmp_path), spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3))
    got = {r.doc_id: (r.score, r.n_terms) for r in own.scores(["two", "one", "nowhere"]).collect()}
    assert made == ["lists"]

    def adds(df, tf, dl):  # of five texts with six tokens
        return max(math.log((5 - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (6 / 5)))

    assert got == {1: (pytest.approx(adds(2, 2, 3) + adds(1, 1, 3)), 2), 3: (pytest.approx(adds(2, 1, 2)), 1)}
    assert own.scores(["nowhere"]).collect() == []


@pytest.mark.parametrize("name", ["bm25_all_terms", "rrf_fusion"])
def test_ranking_by_some_terms_exchanges_no_other_terms(spark, tmp_path, name):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(100)) + " of the with les") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = moved(spark)
    assert QUERIES[name](spark, str(tmp_path)).count() == 40
    assert moved(spark) - before < 1000


def test_a_checked_index_needs_no_lists(spark, tmp_path):
    words = [(1, "é" * 13_000), (2, None), (3, "ab " * 5000), (4, "a" * 5999 + "\u0301" * 9000 + "b c"), (5, "a" * 6000 + "\n" + "b" * 6000), (6, "\u0301" * 7000), (7, "a" * 6000), (8, "b d")]
    docs = spark.createDataFrame(words, "doc_id long, text string").coalesce(1)
    own, made = opened(spark, str(tmp_path), docs)
    checked = own.checked().first()
    assert checked.consistent and checked.notes == 8 and checked.records == checked.lengths == own.records.count()
    assert not {"lists", "terms"} & set(made)
    want = {r.doc_id: r.n for r in docs.select("doc_id", F.size(T.tokens(F.col("text"))).alias("n")).collect()}
    assert {r.doc_id: r.dl for r in own.table("text_lengths").collect()} == want
    assert own.manifest.first().avgdl == pytest.approx(sum(want.values()) / 8)


def test_tokens_that_are_cut_are_one_of_their_text(spark):
    rng = random.Random(3)
    marks = "aZ0e\u0301 \n-\u0130\u03a3\u0307"
    pieces = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 4))) for _ in range(900)]
    many = []
    while sum(many) < len(pieces):
        many.append(min(rng.randint(1, 5), len(pieces) - sum(many)))
    ends = np.cumsum(many).tolist()
    texts = ["".join(pieces[e - n : e]) for e, n in zip(ends, many, strict=True)]
    tokens, counts, whole = alphabet(spark).split_pieces(pa.array(pieces), np.array(many))
    assert (tokens, counts.tolist()) == (lambda x: (x[0], x[1].tolist()))(alphabet(spark).split(pa.array(pieces)))
    assert whole.tolist() == alphabet(spark).split(pa.array(texts))[1].tolist()
