"""Queries over whole tables, and their operators beyond the sizes that the tables have."""

from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import evals
from evidencelake.plans import QUERIES


def test_supersession_covers_orders_of_any_id_and_line(spark, tmp_path):
    # 2 <- 3, 4, 5 and 200000 <- 200001 .. 200003: ids beyond any cap, no line 1, repeated lines.
    rows = [(k, line) for k in (2, 3, 4, 5, 200_000, 200_001, 200_002, 200_003) for line in (2, 2, 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    in_force = [r.id for r in QUERIES["supersession_in_force"](spark, str(tmp_path)).collect()]
    assert sorted(in_force) == [3, 4, 5, 200_001, 200_002, 200_003]
    forks = {r.target: r.successors for r in QUERIES["supersession_forks"](spark, str(tmp_path)).collect()}
    assert forks == {2: 3, 200_000: 3}


def test_sign_test_of_any_count(spark):
    def exact(w, losses):
        n = w + losses
        return min(1.0, float(Fraction(2 * sum(comb(n, i) for i in range(min(w, losses) + 1)), 2**n)))

    pairs = [(0, 0), (1, 0), (3, 4), (5, 5), (305, 195), (537, 538), (600, 600), (1000, 1100), (5000, 4800), (0, 1200)]
    rows = spark.createDataFrame(pairs, "w long, l long")
    got = {(r.w, r.l): r.p for r in rows.select("w", "l", evals.sign_test(F.col("w"), F.col("l")).alias("p")).collect()}
    assert got == {x: pytest.approx(exact(*x), rel=1e-9, abs=1e-300) for x in pairs}


def test_sign_test_sees_whole_counts(spark, tmp_path):
    texts = [("a", "x" * (2000 if k % 3 else 10)) for k in range(90)]
    spark.createDataFrame(texts, "source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.w, r.l) for r in QUERIES["sign_test"](spark, str(tmp_path)).collect()] == [(60, 30)]


def test_vector_similar_looks_for_every_hundredth(spark, tmp_path):
    rows = [(k, [1.0, 0.0] if k < 150 else [0.0, 1.0]) for k in range(0, 301, 50)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.query_id, r.vec_id, r.cosine) for r in QUERIES["vector_similar"](spark, str(tmp_path)).collect())
    near = [(0, 50, 100), (150, 200, 250, 300)]
    assert got == sorted((q, v, 1.0) for group in near for q in group if q % 100 == 0 for v in group)
