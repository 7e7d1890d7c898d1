"""Operators that fold rows in order or go on in rounds, against plain loops."""

import math
import random

from pyspark.sql import functions as F

from evidencelake.operators import evals, graph, index, memory, routing


def candidate(n, path="p", mandatory=False, superseded=False, historical=False, hash_=None, logical=None):
    return {"n": n, "path": path, "mandatory": mandatory, "superseded": superseded, "historical": historical, "hash": hash_ or str(n), "logical": logical or str(n)}


def test_chosen_keeps_quotas_and_drops_repeats(spark):
    def chosen(cases, limit):
        rows = [(q, r["n"], k, r["path"], r["logical"], r["hash"], r["mandatory"], r["superseded"], r["historical"]) for q, listed in enumerate(cases) for k, r in enumerate(listed)]
        table = spark.createDataFrame(rows, "q int, id long, rank int, path string, logical string, hash string, mandatory boolean, superseded boolean, historical boolean")
        out = {q: [] for q in range(len(cases))}
        for r in routing.chosen(table, ["q"], limit).orderBy("q", "place").collect():
            out[r.q].append(r.id)
            assert r.place == len(out[r.q])
        return list(out.values())

    must = [candidate(k, f"m{k}", mandatory=True, superseded=k == 0) for k in range(5)]
    others = [candidate(10 + k, "x") for k in range(9)]
    old = [candidate(30, "h", historical=True), candidate(31, "h", historical=True, hash_="10"), candidate(32, "h", historical=True)]
    again = [candidate(1, "a", hash_="same", logical="1"), candidate(2, "b", hash_="same"), candidate(3, "c", logical="1"), candidate(4, "d")]
    six = [candidate(k, "h", historical=True) for k in range(6)]
    left_out = [*[candidate(k, f"m{k}", mandatory=True) for k in range(4)], *[candidate(10 + k, f"m{k}") for k in range(8)]]
    skipped = [candidate(1, "a", hash_="h1", logical="l1"), candidate(2, "b", hash_="h1", logical="l2"), candidate(3, "c", hash_="h2", logical="l2")]
    got = chosen([[*must, *others, *old], again, six, left_out, skipped, [candidate(1, mandatory=True), candidate(2, mandatory=True)]], 10)
    # Two places are kept back, 8 - 6 = 2 would be left for five mandatory ones, but three is the floor; the superseded one is
    # last; four of a path; of the first two historical ones the repeated text goes.
    assert got[0] == [1, 2, 3, 10, 11, 12, 13, 30]
    assert got[1] == [1, 4] and got[2] == [0, 1]
    assert got[3] == [0, 1, 2, 3, 10, 11, 12, 13, 14, 15]  # rows of a mandatory path are passed over for content or name alone
    assert got[4] == [1, 3] and got[5] == [1]  # what was passed over blocks nothing; the first of a mandatory path


def test_strong_components_against_reachability(spark):
    rng = random.Random(1)
    for size, many in ((12, 14), (30, 45), (8, 30), (5, 0)):
        pairs = {(rng.randrange(size), rng.randrange(size)) for _ in range(many)}
        reach = {n: {n} for n in range(size)}
        for _ in range(size):
            for a, b in pairs:
                for n in range(size):
                    if a in reach[n]:
                        reach[n] |= reach[b]
        want = {n: min(m for m in reach[n] if n in reach[m]) for n in range(size) if any(m != n and n in reach[m] for m in reach[n])}
        got = graph.strong_components(spark.createDataFrame(sorted(pairs), "src long, dst long"))
        assert {r.node: r.cycle for r in got.collect()} == want


def test_heads_of_chains_forks_and_rings(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 5), (60, 61), (61, 60)]  # id, target
    got = memory.heads(spark.createDataFrame(edges, "id long, target long")).collect()
    want = {(k, 40) for k in range(40)} | {(k, 100) for k in range(6)}
    assert {(r.target, r.id) for r in got} == want


def test_nearest_rank_against_sorting(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.random() * 10, float(rng.randrange(3)), None])) for g in ("a", "b") for _ in range(500)] + [("c", 4.0)]
    shares = [0.01, 0.5, 0.95, 1.0]
    got = evals.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares).collect()
    want = set()
    for g in "abc":
        own = sorted(v for h, v in rows if h == g and v is not None)
        want |= {(g, p, own[max(1, math.ceil(p * len(own))) - 1]) for p in shares}
    assert {(r.g, r.p, r.value) for r in got} == want


def test_verbatim_against_contains(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "cd", "ef", "gh\nij"]) for _ in range(60)) for _ in range(20)]
    claims = [t[a : a + n] for t in texts[:8] for a, n in ((3, 40), (10, 9), (0, 25))] + ["not there at all in any of them"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed = spark.createDataFrame(list(enumerate(claims)), "item_id long, claim string")
    want = {(i, d, t.index(c) + 1, len(c)) for i, c in enumerate(claims) for d, t in enumerate(texts) if c in t}
    assert {tuple(r) for r in evals.verbatim(docs, listed, "doc_id", "item_id").collect()} == want


def test_an_update_equals_a_new_index(spark):
    docs = spark.createDataFrame([(k, f"text {k}\n" * (k * 400)) for k in range(6)], "doc_id long, text string")
    old = index.records(docs.filter("doc_id <> 2").withColumn("text", F.when(F.col("doc_id") == 3, "changed").otherwise(F.col("text"))).union(spark.createDataFrame([(9, "gone")], "doc_id long, text string")))
    rows, plan = index.updated(old, docs)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, index.records(docs).collect()))
    assert plan.first().asDict() == {"kept": 4, "rewritten": 2, "gone": 1, "full": False}


def test_a_step_that_reaches_too_many_nodes_is_undone(spark):
    links = spark.createDataFrame([(0, k, 0.5) for k in range(1, 11)], "src long, dst long, rel double")
    degree = spark.createDataFrame([(0, 10)] + [(k, 1) for k in range(1, 11)], "node long, degree long")
    seeds = spark.createDataFrame([(0, 1.0)], "node long, activation double")
    assert graph.spread_traced(seeds, links, degree, 2, most=10).count() == 1
    got = {r.node: (round(r.activation, 6), r.via) for r in graph.spread_traced(seeds, links, degree, 1, most=11).collect()}
    assert len(got) == 11 and got[3] == (0.1, "0>3")
