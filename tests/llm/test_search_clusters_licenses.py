"""Ranked search, ball trees and licence scans against brute force: odd rows, ties, empty tables, clashing names."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_edges import CLASH, SCHEMA, odd_rows

from evidencelake.llm import ball_tree, lexical, license_scan, license_texts
from evidencelake.llm.terms import Vocabulary, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_terms_and_vocabulary():
    rng = random.Random(1)
    texts = ["", "a", None, "Été-ÉTÉ", "ab", "cd", " x", "y ", "5a{b}|~ç", "\x00\x7f", *("".join(rng.choice("aB0 é-·") for _ in range(rng.randint(0, 9))) for _ in range(300))]
    t = terms(pa.array(texts, pa.string()))
    got = [(r, t.data[a:b].tobytes().decode()) for a, b, r in zip(t.starts, t.ends, t.row, strict=True)]
    want = [(r, w) for r, x in enumerate(texts) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", x or "")]
    assert got == want and t.per_row().tolist() == [len(TERM.findall(x or "")) for x in texts]
    names = ["a", "ab", "été", "b", "0"]
    found = Vocabulary(names).find(t)
    assert [names[k] if k >= 0 else None for k in found] == [low(w) if low(w) in names else None for _, w in want]
    part = terms(pa.array(texts, pa.string()).slice(3, 4))
    assert part.rows == 4 and len(part.starts) == sum(len(TERM.findall(x or "")) for x in texts[3:7])


def ranked_brute(docs, items, k):
    bags = [(i, Counter(TERM.findall(low(x)))) for i, x in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = set(TERM.findall(low(text)))
        scores = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in asked if t in b)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ranked_search_of_odd_rows(spark, docs, rows, k):
    items = [(1, rows[0][1]), (2, "alpha7 die3"), (2, "alpha7 die3"), (3, ""), (4, None), (None, "Été4 word WORD"), (5, "nowhere"), (6, "x1 x2 x3 mot4 der7 y")]
    table = spark.createDataFrame([(*i, 0, 0) for i in items], "item_id long, text string, score int, rank int")
    got = Counter(map(tuple, lexical.search(docs, table, k).collect()))
    assert got == ranked_brute([(r[0], r[1]) for r in rows], items, k)
    assert lexical.search(docs.limit(0), table, k).collect() == [] and lexical.search(docs, table.limit(0), k).collect() == []


def test_ranked_search_in_small_shards_and_blocks(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    say = lambda n: " ".join(words[min(299, int(rng.expovariate(0.02)))] for _ in range(n))
    docs = [(k, say(rng.randint(0, 40))) for k in range(900)]
    items = [(k, say(12)) for k in range(20)]
    for name, value in (("SHARD", 1500), ("RANGE", 16), ("GROUP", 2), ("BLOCK", 900)):
        monkeypatch.setattr(lexical, name, value)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert Counter(map(tuple, got.collect())) == ranked_brute(docs, items, 5)


def test_max_score_probes_fewer_postings():
    """Frequent words are not read once the threshold is above what they can add."""
    rng = np.random.default_rng(2)
    rows, n = [], 4096 * 8
    for _ in range(1):
        often = np.sort(rng.choice(n, n // 2, replace=False)).astype(np.int32)
        seldom = np.sort(rng.choice(n, 200, replace=False)).astype(np.int32)
        at = np.concatenate([often, seldom])
        rows.append({"docs": np.arange(n).tobytes(), "sizes": np.full(n, 10).tobytes(), "terms": [0, 1], "dfs": [len(often), len(seldom)], "at": at.tobytes(), "tfs": np.ones(len(at), np.int32).tobytes()})
    best = lexical.Best(10)
    lexical.max_score(lexical.Shard(rows, np.array([600, 5000]), n, 10 * n), [0, 1], best)
    both = sorted(set(often.tolist()) & set(seldom.tolist()))[:10]
    assert sorted(best.docs.tolist()) == both and best.probed < (len(often) + len(seldom)) / 4


def clusters_brute(rows, k=16, rounds=3, dim=64, scale=64):
    def integer(x):
        return int(x) * scale if abs(x) > 2.0**52 else math.floor(scale * x)

    kept = [(i, [integer(x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        to = assign()
        for c in range(len(cents)):
            mine = [v for (_, v), (_, n) in zip(kept, to, strict=True) if n == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    to, most = assign(), (1 << 63) - 1
    inertia = Counter()
    for d, n in to:
        inertia[n] += min(d, most)
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, n, min(d, most), min(most, inertia[n]), min(most, sum(inertia.values())), name[n]) for (i, _), (d, n) in zip(kept, to, strict=True))


def vectors(rng, n, spread):
    middles = [[rng.uniform(-3, 3) for _ in range(64)] for _ in range(7)]
    return [(k, [x + rng.gauss(0, spread) for x in rng.choice(middles)]) for k in range(n)]


@pytest.mark.parametrize("case", ["near", "far", "odd", "few", "wide", "none"])
def test_clusters_against_plain_rounds(spark, case):
    rng = random.Random(case)
    rows = {"near": lambda: vectors(rng, 300, 2.0), "far": lambda: vectors(rng, 400, 0.01), "odd": lambda: vectors(rng, 60, 0.5), "few": lambda: vectors(rng, 5, 1.0), "wide": lambda: vectors(rng, 60, 1.0), "none": list}[case]()
    if case == "odd":
        same = [0.5] * 64
        rows += [(100 + k, same) for k in range(90)] + [(None, same), (None, [1.0] * 64), (7, same), (200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [math.nan] * 64), (206, [math.inf] + [0.0] * 63)]
    if case == "wide":
        rows += [(100, [1e30] * 64), (101, [-1e30] + [0.0] * 63), (102, [3e38] * 64), (103, [2.0**54] * 64), (104, [1e12] * 64)]
    table = spark.createDataFrame([(*r, 3, 4) for r in rows], "vec_id long, embedding array<double>, cluster int, x int").repartition(4)
    assert Counter(map(tuple, ball_tree.clusters(table).collect())) == clusters_brute(rows)


def test_trees_cover_points_once_and_assign_whole_balls():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-5, 5, (500, 8)) + c for c in (0, 1000, -1000)])
    tree, order = ball_tree.grow(points)
    assert sorted(order) == list(range(1500)) and (tree.points == points[order]).all()
    for node, (begin, end, _, radius) in enumerate(tree.nodes.tolist()):
        assert (tree.sums[node] == tree.points[begin:end].sum(axis=0)).all()
        assert np.sqrt(((tree.points[begin:end] - tree.balls[node]) ** 2).sum(axis=1)).max() <= radius + 1e-6
    cents = np.array([[0] * 8, [1000] * 8, [-1000] * 8])
    found = list(ball_tree.ranges(tree, cents))
    assert sum(int(tree.nodes["end"][k] - tree.nodes["begin"][k]) for k, _ in found) == 1500
    assert len(found) < 100 and sum(len(among) > 1 for _, among in found) <= 2  # leaves across two heaps


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_brute(text):
    words = WORD.findall(low(text))
    found = [(i, label) for label, p in license_texts.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def licensed_rows():
    rng = random.Random(8)
    words = "gnu general public license apache cc by mit the of software and x Lizenz GNU-General".split()
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    out += ["Apache License MIT License. CC BY CC-BY", "GNU\nGeneral.Public LICENSE", "mit license" * 3, "xmit license", "mit licenses", None, "", "é gnu général public license", "CC BY", "by cc by cc by"]
    return [(k if k % 9 else None, x) for k, x in enumerate(out)]


def test_license_base_places(spark, docs, rows):
    own = licensed_rows()
    table = spark.createDataFrame([(*r, 1, 2) for r in own], "doc_id long, text string, labels int, row int").repartition(3)
    for frame, of in ((table, own), (docs, rows)):
        got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.digest(frame).collect())
        assert got == Counter((r[0], *base_brute(r[1])) for r in of)
    assert license_scan.digest(table.limit(0)).collect() == []
    assert set(CLASH) <= set(license_scan.scan(docs).select("row.*").columns)


def test_matching_statistics_against_substrings():
    rng = random.Random(6)
    for _ in range(60):
        templates = [[rng.randint(0, 3) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 5))]
        a = license_scan.Automaton(templates)
        runs = {}
        for t, x in enumerate(templates):
            for i in range(len(x)):
                for j in range(i, len(x)):
                    runs.setdefault(tuple(x[i : j + 1]), set()).add((t, j))
        text = [rng.randint(0, 4) for _ in range(40)]
        for k, (state, length) in enumerate(a.walk(text)):
            assert length == max(n for n in range(k + 2) if not n or tuple(text[k + 1 - n : k + 1]) in runs)
            if length:
                assert set(a.ends[state]) == runs[tuple(text[k + 1 - length : k + 1])]


def test_license_labels_of_whole_changed_and_partial_texts(spark):
    mit = dict(license_texts.TEXTS)["mit-text"]
    changed = mit.replace("free of charge", "without any fee at all").replace("merge, publish", "combine, print")
    half = " ".join(mit.split()[:40])
    other = "Lorem ipsum dolor. " * 30
    texts = [mit, f"{other}{changed}\n{other}", half, f"{mit}\n{other * 3}\n{mit}", "Licensed under CC BY-NC 4.0", "licensed under cc by", other, "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License."]
    got = {r.doc_id: r for r in license_scan.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].labels for k in range(9)] == ["mit-text", "mit-text", "", "mit-text", "cc-by,cc-by-nc-4.0", "cc-by", "", "gpl,gpl-3.0", "mit,mit-notice"]
    assert [got[k].score for k in (0, 2, 4, 6)] == [1.0, 0.0, 1.0, 0.0] and 0.85 < got[1].score < 1 and got[3].n_spans == 2
    spans = license_scan.scan(spark.createDataFrame([(0, texts[1])], "doc_id long, text string")).collect()[0].spans
    assert spans[0].first == 90 and spans[0].last == 90 + len(license_scan.words_of(changed)) - 1
