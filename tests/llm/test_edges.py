"""Nulls in every column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for all ten
operators and all stages: brute force where the rows have a defined value, else counts of rows."""

import hashlib
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_operators import dedup_brute, jaccard_brute, lm_brute

from evidencelake.llm import backoff_lm, bin_completion, histogram_shards, id_matrices, langid, media, merkle, mixing, parity_join, suffix_dedup, tokens

#: Columns with names that the operators use inside.
CLASH = ["row", "name", "did", "key", "n", "size", "spans", "ahead", "whole", "need", "before", "copy", "slice", "comp", "hash", "shard", "score", "times", "md5", "_text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH)


def odd_rows():
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta die der das und Été naïve mot x".split()) + str(rng.randint(0, 30)) for _ in range(n))
    base, other = say(60), say(60)
    rows = [
        (1, base, "en", "s1", 5), (1, base, "en", "s1", 5), (1, base, "en", "s1", 5),  # repeated rows
        (2, base, None, None, None), (2, other, "fr", "s2", 0),  # one doc_id with two texts
        (None, base, None, None, None), (None, base, None, None, None), (None, None, None, None, None), (None, None, None, None, None),
        (3, "", "en", "s3", 0), (4, None, "en", "s3", None), (5, "  \n\t ", "de", "s3", 5), (6, "!!! 12", "de", "s3", 6),
        (7, other + " tail", "fr", "s1", 1), (8, other, "fr", "s1", 1), (-5, other, "fr", "s1", 1),
        (9, "word " * 1_000_000, "en", "s2", 5_000_000),  # very long
        (10, say(4), "en", "s2", 1), (11, "y" * 250, "en", "s2", 1), (12, "y" * 99, "en", "s2", 1), (13, "é" * 120, "fr", "s2", 1),
    ]
    return [(*r, *range(len(CLASH))) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('odd')}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def keyed(rows):
    """Rows with ids of their own in the order of (doc_id, null first), for brute force that keys by id."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    return order, [(at, *rows[k][1:]) for at, k in enumerate(order)]


def test_jaccard_components_of_odd_rows(docs, rows):
    order, own = keyed(rows)
    want = Counter((rows[k][0], n, rows[order[c]][0]) for k, (n, c) in zip(order, jaccard_brute(own).values(), strict=True))
    assert Counter(map(tuple, parity_join.jaccard_components(docs).collect())) == want


def test_one_of_each_keeps_one_row_of_each_group(docs, rows):
    order, own = keyed(rows)
    found = jaccard_brute(own)
    got = parity_join.one_of_each(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    groups = {}
    for k, (n, c) in zip(order, found.values(), strict=True):
        groups.setdefault((c, n > 0 or k), []).append(k)
    for members in groups.values():
        first = min((rows[k][0] is not None, rows[k][0] or 0) for k in members)
        mine = [k for k in members if ((rows[k][0] is not None, rows[k][0] or 0)) == first]
        assert any(kept[(rows[k][0], rows[k][1])] for k in mine)
    assert sum(kept.values()) == len(groups)


def test_suffix_dedup_of_odd_rows(docs, rows):
    """Rows of one doc_id count as one document at equal places, so the least of them is taken alone here."""
    seen, some = set(), []
    for r in rows:
        if r[0] not in seen:
            seen.add(r[0])
            some.append(r)
    spark = docs.sparkSession
    table = spark.createDataFrame(some, SCHEMA)
    want = Counter((None if i == -(1 << 62) else i, *v) for i, v in dedup_brute([(-(1 << 62) if r[0] is None else r[0], *r[1:]) for r in some]).items())
    assert Counter(map(tuple, suffix_dedup.digest(table).collect())) == want
    assert suffix_dedup.digest(docs).count() == len(rows)
    spanned = suffix_dedup.dedup_spans(docs)
    assert spanned.columns == [c for c in docs.columns if c != "spans"] + ["spans"] and spanned.count() == len(rows)


def test_suffix_ranks_against_sorting():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 6, 7, 8, 22, 100, 700):
        for top in (1, 2, 300):
            text = rng.integers(1, top + 1, n)
            rank = suffix_dedup.suffix_ranks(text)
            assert sorted(rank) == list(range(n))
            found = [tuple(text[i : i + suffix_dedup.DEPTH]) for i in np.argsort(rank)]
            assert found == sorted(found)


def test_mixing_of_odd_rows(docs, rows):
    got = mixing.mix(docs, [3.0, 1.0, 2.0])
    assert {c: [r[c] for r in got.collect()] for c in ("row", "ahead", "whole")} == {"row": [0] * len(rows), "ahead": [7] * len(rows), "whole": [8] * len(rows)}
    for r in got.collect():
        assert r.times <= 2 and r.taken == r.times * r["size"]
    times = Counter((r.doc_id, r.text) for r in mixing.repeated(docs, [3.0, 1.0, 2.0]).collect())
    assert sum(times.values()) == sum(r.times for r in got.collect())


def test_empty_texts_are_not_taken_more_than_the_epochs(spark):
    table = spark.range(3000).selectExpr("id as doc_id", "if(id < 5, 'a b c', '') as text", "if(id < 3, 's0', 's1') as source")
    assert mixing.mix(table, [3.0, 1.0], epochs=2.0).agg({"times": "max"}).first()[0] <= 2


def test_sharding_of_odd_rows(docs, rows):
    got = histogram_shards.shard(docs, 3)
    assert got.columns == [c for c in docs.columns if c not in ("size", "shard")] + ["size", "law", "shard", "slot"]
    kept = got.collect()
    assert len(kept) == len(rows) and all(r.before == 10 and r._text == 19 for r in kept)
    for s in {r.shard for r in kept}:
        assert sorted(r.slot for r in kept if r.shard == s) == list(range(sum(r.shard == s for r in kept)))


def test_sharding_digest_against_brute_force(docs, rows):
    got = histogram_shards.digest(docs, 3).collect()
    data = [(r[1] or "").encode() for r in rows]
    want = Counter((r[0], len(x) + 1, zlib.crc32(x), "bytes", None) for r, x in zip(rows, data, strict=True))
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_language_id_of_odd_rows(docs, rows):
    model = langid.train(docs)
    got = langid.identify(docs, model, spans=True)
    assert got.count() == len(rows)
    for r in got.collect():
        assert (r.lang_pred == langid.UNKNOWN) == (not any(map(str.isalpha, r.text or ""))) and r._text == 19 and 0 <= r.score <= 1
    held = Counter((r[0], zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows if r[0] is not None)
    assert Counter((r.doc_id, r.held_out) for r in langid.digest(docs).collect() if r.doc_id is not None) == held


def test_backoff_lm_of_odd_rows(docs, rows):
    few = lambda t: (t[0], *t[1:4], round(t[4], 4), round(t[5], 4))
    some = [r for r in rows if r[0] != 9]  # brute force is slow on the long text
    table = docs.filter("doc_id is null or doc_id <> 9")
    got = [few((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in backoff_lm.digest(table).collect()]
    want = [few((r[0], *v)) for r, v in zip(some, lm_brute(some, backoff_lm.PRIOR, backoff_lm.SPREAD), strict=True)]
    assert Counter(got) == Counter(want)
    assert backoff_lm.digest(docs).filter("n_tokens = 1000001").count() == 1


def test_media_of_odd_rows(docs, rows):
    got = media.digest(docs).collect()
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want[(r[0], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values()) and len({v for x in by_text.values() for v in x}) == len(by_text)


def test_merkle_of_odd_rows(docs, rows):
    got = merkle.digest(docs).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((r[0], len(r[1] or "")) for r in rows)
    assert len({r.fingerprint for r in got}) == len({r[1] or "" for r in rows})
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_packing_of_odd_rows(docs, rows):
    made = tokens.words()
    want = Counter()
    for r in rows:
        for piece, start, ids in tokens.pieces(made.ids([r[1] or ""])[0], 4096):
            want[(r[0], piece, start, len(ids) // 4, zlib.crc32(ids))] += 1
    for got in (bin_completion.pack(docs).collect(),):
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        for s in {r.sequence_id for r in got}:
            own = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
            assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= 4096
        assert {r.sequences for r in got} == {len({r.sequence_id for r in got})}
    matrices = id_matrices.id_matrices(docs).collect()
    assert Counter((i, p, s, b - a) for r in matrices for i, p, s, a, b in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False)) == Counter(
        {k: v for k, v in Counter((i, p, s, n) for (i, p, s, n, _), c in want.items() for _ in range(c)).items()}
    )


def test_best_fit_decreasing_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(0, 40))]
        rows = id_matrices.best_fit_decreasing(lengths, 64)
        rooms, want = [], []
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            fits = [r for r in range(len(rooms)) if rooms[r] >= lengths[k]]
            at = min(fits, key=lambda r: rooms[r], default=None)
            if at is None:
                rooms.append(64), want.append([])
                at = len(rooms) - 1
            rooms[at] -= lengths[k]
            want[at].append(k)
        assert sorted(sum(lengths[k] for k in r) for r in rows) == sorted(sum(lengths[k] for k in r) for r in want)
        assert sorted(k for r in rows for k in r) == list(range(len(lengths)))


def test_tokens_equal_the_tokenizer_for_every_letter():
    made = tokens.words()
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    rare = [c for c in letters if not made.tokenizer.normalizer.normalize_str(c).isalpha() or c.lower() != c]
    some = rare + random.Random(1).sample(letters, 3000)
    texts = [" ".join(f"{a}{b} x{a}{b}" for a in some[k : k + 50]) for b in tokens._AFTER for k in range(0, len(some), 50)]
    want = [[*e.ids, 1] for e in made.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in made.ids(texts)] == want


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_of_odd_and_of_empty_tables(spark, docs, rows, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, "")
    if k < 4:
        assert out.columns == docs.columns
        assert {(r.n, r.key, r.spans) for r in out.select("n", "key", "spans").collect()} == {(CLASH.index("n"), CLASH.index("key"), CLASH.index("spans"))}
    else:
        assert out.count() >= len(rows)
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").collect() == []


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    passage = say(40)
    texts = [say(50) for _ in range(8)] + [say(20) + " " + passage + " " + say(20) for _ in range(3)] + ["12 !!", None]
    texts += [texts[0], texts[1] + " more"]
    table = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r in table if r[1] and any(map(str.isalpha, r[1]))]
    kept = [r for r in kept if jaccard_brute(kept)[r[0]][1] == r[0]]
    left, seen = {}, set()
    for i, t, *_ in kept:  # the ASCII bytes that no earlier 100-byte string covers
        gone = [False] * len(t)
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(t[p : p + 100])
        left[i] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    left = {i: t for i, t in left.items() if t}
    mixed = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in left.items()], "doc_id long, text string, lang string, source string, n_chars long")
    times = {r.doc_id: r.times for r in mixing.mix(mixed, [3.0, 1.0, 2.0]).collect()}
    made, want = tokens.words(), Counter()
    for i, t in left.items():
        for piece, start, ids in tokens.pieces(made.ids([t])[0], 4096):
            want[(i, piece, start, len(ids) // 4, zlib.crc32(ids))] += times[i]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want


def test_slices_of_large_parts_lose_no_link(spark, monkeypatch):
    """Families of texts about as alike as the threshold, with slices of three sets and blocks from the second round on."""
    monkeypatch.setattr(parity_join, "SLICE", 3)
    monkeypatch.setattr(parity_join, "GOES_ON", 2.0)
    rng = random.Random(4)
    table = []
    for _ in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(90)]
        for _ in range(16):
            own = list(base)
            for _ in range(rng.randrange(1, 4)):
                own[rng.randrange(90)] = f"x{rng.randrange(10_000)}"
            table.append((len(table), " ".join(own), None, None, None))
    want = jaccard_brute(table)
    assert 3 < len({c for _, c in want.values()}) < len(table)
    docs = spark.createDataFrame([r[:2] for r in table], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.jaccard_components(docs).collect()} == want
