"""The operators against brute force on small tables: nulls, empty and long texts, ties, repeats, other columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evidencelake.llm import backoff_lm, bin_completion, histogram_shards, id_matrices, langid, media, merkle, mixing, parity_join, suffix_dedup, tokens
from evidencelake.llm.common import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, did long, name string, size int"


def small_rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["the", "Été", "naïve"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [say(40) for _ in range(6)]
    texts = [*base, base[0], base[0], base[1].replace("w1 ", "x ", 1), base[1] + " tail", None, "", "   ", "one", "!!! ???", say(3000), "a" * 700, base[2] + "\n\n" + base[3], say(5)]
    passage = say(30)
    texts += [say(20) + "\n" + passage + "\n" + say(20) for _ in range(4)]
    return [(k * 3, x, ["en", "fr", None][k % 3], ["s1", "s2", "s0", None][k % 4], 0, "k", 1, "n", 2) for k, x in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return small_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower_words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


def jaccard_brute(rows):
    sets, up = {}, {}
    for i, x, *_ in rows:
        w = lower_words(x)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        up[i] = i

    def top(i):
        return i if up[i] == i else top(up[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_jaccard_components(docs, rows, empty):
    got = {r[0]: (r[1], r[2]) for r in parity_join.jaccard_components(docs).collect()}
    assert got == jaccard_brute(rows)
    assert parity_join.jaccard_components(empty).collect() == []


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for n in (10, 300, 2000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[n // 8 :], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64))))
        assert parity_join.apart(parity_join.bits(a), parity_join.bits(b)) <= len(np.setxor1d(a, b))
        for x, y in ((a, b), (b, a)):
            assert len(parity_join.sent(x, 75, np.zeros(0, np.uint64))[0])


def test_linked_sets_of_every_size_share_a_key():
    rng = np.random.default_rng(2)
    for n in [*range(3, 40), 255, 256, 300, 1023, 1024, 1100, 1300]:
        u = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        gone = rng.permutation(len(u))[: len(u) // 8]
        v = np.unique(np.concatenate((np.delete(u, gone), rng.integers(0, 1 << 63, max(1, len(u) // 10), dtype=np.uint64))))
        if 100 * len(np.intersect1d(u, v)) >= 75 * len(np.union1d(u, v)):
            (a, i), (b, j) = (parity_join.sent(x, 75, np.zeros(0, np.uint64)) for x in (u, v))
            d = parity_join.most_apart(len(u), len(v), 75)
            place = dict(zip(b.tolist(), j.tolist(), strict=True))
            ok = [(p, place[k]) for k, p in zip(a.tolist(), i.tolist(), strict=True) if k in place]
            assert any(
                (2 * p <= d + len(u) - len(v) and 2 * q <= d - len(u) + len(v)) if p >= 0 else -2 - p - q <= d for p, q in ok
            ), n


def dedup_brute(rows):
    seen, out = set(), {}
    for i, x, *_ in sorted(rows, key=lambda r: r[0]):
        b = (x or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\x01" * 100
            seen.add(b[p : p + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, rows, empty):
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.digest(docs).collect()} == dedup_brute(rows)
    assert suffix_dedup.digest(empty).collect() == []


def test_mixing(docs, rows, empty):
    got = {r.doc_id: r for r in mixing.mix(docs, [3.0, 1.0, 2.0]).collect()}
    sizes = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert {i: r.size for i, r in got.items()} == sizes
    total = sum(sizes.values())
    assert abs(sum({r.source: r.target for r in got.values()}.values()) - 1.5 * total) < 1e-6 * total
    for source in {r[3] for r in rows}:
        own = [r for r in got.values() if r.source == source]
        assert own[0].target <= 2 * own[0].source_size + 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-6
    assert all(r.taken == r.times * r.size and r.times <= 2 for r in got.values())
    assert mixing.mix(empty, [3.0, 1.0, 2.0]).collect() == []
    repeated = Counter(r.doc_id for r in mixing.repeated(docs, [3.0, 1.0, 2.0]).collect())
    assert repeated == Counter({i: r.times for i, r in got.items() if r.times})


@pytest.mark.parametrize("count", [1, 3, 8])
def test_sharding(docs, rows, empty, count):
    got = histogram_shards.shard(docs, count).select("doc_id", "size", "shard", "slot").collect()
    assert {r.doc_id: r["size"] for r in got} == {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
    for s in range(count):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert histogram_shards.shard(empty, count).collect() == []


def test_sharding_splits_one_large_group(spark):
    same = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, cast(id as string), 'the same text again') as text")
    sizes = histogram_shards.shard(same, 8).groupBy("shard").sum("size").collect()
    total = sum(r[1] for r in sizes)
    assert len(sizes) == 8 and all(abs(r[1] - total / 8) < 0.03 * total / 8 for r in sizes)


def test_language_id(spark, docs, empty):
    said = {"en": "the house is near the river and they went home", "de": "das haus ist nicht weit von dem fluss und wir gehen", "ru": "мы идем домой через лес и поле"}
    many = [(k, " ".join(random.Random(k).choices(x.split(), k=12)), lang) for k in range(90) for lang, x in list(said.items())[k % 3 : k % 3 + 1]]
    model = langid.train(spark.createDataFrame(many, "doc_id long, text string, lang string"))
    mixed = " ".join([said["en"]] * 2 + [said["de"]] * 3)
    rows = [(1, said["en"]), (2, said["ru"]), (3, None), (4, "12 34 !!"), (5, mixed)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model, spans=True).collect()}
    assert [got[k].lang_pred for k in range(1, 6)] == ["en", "ru", "und", "und", "de"]
    assert [s.lang for s in got[5].lang_spans] == ["en", "de"] and got[3].score == 0
    assert langid.identify(empty, model).collect() == []
    assert langid.digest(empty).collect() == []


def test_scripts_of_letters():
    said = {"a": "Latin", "é": "Latin", "ж": "Cyrillic", "ქ": "Georgian", "ខ": "Khmer", "አ": "Ethiopic", "ệ": "Latin", "漢": "Han", "𠀀": "Han", "ⴰ": "Tifinagh", "ܐ": "Syriac", "ﷲ": "Arabic", "5": "", "—": ""}
    for letter, name in said.items():
        data = np.frombuffer(f" {letter} ".encode(), np.uint8)
        assert langid._NAMES[langid.scripts(data).max()] == name


def test_languages_of_scripts_that_share_a_lead_byte(spark):
    said = {"ka": "ეს არის ჩემი სახლი და ბაღი", "km": "នេះ ជា ផ្ទះ របស់ ខ្ញុំ និង សួន", "am": "ይህ የእኔ ቤት እና የአትክልት ስፍራ ነው"}
    many = [(k, " ".join(random.Random(k).choices(x.split(), k=9)), lang) for k in range(60) for lang, x in list(said.items())[k % 3 : k % 3 + 1]]
    model = langid.train(spark.createDataFrame(many, "doc_id long, text string, lang string"))
    rows = spark.createDataFrame(list(said.items()), "doc_id string, text string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(rows, model).collect()} == {k: (k, 1.0) for k in said}


def test_viterbi_is_exact():
    rng = np.random.default_rng(3)
    for scores in [[rng.normal(size=(n, 3)).astype(np.float32) for n in (1, 5, 6)]]:
        for s, path in zip(scores, langid._viterbi(scores, 0.7), strict=True):
            value = lambda p, s=s: sum(s[t, k] for t, k in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:], strict=False))
            best = max(value(p) for p in np.ndindex(*[3] * len(s)))
            assert abs(value(path.tolist()) - best) < 1e-4


def lm_brute(rows, prior, spread):
    said = [["<s>", *lower_words(r[1]), "</s>"] for r in rows]
    train = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2 for r in rows]
    grams = [Counter(tuple(w[j : j + n]) for w, t in zip(said, train, strict=True) if t for j in range(len(w) - n + 1) if n > 1 or j) for n in (1, 2, 3)]
    one, two, three = grams
    total, distinct, docs = sum(one.values()), len(one), sum(train)
    times = lambda h: docs if h == ("<s>",) else (one, two)[len(h) - 1][h]

    def p(h, w):
        if not h:
            return (one[(w,)] + 1) / (total + distinct + 1)
        n = times(h)
        if not n:
            return p(h[1:], w)
        k = prior + spread * n
        return ((two, three)[len(h) - 1][(*h, w)] + k * p(h[1:], w)) / (n + k)

    out = []
    for w in said:
        base = sum(np.log10(p((), x)) for x in w[1:])
        out.append((len(w) - 1, sum(one[(x,)] > 0 for x in w[1:]), total, base, sum(np.log10(p(tuple(w[max(0, j - 2) : j]), w[j])) for j in range(1, len(w)))))
    return out


def test_backoff_lm_scores(docs, rows, empty):
    got = {r.doc_id: r for r in backoff_lm.digest(docs).collect()}
    for r, (n, known, total, base, own) in zip(rows, lm_brute(rows, backoff_lm.PRIOR, backoff_lm.SPREAD), strict=True):
        g = got[r[0]]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (n, known, total)
        assert np.isclose(g.base_score, base) and np.isclose(g.score, own)
    assert backoff_lm.digest(empty).collect() == []


def test_probabilities_of_each_state_of_the_automaton_sum_to_one(rows):
    data = [np.frombuffer((r[1] or "").encode(), np.uint8) for r in rows]
    block = backoff_lm.Block([words(x) for x in data], np.array([k % 5 != 0 for k in range(len(rows))]), 3)
    total, distinct = int(block.counts[0].sum()), int((block.counts[0] > 0).sum())
    made = backoff_lm.Automaton(block, total, distinct, 4.0, 0.5)
    known = np.flatnonzero(block.counts[0])
    for state in range(len(made.fail)):
        if state > 1 and made.weight[state] == 0:
            continue  # not a state: its n-gram is not in training
        p = 10 ** made.step(np.full(len(known), state), known)[0]
        fails, at = 0.0, state
        while at != backoff_lm.ROOT:
            fails, at = fails + made.weight[at], made.fail[at]
        assert np.isclose(p.sum() + 10 ** (fails + made.unknown), 1)


def test_planes_round_trip():
    x = np.array([0, 1, 255, 256, 1 << 40, (1 << 56) - 1], np.uint64)
    assert (backoff_lm.numbers(backoff_lm.planes(x, 8), 8) == x).all() and len(backoff_lm.numbers(backoff_lm.planes(x[:0], 8), 8)) == 0


def test_media_round_trip(spark, docs, rows, empty, tmp_path):
    got = {r.doc_id: r for r in media.digest(docs).collect()}
    for i, x, *_ in rows:
        raw = media.payload((x or "").encode())
        assert got[i].payload_sha256 == hashlib.sha256(raw).hexdigest() and got[i].tail_crc32 == zlib.crc32(raw[-16:]) and len(raw) % 192 == 0
    assert media.digest(empty).collect() == []
    folder = f"file://{tmp_path}/a"
    assert media.write_archives(docs, folder) == len(rows)
    for span in (500, 1 << 20):  # ranges much shorter and much longer than members
        read = media.read_archives(spark, folder, span).collect()
        assert sorted(r.doc_id for r in read) == sorted(r[0] for r in rows) and all(r.error is None for r in read)
    name = next((tmp_path / "a").glob("*.media"))
    (tmp_path / "a" / f"9{name.name}").write_bytes(name.read_bytes())  # what an attempt that was not taken leaves behind
    assert media.read_archives(spark, folder).count() == len(rows)
    data = bytearray(name.read_bytes())
    data[60] ^= 255
    name.write_bytes(bytes(data))
    assert sum(r.error is not None for r in media.read_archives(spark, folder).collect()) == 1


def test_merkle(docs, rows, empty):
    got = {r.doc_id: r for r in merkle.digest(docs).collect()}
    order = sorted(rows, key=lambda r: r[0])
    for k, (i, x, *_) in enumerate(order):
        x, nxt = x or "", order[(k + 1) % len(order)][1] or ""
        cut = len(x) // 4
        assert got[i].edited_sha256 == hashlib.sha256((x[: len(x) - cut] + nxt[:cut]).encode()).hexdigest() and got[i].n_chars == len(x)
    same = [got[r[0]].fingerprint for r in rows if r[1] == rows[0][1]]
    assert len(same) == 3 and len(set(same)) == 1
    assert len({got[r[0]].fingerprint for r in rows}) == len({r[1] or "" for r in rows})
    assert merkle.digest(empty).collect() == []


def test_packing(docs, rows, empty):
    got = bin_completion.pack(docs, capacity=64).collect()
    made = tokens.words()
    for i, x, *_ in rows:
        ids = made.ids([x or ""])[0]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [(s, len(p) // 4, zlib.crc32(p)) for _, s, p in tokens.pieces(ids, 64)]
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert bin_completion.pack(empty).collect() == []


def optimum(lengths, capacity):
    best = [len(lengths)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= capacity and bins[b] not in bins[:b]:
                go(k + 1, [*bins[:b], bins[b] + lengths[k], *bins[b + 1 :]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best[0]


def test_bin_completion_finds_the_optimum():
    rng = random.Random(4)
    for _ in range(40):
        lengths = sorted((rng.randint(10, 70) for _ in range(11)), reverse=True)
        plan = bin_completion.plan(dict(Counter(lengths)), 100)
        assert plan.size == optimum(lengths, 100) >= plan.lower_bound == bin_completion.lower_bound(dict(Counter(lengths)), 100)
        assert sum((Counter({k: n * f.count(k) for k in set(f)}) for f, n in plan.bins), Counter()) == Counter(lengths)
        assert all(sum(f) <= 100 for f, _ in plan.bins)


def test_bin_completion_says_proved_only_of_the_optimum():
    rng = random.Random(11)
    proved = 0
    for _ in range(60):
        lengths = sorted((rng.choice([12, 20, 27, 33, 34, 41, 50, 51, 66]) for _ in range(10)), reverse=True)
        plan = bin_completion.plan(dict(Counter(lengths)), 100)
        best = optimum(lengths, 100)
        assert plan.lower_bound <= best <= plan.size and (not plan.proved or plan.size == best)
        proved += plan.proved
    assert proved > 30
    cut = bin_completion.plan({51: 3, 49: 1, 34: 4, 33: 3, 27: 2}, 100, nodes=1)
    assert cut.size >= cut.lower_bound and cut.proved == (cut.size == cut.lower_bound)


def test_viterbi_of_many_languages():
    """The best label of each word, of 300 labels, equals the one of plain rounds."""
    rng = np.random.default_rng(3)
    for k in (150, 300):
        scores = [rng.normal(size=(n, k)).astype(np.float32) for n in (5, 1, 9)]
        for own, path in zip(scores, langid._viterbi(scores, 0.75), strict=True):
            best, back = own[0].astype(np.float64), []
            for row in own[1:]:
                top = int(best.argmax())
                back.append([j if best[j] >= best[top] - 0.75 else top for j in range(k)])
                best = np.maximum(best, best[top] - 0.75) + row
            want = [int(best.argmax())]
            for b in reversed(back):
                want.append(b[want[-1]])
            assert path.tolist() == want[::-1]


def test_language_id_with_two_hundred_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[(k * (7 + j) + j * j * (k // 26 + 1)) % 26] for j in range(9))
    rows = [(d * 200 + k, f"{word(k)} {word(k + 1000)} " * 6, f"l{k:03}") for d in range(4) for k in range(200)]
    got = langid.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == 800 and sum(truth[r.doc_id] == r.lang_pred for r in got if not r.held_out) > 500
    assert {r.lang_pred for r in got} > {"l150", "l199"}


def test_id_matrices(docs, rows, empty):
    found = {}
    for r in id_matrices.padded(id_matrices.id_matrices(docs, 64), 64).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens and r.resets == r.cu_seqlens[:-1]
        for i, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            found[(i, p)] = ids[a:b].tobytes()
    made = tokens.words()
    for i, x, *_ in rows:
        assert b"".join(found[k] for k in sorted(k for k in found if k[0] == i)) == made.ids([x or ""])[0]
    assert id_matrices.id_matrices(empty).collect() == []


def test_tokens_equal_the_tokenizer():
    made = tokens.words()
    odd = ["Hello  world<|endoftext|> it's", "á ́b Σ ΑΣ's", "", " \n", "x" * 3000, "ÀÉ, Ab.,, c's. 5. A5; ǅx µ Ⅷ. ab$$$ .$ &&& don't. 'tis"]
    assert [np.frombuffer(b, "<u4").tolist() for b in made.ids(odd)] == [[*made.tokenizer.encode(x, add_special_tokens=False).ids, 1] for x in odd]
