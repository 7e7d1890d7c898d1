"""N-gram Jaccard join by parity sketches.

Each document's set of distinct word shingles becomes, for its size band, a sketch of ``k`` parts.  A part holds the
parity (XOR) of the 64-bit hashes of the shingles dealt to it, so one shingle in which two sets differ changes one part
at most: the number of differing parts (their Hamming distance) is a lower bound of the symmetric difference.  Sets with
Jaccard similarity s differ in at most d = (|A| + |B|)(1 - s)/(1 + s) shingles, so with more than d filled parts they
share a filled part (pigeonhole).  It is enough to send about the first d + 1 filled parts of each sketch in one global order;
any order is lossless.  The order puts parts last that are frequent in a sample, which only saves work.

Documents with equal sets are one node (a class) from the start.  Candidates come first as stars around one leader a
part, in a few rounds, and only between nodes not yet connected; each is verified by exact intersection.  A leader that
has met all others of its part leaves the part.  Nearly all groups of copies are one component after that.  What is left
in parts that still hold several components is compared in slices of ``SLICE`` sets, sketch against sketch, so that a pair
moves on only if places and the distance of bit sketches leave a link possible; these pairs are verified, too.  Every part
holds one component then or has had all its pairs ruled out: no link that joins two components is lost.

Defined results: null or wordless texts have n_shingles 0 and component_id = doc_id; texts of fewer than ``words`` words
have one shingle, their whole sequence; very long texts are read whole; repeated rows each return a row; a null doc_id
ranks below all others but is returned as null; an empty table returns no rows; extra columns are ignored, and kept by
``one_of_each`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, dealt, did, forget, gathered, longs, mix, partitions, released, shingles, small, stored, texts

U64 = np.uint64
#: Bands of set sizes [L, 4 L).  Below PLAIN a part is a single shingle; from there on a sketch has 2 L parts.
RATIO, PLAIN = 4, 256
#: One document in SAMPLE is looked at for frequent parts; a part seen OFTEN times there comes last in the order. The
#: list is cut at HOT_MOST parts. All three change the work only, not the result.
SAMPLE, OFTEN, HOT_MOST = 16, 3, 1 << 20
#: Rounds of stars go on while one joins at least this share of the sets that are left; sets of a part that are compared
#: in one task; bytes of a sketch that go along. They change the work only, too.
GOES_ON, SLICE, CARRIED = 0.01, 512, 128


def most_apart(n: int, m: int, percent: int) -> int:
    """The largest symmetric difference of sets of n and m elements that still link."""
    return (n + m) * (100 - percent) // (100 + percent)


def bands(n: int, percent: int) -> list[int]:
    """Lower ends of the bands in which a set of n elements may meet a partner: its own, and that of smaller partners."""
    low = 1
    while low * RATIO <= n:
        low *= RATIO
    return [low] + ([low // RATIO] if low > 1 and -(-n * percent // 100) < low else [])


def sketch(u: np.ndarray, low: int) -> np.ndarray:
    """The filled parts of the sketch of the set u in band low, each as a 64-bit key of (band, part, parity)."""
    if low < PLAIN:
        return mix(u ^ mix(np.full(1, low, U64)))
    part = u % U64(2 * low)
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
    parity = np.bitwise_xor.reduceat(mix(u[order]), starts)
    return mix(mix(parity + part[starts]) ^ mix(np.full(1, low, U64)))


def bits(u: np.ndarray) -> bytes:
    """The sketch of u with one-bit parts: as many bits as the next power of two from 2 len(u) on, 64 at least."""
    m = max(64, 1 << (2 * len(u) - 1).bit_length()) if len(u) else 64
    return np.packbits((np.bincount((u & U64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """The Hamming distance of two sketches, the longer folded to the length of the shorter: at most the symmetric
    difference of the sets."""
    x, y = (np.frombuffer(s, np.uint8) for s in ((a, b) if len(a) <= len(b) else (b, a)))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sent(u: np.ndarray, percent: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that a set sends in its bands, frequent ones last, and their places.

    At the first part that sets A and B share, i and j parts stand before it that the other set lacks. If a part is one
    shingle, these are shingles of A - B and of B - A, so i <= (d + |A| - |B|) / 2 and j likewise, and the keys of that
    many places are enough. If not, they are differing parts, max(i, j) <= d; the place is then -1 - i // 2, so that
    the places of linked sets add up to d at most."""
    n = len(u)
    d = most_apart(n, n * 100 // percent, percent)
    keys, places = [u[:0]], [np.zeros(0, np.int32)]
    for low in bands(n, percent) if d else ():
        own = np.sort(sketch(u, low))
        if len(hot):
            at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
            last = hot[at] == own
            own = np.concatenate((own[~last], own[last]))
        least = -(-n * percent // 100)
        most = d if low >= PLAIN else (most_apart(n, least, percent) + n - least) // 2
        keys.append(own[: most + 1])
        at = np.arange(len(keys[-1]), dtype=np.int32)
        places.append(-1 - at // 2 if low >= PLAIN else at)
    return np.concatenate(keys), np.concatenate(places)


def set_name(u: np.ndarray) -> np.int64:
    """A name of the set: equal for equal sets."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(u) * U64(0x9E3779B97F4A7C15) ^ np.bitwise_xor.reduce(mix(u)) ^ U64(len(u))
    return mix(np.array([total]))[0].view(np.int64)


def _hot(docs: DataFrame, words: int) -> np.ndarray:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in texts(batch.column(0)):
                if len(u := shingles(data, words)):
                    own = np.concatenate([sketch(u, low) for low in bands(len(u), 75)])
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["key"])

    sample = docs.filter(F.pmod(F.xxhash64("did", F.lit(3)), F.lit(SAMPLE)) == 0).select("text")
    often = sample.mapInArrow(released(keys), "key long").groupBy("key").count().filter(F.col("count") >= OFTEN)
    rows = often.orderBy(F.desc("count"), "key").limit(HOT_MOST).toArrow().column("key")
    return np.sort(np.array(rows.to_numpy(), np.int64).view(U64))


def _sets_and_parts(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows (key null, name, did, hash, n) for each document and (key, name) for each part that two different sets send."""
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(_hot(docs, words))
    parts = partitions(spark)
    buckets = 4 * parts

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places, names, rows = [], [], [], []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            k = np.concatenate([*keys, np.zeros(0, U64)])
            owner = np.repeat(np.array(names, np.int64), [len(x) for x in keys])
            place = np.concatenate([*places, np.zeros(0, np.int32)])
            columns = ["bucket", "key", "name", "place", "doc"]
            if len(k):
                part = dealt(((k >> U64(40)) % U64(buckets)).astype(np.int32), {"key": k, "name": owner, "place": place})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, pa.binary())], columns)
            if rows:
                none = pa.nulls(len(rows), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x % buckets for x in names], pa.int32()), none, none, none, pa.array(rows, pa.binary())], columns)
            keys.clear(), places.clear(), names.clear(), rows.clear()
            held = 0

        for batch in batches:
            ids, hashes = longs(batch.column(0)), longs(batch.column(2))
            for i, data, h in zip(ids, texts(batch.column(1)), hashes, strict=True):
                u = shingles(data, words)
                name = set_name(u) if len(u) else np.int64(0)
                rows.append(np.array([i, name, len(u), h], np.int64).tobytes() + bits(u))
                own, at = sent(u, percent, hot.value)
                keys.append(own)
                places.append(at)
                names.append(name)
                held += len(own) + 8
                if held > 250_000:
                    yield from flush()
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            docs = [x for x in batch.column("doc").to_pylist() if x is not None]
            if not docs:
                kept.append(batch)
                continue
            head = np.frombuffer(b"".join([x[:32] for x in docs]), np.int64).reshape(-1, 4)
            none = pa.nulls(len(docs), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, pa.array(head[:, 1]), pa.array(head[:, 0]), pa.array(head[:, 2]), pa.array(head[:, 3]), pa.array([x[32:] for x in docs], pa.binary())],
                ["key", "place", "name", "did", "n", "hash", "bits"],
            )
            kept.append(batch.filter(batch.column("key").is_valid()))
        got = gathered(kept, {"key": U64, "name": np.int64, "place": np.int32})
        step = 1 << 16
        order = np.lexsort((got["name"], got["key"]))
        k, f, at = (got[c][order] for c in ("key", "name", "place"))
        if len(k):
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
            k, f, at = k[new], f[new], at[new]
            same = np.zeros(len(k) + 1, bool)
            same[1:-1] = k[1:] == k[:-1]
            keep = same[1:] | same[:-1]
            k, f, at = k[keep], f[keep], at[keep]
        for a in range(0, len(k), step):
            x, y, z = k[a : a + step].view(np.int64), f[a : a + step], at[a : a + step].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x), pa.array(z), pa.array(y), *[pa.nulls(len(x), pa.int64())] * 3, pa.nulls(len(x), pa.binary())],
                ["key", "place", "name", "did", "n", "hash", "bits"],
            )

    blobs = docs.select("did", "text", F.xxhash64("text")).mapInArrow(released(emit), "bucket int, key binary, name binary, place binary, doc binary")
    return blobs.repartition(parts, "bucket").drop("bucket").mapInArrow(released(meet), "key long, place long, name long, did long, n long, hash long, bits binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of edges (a, b): comp is its component's smallest node.  Min-label rounds with jumps."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    label = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")), "label")
    while True:
        near = both.join(label.toDF("other", "c"), "other").groupBy("node").agg(F.min("c").alias("c"))
        step = label.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("to"))
        jump = step.join(label.toDF("to", "root"), "to", "left")
        now = stored(jump.select("node", "was", F.least("to", F.coalesce("root", "to")).alias("comp")), "label")
        forget(label)
        label = now.drop("was")
        label.stored_path = now.stored_path
        if now.filter("was <> comp").isEmpty():
            forget(both)
            return label


def _sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(name, u): the sorted shingles of the documents in needed (did)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in texts(batch.column(0)):
                if len(u := shingles(data, words)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(set_name(u))], pa.int64()), pa.array([u.tobytes()], pa.binary())], ["name", "u"]
                    )

    some = docs.join(small(needed), "did", "left_semi").select("text")
    return some.mapInArrow(released(make), "name long, u binary")


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sketches do not rule out a link."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, n, m, x, y = (c.to_pylist() for c in batch.columns)
            keep = [apart(p, q) <= most_apart(i, j, percent) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = nodes.select("name", "n", "bits")
    full = pairs.join(side.toDF("a", "na", "xa"), "a").join(side.toDF("b", "nb", "xb"), "b")
    return full.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(released(bound), "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets link."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = np.concatenate((a, b))
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(sets.toDF("a", "ua"), "a").join(sets.toDF("b", "ub"), "b").select("a", "b", "ua", "ub")
    return full.mapInArrow(released(verify), "a long, b long")


def _alive(own: DataFrame, order: Column) -> DataFrame:
    """The rows of own (key, name, place, n, comp) whose part holds several components, with its leader (the set that is
    first by order; l_...), the number of its ``slices`` and the own ``slice``: a part of many sets is dealt to several
    tasks. Components and leaders of parts are aggregates, so that no part is gathered in one task."""
    lead = F.min(F.struct(order.alias("order"), *[F.col(c).alias(f"l_{c}") for c in ("name", "place", "n", "comp")])).alias("lead")
    by_key = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n_key"), lead)
    slices = F.ceil(F.col("n_key") / SLICE).cast("int").alias("slices")
    leaders = stored(by_key.filter("lo < hi").select("key", "lead.*", slices).drop("order"), "leaders")
    large = small(leaders.filter("slices > 1").select("key", F.col("slices").alias("more")))
    slice_ = F.pmod(F.xxhash64("name"), F.coalesce("more", F.lit(1))).cast("int")
    rows = own.join(large, "key", "left").withColumn("slice", slice_).drop("more")
    each = leaders.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    live = stored(rows.join(each, ["key", "slice"]), "live")
    forget(leaders)
    return live


def _stars(live: DataFrame, percent: int) -> DataFrame:
    """(name, l_name) for each set of live and the leader of its part, if they are not connected yet and may link."""
    most = F.floor((F.col("n") + F.col("l_n")) * (100 - percent) / (100 + percent))
    i, j, more = F.col("place"), F.col("l_place"), F.col("n") - F.col("l_n")
    early = F.when(i >= 0, (2 * i <= most + more) & (2 * j <= most - more)).otherwise(-2 - i - j <= most)
    near = 100 * F.least("n", "l_n") >= percent * F.greatest("n", "l_n")
    return live.filter((F.col("comp") != F.col("l_comp")) & near & early).select("name", "l_name")


def _block_pairs(key: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places x < y with one key, some at a time, where other (the side of the slice: -1 both, 0, 1) allows."""
    cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    size = np.diff(cuts)
    ends = np.repeat(cuts[1:], size)
    behind = ends - np.arange(len(key)) - 1  # partners of each place: those behind it in its group
    done = np.cumsum(behind)
    lo = 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + (1 << 19), "right")))
        n = behind[lo:hi]
        x = np.repeat(np.arange(lo, hi), n)
        if len(x):
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            ok = (other[x] < 0) | (other[x] != other[y])
            yield x[ok], y[ok]
        lo = hi


def _blocks(live: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of sets that share a part of live, are not connected and are not ruled out by places or sketches."""
    parts = partitions(live.sparkSession)

    def folded(x: bytes) -> bytes:
        y = np.frombuffer(x, np.uint8)
        while len(y) > CARRIED:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        return y.tobytes()

    def fold_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(folded, batch.column(1).to_pylist()), pa.binary())], ["name", "bits"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows < 1 << 15:
                continue
            cell = np.stack([rest.column(c).to_numpy() for c in ("key", "one", "two")])
            last = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0))
            if len(last):  # the last cell may go on in the next batch
                yield from compared(rest.slice(0, int(last[-1]) + 1))
                rest = rest.slice(int(last[-1]) + 1).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from compared(rest)

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, one, two, name, place, n, comp, side = (table.column(c).to_numpy() for c in ("key", "one", "two", "name", "place", "n", "comp", "side"))
        blobs = table.column("bits").to_pylist()
        size = np.array([len(b) for b in blobs])
        group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
        wide = np.zeros((len(blobs), CARRIED // 8), U64)
        for w in np.unique(size):
            at = np.flatnonzero(size == w)
            wide[at, : max(1, w // 8)] = np.frombuffer(b"".join([blobs[i] for i in at]), U64).reshape(len(at), -1)
        for x, y in _block_pairs(group, np.where(one == two, -1, side)):
            most = (n[x] + n[y]) * (100 - percent) // (100 + percent)
            more = n[x] - n[y]
            i, j = place[x], place[y]
            early = np.where(i >= 0, (2 * i <= most + more) & (2 * j <= most - more), -2 - i - j <= most)
            ok = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & early
            x, y, most = x[ok], y[ok], most[ok]
            keep = np.zeros(len(x), bool)
            narrow = np.minimum(size[x], size[y])
            for w in np.unique(narrow):
                at = np.flatnonzero(narrow == w)
                sides = []
                for z in (x[at], y[at]):
                    own = wide[z]
                    for step in [1 << k for k in range(int(size.max()).bit_length() - 1, 2, -1) if 1 << k > w]:
                        own = np.where((size[z] >= step)[:, None], _half_folded(own, step // 16), own)
                    sides.append(own[:, : w // 8])
                keep[at] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1) <= most[at]
            a, b = np.minimum(name[x[keep]], name[y[keep]]), np.maximum(name[x[keep]], name[y[keep]])
            if len(a):
                pair = np.unique(np.stack((a, b), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    sketches = nodes.select("name", "bits").mapInArrow(released(fold_all), "name long, bits binary")
    rows = live.join(sketches, "name")
    # A set meets those of every slice of its part: of the own slice once, and of each other one as one of two sides.
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.select(
        "key", F.least("slice", "t").alias("one"), F.greatest("slice", "t").alias("two"), "name", F.col("place").cast("long").alias("place"), "n", "comp",
        (F.col("slice") > F.col("t")).cast("int").alias("side"), "bits",
    )
    rows = rows.repartition(parts, "key", "one", "two").sortWithinPartitions("key", "one", "two")
    return rows.mapInArrow(released(compare), "a long, b long").distinct()


def _half_folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Each row of 64-bit words with its first ``words`` words XORed by the next as many."""
    out = rows.copy()
    out[:, :words] ^= rows[:, words : 2 * words]
    return out


def linked(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """did, hash (of the text), n and comp for each row of docs: the number of shingles, and a name of the component
    (null without shingles)."""
    docs = docs.select("doc_id", "text").withColumn("did", did())
    table = stored(_sets_and_parts(docs, words, percent), "parity")
    rows = table.filter("key is null").select("did", "name", "n", "hash")
    bit = table.filter("key is null").select("name", "bits").dropDuplicates(["name"])
    parts = table.filter("key is not null").select("key", "name", "place")
    # A name stands for one set: (name, n) would do the same with one more column to carry.
    classes = rows.filter("n > 0").groupBy("name").agg(F.min("did").alias("did"), F.min("n").alias("n"))
    nodes = stored(parts.select("name").distinct().join(classes, "name").join(bit, "name"), "nodes")
    label = nodes.select("name", "n", F.col("name").alias("comp"))

    def joined(pairs: DataFrame) -> int:
        """Verifies pairs (a, b) and joins the components of those that link; how many it joined."""
        nonlocal label
        close = stored(_possible(pairs, nodes, percent), "close")
        ends = close.select(F.col("a").alias("name")).union(close.select("b")).distinct()
        needed = stored(nodes.join(ends, "name").select("did"), "needed")
        links = _linked(close, _sets(docs, needed, words), percent)
        ends = label.select("name", "comp")
        found = links.join(ends.toDF("a", "ca"), "a").join(ends.toDF("b", "cb"), "b").filter("ca <> cb")
        edges = stored(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "joined")
        n = 0
        if not edges.isEmpty():
            to = stored(components(edges).toDF("comp", "to"), "to")
            old, label = label, stored(label.join(small(to), "comp", "left").select("name", "n", F.coalesce("to", "comp").alias("comp")), "comps")
            n = to.filter("comp <> to").count()
            forget(old, to)
        forget(pairs, close, needed, edges)
        return n

    turn, live = 0, None
    while True:
        old, live = live, _alive(parts.join(label, "name"), F.xxhash64("name") if turn else F.col("name"))
        if old is not None:
            forget(old)
        left = live.select("name").distinct().count()
        if not left:
            break
        met = _stars(live, percent)
        if not turn:  # the leader with whom a set shares most parts, before others are tried
            best = met.groupBy("name", "l_name").count().groupBy("name").agg(F.max_by("l_name", F.struct("count", "l_name")).alias("l_name"))
        else:
            best = met
            parts = live.filter("name <> l_name").select("key", "name", "place")
        n = joined(stored(best.select(F.least("name", "l_name").alias("a"), F.greatest("name", "l_name").alias("b")).distinct(), "pairs"))
        if turn and n < GOES_ON * left:
            joined(stored(_blocks(_alive(parts.join(label, "name"), F.col("name")), nodes, percent), "pairs"))
            break
        turn += 1
    named = rows.filter("n > 0").join(label.select("name", "comp"), "name", "left").withColumn("comp", F.coalesce("comp", "name"))
    out = stored(named.select("did", "hash", "n", "comp").union(rows.filter("n = 0").select("did", "hash", "n", F.lit(None).cast("long"))), "linked")
    forget(table, nodes, label, live)
    return out


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text, ...): two documents link when
    100 * |A & B| >= percent * |A | B|; component_id is the smallest doc_id reachable by links."""
    rows = linked(docs, words, percent)
    # A component may hold a large share of all rows: the smallest id of each reaches them without an exchange of rows by
    # component, if the table of those with several ids is counted to be small.
    several = rows.filter("comp is not null").groupBy("comp").agg(F.min("did").alias("least"), F.max("did").alias("most"))
    least = stored(several.filter("least < most").select("comp", "least"), "least")
    out = rows.join(small(least), "comp", "left").withColumn("least", F.coalesce("least", "did"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("did").alias("doc_id"), F.col("n").alias("n_shingles"), real("least").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id, then the least hash of its text, and any of
    rows that are equal in both. Rows without shingles stay."""
    rows = linked(docs, words, percent)
    texted = stored(rows.filter("comp is not null").groupBy("did", "hash").agg(F.min("comp").alias("comp"), F.count("*").alias("times")), "texted")
    alone = F.struct("did", "hash")
    first = texted.groupBy("comp").agg(F.min(alone).alias("first"), F.count("*").alias("members"))
    first = stored(first.filter("members > 1").select("comp", "first"), "first")
    judged = texted.join(small(first), "comp", "left").withColumn("stays", F.col("first").isNull() | (alone == F.col("first")))
    # Rows that go, and those of which one is to be taken; all others stay as they are.
    some = stored(judged.filter("not stays or times > 1").select("did", "hash", "stays"), "some")
    forget(rows, texted, first)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(row, did().alias("did"), F.xxhash64("text").alias("hash"))
    out = own.join(small(some), ["did", "hash"], "left_anti").select("row")
    repeated = own.join(small(some.filter("stays")), ["did", "hash"], "left_semi").groupBy("did", "hash").agg(F.first("row").alias("row"))
    return out.union(repeated.select("row")).select("row.*")
