"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier go.

1. Restriction, without loss.  Equal texts are judged once: later copies of at least ``length`` bytes go whole.  In the
   others, every window of ``length`` bytes has an anchor, the ``GRAM`` bytes in it with the least hash; equal windows
   have equal anchors at equal places.  Anchors that occur once anywhere rule their windows out.
2. Distributed difference-cover sort of the rest.  The stretches of bytes around each repeated anchor go to the
   partition of its hash, so all suffixes that may share a prefix of ``length`` bytes meet there; equal stretches are one
   from then on, and anchors with one stretch left are done.  The other stretches of a partition make strings, in which
   the positions not divisible by 3 (the difference cover) are sampled: their triples are sorted and named by rank, the
   string of names is sorted in the same way until names are unique or stand for ``DEPTH`` = 3^5 bytes, the remaining
   suffixes are sorted by their first byte and the rank behind it and merged in.  Then the ``length`` bytes of neighbours
   in the suffix array are compared: all windows of a run of equal ones but the earliest start later.

The order of suffixes that share ``DEPTH`` bytes is left open: no window is that long.  A global order of all suffixes
(0.58 billion sampled triples for 0.5 GB) is not made: suffixes of different anchors never have to be compared.

Defined results: null is the empty text; documents shorter than ``length`` bytes lose nothing; very long texts are read
whole; rows that repeat a doc_id count as that one document (they never shorten each other at equal places); a null
doc_id is below all others; of equal strings the one in the smallest doc_id, then at the first place, stays; an empty
table returns no rows; extra columns are kept by ``dedup_spans``, whatever their names but ``spans``, and ignored by the
digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import did, fold, forget, gathered, grams, longs, mix, dealt, partitions, released, small, stored, texts

U64 = np.uint64
#: The length of a string, and the bytes of an anchor.
LENGTH, GRAM = 100, 32
#: Levels of names of triples: ranks tell suffixes apart that differ in their first 3^LEVELS bytes, LENGTH at least.
LEVELS = 5
DEPTH = 3**LEVELS
#: Anchor places in a window; bytes from the first window that an anchor can serve to the end of the last.
PLACES = LENGTH - GRAM + 1
SPAN = LENGTH + PLACES - 1
#: Anchors held before they are sent on.
HELD = 1 << 19
#: Bytes that make one string: the stretches of some anchors, of one at least.
TOGETHER = 1 << 18


def owners(data: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes the place of its anchor: the leftmost least hash."""
    h = grams(data, GRAM)
    n = len(h) - PLACES + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = U64((1 << 31) - 1)
    h = (h & ~low) | np.arange(len(h), dtype=U64)
    rows = -(-len(h) // PLACES)
    padded = np.full(rows * PLACES, ~U64(0))
    padded[: len(h)] = h
    grid = padded.reshape(rows, PLACES)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[PLACES - 1 : PLACES - 1 + n]) & low).astype(np.int64)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def _repeated(docs: DataFrame) -> DataFrame:
    """(name, at): places of anchors whose hash occurs at two places of different texts or of one text. name: of a text."""
    parts = partitions(docs.sparkSession)
    buckets = 4 * parts

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        size = 0

        def flush() -> pa.RecordBatch | None:
            key = np.concatenate([k for k, _, _ in held] + [np.zeros(0, U64)])
            at = np.concatenate([a for _, a, _ in held] + [np.zeros(0, np.uint32)])
            name = np.repeat(np.array([x for _, _, x in held], np.int64), [len(k) for k, _, _ in held])
            held.clear()
            return dealt(((key >> U64(24)) % U64(buckets)).astype(np.int32), {"key": key, "name": name, "at": at})

        for batch in batches:
            for name, data in zip(longs(batch.column(0)), texts(batch.column(1)), strict=True):
                own = owners(data)
                if len(own):
                    place = own[_runs(own)[:-1]]
                    place = np.unique(place)
                    held.append((grams(data, GRAM)[place], place.astype(np.uint32), int(name)))
                    size += len(place)
                if size >= HELD:
                    size = 0
                    yield flush()
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches, {"key": U64, "name": np.int64, "at": np.uint32})
        order = np.lexsort((got["at"], got["name"], got["key"]))
        key, name, at = (got[c][order] for c in ("key", "name", "at"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1]) | (at[1:] != at[:-1])
        key, name, at = key[new], name[new], at[new]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        keep = same[1:] | same[:-1]
        name, at = name[keep], at[keep]
        order = np.argsort(name, kind="stable")
        name, at = name[order], at[order]
        cuts = _runs(name)
        for lo in range(0, len(cuts) - 1, 10_000):
            hi = min(lo + 10_000, len(cuts) - 1)
            blobs = [at[cuts[k] : cuts[k + 1]].tobytes() for k in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array(name[cuts[lo:hi]]), pa.array(blobs, pa.binary())], ["name", "at"])

    sent = docs.select("name", "text").mapInArrow(released(emit), "bucket int, key binary, name binary, at binary")
    return sent.repartition(parts, "bucket").drop("bucket").mapInArrow(released(meet), "name long, at binary")


def _sorted(columns: list[np.ndarray], tops: list[int]) -> tuple[np.ndarray, np.ndarray | None]:
    """The order of rows by columns (each from 0 to its top), and the rows as single numbers where 64 bits hold them."""
    if sum(int(t).bit_length() for t in tops) > 63:
        return np.lexsort(columns[::-1]), None
    key = columns[0].astype(np.int64)
    for c, t in zip(columns[1:], tops[1:], strict=True):
        key = key << int(t).bit_length() | c
    return np.argsort(key, kind="stable"), key


def _before(columns: list[np.ndarray], others: list[np.ndarray], tops: list[int]) -> np.ndarray:
    """How many of others (rows in order) are below each row of columns."""
    n = len(others[0])
    both = [np.concatenate((o, c)) for o, c in zip(others, columns, strict=True)]
    order, key = _sorted(both, tops)
    if key is not None:
        return np.searchsorted(np.sort(key[:n]), key[n:], "left")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(order < n) - (order < n)
    return rank[n:]


def suffix_ranks(text: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """The rank of each suffix of text (numbers from 1 on) by its first 3^levels symbols at least: difference cover 3."""
    n = len(text)
    s = np.concatenate((text.astype(np.int64), np.zeros(3, np.int64)))
    top = int(text.max(initial=1))
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # the last of ``one`` sees the end of the text
    sampled = np.concatenate((one, two))
    if not len(sampled):
        return np.zeros(n, np.int64)
    order, key = _sorted([s[sampled], s[sampled + 1], s[sampled + 2]], [top] * 3)
    triple = [key[order]] if key is not None else [s[sampled + k][order] for k in range(3)]
    new = np.zeros(len(order), np.int64)
    for t in triple:
        new[1:] |= t[1:] != t[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) + 1
    last = int(new.sum()) + 1
    among = names - 1 if last == len(names) else suffix_ranks(names, levels - 1) if levels > 1 else None
    if among is None:
        among = np.empty(len(order), np.int64)
        among[order] = np.arange(len(order))
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = among + 1
    # The rest, by the first symbol and the sampled suffix behind it, merged with each of the two sampled classes.
    rest = np.arange(0, n, 3)
    tops = [top, len(sampled) + 1]
    rest = rest[_sorted([s[rest], rank[rest + 1]], tops)[0]]
    end = int(len(one) > 0 and one[-1] == n)  # the empty suffix, before all others, is none of the text
    one = one[one < n]
    place = np.empty(n, np.int64)
    place[rest] = np.arange(len(rest))
    place[rest] += _before([s[rest], rank[rest + 1]], [s[one], rank[one + 1]], tops)
    pair = lambda x: [s[x], s[x + 1], rank[x + 2]]
    place[rest] += _before(pair(rest), pair(two), [top, *tops])
    for x, columns, limits in ((one, lambda x: [s[x], rank[x + 1]], tops), (two, pair, [top, *tops])):
        place[x] = rank[x] - 1 - end + (_before(columns(x), columns(rest), limits) if len(rest) else 0)
    order = np.argsort(place, kind="stable")
    out = np.empty(n, np.int64)
    out[order] = np.arange(n)
    return out


def _settled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that stay, rows that go): of stretches with equal anchors, windows and bytes the earliest stays."""
    x = np.ascontiguousarray(rows["bytes"])
    alike = fold([rows["key"], rows["lo"].astype(U64) << U64(16) | rows["hi"].astype(U64), *x.view(U64).T])
    order = np.lexsort((rows["at"], rows["did"], alike))
    cuts = _runs(alike[order])
    first = np.repeat(order[cuts[:-1]], np.diff(cuts))
    later = (rows["did"][order] != rows["did"][first]) | (rows["at"][order] != rows["at"][first])
    for at in range(0, len(order), 1 << 12):  # some rows at a time
        some = slice(at, at + (1 << 12))
        later[some] &= (x[order[some]] == x[first[some]]).all(axis=1)
    del x
    return rows[np.sort(order[~later])], rows[order[later]]


def _later(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of rows, starts of windows) for each window in rows (stretches) that an earlier window equals."""
    lo, size = rows["lo"].astype(np.int64), rows["hi"].astype(np.int64) - rows["lo"] + LENGTH
    cuts = np.cumsum(size + 1) - (size + 1)  # a separator behind each stretch
    text = np.ones(int(cuts[-1] + size[-1]) + 1, np.int16)
    owner = np.repeat(np.arange(len(rows)), size)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    at = cuts[owner] + within
    text[at] = rows["bytes"][owner, lo[owner] + within].astype(np.int16) + 2
    rank = suffix_ranks(text)
    windows = within < size[owner] - LENGTH + 1
    at, owner, within = at[windows], owner[windows], within[windows]
    order = np.argsort(rank[at])
    at, owner, start = at[order], owner[order], (rows["at"][owner] + lo[owner] + within)[order]
    equal = np.zeros(len(at), bool)  # to the neighbour before
    view = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    for k in range(1, len(at), 1 << 15):
        x = at[k - 1 : k + (1 << 15)]
        equal[k : k + len(x) - 1] = (view[x[1:]] == view[x[:-1]]).all(axis=1)
    run = np.cumsum(~equal)
    order = np.lexsort((start, rows["did"][owner], run))
    owner, start = owner[order], start[order]
    cuts = _runs(run[order])
    first = np.repeat(cuts[:-1], np.diff(cuts))
    later = (rows["did"][owner] != rows["did"][owner[first]]) | (start != start[first])
    return owner[later], start[later]


def _starts(docs: DataFrame) -> DataFrame:
    """(did, name, starts): runs of windows that also start earlier. docs: did, name, text, at (the repeated anchors)."""
    parts = 2 * partitions(docs.sparkSession)
    buckets = 4 * parts
    entry = np.dtype([("key", U64), ("did", np.int64), ("name", np.int64), ("at", np.int64), ("lo", np.int16), ("hi", np.int16), ("bytes", np.uint8, SPAN)])
    settled = np.dtype([("did", np.int64), ("name", np.int64), ("start", np.int64), ("n", np.int64)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            # Of equal stretches of one task only the earliest is sent; the others are settled here, so that a passage
            # in very many documents reaches its partition at most once a task.
            rows, gone = _settled(np.concatenate(held))
            held.clear()
            done = np.zeros(len(gone), settled)
            done["did"], done["name"] = gone["did"], gone["name"]
            done["start"], done["n"] = gone["at"] + gone["lo"], gone["hi"] - gone["lo"] + 1
            for column, values, bucket in (
                ("rows", rows, lambda v: v["key"] >> U64(24)),
                ("done", done, lambda v: mix(v["name"].view(U64) if len(v) else np.zeros(0, U64))),
            ):
                batch = dealt((bucket(values) % U64(buckets)).astype(np.int32), {column: values})
                if batch is not None:
                    none = pa.nulls(batch.num_rows, pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0), *([batch.column(1), none] if column == "rows" else [none, batch.column(1)])], ["bucket", "rows", "done"])

        for batch in batches:
            ids, names_ = longs(batch.column(0)), longs(batch.column(1))
            for i, name, data, blobs in zip(ids, names_, texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                own = owners(data)
                if not len(own):
                    continue
                wanted = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in blobs])).astype(np.int64)
                cuts = _runs(own)  # windows of one anchor are adjacent
                place = own[cuts[:-1]]
                keep = np.isin(place, wanted)
                if not keep.any():
                    continue
                place, lo, hi = place[keep], cuts[:-1][keep], cuts[1:][keep] - 1
                rows = np.zeros(len(place), entry)
                base = place - (PLACES - 1)
                rows["key"] = mix(grams(data, GRAM)[place])
                rows["did"], rows["name"], rows["at"] = i, name, base
                rows["lo"], rows["hi"] = lo - base, hi - base
                index = base[:, None] + np.arange(SPAN)
                inside = (index >= 0) & (index < len(data))
                rows["bytes"] = np.where(inside, data[np.clip(index, 0, len(data) - 1)], 0)
                held.append(rows)
                size += len(rows)
                if size >= HELD // 8:
                    size = 0
                    yield from flush()
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches, {"rows": entry, "done": settled})
        done = got["done"]
        rows, gone = _settled(got.pop("rows"))
        order = np.argsort(rows["key"], kind="stable")
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cuts = _runs(rows["key"][order])
        several = np.diff(cuts) > 1  # an anchor with one stretch left has no other window to compare
        rows = rows[order[np.repeat(several, np.diff(cuts))]]
        cuts = _runs(rows["key"])
        length = np.concatenate(([0], np.cumsum(rows["hi"].astype(np.int64) - rows["lo"] + LENGTH + 1)))
        at = 0
        while at < len(cuts) - 1:  # some anchors at a time, so that their string fits in memory
            to = max(at + 1, int(np.searchsorted(length[cuts], length[cuts[at]] + TOGETHER, "right")) - 1)
            low, high = int(cuts[at]), int(cuts[to])
            each, start = _later(rows[low:high])
            order = np.lexsort((start, each))
            each, start = each[order], start[order]
            heads = np.flatnonzero(np.append(True, (each[1:] != each[:-1]) | (start[1:] != start[:-1] + 1))[: len(each)])
            found.append((low + each[heads], start[heads], np.diff(np.append(heads, len(each)))))
            at = to
        who, start, n = (np.concatenate([f[k] for f in found] + [np.zeros(0, np.int64)]).astype(np.int64) for k in range(3))
        ids = np.concatenate((rows["did"][who], gone["did"], done["did"]))
        name = np.concatenate((rows["name"][who], gone["name"], done["name"]))
        n = np.concatenate((n, gone["hi"].astype(np.int64) - gone["lo"] + 1, done["n"]))
        start = np.concatenate((start, gone["at"] + gone["lo"], done["start"]))
        if not len(ids):
            return
        order = np.lexsort((start, name, ids))
        ids, name, start, n = ids[order], name[order], start[order], n[order]
        cuts = np.unique(np.concatenate((_runs(ids), _runs(name))))
        # Neighbouring windows make one run.
        head = np.ones(len(ids), bool)
        head[1:] = start[1:] != start[:-1] + n[:-1]
        head[cuts[:-1]] = True
        heads = np.flatnonzero(head)
        runs = np.stack((start[heads], np.add.reduceat(n, heads)), axis=1).astype(np.uint32)
        cuts = np.searchsorted(heads, cuts)
        for lo in range(0, len(cuts) - 1, 10_000):
            hi = min(lo + 10_000, len(cuts) - 1)
            blobs = [runs[cuts[k] : cuts[k + 1]].tobytes() for k in range(lo, hi)]
            of = heads[cuts[lo:hi]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(name[of]), pa.array(blobs, pa.binary())], ["did", "name", "starts"])

    sent = docs.select("did", "name", "text", "at").mapInArrow(released(emit), "bucket int, rows binary, done binary")
    return sent.repartition(parts, "bucket").drop("bucket").mapInArrow(released(meet), "did long, name long, starts binary")


def removed_runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of bytes covered by windows. starts: pairs (first start, how many starts in a row)."""
    if not len(starts):
        return []
    s = starts.reshape(-1, 2).astype(np.int64)
    s = s[np.argsort(s[:, 0], kind="stable")]
    low, high = s[:, 0], np.maximum.accumulate(s[:, 0] + s[:, 1] - 1 + LENGTH)
    cut = np.flatnonzero(low[1:] > high[:-1]) + 1
    return list(zip(low[np.concatenate(([0], cut))].tolist(), high[np.concatenate((cut - 1, [len(s) - 1]))].tolist(), strict=True))


def dedup_spans(docs: DataFrame) -> DataFrame:
    """docs with ``spans``: array of (start, end) in bytes of the UTF-8 text, the maximal runs that go."""
    other = [c for c in docs.columns if c.lower() != "spans"]
    # The caller's columns travel as one, so that their names meet none of ours.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in other]).alias("row"), did().alias("did"), F.xxhash64("text").alias("name"))
    text = F.col("row.text")
    plain = own.select("did", "name", text.alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    by_text = plain.filter(size >= LENGTH).groupBy("name", F.md5("text").alias("md5")).agg(F.min("did").alias("did"), F.count("*").alias("n"))
    first = stored(by_text.select("name", "md5", "did", "n"), "first")
    repeated = _repeated(plain.filter(size >= LENGTH)).groupBy("name").agg(F.collect_list("at").alias("at"))
    anchors = stored(repeated.join(first.select("name", "did"), "name"), "anchors")
    # Texts move to their anchors at every size: a broadcast would only suit small inputs.
    some = plain.join(anchors, ["did", "name"])
    starts = stored(_starts(some.select("did", "name", "text", "at")), "starts")
    forget(anchors)
    runs = starts.groupBy("did", "name").agg(F.collect_list("starts").alias("starts"))
    copies = first.filter("n > 1").select("name", "md5", F.col("did").alias("least"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"start": a, "end": b} for a, b in removed_runs(np.concatenate([np.frombuffer(x, np.uint32) for x in blobs]))]
                for blobs in batch.column(2).to_pylist()
            ]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], ["did", "name", "spans"])

    kind = "array<struct<start:bigint,end:bigint>>"
    spans = stored(runs.mapInArrow(released(cover), f"did long, name long, spans {kind}"), "spans")
    copies = stored(copies, "copies")
    forget(starts, first)
    out = own.join(small(spans, 16 * F.size("spans")), ["did", "name"], "left").withColumn("md5", F.md5(text))
    out = out.join(small(copies, F.lit(40)), ["name", "md5"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length(text).cast("long").alias("end")))
    value = F.when(F.col("did") > F.col("least"), whole).otherwise(F.coalesce("spans", F.array().cast(kind)))
    return out.select("row.*", value.alias("spans"))


def kept(data: bytes, spans: list[dict]) -> bytes:
    """data without the spans."""
    out, at = [], 0
    for s in spans:
        out.append(data[at : s["start"]])
        at = s["end"]
    return b"".join([*out, data[at:]])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, lost, n, sha = [], [], [], []
            for data, spans in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                raw = data.tobytes()
                size.append(len(raw)), n.append(len(spans)), lost.append(sum(s["end"] - s["start"] for s in spans))
                sha.append(hashlib.sha256(kept(raw, spans)).hexdigest())
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in (size, lost, n)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = dedup_spans(docs.select("doc_id", "text"))
    return spans.mapInArrow(released(measure), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
