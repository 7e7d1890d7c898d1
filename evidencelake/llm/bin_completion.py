"""Best-fit packing by bin completion.

The search sees only how many pieces there are of each length: at most ``capacity`` numbers, whatever the size of the
table.  Best-fit decreasing gives the first incumbent.  If it misses the lower bound, bin completion fills bins one
after the other around the largest piece left: it enumerates the undominated fillings of the room beside it, least waste
first and large pieces before small ones, takes each as often as the pieces allow, and drops every branch whose waste
exceeds what a better solution than the incumbent could have.  Sets of sums that the shorter lengths can reach cut the
enumeration to fillings that exist.  What a branch leaves is packed by best fit from time to time, so the incumbent is
complete at any time.

The search ends when the incumbent meets the lower bound, when all branches are closed, or at one of the limits ``nodes``
and ``width``.  The result says which: ``lower_bound`` holds for every packing, and ``proved`` tells whether none has
fewer sequences.

The plan (runs of equal bins) is a bounded table.  Each piece gets its rank among the pieces of its length from counts
of (length, bucket), and the rank gives its bin and offset.  No piece leaves the cluster.

Defined results: null or empty texts are one piece of one token (the end id); repeated rows are packed each; an empty
table returns no rows; extra columns are ignored; a null doc_id stays null; a text longer than a sequence is cut; pieces
of equal length take the places of that length by a hash of (doc_id, piece), then by doc_id, piece and ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, did, partitions, stored
from .tokens import TOKENIZER, pieces, words

#: A filled bin: its lengths, the largest first.
Filling = tuple[int, ...]
#: Limits of the search: bins filled in all, and undominated fillings tried for one bin. A search that reaches one ends
#: with its incumbent, and says so.
NODES, WIDTH = 20_000, 8
#: Sums are looked up in sets that are made anew after this many bins; older sets only prune less.
FRESH = 64
#: Texts tokenised at once.
SLICE = 250


class Plan(NamedTuple):
    """Fillings with the number of bins of each; no packing has fewer than lower_bound bins; proved: nor fewer than this."""

    bins: list[tuple[Filling, int]]
    lower_bound: int
    proved: bool

    @property
    def size(self) -> int:
        return sum(n for _, n in self.bins)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing, bins with the same content together: (filling, number of bins)."""
    open_bins: dict[int, list[tuple[tuple, int]]] = {}  # by room; contents as chains (times, length, chain before)
    rooms: list[int] = []  # sorted keys of open_bins

    def put(chain: tuple, n: int, room: int) -> None:
        if n:
            if room not in open_bins:
                open_bins[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            open_bins[room].append((chain, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                put((each, length, ()), left // each, capacity - each * length)
                put((left % each, length, ()), min(1, left % each), capacity - left % each * length)
                break
            room = rooms[at]
            chain, n = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            each = room // length  # best fit goes on with the bin that it has just filled
            full = min(n, left // each)
            if full:
                put((each, length, chain), full, room - each * length)
                put(chain, n - full, room)
                left -= full * each
            else:
                put((left, length, chain), 1, room - left * length)
                put(chain, n - 1, room)
                left = 0

    def unrolled(chain: tuple) -> Filling:
        out: list[int] = []
        while chain:
            times, length, chain = chain
            out += [length] * times
        return tuple(reversed(out))

    return [(unrolled(chain), n) for bins in open_bins.values() for chain, n in bins]


def lower_bound(counts: dict[int, int] | np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: by volume, and by pieces of over half a bin with those that fit beside none of them.
    counts: by length, or an array with the count of each length from 0 to capacity."""
    if isinstance(counts, dict):
        n = np.zeros(capacity + 1, np.int64)
        for k, m in counts.items():
            n[k] = m
    else:
        n = counts
    size = n * np.arange(capacity + 1)
    pieces_to, volume_to = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(size)))
    half = capacity // 2
    small = np.flatnonzero(n[: half + 1])
    big = pieces_to[-1] - pieces_to[capacity - small + 1]
    middle = pieces_to[capacity - small + 1] - pieces_to[half + 1]
    room = middle * capacity - (volume_to[capacity - small + 1] - volume_to[half + 1])
    more = np.maximum(0, -(-(volume_to[half + 1] - volume_to[small] - room) // capacity))
    least = int((big + middle + more).max(initial=0))
    return max(least, -(-int(volume_to[-1]) // capacity), int(pieces_to[-1] - pieces_to[half + 1]))


def _fits_into(items: Filling, rooms: Filling) -> bool:
    """Whether items can be packed into rooms. Both are short: a filling has at most as many pieces as its search asked."""
    if not items:
        return True
    seen = set()
    for k, room in enumerate(rooms):
        if items[0] <= room and room not in seen:
            seen.add(room)
            if _fits_into(items[1:], (*rooms[:k], room - items[0], *rooms[k + 1 :])):
                return True
    return False


class _Search:
    """Depth-first bin completion over counts that are changed in place and restored on the way back."""

    def __init__(self, counts: dict[int, int], capacity: int, width: int) -> None:
        self.capacity, self.width = capacity, width
        self.n = np.zeros(capacity + 1, np.int64)
        for k, m in counts.items():
            self.n[k] = m
        self.lengths: list[int] = sorted(counts)
        self.reach: list[int] = []
        self.made = 0
        self.cut = False  # a limit of the enumeration was reached

    def take(self, need: dict[int, int], times: int) -> None:
        for k, m in need.items():
            self.n[k] -= m * times
            if not self.n[k]:
                self.lengths.pop(bisect_left(self.lengths, k))

    def give(self, need: dict[int, int], times: int) -> None:
        for k, m in need.items():
            if not self.n[k]:
                self.lengths.insert(bisect_left(self.lengths, k), k)
                self.reach = []
            self.n[k] += m * times

    def _sums(self) -> None:
        """known[j]: the lengths; reach[j]: a bit for each sum of any numbers of the j + 1 shortest of them. Lengths that
        are used up later stay in: the sets then hold too much, never too little."""
        full = (1 << (self.capacity + 1)) - 1
        self.known, self.reach, self.made = list(self.lengths), [], 0
        bits = 1
        for k in self.known:
            step = k
            while step <= self.capacity:
                bits |= bits << step & full
                step *= 2
            self.reach.append(bits)

    def fillings(self, largest: int, waste: int) -> list[Filling]:
        """Undominated fillings beside one piece of length largest that waste at most ``waste``: least waste first."""
        if not self.reach or self.made >= FRESH:
            self._sums()
        self.made += 1
        room = self.capacity - largest
        short = [k for k in (self.lengths[0], largest) if k <= room]
        if not short or (self.lengths[0] == largest and self.n[largest] == 1):
            return [()] if room <= waste else []
        found: list[Filling] = []
        steps = 64 * self.width * 8
        used: Counter[int] = Counter({largest: 1})

        def go(top: int, left: int, chosen: tuple[int, ...]) -> None:
            nonlocal steps
            if not left:
                found.append(chosen)
                return
            at = bisect_right(self.known, min(top, left)) - 1
            while at >= 0 and len(found) < self.width:
                if not self.reach[at] >> left & 1:  # no sum of this and shorter lengths
                    return
                k = self.known[at]
                steps -= 1
                if steps <= 0:
                    self.cut = True
                    return
                if used[k] < self.n[k]:
                    used[k] += 1
                    go(k, left - k, (*chosen, k))
                    used[k] -= 1
                at -= 1

        least = self.lengths[0]
        for w in range(min(waste, room) + 1):
            if len(found) >= self.width or steps <= 0:
                self.cut = True
                break
            before = len(found)
            go(self.capacity, room - w, ())
            if w >= least:  # a filling that leaves room for another piece is dominated by the one with that piece
                found[before:] = [f for f in found[before:] if not self._room_for(f, largest, w)]
        kept: list[Filling] = []
        for f in found:
            if not any(_fits_into(f, g) for g in kept if sum(g) >= sum(f) and len(g) <= 8 and len(f) <= 8):
                kept.append(f)
        return kept

    def _room_for(self, filling: Filling, largest: int, left: int) -> bool:
        for k in self.lengths:
            if k > left:
                return False
            if filling.count(k) + (k == largest) < self.n[k]:
                return True
        return False


def plan(counts: dict[int, int], capacity: int, nodes: int = NODES, width: int = WIDTH) -> Plan:
    """Fillings and how many bins get each, for all pieces of counts."""
    counts = {k: n for k, n in counts.items() if n}
    best, least = best_fit(counts, capacity), lower_bound(counts, capacity)
    size = sum(n for _, n in best)
    if size <= least:
        return Plan(best, least, True)
    total = sum(k * n for k, n in counts.items())
    search = _Search(counts, capacity, width)
    path: list[tuple[Filling, int, dict[int, int]]] = []
    used = waste = spent = 0
    checked = pieces_left = sum(counts.values())

    def opened() -> list[Filling]:
        largest = search.lengths[-1]
        return [(largest, *f) for f in reversed(search.fillings(largest, (size - 1) * capacity - total - waste))]

    stack = [opened()]
    while stack and size > least and spent < nodes:
        if not stack[-1]:
            stack.pop()
            if path:
                filling, times, need = path.pop()
                search.give(need, times)
                used, waste = used - times, waste - times * (capacity - sum(filling))
                pieces_left += times * len(filling)
            continue
        filling = stack[-1].pop()
        need = dict(Counter(filling))
        room, allowed = capacity - sum(filling), (size - 1) * capacity - total - waste
        times = min(int(search.n[k]) // n for k, n in need.items())
        times = min(times, allowed // room) if room else times
        if times < 1:
            continue
        spent += 1
        search.take(need, times)
        path.append((filling, times, need))
        used, waste, pieces_left = used + times, waste + times * room, pieces_left - times * len(filling)
        if used + lower_bound(search.n, capacity) >= size:
            stack.append([])
            continue
        if not search.lengths or pieces_left <= 0.9 * checked or pieces_left < 64:
            checked = pieces_left
            tail = best_fit({k: int(search.n[k]) for k in search.lengths}, capacity)
            if used + sum(n for _, n in tail) < size:
                best = [(f, n) for f, n, _ in path] + tail
                size = sum(n for _, n in best)
        stack.append(opened() if search.lengths else [])
        if not search.lengths:
            checked = sum(counts.values())
    # Taking a filling as often as possible leaves out branches that take it less often, so only a search whose
    # fillings were each taken once has seen them all.
    whole = not stack and not search.cut and max(counts.values()) == 1
    return Plan(best, least, size <= least or whole)


def document_pieces(docs: DataFrame, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """did, piece, start, length, ids_crc32 of each piece of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = words(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = []
                for i, ids in zip(part.column(0).to_pylist(), made.ids([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    rows += [(i, piece, start, len(p) // 4, zlib.crc32(p)) for piece, start, p in pieces(ids, capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["did", "piece", "start", "length", "ids_crc32"])

    return docs.select(did().alias("did"), "text").mapInArrow(cut, "did long, piece long, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str = TOKENIZER, nodes: int = NODES, width: int = WIDTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of docs (doc_id, text, ...), and for all
    pieces alike sequences (their number), lower_bound (no packing has fewer) and proved (nor fewer than sequences)."""
    spark = docs.sparkSession
    cut = stored(document_pieces(docs, capacity, tokenizer), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    length, first, base, each, start = [], [], [], [], []
    seen: dict[int, int] = {}
    bins = 0
    made = plan(counts, capacity, nodes, width)
    for filling, n in made.bins:
        at = 0
        for k in sorted(set(filling), reverse=True):
            times = filling.count(k)
            length.append(k), first.append(seen.get(k, 0)), base.append(bins), each.append(times), start.append(at)
            seen[k] = seen.get(k, 0) + n * times
            at += k * times
        bins += n
    table = np.array([length, first, base, each, start], np.int64).reshape(5, -1)
    table = table[:, np.lexsort((table[1], table[0]))]
    runs = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, lo, bin0, times, off = runs.value
        heads = np.concatenate((np.searchsorted(k, np.arange(capacity + 2)),))
        for batch in batches:
            own, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.zeros(len(own), np.int64)
            for x in np.unique(own):
                here = own == x
                a, b = heads[x], heads[x + 1]
                at[here] = a + np.searchsorted(lo[a:b], rank[here], "right") - 1
            turn = rank - lo[at]
            sequence, place_in = bin0[at] + turn // times[at], off[at] + turn % times[at] * own
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(place_in)], names)

    names = ["did", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("did", "piece"), F.lit(4 * partitions(spark))))
    ahead = cut.groupBy("length", "bucket").count()
    ahead = ahead.withColumn(
        "before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("count")
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("did", "piece", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("own", own).join(ahead, ["length", "bucket"])
    ranked = ranked.select("did", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))
    out = ranked.mapInArrow(place, ", ".join(f"{c} long" for c in names))
    return out.select(
        F.when(F.col("did") != NULL_ID, F.col("did")).alias("doc_id"), F.col("piece").cast("int").alias("piece"), *names[2:],
        F.lit(made.size).cast("long").alias("sequences"), F.lit(made.lower_bound).cast("long").alias("lower_bound"), F.lit(made.proved).alias("proved"),
    )
