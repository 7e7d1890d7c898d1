"""Token-ID output: best-fit-decreasing packing into rows of an id matrix.

A task tokenises its documents, cuts those that are longer than a row into pieces without loss, and packs the pieces of
each ``BLOCK`` of ids: longest first, each into the row with the least room that holds it.  A segment tree over the
possible rooms finds that row in log(capacity) steps.  No row of the table moves between tasks.

A packed row has its ids (little-endian unsigned 32-bit, as binary; ``padded`` fills the row up), the cumulative lengths
of its segments from 0 on (``cu_seqlens``), and ``resets``, the places where positions start again at 0.

Defined results: null or empty texts are one segment of one id (the end id); repeated rows are packed each; an empty
table returns no rows; extra columns are ignored; a null doc_id stays null in ``doc_ids``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZER, pieces, words

#: Bytes of ids that are packed together, and texts tokenised at once.
BLOCK, SLICE = 48 << 20, 250


class Rooms:
    """Rows by the room they have left, for the question: which has the least room of at least n?"""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) with the least room of at least ``least``, taken out; None if there is none."""
        at = self.leaves + least
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up to the first filled subtree on the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The numbers of the pieces in each row."""
    rooms, rows = Rooms(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = rooms.take(lengths[k])
        room, row = found or (capacity, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(k)
        rooms.put(room - lengths[k], row)
    return rows


_ROW = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, starts array<long>, cu_seqlens array<int>, resets array<int>, ids binary"


def id_matrices(docs: DataFrame, capacity: int = 4096, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each packed sequence of docs (doc_id, text, ...)."""

    def packed(found: list[tuple], base: int) -> pa.RecordBatch:
        out = []
        for n, row in enumerate(best_fit_decreasing([len(f[3]) // 4 for f in found], capacity)):
            segments = [found[k] for k in row]
            cuts = np.cumsum([0] + [len(s[3]) // 4 for s in segments]).tolist()
            out.append((base + n, cuts[-1], [s[0] for s in segments], [s[1] for s in segments], [s[2] for s in segments], cuts, cuts[:-1], b"".join([s[3] for s in segments])))
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
        names = [c.split()[0] for c in _ROW.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, base = words(tokenizer), TaskContext.get().partitionId() << 40
        found: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, size
            rows = packed(found, base)
            base += rows.num_rows
            found.clear()
            size = 0
            for at in range(0, rows.num_rows, 256):
                yield rows.slice(at, 256)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for i, ids in zip(part.column(0).to_pylist(), made.ids([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    found += [(i, *p) for p in pieces(ids, capacity)]
                    size += len(ids)
                if size >= BLOCK:
                    yield from flush()
        if found:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, _ROW)


def padded(rows: DataFrame, capacity: int = 4096, pad: int = 0) -> DataFrame:
    """rows with ``ids`` filled up to capacity ids: each a row of an id matrix."""
    fill = F.repeat(F.lit(pad.to_bytes(4, "little").hex()), F.lit(capacity) - F.col("n_tokens"))
    return rows.withColumn("ids", F.concat("ids", F.unhex(fill)))


def write_matrices(rows: DataFrame, path: str, capacity: int = 4096, pad: int = 0) -> None:
    """Writes the id matrices with their segment lengths and resets as Parquet."""
    padded(rows, capacity, pad).write.parquet(path)
