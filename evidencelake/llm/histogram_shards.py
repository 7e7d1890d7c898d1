"""Sharding by histogram sort.  DataFrame operations only.

Law ``bytes``: shards are ranges of one order, cut where their sizes are equal.  The order is by a hash of the text,
then a hash of doc_id, then doc_id, so equal texts are neighbours.  Splitters are found by counting: each round adds up
the exact bytes in ``PROBES`` cells between the bounds still open for each splitter, over all partitions at once, and
keeps the cell that holds the target; only these counts reach the driver.  A splitter is settled when a cell boundary is
within ``tolerance`` of its target.  One text that holds more than that is split by the second hash.  Then the rows move
once, dealt by (shard, cell), and are numbered within their cell, after the rows of the cells before.

Defined results: a null text has 0 bytes and so size 1, and the CRC of no bytes, 0; rows that repeat a doc_id and text
take neighbouring slots; a null doc_id sorts first within its text; an empty table returns no rows; columns named as the
result's are replaced, other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import did, stored

PROBES = 64
#: Cells of a shard by text hash and by document hash: rows of a cell are numbered in one task.
TEXT_CELLS, ID_CELLS = 16, 16
_TOP = 1 << 63


def _half(c: Column) -> Column:
    """A 64-bit hash as a number from 0 to 2^63 - 1, so that differences do not overflow."""
    return F.shiftrightunsigned(c, 1)


def _refine(rows: DataFrame, key: str, goals: dict[int, int], slack: int) -> dict[int, tuple[int, int]]:
    """For each splitter j with target goals[j]: (bound, bytes below it), the bound within slack of the target, or the
    value of a key that holds the target alone (then bytes below are more than slack away)."""
    lowest, highest = rows.agg(F.min(key), F.max(key)).first()
    if lowest is None:
        return {}
    # Open bounds [lo, hi] of keys, and the bytes below lo.
    bounds = {j: (lowest, highest, 0) for j in goals}
    found: dict[int, tuple[int, int]] = {}
    while bounds:
        spans = sorted({(lo, hi) for lo, hi, _ in bounds.values()})
        cells = F.lit(None)
        for k, (lo, hi) in enumerate(spans):
            width = max(1, -(-(hi - lo + 1) // PROBES))
            cells = F.when(F.col(key).between(lo, hi), F.lit(k * PROBES) + F.expr(f"({key} - {lo}L) div {width}L")).otherwise(cells)
        counted = rows.select(cells.alias("cell"), key, "size").filter("cell is not null").groupBy("cell")
        got = {r["cell"]: r for r in counted.agg(F.sum("size").alias("size"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        nxt = {}
        for j, (lo, hi, below) in bounds.items():
            k = spans.index((lo, hi))
            own = [got[c] for c in sorted(got) if k * PROBES <= c < (k + 1) * PROBES]
            at = below
            for r in own:
                if at + r["size"] > goals[j] or r is own[-1]:
                    break
                at += r["size"]
            after = at + r["size"]
            if min(goals[j] - at, after - goals[j]) <= slack:
                found[j] = (r["lo"], at) if goals[j] - at <= after - goals[j] else (r["hi"] + 1, after)
            elif r["lo"] == r["hi"]:
                found[j] = (r["lo"], at)
            else:
                nxt[j] = (r["lo"], r["hi"], at)
        bounds = nxt
    return found


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.01) -> DataFrame:
    """docs with size, law, shard and slot: sizes of shards are near equal, slots of a shard gapless from 0."""
    new = ["size", "law", "shard", "slot"]
    other = [c for c in docs.columns if c.lower() not in new]
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in other]).alias("row"),  # so that the caller's names meet none of ours
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        _half(F.xxhash64("text")).alias("_text"),
        _half(F.xxhash64(did())).alias("_id"),
        did().alias("_did"),
    )
    return _shard(own, shards, tolerance).select("row.*", *new)


def _shard(own: DataFrame, shards: int, tolerance: float) -> DataFrame:
    total = own.agg(F.sum("size")).first()[0] or 0
    slack = int(tolerance * total / shards)
    goals = {j: j * total // shards for j in range(1, shards)}
    by_text = _refine(own.select("_text", "size"), "_text", goals, slack)
    splitters: dict[int, tuple[int, int]] = {}
    for j, (bound, below) in by_text.items():
        splitters[j] = (bound, 0)
        if abs(goals[j] - below) > slack:  # one text holds the target: split it by the hash of doc_id
            inner = _refine(own.filter(F.col("_text") == bound).select("_id", "size"), "_id", {j: goals[j] - below}, slack)
            splitters[j] = (bound, inner[j][0])
    number = F.lit(0)
    for text, ident in splitters.values():
        # A bound may be one past the largest key, 2^63, which no long holds: then no row is behind it.
        if text < _TOP:
            behind = (F.col("_text") > text) | ((F.col("_text") == text) & ((F.col("_id") >= ident) if ident < _TOP else F.lit(False)))
            number = number + behind.cast("int")
    text_cell = F.expr(f"_text div {_TOP // (TEXT_CELLS * shards)}L")
    id_cell = F.expr(f"_id div {_TOP // ID_CELLS}L")
    rows = own.withColumns({"law": F.lit("bytes"), "shard": number, "_a": text_cell, "_b": id_cell})
    # (shards + 1) * TEXT_CELLS * ID_CELLS * shards rows at most, whatever the size of the table
    cells = rows.groupBy("shard", "_a", "_b").count()
    ahead = Window.partitionBy("shard").orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(cells.withColumn("before", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count"), "cells")
    within = Window.partitionBy("shard", "_a", "_b").orderBy("_text", "_id", "_did")
    numbered = rows.withColumn("_own", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(cells), ["shard", "_a", "_b"]).withColumn("slot", (F.col("before") + F.col("_own")).cast("long"))


def digest(docs: DataFrame, shards: int = 8, tolerance: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs; texts are read once."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        _half(F.xxhash64("text")).alias("_text"),
        _half(F.xxhash64(did())).alias("_id"),
        did().alias("_did"),
    )
    out = _shard(stored(rows, "keys"), shards, tolerance)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
