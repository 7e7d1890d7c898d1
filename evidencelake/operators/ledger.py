"""Append-only ledgers: chains of hashes, sessions, co-occurrence, supersession, costs, differences of generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): added, removed, changed or unchanged between two generations (key, digest)."""
    a, b = old.select(key, F.col(digest).alias("_old")), new.select(key, F.col(digest).alias("_new"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def moved(removed: DataFrame, added: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, moved_to): the n-th removed row of a digest became the n-th added row of that digest."""
    nth = Window.partitionBy(digest).orderBy(key)
    a = removed.select(key, digest, F.row_number().over(nth).alias("_n"))
    b = added.select(F.col(key).alias("moved_to"), digest, F.row_number().over(Window.partitionBy(digest).orderBy(key)).alias("_n"))
    return a.join(b, [digest, "_n"]).select(key, "moved_to")


def chained(rows: DataFrame, group: str, order: str, line: Column) -> DataFrame:
    """rows with sha and prev: the hash of the line, and that of the line before."""
    own = rows.withColumn("sha", F.sha2(line.cast("binary"), 256))
    return own.withColumn("prev", F.lag("sha").over(Window.partitionBy(group).orderBy(order)))


def pair_counts(baskets: DataFrame, basket: str, item: str, session: str, day: str) -> DataFrame:
    """(a, b, n, sessions, days): how often two items share a basket, once a basket. Baskets are short (the caller
    bounds them), so a self-join on the basket stays linear in the table."""
    own = baskets.select(basket, item, session, day).distinct()
    a = own.select(F.col(basket).alias("_k"), F.col(item).alias("a"), F.col(session).alias("_s"), F.col(day).alias("_d"))
    b = own.select(F.col(basket).alias("_k"), F.col(item).alias("b"))
    pairs = a.join(b, "_k").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.countDistinct("_k").alias("n"), F.countDistinct("_s").alias("sessions"), F.countDistinct("_d").alias("days"))


def sessions(events: DataFrame, user: str, ts: str, gap_minutes: int) -> DataFrame:
    """events with session: a new one after a gap."""
    w = Window.partitionBy(user).orderBy(ts, "event_id")
    gone = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    return events.withColumn("session", F.sum(F.when(gone.isNull() | (gone > gap_minutes * 60), 1).otherwise(0)).over(w))


def successors(edges: DataFrame) -> DataFrame:
    """(target, n): how many records supersede a record directly. edges: (id, supersedes)."""
    return edges.groupBy(F.col("supersedes").alias("target")).agg(F.countDistinct("id").alias("n"))


def in_force(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Records that nothing supersedes."""
    return records.join(edges.select(F.col("supersedes").alias("id")), "id", "left_anti")


def known_sum(value: Column) -> list[Column]:
    """total of the known values and how many are unknown: unknown is not zero."""
    return [F.round(F.sum(value), 6).alias("total"), F.count_if(value.isNull()).alias("unknown")]
