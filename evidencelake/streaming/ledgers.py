"""Ledgers as streams: daily counts, entries once, and a limit for each session with one marker."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidencelake.operators import index


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, event_type, n) of a stream of events by windows of a day; entries later than ``late`` are dropped."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return windows.select(F.to_date("window.start").alias("day"), "event_type", "n")


def once(entries: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Entries with each key once: an append that is repeated changes nothing."""
    return entries.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def _smallest(frames: Iterator[pd.DataFrame], column: str, most: int) -> tuple[list, int]:
    """(the smallest ``most`` values, how many there are) over all frames of a key, which come in any order."""
    kept: list = []
    count = 0
    for frame in frames:
        count += len(frame)
        kept = heapq.nsmallest(most, [*kept, *frame[column]])
    return kept, count


def capped(entries: DataFrame, session: str, most: int) -> DataFrame:
    """(session, event_id, overflow): the first ``most`` entries of each session, then one row that says more came (the
    limit is the feature). Entries of one batch are taken by event_id, however its frames are cut; memory holds ``most``."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, marked = state.get if state.exists else (0, False)
        room = max(0, most - seen)
        first, count = _smallest(frames, "event_id", room)
        yield pd.DataFrame({"session": key[0], "event_id": first, "overflow": False})
        if count > room and not marked:
            marked = True
            yield pd.DataFrame({"session": [key[0]], "event_id": [None], "overflow": [True]})
        state.update((seen + len(first), marked))

    return entries.select(F.col(session).alias("session"), "event_id").groupBy("session").applyInPandasWithState(
        keep, "session long, event_id long, overflow boolean", "seen long, marked boolean", "append", GroupStateTimeout.NoTimeout
    )


def chained(entries: DataFrame, session: str) -> DataFrame:
    """(session, n, event_id, prev, sha): entries numbered on within their session, each with the hash of the one before.
    The state of a session is its last number and hash, so a session has one writer; entries of one batch follow by
    event_id, and are held together for that."""

    def add(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, prev = state.get if state.exists else (0, "")
        rows = []
        for event in sorted(e for frame in frames for e in frame["event_id"]):
            sha = hashlib.sha256(f"{n}:{prev}:{event}".encode()).hexdigest()
            rows.append((key[0], n, event, prev, sha))
            n, prev = n + 1, sha
        state.update((n, prev))
        yield pd.DataFrame(rows, columns=["session", "n", "event_id", "prev", "sha"])

    return entries.select(F.col(session).alias("session"), "event_id").groupBy("session").applyInPandasWithState(
        add, "session long, n long, event_id long, prev string, sha string", "n long, prev string", "append", GroupStateTimeout.NoTimeout
    )


def near_session(entries: DataFrame, sessions: DataFrame, user: str, ts: str) -> DataFrame:
    """Entries of a stream that fall into the time of a session (user, lo, hi), a second after its end included."""
    inside = (F.col(ts) >= F.col("lo")) & (F.col(ts) <= F.col("hi") + F.expr("INTERVAL 1 SECOND"))
    return entries.join(sessions, user).filter(inside)


def index_merger(path: str, key: str = "doc_id") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: each batch of changed notes (key, text; null text for a note that is gone) makes the
    next generation of records below path. Records of other notes are kept as they are. A batch that comes again makes
    the same generation again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = index.records(batch.filter("text is not null"), key)
        if number:
            old = spark.read.parquet(f"{path}/{number - 1}").join(batch.select(key), key, "left_anti")
            now = old.unionByName(now)
        now.write.mode("overwrite").parquet(f"{path}/{number}")

    return merge
