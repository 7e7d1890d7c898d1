"""An index that grows by segments: each batch of changed notes makes a small one, and what it replaces is hidden, not rewritten.

A segment has the records, postings and lengths of its notes, and ``touched``: the keys that it adds, changes or takes away.
A row counts if no later segment has touched its key, so reading is a union of segments, each without the keys of the later ones.
When FANOUT segments of one tier stand side by side at the young end, they become one of the next tier, so a note is
rewritten once a tier and segments stay few. What holds is said by the newest complete commit; a batch that comes again
finds its commit and does nothing, and one that was killed half way writes over its leftovers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions.text import tokens

from .index import Index, postings, records, stored_text
from .shared import _place, remove
from .shards import shards

#: Segments of a tier that are put together.
FANOUT = 4
_TABLES = ["records", "record_postings", "lengths"]


class Segments(Index):
    """The segments below path, as an index: tables are read merged."""

    @property
    def state(self) -> tuple[int, list[tuple[str, int]]]:
        """(number of the newest commit, its segments (name, tier), the oldest first)."""
        system, place = _place(self.spark, f"{self.path}/commits")
        if not system.exists(place):
            return -1, []
        numbers = [int(f.getPath().getName()) for f in system.listStatus(place)]
        done = [n for n in numbers if system.exists(_place(self.spark, f"{self.path}/commits/{n:09}/_SUCCESS")[1])]
        if not done:
            return -1, []
        rows = self.spark.read.schema("at int, name string, tier int").json(f"{self.path}/commits/{max(done):09}").collect()  # a row a segment
        return max(done), [(r["name"], r["tier"]) for r in sorted(rows) if r["name"]]

    def _part(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{segment}/{name}")

    def _merged(self, names: list[str], table: str) -> DataFrame:
        """The rows of segments that none of the later ones among them hides."""
        parts = []
        for k, name in enumerate(names):
            later = [self._part(x, "touched").select(self.key) for x in names[k + 1 :]]
            rows = self._part(name, table)
            parts.append(rows.join(reduce(DataFrame.union, later).distinct(), self.key, "left_anti") if later else rows)
        return reduce(DataFrame.unionByName, parts)

    def table(self, name: str) -> DataFrame:
        if name == "record_terms":
            return self.table("record_postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.countDistinct(self.key).alias("notes"))
        return self._merged([x for x, _ in self.state[1]], name)

    @property
    def shards(self) -> DataFrame:
        return shards(stored_text(self.table("records"), self.key), self.key)

    @property
    def manifest(self) -> DataFrame:
        return self.table("lengths").agg(F.countDistinct(self.key).alias("notes"), F.count("*").alias("records"), F.avg("dl").alias("record_avgdl"))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Takes a batch (key, text) in: a null text takes the note away; of several rows of a key the one with the largest text
        counts. Numbers grow by batch."""
        last, segments = self.state
        if number <= last:
            return
        name, n = f"batch-{number:09}", int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        folder = f"{self.path}/segments/{name}"
        remove(self.spark, folder)
        rows = batch.groupBy(self.key).agg(F.max("text").alias("text"))
        rows.select(self.key, F.col("text").isNull().alias("gone"), "text").write.parquet(f"{folder}/batch")
        rows = self._part(name, "batch")
        rows.select(self.key, "gone").write.parquet(f"{folder}/touched")
        records(rows.filter("not gone"), self.key).write.parquet(f"{folder}/records")
        listed = self._part(name, "records").select(self.key, "chunk", tokens(F.col("content")).alias("all"))
        listed.select(self.key, "chunk", F.size("all").cast("long").alias("dl")).write.parquet(f"{folder}/lengths")
        made = postings(listed, [self.key, "chunk"]).drop("positions")
        made.repartition(n, "term", self.key).sortWithinPartitions("term").write.parquet(f"{folder}/record_postings")
        remove(self.spark, f"{folder}/batch")
        segments = [*segments, (name, 0)]
        self._commit(number, self._compacted(segments, number))

    def _compacted(self, segments: list[tuple[str, int]], number: int) -> list[tuple[str, int]]:
        while len(segments) >= FANOUT and len({tier for _, tier in segments[-FANOUT:]}) == 1:
            old, tier = segments[-FANOUT:], segments[-1][1] + 1
            names, name = [x for x, _ in old], f"tier-{tier}-{number:09}"
            folder = f"{self.path}/segments/{name}"
            remove(self.spark, folder)
            for table in _TABLES:
                self._merged(names, table).write.parquet(f"{folder}/{table}")
            touched = self._merged(names, "touched")
            oldest = len(segments) == FANOUT  # then there is nothing left to hide
            (touched.filter("not gone") if oldest else touched).write.parquet(f"{folder}/touched")
            segments = [*segments[:-FANOUT], (name, tier)]
        return segments

    def _commit(self, number: int, segments: list[tuple[str, int]]) -> None:
        rows = [(k, name, tier) for k, (name, tier) in enumerate(segments)]
        self.spark.createDataFrame(rows, "at int, name string, tier int").coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/{number:09}")

    def tidy(self) -> None:
        """Removes the segments and commits that the newest commit does not name, once no reader uses them any more."""
        number, segments = self.state
        keep = {name for name, _ in segments}
        for part, stays in (("segments", lambda x: x in keep), ("commits", lambda x: int(x) == number)):
            system, place = _place(self.spark, f"{self.path}/{part}")
            for f in system.listStatus(place) if system.exists(place) else []:
                if not stays(f.getPath().getName()):
                    system.delete(f.getPath(), True)

    def each_batch(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch of a stream of changes (key, text)."""
        return lambda batch, number: self.apply(batch, number)
