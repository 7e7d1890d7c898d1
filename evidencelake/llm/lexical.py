"""Ranked lexical search with MaxScore.

One pass over the documents writes an index of the terms that are asked for: a row a batch of documents, with the lists of
its terms. A scoring task reads such rows, joins them to shards of at most SHARD postings and answers every item on each. Of an
item's lists, sorted by the most that each can add, those whose bounds together stay below the item's threshold (its k-th
best score so far) are non-essential: documents come from the essential lists alone, and the others are probed, highest
bound first, only for documents that can still reach the threshold. Thresholds carry over from shard to shard of a task.
What tasks send is k rows an item; groups of tasks are merged before items are.

Defined results: null and empty texts have no terms and are not counted; a null doc_id is kept and ranks first among equal
scores; repeated rows are documents of their own, in items as well; an item without terms has no rows; texts are read
whole. Items are asked in blocks of about BLOCK bytes of text, each with an index of its own, so that no task holds more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, did, forget, stored
from .terms import Vocabulary, terms

#: Bytes of item texts that are asked at once, postings of a shard, documents that are looked at together, tasks whose
#: best rows meet first.
BLOCK, SHARD, RANGE, GROUP = 4 << 20, 2 << 20, 4096, 64
_ROW = "docs binary, sizes binary, counted long, words long, terms array<int>, dfs array<long>, at binary, tfs binary"


def _items(texts: list[str | None]) -> tuple[list[str], list[list[int]]]:
    """The distinct terms of all texts, and for each text the numbers of its own."""
    t = terms(pa.array([(x or "").encode() for x in texts], pa.large_binary()))
    names: dict[str, int] = {}
    own: list[dict[int, None]] = [{} for _ in texts]
    for a, b, row in zip(t.starts, t.ends, t.row, strict=True):
        own[row][names.setdefault(t.data[a:b].tobytes().lower().decode(), len(names))] = None
    return list(names), [list(x) for x in own]


def _index(docs: DataFrame, names: list[str], name: str) -> DataFrame:
    """A row a batch: doc_ids and numbers of terms of its documents; the terms asked for that it has, in how many documents
    each; the documents and frequencies of their lists, one list after the other."""
    listed = docs.sparkSession.sparkContext.broadcast(names)  # the terms of one block of items

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(listed.value)
        for batch in batches:
            t = terms(batch.column(1))
            found = vocabulary.find(t)
            own = found >= 0
            key, tf = np.unique(found[own] * t.rows + t.row[own], return_counts=True)
            term, df = np.unique(key // max(1, t.rows), return_counts=True)
            n = t.per_row()
            columns = [batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), n.astype(np.int64).tobytes(), int((n > 0).sum()), int(n.sum())]
            lists = [term.astype(np.int32), df.astype(np.int64)]
            raw = [(key % max(1, t.rows)).astype(np.int32).tobytes(), tf.astype(np.int32).tobytes()]
            yield pa.RecordBatch.from_pydict(
                dict(zip(("docs", "sizes", "counted", "words", "terms", "dfs", "at", "tfs"), [[x] for x in (*columns, *lists, *raw)], strict=True)),
                pa.schema([("docs", pa.binary()), ("sizes", pa.binary()), ("counted", pa.int64()), ("words", pa.int64()), ("terms", pa.list_(pa.int32())), ("dfs", pa.list_(pa.int64())), ("at", pa.binary()), ("tfs", pa.binary())]),
            )

    return stored(docs.select(did().alias("doc_id"), "text").mapInArrow(make, _ROW), name)


class Shard:
    """The lists of some documents: for each term their places, ascending, and what the term adds to each."""

    def __init__(self, rows: list[dict], weights: np.ndarray, n: int, total: int) -> None:
        of = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
        docs, sizes = of("docs", np.int64), np.concatenate(of("sizes", np.int64))
        base = np.cumsum([0, *map(len, docs)])[:-1]
        self.docs = np.concatenate(docs)
        whole = 50 * n * int(sizes.max(initial=0)) < 1 << 63
        long = 50 + (50 * sizes * n) // max(1, total) if whole else 50 + np.array([(50 * int(x) * n) // total for x in sizes], np.int64)
        term = np.concatenate([np.repeat(np.asarray(r["terms"], np.int64), r["dfs"]) for r in rows])
        at = np.concatenate([x.astype(np.int64) + b for x, b in zip(of("at", np.int32), base, strict=True)])
        tf = np.concatenate(of("tfs", np.int32)).astype(np.int64)
        order = np.argsort(term, kind="stable")  # the rows' documents ascend, and so do those of each list
        term, self.at, tf = term[order], at[order], tf[order]
        self.adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * long[self.at]))
        self.first = np.searchsorted(term, np.arange(len(weights) + 1))
        some = np.flatnonzero(np.diff(self.first))
        self.bound = np.zeros(len(weights), np.int64)
        if len(some):
            self.bound[some] = np.maximum.reduceat(self.adds, self.first[some])


class Best:
    """The k best (score, doc_id) of an item so far, in any order; threshold is the least score that may still enter."""

    def __init__(self, k: int) -> None:
        self.k, self.threshold, self.probed = k, 1, 0
        self.scores = self.docs = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs])
        best = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[best], docs[best]
        if len(best) == self.k:
            self.threshold = int(self.scores[-1])  # an equal score with a smaller doc_id still enters


def max_score(shard: Shard, asked: list[int], best: Best) -> None:
    """Enters the shard's documents that belong to the k best of the item with these terms."""
    lists = sorted((t for t in asked if shard.bound[t] > 0), key=lambda t: int(shard.bound[t]))
    together = np.cumsum(shard.bound[lists]) if lists else np.zeros(0, np.int64)
    places = [shard.at[shard.first[t] : shard.first[t + 1]] for t in lists]
    adds = [shard.adds[shard.first[t] : shard.first[t + 1]] for t in lists]
    for begin in range(0, len(shard.docs), RANGE):
        essential = int(np.searchsorted(together, best.threshold))  # those before cannot reach it together
        if essential == len(lists):
            return
        scores = np.zeros(RANGE, np.int64)
        for at, add in zip(places[essential:], adds[essential:], strict=True):
            a, b = np.searchsorted(at, (begin, begin + RANGE))
            scores[at[a:b] - begin] += add[a:b]
            best.probed += int(b - a)
        may = np.flatnonzero(scores)
        for k in range(essential - 1, -1, -1):
            may = may[scores[may] + together[k] >= best.threshold]
            if not len(may):
                break
            where = np.searchsorted(places[k], may + begin)
            where[where == len(places[k])] = 0
            has = places[k][where] == may + begin
            scores[may[has]] += adds[k][where[has]]
            best.probed += len(may)
        may = may[scores[may] >= best.threshold]
        if len(may):
            best.add(scores[may], shard.docs[may + begin])


def _shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n: int, total: int) -> Iterator[Shard]:
    rows, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            rows.append(row)
            size += sum(row["dfs"]) + len(row["docs"]) // 8
            if size >= SHARD:
                yield Shard(rows, weights, n, total)
                rows, size = [], 0
    if rows:
        yield Shard(rows, weights, n, total)


def _block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """(item, group, doc_id, score): of each task its k best documents of each item."""
    names, asked = _items([text for _, text in items])
    index = _index(docs, names, "lexical")
    counts = index.agg(F.sum("counted").alias("n"), F.sum("words").alias("total")).first()
    n, total = counts["n"] or 0, counts["total"] or 0
    df = np.zeros(len(names), np.int64)
    for row in index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df")).collect():  # the terms of the items
        df[row["terms"]] = row["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    given = docs.sparkSession.sparkContext.broadcast((weights, asked))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, asked = given.value
        best = [Best(k) for _ in asked]
        for shard in _shards(batches, weights, n, total):
            for own, kept in zip(asked, best, strict=True):
                max_score(shard, own, kept)
        group = TaskContext.get().partitionId() // GROUP
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.docs) for b in best])
        if len(item):
            yield pa.RecordBatch.from_pydict({"item": item, "group": np.full(len(item), group, np.int32), "doc_id": np.concatenate([b.docs for b in best]), "score": np.concatenate([b.scores for b in best])})

    rows = index.select("docs", "sizes", "terms", "dfs", "at", "tfs").mapInArrow(score, "item int, group int, doc_id long, score long")
    order = [F.desc("score"), F.asc("doc_id")]
    for keys in (["item", "group"], ["item"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    ids = [None if i is None else int(i) for i, _ in items]
    named = docs.sparkSession.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    out = rows.join(F.broadcast(named), "item")  # the items of one block
    out = stored(out.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score"), "ranked")
    forget(index)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, as the module says. Items are read in blocks that
    their hashes choose, so none grows with the table; each block takes one pass over the documents."""
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("size")).first()["size"] or 0
    blocks = max(1, math.ceil(size / BLOCK))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = [(r[0], r[1]) for r in part.select("item_id", "text").collect()]  # about BLOCK bytes
        if rows:
            out = out.unionByName(_block(docs, rows, k))
    return out


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def sql(k: int = 50) -> str:
    """DuckDB SQL of the same rows."""
    return f"""
WITH q AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
l AS (SELECT doc_id, {_TERMS} AS all_terms FROM documents),
d AS (SELECT doc_id, len(all_terms)::BIGINT AS n, all_terms FROM l WHERE len(all_terms) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
x AS (SELECT doc_id, n, unnest(all_terms) AS term FROM d),
tf AS (SELECT term, doc_id, n, count(*)::BIGINT AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term) CROSS JOIN c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) CROSS JOIN c GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""
