"""LM scoring by a weighted backoff automaton.

Tokens are words, and one end a document.  A state is a history of up to ``order`` - 1 tokens (a start mark included)
that training has seen; the empty history is the root.  A state seen n times has, with k = prior + spread * n,

- an arc for each token that training has seen c times behind it, of probability
  c / (n + k) + k / (n + k) * (the token's probability in the state of the next shorter history);
- a failure arc of weight k / (n + k) to that shorter history's state, for all other tokens.

The root has an arc for every token, (c + 1) / (N + 1 * (V + 1)), unknown ones included.  So the probabilities of each
state sum to one.  A text is read once from left to right: from the current state failure arcs are followed to the first
state with an arc for the token, their weights and the arc's probability are added up as logarithms, and the arc leads to
the next state, the longest history that training has seen.  Long texts are read in runs of ``RUN`` tokens, each from the
state that the tokens before it lead to, and all runs of a block step together.

Distribution.  Each task cuts the documents that it reads into blocks of about ``BLOCK`` bytes and sends each as numbers of
words, small ones for frequent words; texts are not moved.  A block counts its distinct n-grams (those of
training documents; the others with count 0, as a request) and sends each once to the partition of its hash, which adds
up all blocks and answers with what the others have.  So a block has exactly the states and arcs that its texts can
reach, no block has the model of the corpus, and nothing is collected at the driver.  Keys go sorted, as differences, and
all numbers byte plane by byte plane and compressed.

Defined results: null text is the empty text, one end token; without training documents N = V = 0; a null doc_id is the
empty text where held_out is decided, and is returned as null; equal texts have equal scores; repeated rows are
documents of their own; very long texts are read whole; an empty table returns no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, did, fold, longs, mix, partitions, texts, words

U64 = np.uint64
#: Bytes of text in a block, and tokens in a run.
BLOCK, RUN = 6 << 20, 256
#: Weight of the shorter history: in tokens, and in tokens for each token of the longer one.
PRIOR, SPREAD = 4.0, 0.5
_END, _START = mix(np.array([11, 12], U64))
#: The states that every automaton has, and bits of an n-gram's hash that are sent.
ROOT, START, KEY_BITS = 0, 1, 56


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether training leaves a document out: crc32(doc_id as text) mod 7 is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Block:
    """The n-grams of some texts, given as hashes of their words. grams[n]: sorted distinct ones of n + 1 tokens; at[n]: the one that ends at each token,
    -1 where the text has too few before it; counts[n]: how often training documents have them."""

    def __init__(self, rows: list[np.ndarray], train: np.ndarray, order: int) -> None:
        self.sizes = np.array([len(r) + 1 for r in rows], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        weight = np.repeat(train.astype(np.float64), self.sizes)
        line = np.concatenate([x for r in rows for x in (np.array([_START]), r, np.array([_END]))] + [np.zeros(0, U64)])
        place = np.arange(int(self.sizes.sum())) - np.repeat(self.first, self.sizes)  # in its text
        ends = np.arange(len(place)) + np.repeat(np.arange(len(rows)), self.sizes) + 1  # of each token in line
        self.grams, self.at, self.counts = [], [], []
        for n in range(1, order + 1):
            full = place >= n - 2
            end = ends[full]
            keys = mix(fold([line[end - j] for j in range(n - 1, -1, -1)]) + U64(n)) >> U64(64 - KEY_BITS)
            grams, own = np.unique(keys, return_inverse=True)
            at = np.full(len(place), -1)
            at[full] = own
            self.grams.append(grams)
            self.at.append(at)
            self.counts.append(np.bincount(own, weights=weight[full], minlength=len(grams)).astype(np.int64))
        self.end = int(self.at[0][-1]) if len(place) else -1

    def cuts(self, n: int, buckets: int) -> np.ndarray:
        """Where the n-grams of each bucket start: buckets are ranges of hashes."""
        bounds = np.array([b << KEY_BITS for b in range(buckets + 1)], object) // buckets
        return np.searchsorted(self.grams[n], bounds.astype(U64))


class Automaton:
    """States and arcs over the n-grams of a block, whose counts are those of the corpus. Tokens: places in grams[0]."""

    def __init__(self, block: Block, total: int, distinct: int, prior: float, spread: float) -> None:
        self.block, self.tokens = block, len(block.grams[0])
        seen = [c > 0 for c in block.counts]
        order = len(seen)
        back = lambda n: (prior + spread * n) / (n + prior + spread * n)
        docs = int(block.counts[0][block.end]) if block.end >= 0 else 0  # every training document starts and ends once
        p = (block.counts[0] + 1) / (total + distinct + 1)
        self.base = np.log10(p)
        #: The log-probability of a token that no training document has.
        self.unknown = float(np.log10(1 / (total + distinct + 1)))
        where = [np.full(len(g), -1) for g in block.grams]  # a place where each n-gram ends
        for at, w in zip(block.at, where, strict=True):
            ends = np.flatnonzero(at >= 0)
            w[at[ends]] = ends
        # States: root, start, then the seen n-grams of each length below order; no token follows an end.
        bases = np.cumsum([2] + [len(g) for g in block.grams[: order - 1]])
        goes_on = [s & (block.at[0][w] != block.end) for s, w in zip(seen, where, strict=True)]
        self.state = [np.where(s, b + np.arange(len(s)), ROOT) for s, b in zip(goes_on[: order - 1], bases, strict=False)]
        size = int(bases[order - 1])
        self.fail, weight = np.zeros(size, np.int64), np.ones(size)
        weight[START] = back(docs) if docs else 1.0
        self.start = START if docs else ROOT
        keys, logs, to = [], [], []
        for n in range(order):
            if n:
                some = np.flatnonzero(seen[n])
                end = where[n][some]
                lower = block.at[n - 1][end]
                opens = np.isin(end, block.first) if n == 1 else np.zeros(len(end), bool)
                history = np.where(opens, 0, block.at[n - 1][end - 1])
                times = np.where(opens, docs, block.counts[n - 1][history])
                own = np.zeros(len(seen[n]))
                k = prior + spread * times
                own[some] = (block.counts[n][some] + k * p[lower]) / (times + k)
                keys.append(np.where(opens, START, self.state[n - 1][history]) * self.tokens + block.at[0][end])
                logs.append(np.log10(own[some]))
                to.append(self.state[n][some] if n < order - 1 else self.state[n - 1][lower])
                p = own
            if n < order - 1:
                some = np.flatnonzero(goes_on[n])
                if n:
                    self.fail[self.state[n][some]] = self.state[n - 1][block.at[n - 1][where[n][some]]]
                weight[self.state[n][some]] = back(block.counts[n][some])
        self.weight = np.log10(weight)
        keys = np.concatenate([*keys, np.zeros(0, np.int64)])
        sort = np.argsort(keys)
        self.arcs, self.logs, self.to = (np.concatenate([*x, np.zeros(0)])[sort] for x in ([keys], logs, to))
        self.arcs, self.to = self.arcs.astype(np.int64), self.to.astype(np.int64)

    def step(self, states: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability, next state) of each token from each state."""
        logp, state, after = np.zeros(len(states)), states.copy(), np.zeros(len(states), np.int64)
        open_ = np.arange(len(states))
        while len(open_):
            now, token = state[open_], tokens[open_]
            root = now == ROOT
            at = open_[root]
            logp[at] += self.base[token[root]]
            after[at] = self.state[0][token[root]] if self.state else ROOT
            open_, now, token = open_[~root], now[~root], token[~root]
            key = now * self.tokens + token
            arc = np.minimum(np.searchsorted(self.arcs, key), max(0, len(self.arcs) - 1))
            hit = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(key), bool)
            at = open_[hit]
            logp[at] += self.logs[arc[hit]]
            after[at] = self.to[arc[hit]]
            open_, now = open_[~hit], now[~hit]
            logp[open_] += self.weight[now]
            state[open_] = self.fail[now]
        return logp, after

    def scores(self) -> np.ndarray:
        """The log10 probability of each text of the block."""
        block = self.block
        runs = -(-block.sizes // RUN)
        owner = np.repeat(np.arange(len(runs)), runs)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        begin = block.first[owner] + turn * RUN
        size = np.minimum(RUN, block.first[owner] + block.sizes[owner] - begin)
        order = np.argsort(-size, kind="stable")
        owner, turn, begin, size = owner[order], turn[order], begin[order], size[order]
        state = np.where(turn == 0, self.start, ROOT)
        for n, states in enumerate(self.state):  # the longest history seen before the run
            before = np.where(turn > 0, block.at[n][begin - 1], -1)
            state = np.where((before >= 0) & (states[before] != ROOT), states[before], state)
        total = np.zeros(len(size))
        for t in range(int(size[0]) if len(size) else 0):
            alive = int(np.searchsorted(-size, -t, "left"))  # runs of more than t tokens
            logp, state[:alive] = self.step(state[:alive], block.at[0][begin[:alive] + t])
            total[:alive] += logp
        return np.bincount(owner, weights=total, minlength=len(runs))


def planes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each number, plane by plane, compressed."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def numbers(data: bytes, width: int) -> np.ndarray:
    """The numbers of planes()."""
    data = zstandard.ZstdDecompressor().decompress(data)
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1)


_PACKED = "block long, ids binary, held binary, sizes binary, names binary, ranks binary, words binary"
_SENT = "bucket int, n int, block long, keys binary, counts binary"
_ANSWER = "block long, n int, bucket int, size long, more binary, total long, known long"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held: Column, order: int = 3, prior: float = PRIOR, spread: float = SPREAD) -> DataFrame:
    """doc_id, held_out (``held``), n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    spark = docs.sparkSession
    parts = partitions(spark)
    buckets = 4 * parts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block: its documents, and their words as numbers in the sorted list of the block's words."""
        parts_of, rows, size, nth = [], [], 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            names, at, often = np.unique(np.concatenate([*rows, np.zeros(0, U64)]), return_inverse=True, return_counts=True)
            rank = np.empty(len(names), np.int64)
            rank[np.argsort(-often, kind="stable")] = np.arange(len(names))  # small numbers for frequent words: they compress
            ids, held_ = (np.concatenate(x) for x in zip(*parts_of, strict=True))
            columns = {"block": nth, "ids": ids.tobytes(), "held": held_.tobytes(), "sizes": planes(np.array([len(r) for r in rows]), 4), "names": planes(np.diff(names, prepend=U64(0)) if len(names) else names, 8), "ranks": planes(rank, 4), "words": planes(rank[at], 4)}
            return pa.RecordBatch.from_pylist([columns], pa.schema([(k, pa.int64() if k == "block" else pa.binary()) for k in columns]))

        for batch in batches:
            begin = 0
            flags = batch.column(1).to_numpy(zero_copy_only=False)
            for k, x in enumerate(texts(batch.column(2))):
                rows.append(words(x))
                size += len(x) + 8
                if size >= BLOCK or k == batch.num_rows - 1:
                    parts_of.append((longs(batch.column(0))[begin : k + 1], flags[begin : k + 1]))
                    begin = k + 1
                if size >= BLOCK:
                    yield row()
                    parts_of, rows, size, nth = [], [], 0, nth + 1
        if rows:
            yield row()

    # A task that runs again reads the same rows in the same order, so its blocks are the same.
    packed = docs.select(did().alias("did"), held.alias("held"), "text").mapInArrow(pack, _PACKED)

    def opened(row: dict) -> tuple[Block, np.ndarray, np.ndarray]:
        """The block of a row, and the ids of its documents and whether they are held out."""
        names, sizes = np.cumsum(numbers(row["names"], 8), dtype=U64), numbers(row["sizes"], 4).astype(np.int64)
        by_rank = np.empty_like(names)
        by_rank[numbers(row["ranks"], 4).astype(np.int64)] = names
        line = by_rank[numbers(row["words"], 4).astype(np.int64)]
        held_ = np.frombuffer(row["held"], bool)
        return Block(np.split(line, np.cumsum(sizes)[:-1]), ~held_, order), np.frombuffer(row["ids"], np.int64), held_

    def ask(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        block, out = opened(row)[0], []
        for n in range(order):
            cut = block.cuts(n, buckets)
            for b in range(buckets):
                x, y = cut[b], cut[b + 1]
                if x < y or not n:  # the answers to single tokens bring the totals, so each bucket is asked
                    keys = block.grams[n][x:y]
                    apart = np.diff(keys, prepend=U64(0)) if len(keys) else keys
                    out.append((b, n, row["block"], planes(apart, 8), planes(block.counts[n][x:y], 4)))
        return pa.table([pa.array(c) for c in zip(*out, strict=True)], pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows: list[tuple] = []
        for batch in batches:  # in the order of (bucket, n): one such cell is held at a time
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held_rows and row[:2] != held_rows[0][:2]:
                    yield from answered(held_rows)
                    held_rows = []
                held_rows.append(row)
        if held_rows:
            yield from answered(held_rows)

    def answered(cell: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = [np.cumsum(numbers(r[3], 8), dtype=U64) for r in cell]
        own = np.concatenate([numbers(r[4], 4) for r in cell]).astype(np.int64)
        cuts = np.cumsum([0] + [len(k) for k in keys])
        names, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=own, minlength=len(names)).astype(np.int64)
        more, sums, known = total[at] - own, int(total.sum()), int((total > 0).sum())
        bucket, n = cell[0][:2]
        for lo in range(0, len(cell), 500):
            some = range(lo, min(lo + 500, len(cell)))
            out = [(cell[k][2], n, bucket, int(cuts[k + 1] - cuts[k]), planes(more[cuts[k] : cuts[k + 1]], 8), sums, known) for k in some]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "n", "bucket", "size", "more", "total", "known"])

    def read(table: pa.Table, answers: pa.Table) -> pa.Table:
        block, ids, held_ = opened(table.to_pylist()[0])
        cuts = [block.cuts(n, buckets) for n in range(order)]
        total = distinct = 0
        for n, bucket, size, more, sums, known in zip(*(answers.column(c).to_pylist() for c in ("n", "bucket", "size", "more", "total", "known")), strict=True):
            x, y = cuts[n][bucket : bucket + 2]
            assert y - x == size
            block.counts[n][x:y] += numbers(more, 8).astype(np.int64)
            if not n:
                total, distinct = total + sums, distinct + known
        made = Automaton(block, total, distinct, prior, spread)
        seen = block.counts[0][block.at[0]] > 0
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=ids == NULL_ID),
                "held_out": held_,
                "n_tokens": block.sizes,
                "n_known": np.add.reduceat(seen.astype(np.int64), block.first),
                "train_tokens": np.full(len(ids), total, np.int64),
                "base_score": np.add.reduceat(made.base[block.at[0]], block.first),
                "score": made.scores(),
            }
        )

    asked = packed.groupBy("block").applyInArrow(ask, _SENT).repartition(parts, "bucket").sortWithinPartitions("bucket", "n")
    answers = asked.mapInArrow(answer, _ANSWER)
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(read, _SCORED)


def digest(docs: DataFrame, order: int = 3, prior: float = PRIOR, spread: float = SPREAD) -> DataFrame:
    return score(docs.select("doc_id", "text"), held_out(), order, prior, spread)
