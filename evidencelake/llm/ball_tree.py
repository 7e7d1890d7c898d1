"""Centroid clustering (Lloyd's rounds over exact integers) with partition-local ball trees.

Vectors become integers once and are stored as trees of at most TREE vectors, one row each: a node has the centre and the
radius of its ball, the number of its vectors and their exact sum; leaves are ranges of the vectors, which lie in tree
order. A round walks every tree: where, by the triangle inequality, one centroid is nearer to all of a ball than any other, the
ball's count and sum go to it unseen; else the walk descends, at last to exact distances of the vectors of a leaf. A round
sends k * (1 + dim) sums a task, which Spark adds up; what reaches the driver is k * (1 + dim) numbers.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out; so an
empty table gives no rows, and with fewer than k vectors there are that many centroids. A null vec_id is written ``null``
where it is hashed; of equal hashes the smaller vector comes first. Repeated rows are vectors of their own. Ties of distance go to
the smaller number. Components beyond 2^27 are handled exactly as well, but a distance or inertia beyond 2^63 - 1 is
returned as that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: Vectors of a tree and of a leaf; components up to EXACT have squared distances in 64 bits; the most that a long holds.
TREE, LEAF, EXACT, MOST = 4096, 16, 1 << 27, (1 << 63) - 1
#: Sums travel as limbs of so many bits, so that they are exact however large.
LIMB = 60
_ROW = "ids binary, named binary, wide boolean, points binary, nodes binary, balls binary, sums binary"
_NODE = np.dtype([("begin", np.int32), ("end", np.int32), ("right", np.int32), ("radius", np.float64)])


def usable(vectors: DataFrame, dim: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, x): the vectors with exactly dim components, all of them finite, as doubles."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    good = (F.size(column) == dim) & finite
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(column, lambda x: x.cast("double")).alias("x"))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python's if one is beyond EXACT; scale is a power of two, so both are exact."""
    if not x.size or np.abs(x).max() <= EXACT / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[int(v) * scale if abs(v) > 2.0**52 else math.floor(v * scale) for v in row] for row in x.tolist()], object)


def floats(points: np.ndarray) -> np.ndarray:
    """points as doubles; infinite where they are larger than any."""
    if points.dtype != object:
        return points.astype(np.float64)
    most = 1 << 1023
    return np.array([[float(v) if -most < v < most else math.copysign(math.inf, v) for v in row] for row in points], np.float64)


def squares(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances to one centroid."""
    by = points - centroid
    return (by * by).sum(axis=1)


class Tree(NamedTuple):
    """Nodes in preorder: a left child follows its parent, ``right`` is the other child (0: a leaf). balls: their centres; sums:
    of the points of each node; each node's points are a range."""

    points: np.ndarray
    nodes: np.ndarray
    balls: np.ndarray
    sums: np.ndarray


def grow(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree, and the order in which it has taken the points. A range is halved at the median of its projection on the line
    between two far points of it."""
    order, nodes, balls, near = np.arange(len(points)), [], [], floats(points)
    open_ = [(0, len(points), -1)]
    with np.errstate(all="ignore"):
        while open_:
            begin, end, parent = open_.pop()
            own = order[begin:end]
            ball = near[own].mean(axis=0)
            far = np.sqrt(((near[own] - ball) ** 2).sum(axis=1))
            if parent >= 0:
                nodes[parent][2] = len(nodes)
            nodes.append([begin, end, 0, far.max() * (1 + 1e-9)])
            balls.append(ball)
            if end - begin > LEAF and far.max() > 0:
                a = near[own[far.argmax()]]
                b = near[own[((near[own] - a) ** 2).sum(axis=1).argmax()]]
                middle = (end - begin) // 2
                order[begin:end] = own[np.argpartition(near[own] @ (b - a), middle)]
                open_ += [(begin + middle, end, len(nodes) - 1), (begin, begin + middle, -1)]
    return _summed(points[order], np.array([tuple(x) for x in nodes], _NODE), np.array(balls)), order


def _summed(points: np.ndarray, nodes: np.ndarray, balls: np.ndarray) -> Tree:
    upto = np.concatenate([np.zeros_like(points[:1]), np.cumsum(points, axis=0)])
    return Tree(points, nodes, balls, upto[nodes["end"]] - upto[nodes["begin"]])


def ranges(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(node, centroids that can be nearest there): the nodes cover the points once. One centroid alone means that the whole ball
    is nearer to it than to any other; several are left at leaves only."""
    near = floats(centroids)
    slack = 1e-6 * (1 + np.abs(near).max(initial=0) + np.abs(tree.balls).max(initial=0))  # far above the error of doubles
    open_ = [(0, np.arange(len(centroids)))]
    with np.errstate(all="ignore"):
        while open_:
            k, among = open_.pop()
            d = np.sqrt(((near[among] - tree.balls[k]) ** 2).sum(axis=1))
            among = among[~(d > d.min() + 2 * tree.nodes["radius"][k] + slack)]  # overflown distances rule nothing out
            right = int(tree.nodes["right"][k])
            if len(among) == 1 or not right:
                yield k, among
            else:
                open_ += [(right, among), (k + 1, among)]


def nearest(points: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest of the centroids ``among``, which ascend; of equals the smaller number."""
    d = np.stack([squares(points, centroids[c]) for c in among], axis=1)
    best = d.argmin(axis=1)
    return among[best], d[np.arange(len(points)), best]


def trees(points: DataFrame, scale: int) -> DataFrame:
    """A row for each tree of at most TREE vectors of a partition."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                tree, order = grow(whole(x, scale))
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)[order]
                named = part.column(0).is_valid().to_numpy(zero_copy_only=False)[order]
                wide = tree.points.dtype == object
                row = {"ids": ids, "named": named, "wide": wide, "points": x[order] if wide else tree.points, "nodes": tree.nodes, "balls": tree.balls, "sums": None if wide else tree.sums}
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], pa.bool_() if k == "wide" else pa.binary()) for k, v in row.items()], list(row))

    return stored(points.mapInArrow(plant, _ROW), "balls")


def _read(row: dict, dim: int, scale: int, wide: bool) -> Tree:
    """The tree of a row, in Python's integers if it or the centroids (wide) need them."""
    nodes, balls = np.frombuffer(row["nodes"], _NODE), np.frombuffer(row["balls"], np.float64).reshape(-1, dim)
    if row["wide"]:
        return _summed(whole(np.frombuffer(row["points"], np.float64).reshape(-1, dim), scale), nodes, balls)
    points, sums = (np.frombuffer(row[c], np.int64).reshape(-1, dim) for c in ("points", "sums"))
    return Tree(points.astype(object), nodes, balls, sums.astype(object)) if wide else Tree(points, nodes, balls, sums)


def _round(balls: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The next centroids: of each its vectors' floor(sum / count), of an empty one itself."""
    k, dim = centroids.shape
    wide = centroids.dtype == object

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dim + 1), object)  # the last column counts
        for batch in batches:
            for row in batch.to_pylist():
                tree = _read(row, dim, scale, wide)
                own = np.zeros((k, dim + 1), tree.sums.dtype)
                for node, among in ranges(tree, centroids):
                    begin, end = int(tree.nodes["begin"][node]), int(tree.nodes["end"][node])
                    if len(among) == 1:
                        own[among[0], :dim] += tree.sums[node]
                        own[among[0], dim] += end - begin
                    else:
                        to, _ = nearest(tree.points[begin:end], centroids, among)
                        for c in among:
                            own[c, :dim] += tree.points[begin:end][to == c].sum(axis=0)
                            own[c, dim] += int((to == c).sum())
                sums += own
        out = []
        for (c, j), v in np.ndenumerate(sums):
            limb, v = 0, int(v)
            while v not in (0, -1) or (v == -1 and limb == 0):
                out.append((c, j, limb, v & ((1 << LIMB) - 1)))
                v, limb = v >> LIMB, limb + 1
            if v == -1:
                out.append((c, j, limb, -1))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["c", "j", "limb", "v"])

    parts = balls.select("wide", "points", "nodes", "balls", "sums").mapInArrow(add, "c int, j int, limb int, v long")
    total = np.zeros((k, dim + 1), object)
    for r in parts.groupBy("c", "j", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # k * (dim + 1) numbers
        total[r["c"], r["j"]] += int(r["v"]) << (LIMB * r["limb"])
    new = np.array([[s // row[dim] for s in row[:dim]] if row[dim] else old.tolist() for row, old in zip(total, centroids, strict=True)], object)
    return new if max(abs(v) for v in new.ravel()) > EXACT else new.astype(np.int64)


def _assign(balls: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector; a whole ball is measured against its one centroid alone."""
    dim, wide = centroids.shape[1], centroids.dtype == object

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = _read(row, dim, scale, wide)
                to, far = np.zeros(len(tree.points), np.int32), np.zeros(len(tree.points), tree.points.dtype)
                for node, among in ranges(tree, centroids):
                    own = slice(int(tree.nodes["begin"][node]), int(tree.nodes["end"][node]))
                    to[own], far[own] = nearest(tree.points[own], centroids, among)
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["named"], bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(to), pa.array(np.minimum(far, MOST).astype(np.int64))], ["vec_id", "cluster", "distance"])

    return balls.mapInArrow(assign, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    spark = vectors.sparkSession
    points = usable(vectors, dim, key, column)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    first = points.orderBy(name, "x").limit(k).collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    centroids = whole(np.array([r["x"] for r in first], np.float64), scale)
    balls = trees(points, scale)
    for _ in range(rounds):
        centroids = _round(balls, centroids, scale)
    assigned = stored(_assign(balls, centroids, scale), "assigned")
    forget(balls)
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = min(MOST, sum(sums.values()))
    rows = [(c, min(MOST, sums.get(c, 0)), total, hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()) for c, row in enumerate(centroids)]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> str:
    """DuckDB SQL of the same rows, for tables with distinct ids and integers of ordinary size."""
    near = "SELECT vec_id, v.q, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN {c} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c.c) = 1"
    mean = (
        "SELECT c.c, CASE WHEN m.q IS NULL THEN c.q ELSE m.q END AS q FROM {c} c LEFT JOIN (SELECT c, list(s ORDER BY j) AS q FROM (SELECT c, j, (sum(x) // count(*) - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS s "
        "FROM (SELECT c, unnest(q) AS x, unnest(range(len(q))) AS j FROM {a}) GROUP BY ALL) GROUP BY c) m USING (c)"
    )
    steps = "".join(f", a{r} AS MATERIALIZED ({near.format(c=f'c{r}')}), c{r + 1} AS MATERIALIZED ({mean.format(c=f'c{r}', a=f'a{r}')})" for r in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, q FROM v ORDER BY c LIMIT {k}){steps},
z AS MATERIALIZED ({near.format(c=f'c{rounds}')})
SELECT vec_id, z.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY z.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM z JOIN c{rounds} c USING (c)"""
