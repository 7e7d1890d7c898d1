"""Mixing sources to target weights by capped water-filling.

Targets: the budget is shared by weight; a source whose share exceeds ``epochs`` times its size is clamped there, and
the excess goes to the others by weight, until none is above.  Ordered by cap / weight the clamped sources are a prefix,
found with running sums over the table of sources (one row a source, aggregated before it moves).

Sampling: a source at e epochs repeats every document floor(e) times and one seeded sample of its documents once more.
Documents are ordered by the MD5 of (seed, doc_id); the sample is the prefix whose size comes nearest to the fraction
that is left, so a source misses its target by half a document at most.  Running sums go through ``CELLS`` cells of the
order, so that no source, however large, is gathered in one task; only the cell in which the prefix ends is summed row by
row.

Defined results: null text has size 0; a null source is a source of its own, after all others; a source of size 0 has
target 0 and its documents are taken floor(0) = 0 times; empty texts of other sources are repeated as their place in the
order says, never more than ``epochs`` times; a null doc_id is hashed as the empty text; of documents with equal hashes
the one with the smaller doc_id, then size comes first, and equal rows in any order; very long texts are counted whole;
repeated rows are documents of their own; an empty table returns no rows; extra columns are kept, whatever their names,
unless a result column has their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, small, stored

#: The pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Cells of the order of each source: the first three hex digits of the hash.
CELL_DIGITS = 3


def size_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, epochs: float) -> DataFrame:
    """source, source_size, target of each source in sizes (source, size)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = F.sum("source_size").over(Window.partitionBy())
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    by_source = by_source.withColumns({"weight": weight, "budget": share * total, "cap": epochs * F.col("source_size")})
    upto = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    state = by_source.withColumns(
        {
            "gone": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "heavy": F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # The order makes this a prefix: once a source is below its cap, all later ones are.
    state = state.withColumn("clamped", F.col("cap") * F.col("heavy") <= F.col("weight") * (F.col("budget") - F.col("gone")))
    everyone = Window.partitionBy()
    free = F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(everyone)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(everyone), F.lit(0.0))
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(left * F.col("weight") / free)
    return state.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, times (how often the mix repeats the document) and taken (words)."""
    new = ["size", "source_size", "target", "times", "taken"]
    other = [c for c in docs.columns if c.lower() not in new]
    size = size_words() if "text" in docs.columns else F.col("size").cast("long")
    # The caller's columns travel as one, so that their names meet none of ours.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in other]).alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), size.alias("size"))
    return _mix(own, weights, share, epochs, seed).select("row.*", *new)


def _mix(own: DataFrame, weights: list[float], share: float, epochs: float, seed: int) -> DataFrame:
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    own = own.withColumns({"_hash": hashed, "_cell": F.substring(hashed, 1, CELL_DIGITS)})
    keys = own.select("source", "size", "_cell")
    cells = stored(keys.groupBy("source", "_cell").agg(F.sum("size").alias("size")), "cells")
    goals = targets(cells, weights, share, epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    )
    goals = stored(goals.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    in_order = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cells.withColumn("ahead", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    same = lambda a, b: F.expr(f"{a}.source <=> {b}.source")
    marks = ahead.alias("a").join(goals.alias("g"), same("a", "g")).select(
        F.col("a.source").alias("source"), F.col("a._cell").alias("_cell"), "ahead", F.col("a.size").alias("cell_size"), "source_size", "target", "whole", "need"
    )
    # 16^CELL_DIGITS rows a source at most: documents stay where they are unless these are counted to be many.
    marks = stored(marks, "marks")
    forget(cells, goals)
    marks = small(marks, F.lit(96) + F.coalesce(F.octet_length("source"), F.lit(0))).alias("m")
    full = own.alias("d").join(marks, F.expr("d.source <=> m.source AND d._cell = m._cell"))
    full = full.select("d.*", "ahead", "cell_size", "source_size", "target", "whole", "need")
    # The prefix ends in the cell that holds `need`; a document belongs to it if its middle does.
    ends = (F.col("ahead") <= F.col("need")) & (F.col("ahead") + F.col("cell_size") > F.col("need"))
    inside = Window.partitionBy("source", "_cell").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    edge = full.filter(ends).withColumn("more", (2 * at + F.col("size") <= 2 * F.col("need")).cast("long"))
    rest = full.filter(~ends).withColumn("more", (F.col("ahead") < F.col("need")).cast("long"))
    times = F.col("whole") + F.when((F.col("source_size") > 0) & (F.col("need") > 0), F.col("more")).otherwise(0)
    return edge.unionByName(rest).withColumns({"times": times}).withColumn("taken", F.col("times") * F.col("size"))


def digest(docs: DataFrame, weights: list[float], share: float, epochs: float, seed: int) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs; texts are read once and not moved."""
    sizes = stored(docs.select("doc_id", "source", size_words().alias("size")), "sizes")
    return _mix(sizes, weights, share, epochs, seed).select("doc_id", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, weights: list[float], share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed table: each document of docs as often as the mix takes it, with the columns of docs."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"), "doc_id", "source", size_words().alias("size"))
    mixed = mix(whole, weights, share, epochs, seed).filter("times > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("whole_row.*")


def sql(weights: list[float], share: float, epochs: float, seed: int) -> str:
    """The same rows in DuckDB's SQL."""
    arms = ", ".join(str(float(w)) for w in weights)
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5('{seed}:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, {share} * SUM(source_size) OVER () AS budget, {epochs} * source_size AS cap,
         list_extract([{arms}], CAST((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1 AS INT)) AS weight
  FROM s
), p AS (
  SELECT *, COALESCE(SUM(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
         SUM(weight) OVER () - COALESCE(SUM(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy
  FROM w
), c AS (SELECT *, cap * heavy <= weight * (budget - gone) AS clamped FROM p
), t AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE CAST(budget - COALESCE(SUM(CASE WHEN clamped THEN cap END) OVER (), 0) AS DOUBLE)
              * CAST(weight AS DOUBLE) / CAST(SUM(CASE WHEN NOT clamped THEN weight END) OVER () AS DOUBLE) END AS target
  FROM c
), n AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(FLOOR(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
         COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN source_size > 0 AND 2 * pos + size <= 2 * need THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r"""
