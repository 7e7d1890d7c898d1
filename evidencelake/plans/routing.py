"""Queries: rules and ladders of routing, lifecycle and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Tables, query


@query(
    "WITH v AS (SELECT * FROM (VALUES (8.0, 0), (5.0, 1), (1.5, 2)) x(w, m)), r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY m ORDER BY length(text) DESC, doc_id) AS pos FROM documents JOIN v ON doc_id % 3 <> m), "
    "f AS (SELECT doc_id, sum(w / (40 + pos)) AS score FROM r WHERE pos <= 80 GROUP BY doc_id) SELECT doc_id, round(score, 6) AS score FROM f"
)
def weighted_fusion(t: Tables) -> DataFrame:
    """Three ranked variants of at most 80 rows, fused by weight over 40 + rank (the limit is the operator)."""
    out = None
    for weight, m in ((8.0, 0), (5.0, 1), (1.5, 2)):
        best = t.documents.filter(F.col("doc_id") % 3 != m).select("doc_id", F.char_length("text").alias("n")).orderBy(F.desc("n"), "doc_id").limit(80)
        pos = F.row_number().over(Window.orderBy(F.desc("n"), "doc_id"))  # eighty rows
        part = best.select("doc_id", (F.lit(weight) / (40 + pos)).alias("c"))
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id").agg(F.round(F.sum("c"), 6).alias("score"))


@query(
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS used FROM lineitem"
)
def running_use(t: Tables) -> DataFrame:
    """Use so far within each order, line after line."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", net.alias("net"), F.sum("l_quantity").over(w).alias("used"))


@query(
    "WITH b AS (SELECT event_id, CAST(ts AS DATE) AS day, event_type FROM events), m AS (SELECT day, min(event_id) AS lo, max(event_id) AS hi, count(*) AS n FROM b GROUP BY day) "
    "SELECT a.day, a.n, count(c.day) AS overlaps FROM m a LEFT JOIN m c ON a.day <> c.day AND a.lo < c.hi AND c.lo < a.hi GROUP BY a.day, a.n"
)
def span_overlaps(t: Tables) -> DataFrame:
    """How many other days' ranges of numbers each day's range overlaps (a row a day on both sides)."""
    m = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.count("*").alias("n"))
    a, c = m.alias("a"), m.alias("c")
    met = F.expr("a.day <> c.day AND a.lo < c.hi AND c.lo < a.hi")
    return a.join(c, met, "left").groupBy("a.day", "a.n").agg(F.count("c.day").alias("overlaps"))
