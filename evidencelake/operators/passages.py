"""Passages: lines of texts that match a query, chosen, merged and packed within limits.

A text's lines are one array in its row, so choosing among them needs no exchange; the folds run over that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions.text import lines, tokens


def matched_lines(docs: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """(key, pos, line, size, matched, title): the lines of each text, from 1 on, with the terms that they and the first
    line have."""
    listed = F.array(*map(F.lit, terms))
    each = docs.select(key, F.array_intersect(listed, tokens(F.element_at(lines(F.col("text")), 1))).alias("title"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    return each.select(key, (F.col("pos") + 1).cast("long").alias("pos"), "line", F.char_length("line").cast("long").alias("size"), F.array_intersect(listed, tokens(F.col("line"))).alias("matched"), "title")


def relevance(matched: Column, inherited: Column, n: int) -> Column:
    """Terms of the passage itself, and half of those that only its heading has, as a share of the query."""
    return (F.size(matched) + 0.5 * F.size(F.array_except(inherited, matched))) / n


def windows(matched: DataFrame, limit: int, most: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, lo, hi): up to ``most`` lines with a term, those with most terms first, as long as they fit into ``limit``
    characters together (one that does not is passed over); neighbours become one window."""
    some = matched.filter(F.size("matched") > 0)
    rank = F.struct((-F.size("matched")).alias("few"), "pos", "size")
    listed = some.groupBy(key).agg(F.array_sort(F.collect_list(rank)).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["used"] + x["size"] <= limit) & (F.size(s["taken"]) < most)
        return F.struct((s["used"] + F.when(fits, x["size"]).otherwise(0)).alias("used"), F.when(fits, F.array_append(s["taken"], x["pos"])).otherwise(s["taken"]).alias("taken"))

    taken = listed.select(key, F.explode(F.aggregate("all", start, step)["taken"]).alias("pos"))
    return islands(taken, key, "pos")


def islands(rows: DataFrame, key: str, pos: str, gap: int = 1) -> DataFrame:
    """(key, lo, hi): runs of positions that are at most ``gap`` apart."""
    order = Window.partitionBy(key).orderBy(pos)
    new = F.coalesce(F.col(pos) - F.lag(pos).over(order) > gap, F.lit(True)).cast("int")
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min(pos).alias("lo"), F.max(pos).alias("hi")).drop("run")


def focus(matched: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lo, hi): lines with a term and the lines before and after, merged."""
    last = matched.groupBy(key).agg(F.max("pos").alias("last"))
    near = matched.filter(F.size("matched") > 0).select(key, F.explode(F.sequence(F.col("pos") - 1, F.col("pos") + 1)).alias("pos")).distinct()
    return islands(near.join(last, key).filter("pos between 1 and last").select(key, "pos"), key, "pos")


def cut_lines(text: Column, limit: int) -> Column:
    """The first ``limit`` characters, or less, up to the last line end among them."""
    head = F.substr(text, F.lit(1), F.lit(limit))
    back = F.instr(F.reverse(head), F.lit("\n"))
    return F.when(F.char_length(text) <= limit, text).when(back > 0, F.substr(text, F.lit(1), F.lit(limit) - back)).otherwise(head)


def packed_paragraphs(text: Column, size: int, overlap: int) -> Column:
    """Paragraphs (here: lines) put together to chunks of ``size`` characters; each starts with the end of the last."""
    start = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, p: Column) -> Column:
        fits = s["now"].isNull() | (F.char_length(s["now"]) + 1 + F.char_length(p) <= size)
        joined = F.when(s["now"].isNull(), p).when(fits, F.concat(s["now"], F.lit("\n"), p)).otherwise(F.concat(F.right(s["now"], F.lit(overlap)), F.lit("\n"), p))
        return F.struct(joined.alias("now"), F.when(fits, s["done"]).otherwise(F.array_append(s["done"], s["now"])).alias("done"))

    return F.aggregate(lines(text), start, step, lambda s: F.array_append(s["done"], s["now"]))


def excerpt(docs: DataFrame, term: str, limit: int, key: str = "doc_id") -> DataFrame:
    """(key, lo, hi): the first line with ``term``, grown by the lines after it and then by those before it, within
    ``limit`` characters, line ends included."""
    each = docs.select(key, F.posexplode(lines(F.col("text"))).alias("pos", "line")).select(key, (F.col("pos") + 1).cast("long").alias("pos"), (F.char_length("line") + 1).alias("size"), F.contains("line", F.lit(term)).alias("hit"))
    first = each.filter("hit").groupBy(key).agg(F.min("pos").alias("first"))
    order = Window.partitionBy(key)
    sums = each.join(first, key).withColumns(
        {
            "after": F.sum(F.when(F.col("pos") >= F.col("first"), F.col("size")).otherwise(0)).over(order.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)),
            "before": F.sum(F.when(F.col("pos") < F.col("first"), F.col("size")).otherwise(0)).over(order.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    right = sums.filter((F.col("pos") >= F.col("first")) & ((F.col("after") <= limit) | (F.col("pos") == F.col("first"))))
    right = right.groupBy(key).agg(F.max("pos").alias("hi"), F.max("after").alias("used"))
    left = sums.filter(F.col("pos") <= F.col("first")).join(right, key).filter((F.col("pos") == F.col("first")) | (F.col("used") + F.col("before") <= limit))
    return left.groupBy(key).agg(F.min("pos").alias("lo"), F.min("hi").alias("hi"))
