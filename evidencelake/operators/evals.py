"""Scores of retrieval runs: intervals, paired outcomes, gates, percentiles, verification of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The normal quantile of the Wilson interval (fixed value).
Z = 1.959963984540054


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """The interval of a share; (0, 0) without cases."""
    p = hits / n
    middle, half = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    over = 1 + Z * Z / n
    bound = lambda c: F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))).otherwise(0.0)
    return bound((middle - half) / over), bound((middle + half) / over)


def sign_test(wins: Column, losses: Column) -> Column:
    """The exact two-sided sign test, from the running product of binomials. They start at the largest, C(n, n / 2), as
    1 and are divided by the sum of all, so that no n is too large; terms beyond 20 sqrt(n) places are 0 in doubles."""
    n, k = wins + losses, F.least(wins, losses)
    half = F.floor(n / 2)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("low"))
    def step(s: Column, j: Column) -> Column:
        i = half - j
        low = s["low"] + F.when(i <= k, s["term"]).otherwise(0.0)
        return F.struct((s["term"] * i / (n - i + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum"), low.alias("low"))
    places = F.sequence(F.lit(0), F.least(half, F.ceil(20 * F.sqrt(n))).cast("int"))
    # The other half is the same; of an even n the largest term is in both.
    p = F.aggregate(places, start, step, lambda s: 2 * s["low"] / (2 * s["sum"] - F.when(n % 2 == 0, 1.0).otherwise(0.0)))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), p))


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: both, only_a, only_b, neither. a and b: (key, ok)."""
    j = a.select(key, F.col("ok").alias("x")).join(b.select(key, F.col("ok").alias("y")), key)
    c = lambda cond, name: F.count_if(cond).alias(name)
    x, y = F.col("x"), F.col("y")
    return j.agg(c(x & y, "both"), c(x & ~y, "only_a"), c(~x & y, "only_b"), c(~x & ~y, "neither"))


def nearest_rank(rows: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """(group, p, value): the value at rank ceil(p n) of each group. Equal values are counted before anything moves;
    values fall into cells of their group's range, counts of cells say in which cell a rank lies, and only the values of
    such cells are put in order, so no group is sorted in one task."""
    cells = 1024
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("times"))
    ends = counts.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("times").alias("n"))
    same = F.expr(f"a.`{group}` <=> b.`{group}`")
    span = F.col("hi").cast("double") - F.col("lo").cast("double")
    at = F.when(span > 0, F.least(F.lit(cells - 1), F.floor((F.col(value).cast("double") - F.col("lo").cast("double")) / span * cells))).otherwise(0)
    placed = counts.alias("a").join(ends.alias("b"), same).select(F.col(f"a.{group}").alias(group), F.col(f"a.{value}").alias("value"), "times", "n", at.cast("int").alias("cell"))
    # As many rows as cells in each group.
    sums = placed.groupBy(group, "cell").agg(F.sum("times").alias("in_cell"), F.min("n").alias("n"))
    before = F.coalesce(F.sum("in_cell").over(Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = F.explode(F.array(*[F.struct(F.lit(s).alias("p"), F.greatest(F.lit(1), F.ceil(F.lit(s) * F.col("n"))).alias("rank")) for s in shares])).alias("mark")
    wanted = sums.withColumn("before", before).select(group, "cell", "before", "in_cell", marks)
    wanted = wanted.filter((F.col("mark.rank") > F.col("before")) & (F.col("mark.rank") <= F.col("before") + F.col("in_cell"))).select(group, "cell", "before", "mark.p", "mark.rank")
    met = placed.alias("a").join(wanted.alias("b"), same & F.expr("a.cell = b.cell")).select(F.col(f"b.{group}").alias(group), "p", "rank", "before", "value", "times")
    upto = F.sum("times").over(Window.partitionBy(group, "p").orderBy("value"))
    return met.withColumn("upto", F.col("before") + upto).filter("upto >= rank").groupBy(group, "p").agg(F.min("value").alias("value"))


def verbatim(docs: DataFrame, claims: DataFrame, key: str, claim_key: str, words: int = 4) -> DataFrame:
    """(claim_key, key, at, n): claims that stand word for word in a text, with the first place (from 1) and length. The
    words of a claim between its first and its last stand in the text as they are, so the hash of ``words`` of them is
    looked up among those of the texts; only ids move for that. Claims too short for it are compared with each text."""
    listed = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    hashed = lambda w, i: F.xxhash64(*[F.element_at(w, i + k) for k in range(words)])
    named = claims.select(claim_key, "claim", F.size(listed(F.col("claim"))).alias("size"))
    anchors = named.filter(F.col("size") >= words + 2).select(claim_key, hashed(listed(F.col("claim")), F.lit(2)).alias("anchor"))
    w = docs.select(key, listed(F.col("text")).alias("w")).filter(F.size("w") >= words)
    all_ = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: hashed(F.col("w"), i)))
    ids = w.select(key, F.explode(all_).alias("anchor")).join(anchors, "anchor").select(key, claim_key).distinct()
    long = ids.join(docs.select(key, "text"), key).join(claims.select(claim_key, "claim"), claim_key)
    short = docs.select(key, "text").join(named.filter(F.col("size") < words + 2).select(claim_key, "claim"), F.contains("text", F.col("claim")))
    met = long.filter(F.contains("text", F.col("claim"))).select(claim_key, key, "text", "claim").union(short.select(claim_key, key, "text", "claim"))
    return met.select(claim_key, key, F.instr("text", F.col("claim")).cast("long").alias("at"), F.char_length("claim").cast("long").alias("n"))


def sample(rows: DataFrame, key: str, seed: str, k: int) -> DataFrame:
    """The first k rows in the order of the hash of seed and key: the same ones for everybody."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary"), 256)
    return rows.withColumn("digest", digest).orderBy("digest", key).limit(k)


def facets(rows: DataFrame, names: list[str], *aggregates: Column) -> DataFrame:
    """(facet, value, ...): one row for each value of each column, from one pass."""
    wide = rows.withColumn("_f", F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names])))
    return wide.groupBy(F.col("_f.facet").alias("facet"), F.col("_f.value").alias("value")).agg(*aggregates)


def span_states(claims: DataFrame) -> DataFrame:
    """claims (a, b, quote, text, ...) with state: the first thing that is wrong with a quote from lines a to b (from 1), or
    ok."""
    plain = lambda c: F.regexp_replace(c, r"\s+", " ")
    lines = F.split("text", "\n", -1)
    span = F.when(F.col("b") >= F.col("a"), F.array_join(F.slice(lines, F.col("a"), F.greatest(F.lit(0), F.col("b") - F.col("a") + 1)), "\n")).otherwise("")
    state = (
        F.when(F.col("b") < F.col("a"), "lines are out of order")
        .when(F.col("b") - F.col("a") + 1 > 21, "span is too long")
        .when(F.char_length("quote") < 12, "quote is too short")
        .when(F.contains(span, F.col("quote")), "ok")
        .when(F.contains(plain(span), plain(F.col("quote"))), "ok but for white space")
        .when(F.contains("text", F.col("quote")), "stands elsewhere")
        .otherwise("not found")
    )
    return claims.withColumn("state", state)


def least_sample(total: Column, bad: Column, risk: float) -> Column:
    """The smallest sample of ``total`` that misses all ``bad`` ones with a probability of ``risk`` at most: each draw
    multiplies it by the share of good ones that are left."""
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0).cast("long").alias("n"))

    def draw(s: Column, _: Column) -> Column:
        left = s["p"] * (total - bad - s["n"]) / (total - s["n"])
        return F.when(s["p"] > risk, F.struct(left.alias("p"), (s["n"] + 1).alias("n"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), total), start, draw)["n"]


def contract(evidence: DataFrame) -> DataFrame:
    """(query, groups, met, complete) of evidence (query, grp, there): a group is met by any, a query by all its groups."""
    g = evidence.groupBy("query", "grp").agg(F.bool_or("there").alias("met"))
    return g.groupBy("query").agg(F.count("*").alias("groups"), F.count_if("met").alias("met"), F.bool_and("met").alias("complete"))
