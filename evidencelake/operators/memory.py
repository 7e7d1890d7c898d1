"""Stores of records that are only appended: what they accept, what is in force, what is wrong, what moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, forget

#: Steps of doubling: chains of 2^ROUNDS records.
ROUNDS = 40


def appended(incoming: DataFrame, least: int, most: int, kinds: list[str]) -> DataFrame:
    """incoming (id, kind, text, ...) with state: refused with its reason, known (content that is there), or appended."""
    size = F.char_length("text")
    first = F.row_number().over(Window.partitionBy("id").orderBy("conv_id", "turn")) == 1
    state = F.when(size < least, "refused: short").when(size > most, "refused: long").when(~F.col("kind").isin(kinds), "refused: kind").when(~first, "known").otherwise("appended")
    return incoming.withColumn("state", state)


def heads(edges: DataFrame) -> DataFrame:
    """(target, id): for each superseded record those in force that follow it by edges (id, target) over any number of
    steps. A step doubles the reach, and only ends are kept, so no pair of a long chain is stored twice. Records that
    replace each other in a ring have no head: after ROUNDS only such rows still move."""
    step = cut(edges.select("target", F.col("id").alias("to")).distinct())
    for _ in range(ROUNDS):
        # A place that is superseded itself gives way to what its own row leads to.
        onward = step.select(F.col("target").alias("to"), F.col("to").alias("next"))
        now = cut(step.join(onward, "to", "left").select("target", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")).distinct())
        moved = not now.filter("moved").isEmpty()
        forget(step)
        step = cut(now.select("target", "to").distinct())
        forget(now)
        if not moved:
            break
    ends = step.join(edges.select(F.col("target").alias("to")), "to", "left_anti")
    return ends.select("target", F.col("to").alias("id"))


def problems(records: DataFrame, sources: DataFrame, kinds: list[str]) -> DataFrame:
    """(conv_id, line, problem): one row for each rule that a record breaks."""
    say = lambda rows, text: rows.select("conv_id", "line", F.lit(text).alias("problem"))
    ids = records.select("id")
    repeated = records.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("conv_id", "line"))).filter("nth > 1")
    unknown = records.filter("supersedes is not null").join(ids.select(F.col("id").alias("supersedes")), "supersedes", "left_anti")
    closed = records.filter("closes is not null").join(records.select(F.col("id").alias("closes"), F.col("kind").alias("of")), "closes")
    held = records.select("id", "conv_id", "line").join(sources.select("id", "recorded", "sha"), "id")
    found = [
        say(records.filter(F.trim("text") == ""), "text is empty"),
        say(records.filter(~F.col("kind").isin(kinds)), "kind is not known"),
        say(repeated, "id is repeated"),
        say(unknown, "supersedes an unknown record"),
        say(records.filter("closes = id"), "closes itself"),
        say(closed.filter("of <> 'task'"), "closes what is no task"),
        say(records.filter("turn <> line - 1"), "rows are not numbered on"),
        say(held.filter("sha is null"), "source is gone"),
        say(held.filter("sha <> recorded"), "source has changed"),
    ]
    out = found[0]
    for rows in found[1:]:
        out = out.union(rows)
    return out


def resume(records: DataFrame, sources: DataFrame, session: str, order: str, most: int) -> DataFrame:
    """The newest records in force of each session, with how many of their sources are stale and whether they are tasks
    that no record in force closes."""
    force = records.join(records.filter("supersedes is not null").select(F.col("supersedes").alias("id")), "id", "left_anti")
    stale = sources.groupBy("id").agg(F.count_if(F.col("sha").isNull() | (F.col("sha") != F.col("recorded"))).alias("stale"))
    closed = force.filter("closes is not null").select(F.col("closes").alias("id")).distinct().withColumn("closed", F.lit(True))
    full = force.join(stale, "id", "left").join(closed, "id", "left")
    nth = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    shown = full.withColumn("nth", nth).filter(F.col("nth") <= most)
    return shown.withColumns({"stale": F.coalesce("stale", F.lit(0)), "open": (F.col("kind") == "task") & F.col("closed").isNull()})


def rebound(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, path, moved_to, new_id): records whose source is gone but whose bytes are elsewhere in manifest (path, sha)."""
    place = manifest.groupBy("sha").agg(F.min("path").alias("moved_to"))
    gone = sources.filter("sha is null").select("id", "path", F.col("recorded").alias("sha"))
    new_id = F.sha2(F.concat("id", F.lit(":"), "moved_to"), 256)
    return gone.join(place, "sha").select("id", "path", "moved_to", new_id.alias("new_id"))


def torn(rows: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, lines, torn, inner_damage): lines that are no JSON, and those of them that are not the last."""
    bad = F.try_parse_json(line).isNull()
    last = rows.groupBy(key).agg(F.max(order).alias("last_line"))
    return rows.drop("last_line").join(last, key).groupBy(key).agg(F.count("*").alias("lines"), F.count_if(bad).alias("torn"), F.count_if(bad & (F.col(order) < F.col("last_line"))).alias("inner_damage"))


def rotated(rows: DataFrame, key: str, order: list[str], size: Column, most: int) -> DataFrame:
    """rows with segment: how often the ledger had filled up before the entry."""
    before = F.sum("entry_size").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("entry_size")
    return rows.withColumn("entry_size", size).withColumn("segment", F.floor(before / most)).drop("entry_size")


def first_difference(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, first_difference): the first line, from 1 on, in which a and b differ; equal ones have no row."""
    x, y = (F.split(c, "\n", -1) for c in (a, b))
    other = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"]))
    return rows.select(key, F.array_position(other, True).cast("long").alias("first_difference")).filter("first_difference > 0")


def contract_problems(jobs: DataFrame) -> DataFrame:
    """(job, problem) of jobs (job, source, target, budget, hashed)."""
    inside = lambda a, b: F.startswith(a, F.concat(b, F.lit("/")))
    s, g = F.col("source"), F.col("target")
    overlap = (s != "") & ((s == g) | inside(g, s) | inside(s, g))
    rules = [(overlap, "output overlaps a source"), (s == "", "no source"), (F.col("budget") <= 0, "no budget"), (~F.col("hashed"), "source without hash")]
    said = F.filter(F.array(*[F.when(rule, text) for rule, text in rules]), lambda x: x.isNotNull())
    return jobs.select("job", F.explode(said).alias("problem"))


def fitted(rows: DataFrame, key: str, order: str, line: str, most: int) -> DataFrame:
    """(key, text): the first lines of each key that fit into ``most`` characters together, line ends included."""
    used = F.sum(F.char_length(line) + 1).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("used", used).filter(F.col("used") <= most)
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, line))).alias("x")).select(key, F.array_join(F.col(f"x.{line}"), "\n").alias("text"))


def packets(items: DataFrame, key: str, order: list[str], recorded: str, now: str) -> DataFrame:
    """(key, packet_id, items, state): a packet is served if each of its sources still has the recorded hash."""
    p = items.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*order, recorded))).alias("x"), F.bool_and(F.coalesce(F.col(now) == F.col(recorded), F.lit(False))).alias("fresh"), F.count("*").alias("items")
    )
    return p.select(key, F.sha2(F.array_join(F.col(f"x.{recorded}"), ","), 256).alias("packet_id"), "items", F.when(F.col("fresh"), "SERVED").otherwise("WITHHELD").alias("state"))


def generations_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows that only a or only b has, and whether they are the same."""
    both = a.withColumn("side", F.lit(1)).union(b.withColumn("side", F.lit(-1))).groupBy(*a.columns).agg(F.sum("side").alias("d")).filter("d <> 0")
    sums = both.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_current"), F.coalesce(-F.sum(F.least("d", F.lit(0))), F.lit(0)).alias("only_previous"))
    return sums.withColumn("same", (F.col("only_current") == 0) & (F.col("only_previous") == 0))


def health(old: DataFrame, new: DataFrame, key: str, group: str, oversize: int) -> DataFrame:
    """(group, indexed, changed, deleted, added, skipped, overall) of an index (key, group, sha) and files (and size)."""
    a = old.select(key, F.col(group).alias("g_old"), F.col("sha").alias("old"))
    b = new.select(key, F.col(group).alias("g_new"), F.col("sha").alias("new"), "size")
    d = a.join(b, key, "full_outer").withColumn(group, F.coalesce("g_old", "g_new"))
    sums = d.groupBy(group).agg(
        F.count("old").alias("indexed"),
        F.count_if(F.expr("old <> new")).alias("changed"),
        F.count_if(F.col("new").isNull()).alias("deleted"),
        F.count_if(F.col("old").isNull() & (F.col("size") > 0)).alias("added"),
        F.count_if(F.col("size") > oversize).alias("skipped"),
    )
    overall = F.when(F.col("indexed") == 0, "missing").when(F.col("changed") + F.col("deleted") > 0, "degraded").when(F.col("added") + F.col("skipped") > 0, "stale").otherwise("ok")
    return sums.withColumn("overall", overall)
