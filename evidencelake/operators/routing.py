"""Prompts: their words, the routes and aliases that they name, query variants, and what may enter a packet.

Configuration (triggers, aliases, term lists) comes as small DataFrames; prompts are a table like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions.text import fold

#: Words of no use in a search (fixed values).
STOPWORDS = [
    "a", "about", "an", "and", "are", "as", "at", "be", "can", "do", "for", "from", "how", "i", "in", "is", "it", "me", "my", "of", "on", "or", "that",
    "the", "this", "to", "we", "what", "when", "where", "which", "who", "why", "with", "would", "you", "your", "please", "write", "find", "make",
]
#: Phrases by which a later row takes an earlier one back (fixed values).
CORRECTIONS = [
    r"\bi do not want (?:this|that)\b", r"\bi don't want (?:this|that)\b", r"\bthat is not what i (?:meant|asked)\b", r"\bcorrection\s*:", r"\bnot what i want\b", r"\byou misunderstood\b",
    r"\bthat is (?:not|incorrect|wrong)\b",
]
#: Tiers by the length of the prompt: name, most characters, sources, characters of the packet and of a source (fixed values).
TIERS = [("brief", 160, 18, 40000, 6000), ("standard", 600, 22, 60000, 9000), ("full", None, 28, 86000, 24000)]
#: Letters of a stem, and of what may follow it (fixed values).
LEAST_STEM, MOST_SUFFIX = 5, 12
WORD = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"


def words(c: Column) -> Column:
    """The words of a prompt; a hyphen or apostrophe inside joins two runs to one word."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def terms(prompts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(*keys, pos, term, folded): words that are no stopword, longer than one letter and no number; of equal foldings the
    first spelling."""
    each = prompts.select(*keys, F.posexplode(words(F.col(text))).alias("pos", "term")).withColumn("folded", fold(F.col("term")))
    some = each.filter(~F.col("folded").isin(STOPWORDS) & (F.char_length("folded") > 1) & ~F.rlike("folded", F.lit("^[0-9]+$")))
    first = some.groupBy(*keys, "folded").agg(F.min(F.struct("pos", "term")).alias("first"))
    return first.select(*keys, F.col("first.pos").cast("long").alias("pos"), F.col("first.term").alias("term"), "folded")


def normal(c: Column) -> Column:
    """The folded tokens between single blanks, so that a phrase of whole words is found by its blanks."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(fold(c), F.lit(r"/?[\p{L}\p{N}]+"), F.lit(0)), " "), F.lit(" "))


def has_phrase(normalised: Column, phrase: Column) -> Column:
    return F.contains(normalised, F.concat(F.lit(" "), phrase, F.lit(" ")))


def has_stem(normalised: Column, phrase: Column) -> Column:
    """Whole words, or for a stem of LEAST_STEM letters a word that goes on for at most MOST_SUFFIX letters."""
    longer = F.exists(F.split(F.trim(normalised), " "), lambda w: F.startswith(w, phrase) & (F.char_length(w) - F.char_length(phrase) <= MOST_SUFFIX))
    return has_phrase(normalised, phrase) | ((F.char_length(phrase) >= LEAST_STEM) & ~F.contains(phrase, F.lit(" ")) & longer)


def route_scores(prompts: DataFrame, keys: list[str], triggers: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """(*keys, route, score): the weights of a route's triggers that a prompt has, times its priority. triggers: (route,
    trigger, priority); fallbacks: (term, route, unless), used where none of the routes in unless was found. Both are
    configuration: a few rows."""
    own = prompts.select(*keys, normal(F.col("text")).alias("said"))
    weight = F.when(F.startswith("trigger", F.lit("/")), 4).otherwise(F.greatest(F.lit(1), F.size(F.split("trigger", " "))))
    hits = own.join(F.broadcast(triggers), has_stem(F.col("said"), F.col("trigger")))
    scored = hits.groupBy(*keys, "route").agg((F.sum(weight) * F.max("priority")).cast("long").alias("score"))
    found = own.join(scored.groupBy(*keys).agg(F.collect_set("route").alias("routes")), keys, "left").withColumn("routes", F.coalesce("routes", F.array().cast("array<string>")))
    more = found.join(F.broadcast(fallbacks), has_stem(F.col("said"), F.col("term"))).filter(~F.arrays_overlap("routes", "unless") & ~F.array_contains("routes", F.col("route")))
    return scored.union(more.select(*keys, "route", F.lit(1).cast("long")).distinct())


def best_routes(scored: DataFrame, keys: list[str], most: int) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(F.desc("score"), "route")
    return scored.withColumn("rank", F.row_number().over(first).cast("long")).filter(F.col("rank") <= most)


def overflow(items: DataFrame, keys: list[str], order: str, size: str, most: int) -> DataFrame:
    """items with inlined: in order, each item that still fits is inlined; one that does not is left out and smaller ones
    may follow. The items of a key are a packet's candidates, at most a few dozen."""
    struct = F.struct(order, size)
    listed = items.groupBy(*keys).agg(F.array_sort(F.collect_list(struct)).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("fits"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x[size] <= most
        return F.struct((s["used"] + F.when(fits, x[size]).otherwise(0)).cast("long").alias("used"), F.array_append(s["fits"], fits).alias("fits"))

    folded = listed.withColumn("fits", F.aggregate("all", start, step)["fits"])
    each = folded.select(*keys, F.explode(F.arrays_zip("all", "fits")).alias("x"))
    return each.select(*keys, F.col(f"x.all.{order}").alias(order), F.col(f"x.all.{size}").alias(size), F.col("x.fits").alias("inlined"))


def chosen(candidates: DataFrame, keys: list[str], limit: int, floor: int = 3, reserve: int = 6, tail: int = 2, each: int = 4) -> DataFrame:
    """(*keys, place, id): the candidates (*keys, id, rank, path, logical, hash, mandatory, superseded, historical) that enter a
    packet of ``limit`` rows, at most a few dozen a packet.

    Of mandatory rows the first of each path counts, superseded ones last; their quota leaves ``reserve`` rows to the others
    but never falls below ``floor``. A row is passed over whose hash or logical name a chosen row has, or of whose path
    ``each`` other rows are chosen. ``tail`` rows are kept for the first historical ones, unless a chosen row has their hash."""
    at = lambda *by: Window.partitionBy(*keys, *by)
    c = F.col
    kind = F.when(c("historical"), "tail").when(c("mandatory"), "must").otherwise("free")
    rows = candidates.withColumn("kind", kind).withColumn("again", F.row_number().over(at("kind", "path").orderBy("rank")))
    rows = rows.filter((c("kind") != "must") | (c("again") == 1))
    count = lambda k: F.count_if(c("kind") == k).over(at())
    places = F.greatest(F.lit(1), limit - F.least(F.lit(tail), count("tail")))
    least = F.least(F.lit(floor), count("must"), F.greatest(F.lit(1), places - 1))
    quota = F.least(count("must"), F.greatest(least, places - F.least(F.lit(reserve), count("free"))))
    late = (c("kind") == "must") & c("superseded")
    rows = rows.withColumns({"places": places, "quota": quota, "nth": F.row_number().over(at("kind").orderBy(late, "rank"))})
    walk = rows.filter(((c("kind") == "must") & (c("nth") <= c("quota"))) | (c("kind") == "free"))
    item = F.struct((c("kind") == "free").alias("free"), "nth", "id", "hash", "logical", "path")
    listed = walk.groupBy(*keys).agg(F.first("places").alias("places"), F.array_sort(F.collect_list(item)).alias("all"))

    def step(taken: Column, x: Column) -> Column:
        same = F.exists(taken, lambda t: (t["hash"] == x["hash"]) | (t["logical"] == x["logical"]))
        full = x["free"] & (F.size(F.filter(taken, lambda t: t["free"] & (t["path"] == x["path"]))) >= each)
        return F.when((F.size(taken) < c("places")) & ~same & ~full, F.array_append(taken, x)).otherwise(taken)

    taken = listed.select(*keys, F.aggregate("all", F.slice("all", 1, 0), step).alias("taken"))
    old = rows.filter((c("kind") == "tail") & (c("nth") <= tail)).join(taken, keys, "left")
    old = old.filter(~F.coalesce(F.array_contains("taken.hash", c("hash")), F.lit(False)))
    old = old.withColumn("copy", F.row_number().over(at("hash").orderBy("rank"))).filter("copy = 1")
    place = F.coalesce(F.size("taken"), F.lit(0)) + F.row_number().over(at().orderBy("rank"))
    first = taken.select(*keys, F.posexplode("taken.id").alias("pos", "id"))
    return first.select(*keys, (c("pos") + 1).cast("long").alias("place"), "id").union(old.select(*keys, place.cast("long").alias("place"), "id"))


def status(evidence: Column, mandatory: Column, verified: Column, user: Column, assistant: Column, conversation: Column, web: Column, unclear: Column, limits: Column) -> Column:
    """The rung of a prompt: the first that applies. evidence: rows found for the prompt itself; the others count rows, or
    say whether."""
    return (
        F.when(web, "EXTERNAL_RECHECK")
        .when(unclear, "NOT_FOUND")
        .when((evidence == 0) & (mandatory > 0), "PARTIAL")
        .when(evidence == 0, "NOT_FOUND")
        .when(limits, "PARTIAL")
        .when(verified < evidence, "PARTIAL")
        .when(user > 0, "USER_STATED")
        .when((conversation > 0) & (assistant == conversation), "PARTIAL")
        .when(verified > 0, "SUPPORTED")
        .otherwise("PARTIAL")
    )
