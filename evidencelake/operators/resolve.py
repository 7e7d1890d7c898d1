"""Targets of links between notes: the rules in turn, each an equality of keys, so no link is compared with every note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions.text import fold

#: Candidates that are named for a link that several notes answer to.
NAMED = 10


def normal_path(path: Column) -> Column:
    """The folded path without ``.`` and with ``..`` followed; null if it leads above the root."""

    def step(at: Column, part: Column) -> Column:
        up = F.when(F.size(at) > 0, F.slice(at, 1, F.size(at) - 1))
        return F.when(part.isin("", "."), at).when(part == "..", up).otherwise(F.array_append(at, part))

    parts = F.aggregate(F.split(fold(path), "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(parts) > 0, F.array_join(parts, "/"))


def _answers(keys: DataFrame) -> DataFrame:
    """(key, n, paths) of (key, path): how many notes a key stands for, and the first NAMED of them."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy("path"))
    few = keys.withColumn("nth", nth).filter(F.col("nth") <= NAMED).groupBy("key").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return keys.groupBy("key").agg(F.count("*").alias("n")).join(few, "key")


def cascade(links: DataFrame, files: DataFrame, ending: str = ".md") -> DataFrame:
    """links (src: the path of their note, target, ...) with rule, dst, n, candidates and reason. files: (path).

    The rules: ``folder``, the target from the folder of src; ``path``, the target as a whole path; ``suffix``, the notes whose path
    ends with it, a bare name included. The first rule that any note answers decides: one note is the edge (resolved), several
    are ambiguous; where none does, the link is missing, also if it leads above the root. Paths are compared folded; a target
    whose last part has no dot gets ``ending``."""
    folded = files.select(F.col("path"), normal_path(F.col("path")).alias("key"))
    parts = F.split("key", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    exact, suffix = _answers(folded), _answers(folded.select(F.explode(ends).alias("key"), "path"))
    target = F.when(F.contains(F.substring_index("target", "/", -1), F.lit(".")), F.col("target")).otherwise(F.concat("target", F.lit(ending)))
    folder = F.regexp_extract("src", "^(.*/)?", 0)
    rows = links.withColumns({"_near": normal_path(F.concat(folder, target)), "_whole": normal_path(F.regexp_replace(target, "^/+", ""))})
    for name, key, known in (("folder", "_near", exact), ("path", "_whole", exact), ("suffix", "_whole", suffix)):
        rows = rows.join(known.select(F.col("key").alias(key), F.struct("n", "paths").alias(f"_{name}")), key, "left")
    rules = ["folder", "path", "suffix"]
    hit = F.coalesce(*[f"_{r}" for r in rules])
    rule = F.coalesce(*[F.when(F.col(f"_{r}").isNotNull(), F.lit(r)) for r in rules])
    n = F.coalesce(hit["n"], F.lit(0))
    reason = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("missing")
    return rows.select(*[F.col(f"`{c}`") for c in links.columns], rule.alias("rule"), F.when(n == 1, hit["paths"][0]).alias("dst"), n.alias("n"), F.when(n > 1, hit["paths"]).alias("candidates"), reason.alias("reason"))
