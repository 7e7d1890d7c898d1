"""Folders of notes and ledgers of JSON lines as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Kinds of files that are read, and the size from which a file is skipped (fixed values).
KINDS, LARGEST = ("md", "txt", "json", "jsonl", "csv"), 50_000_000


def scan_notes(spark: SparkSession, folder: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, text, sha256, n_bytes, state): the files below a folder. state: ok, excluded, unsupported_name, oversize or
    not_utf8. Contents of files that are not read are not kept. Spark's reader itself leaves out empty files and names
    that start with a dot or underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.substring_index(F.col("path"), folder.rstrip("/").split("://")[-1] + "/", -1)
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    listed = F.lit(False)
    for prefix in excluded:
        listed = listed | (F.lower(path) == prefix.lower()) | F.startswith(F.lower(path), F.lit(prefix.lower() + "/"))
    kind = F.lower(F.substring_index(path, ".", -1))
    state = (
        F.when(hidden | listed, "excluded").when(~kind.isin(*KINDS), "unsupported_name").when(F.col("length") > LARGEST, "oversize")
        .when(~F.expr("is_valid_utf8(CAST(content AS STRING))"), "not_utf8").otherwise("ok")
    )
    ok = state == "ok"
    return files.select(path.alias("path"), F.when(ok, F.col("content").cast("string")).alias("text"), F.when(ok, F.sha2("content", 256)).alias("sha256"), F.col("length").alias("n_bytes"), state.alias("state"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, row): the lines of files, numbered from 1. A file is read in splits: each task knows the place of a line in its
    own, and what stands before comes from the counts of lines by split, a row a split."""
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("row"),
    )
    splits = rows.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("before", before).select("path", "start", "first", "before")
    return rows.join(splits, ["path", "start"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias("line"), "row")


def scan_ledger(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(file, line, record, problem): the lines of JSON ledgers; a line that is no object of the schema is a problem, and
    the others are kept."""
    rows = numbered_lines(spark, path)
    record = F.from_json("row", schema, {"mode": "PERMISSIVE"})
    bad = F.try_parse_json("row").isNull() | ~F.startswith(F.ltrim("row"), F.lit("{"))
    return rows.select("file", "line", F.when(~bad, record).alias("record"), F.when(bad, "not a JSON object").alias("problem"))
