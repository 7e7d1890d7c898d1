"""Tables in the folder that all executors share: cutting lineage in loops, stored indexes and graphs."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a local session gets a folder of its own; on a cluster a
    folder of one machine would lose data, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidencelake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple[object, object]:
    """The file system of path, and path in its terms."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of about ``size`` bytes at most for the plans that run inside; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = str(spark.conf.get(name))
    spark.conf.set(name, str(min(size, int(was.rstrip("bB")))) if int(was.rstrip("bB")) > 0 else str(size))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back: later plans start there, and lost executors cost their tasks alone."""
    path = f"{shared_dir(df.sparkSession)}/evidencelake/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.delete(place, True)


def forget(*tables: DataFrame) -> None:
    """Removes what cut() has written for tables, once nothing reads them any more."""
    for table in tables:
        path = getattr(table, "stored_path", None)
        if path is not None:
            remove(table.sparkSession, path)


def generation(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of the files below paths: it changes whenever one of them does."""
    seen = []
    for path in paths:
        system, place = _place(spark, path)
        files = system.listFiles(place, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def generations(spark: SparkSession, name: str, paths: list[str], build: Callable[[str], None], state: str | None = None) -> str:
    """The folder of the tables that ``build(folder)`` writes for the present state of paths. They are built once a state:
    into a folder of their own, which gets its final name when it is complete, so readers see a whole one or none. state: that of
    the tables that this one belongs to; if the files are no longer those, it cannot be built any more, which is an error."""
    final = f"{shared_dir(spark)}/evidencelake/{name}-{state or generation(spark, paths)}"
    system, place = _place(spark, final)
    if not system.exists(place):
        staged = f"{final}-{uuid.uuid4().hex}"
        build(staged)
        if state and generation(spark, paths) != state:
            remove(spark, staged)
            raise RuntimeError(f"{', '.join(paths)} changed while {name} was built of them")
        if not system.rename(_place(spark, staged)[1], place) and not system.exists(place):
            raise RuntimeError(f"{final} could not be put in place")
    return final
