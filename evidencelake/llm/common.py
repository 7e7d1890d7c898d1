"""What the operators of this subpackage share: stored stages, checked broadcasts, hashing of words and bytes.

Every text is read whole.  A null text counts as the empty text.  ``doc_id`` may be null or repeated: operators
that need an order put null first (``did``).
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many bytes of payload; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
NULL_ID = -(1 << 63)
U64 = np.uint64


def _give_back_memory() -> None:
    """Freed arrays of over 1 MB go back to the system at once: workers live long, and several share an executor."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass
    pa.set_memory_pool(pa.system_memory_pool())


_give_back_memory()


def released(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, after whose last batch the worker gives back what it has freed: idle workers then hold little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where that is unset, a local session gets a
    folder of its own; on a cluster a folder of one machine would lose data, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidencelake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet into the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidencelake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes what stored() has written for tables, once nothing reads them any more."""
    for table in tables:
        path = getattr(table, "stored_path", None)
        if path is not None:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def bounded_batches(spark: SparkSession, rows: int = 1024, size: int = 4 << 20) -> None:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes from now on, so that texts and sets in flight between
    the JVM and Python workers take little memory. Spark reads both settings when a plan runs, which the caller does, so
    they stay set in the session; results do not depend on them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(str(spark.conf.get(key)).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def did(column: str | Column = "doc_id") -> Column:
    """doc_id with a value for null, below all others."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NULL_ID)).cast("long")


def small(df: DataFrame, payload: Column | None = None) -> DataFrame:
    """df (a stored table) with a broadcast hint if its rows (24 bytes and ``payload`` each) are counted to take at most
    BROADCAST_BYTES; else as it is."""
    width = F.lit(24) + (F.coalesce(payload, F.lit(0)) if payload is not None else F.lit(0))
    size = df.agg(F.sum(width.cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


# --- hashing ------------------------------------------------------------------------------------------------------

_BASE = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit of x."""
    x = x + _BASE
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def fold(parts: Iterable[np.ndarray]) -> np.ndarray:
    """One 64-bit value for a sequence of equally long arrays, sensitive to order."""
    out = None
    for p in parts:
        out = mix(p) if out is None else mix((out * _M1) ^ p)
    return out


_BYTE = mix(np.arange(256, dtype=U64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW_BYTE = _BYTE[_LOWER]
#: The white space of the word pattern [^\x20\x09-\x0D]+.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n; B is odd and so has an inverse."""
    if len(_POWERS[0]) < n:
        size, b = 1 << int(n - 1).bit_length(), int(_BASE)
        inverse = pow(b, -1, 1 << 64)
        for k, base in enumerate((b, inverse)):
            p = np.full(size, base, U64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def _prefix(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * _powers(len(data))[0], out=out[1:])
    return out


def words(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word of the UTF-8 bytes, A-Z lower-cased."""
    if not len(data):
        return np.zeros(0, U64)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2], edges[1::2]
    p = _prefix(data, _LOW_BYTE)
    inverse = _powers(len(data))[1]
    return mix((p[ends] - p[starts]) * inverse[starts] + (ends - starts).astype(U64))


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each k bytes."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    p = _prefix(data, _BYTE)
    return mix((p[k:] - p[:-k]) * _powers(len(data))[1][:n])


def shingles(data: np.ndarray, k: int = 5) -> np.ndarray:
    """The sorted distinct k-word shingles; with fewer words the whole sequence as one; without words none."""
    h = words(data)
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    return np.unique(fold([h[j : j + n] for j in range(k)]) + U64(k))


# --- Arrow --------------------------------------------------------------------------------------------------------


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each value, without copies; null as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]] if valid[i] else raw[:0]


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def dealt(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """A row for each bucket: the bucket and, for each column, the bytes of its entries of that bucket."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]))
    arrays = [pa.array(b[cuts[:-1]].astype(np.int32))]
    for values in columns.values():
        v = values[order]
        arrays.append(pa.array([v[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])


def gathered(batches: Iterable[pa.RecordBatch], types: dict[str, object]) -> dict[str, np.ndarray]:
    """What dealt() has sent to this partition, one array a column."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in types}
    for batch in batches:
        for k, t in types.items():
            parts[k] += [np.frombuffer(x, t) for x in batch.column(k).to_pylist() if x]
    out = {}
    for k, t in types.items():  # a column's pieces go when it is put together
        pieces = parts.pop(k)
        out[k] = np.concatenate(pieces) if pieces else np.zeros(0, t)
        del pieces
    return out
