"""Media columns: a Spark data source over folders of archives, planned by byte ranges.

``write_archives`` stores each payload as a member of an archive: lossless 8-bit grey PNG, 192 samples a line.  An
archive is its members, then a directory of (doc_id, offset, length, bytes, CRC), then a footer.  The data source
``media_archive`` plans one partition for each ``RANGE`` bytes of each archive; a partition reads the directory at the
end of the file and serves the members that start in its range, streamed in Arrow batches.  A member that cannot be read
or fails its CRC is read again by its offset, alone, up to ``RETRIES`` times; after that its row has an error and no
payload, and the others are not touched.

Archives go to the shared folder through pyarrow's file systems, so any store they know will do.  A task writes under a
name of its own and renames when done; a repeated task writes the same members again, and the last rename wins.

Defined results: null is the empty text, one line of blanks; equal texts give equal rows; repeated rows are members of
their own; an empty table returns no rows; extra columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import NULL_ID, did, longs, shared_dir, texts

LINE = 192
#: Bytes of an archive before the next one starts, of a partition's range, and of a batch of payloads.
ARCHIVE, RANGE, BATCH = 64 << 20, 16 << 20, 4 << 20
RETRIES = 3
_ENTRY = np.dtype([("did", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("size", "<u8"), ("crc", "<u4")])
_FOOTER = "<QQ8s"
_MAGIC = b"EVMEDIA1"
_PNG = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes) -> bytes:
    """text, blanks appended up to a positive multiple of LINE."""
    return text + b" " * (max(LINE, -(-len(text) // LINE) * LINE) - len(text))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(samples: bytes) -> bytes:
    """A PNG of grey lines of LINE samples."""
    lines = np.frombuffer(samples, np.uint8).reshape(-1, LINE)
    raw = np.zeros((len(lines), LINE + 1), np.uint8)  # each line starts with its filter, 0: none
    raw[:, 1:] = lines
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(image: bytes) -> bytes:
    """The samples of a PNG made by encode()."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, width = 8, b"", 0
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + size]
        if struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk of the PNG is damaged")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation, share of each sixteenth of the range, and a 64-bit hash of which eighths of the image are
    brighter than the mean."""
    x = np.frombuffer(samples, np.uint8)
    parts = np.array_split(x, 64)
    means = np.array([p.mean() if len(p) else 0 for p in parts])
    bright = np.packbits(means > x.mean()).tobytes().hex()
    shares = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"mean={x.mean():.3f};std={x.std():.3f};hist={'.'.join(map(str, shares))};bright={bright}"


def _folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


#: The file that lists the archives of a folder.
_LIST = "_archives"


def _archive(part: int, attempt: int, number: int) -> str:
    return f"{part:06d}-{attempt:06d}-{number:04d}.media"


def write_archives(docs: DataFrame, uri: str) -> int:
    """Stores each text of docs (doc_id, text, ...) as a member; returns how many there are. An attempt of a task writes
    files of its own; the driver lists those of the attempts that Spark took, and only listed files are read."""
    fs, path = _folder(uri)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = _folder(uri)
        number, out, entries, at, members = 0, None, [], 0, 0
        own = f"{folder}/_{task.partitionId():06d}-{task.taskAttemptId()}"

        def close() -> None:
            nonlocal out, entries, at, number
            table = np.array(entries, _ENTRY)
            out.write(table.tobytes())
            out.write(struct.pack(_FOOTER, at, len(entries), _MAGIC))
            out.close()
            store.move(own, f"{folder}/{_archive(task.partitionId(), task.taskAttemptId(), number)}")
            out, entries, at, number = None, [], 0, number + 1

        for batch in batches:
            for i, text in zip(longs(batch.column(0)), texts(batch.column(1)), strict=True):
                raw = text.tobytes()
                image = encode(payload(raw))
                if out is None:
                    out = store.open_output_stream(own)
                out.write(image)
                entries.append((i, at, len(image), len(raw), zlib.crc32(image)))
                at, members = at + len(image), members + 1
                if at >= ARCHIVE:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "attempt": task.taskAttemptId(), "files": number, "members": members}])

    taken = docs.select(did(), "text").mapInArrow(write, "part long, attempt long, files long, members long").collect()  # a row a task
    names = [_archive(r["part"], r["attempt"], n) for r in taken for n in range(r["files"])]
    with fs.open_output_stream(f"{path}/{_LIST}") as out:
        out.write("\n".join(sorted(names)).encode())
    return sum(r["members"] for r in taken)


class Range(InputPartition):
    """Bytes start to end of an archive of size bytes."""

    def __init__(self, path: str, size: int, start: int, end: int) -> None:
        self.path, self.size, self.start, self.end = path, size, start, end


class MediaReader(DataSourceReader):
    def __init__(self, uri: str, span: int) -> None:
        self.uri, self.span = uri, span

    def partitions(self) -> Sequence[InputPartition]:
        fs, path = _folder(self.uri)
        with fs.open_input_file(f"{path}/{_LIST}") as listed:
            names = listed.read().decode().split()
        found = fs.get_file_info([f"{path}/{name}" for name in names])
        return [Range(f.path, f.size, a, min(f.size, a + self.span)) for f in sorted(found, key=lambda f: f.path) for a in range(0, f.size, self.span)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark passes when there is nothing to read
            return
        fs, _ = _folder(self.uri)
        with fs.open_input_file(partition.path) as file:
            at, n, magic = struct.unpack(_FOOTER, file.read_at(struct.calcsize(_FOOTER), partition.size - struct.calcsize(_FOOTER)))
            if magic != _MAGIC:
                raise ValueError(f"{partition.path} is not a complete archive")
            table = np.frombuffer(file.read_at(n * _ENTRY.itemsize, at), _ENTRY)
            table = table[(table["offset"] >= partition.start) & (table["offset"] < partition.end)]
            archive = partition.path.rpartition("/")[2]
            for part in np.split(table, np.flatnonzero(np.diff((table["offset"] - table["offset"][:1].sum()) // BATCH)) + 1) if len(table) else []:
                first = int(part["offset"][0])
                stretch = file.read_at(int(part["offset"][-1] + part["length"][-1]) - first, first)
                got = [self._member(fs, partition.path, e, stretch[int(e["offset"]) - first :][: int(e["length"])]) for e in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part["did"], mask=part["did"] == NULL_ID),
                        pa.array(part["size"].astype(np.int64)),
                        pa.array([archive] * len(part)),
                        pa.array(part["offset"].astype(np.int64)),
                        pa.array([m for m, _ in got], pa.binary()),
                        pa.array([e for _, e in got], pa.string()),
                    ],
                    ["doc_id", "n_bytes", "archive", "offset", "media", "error"],
                )

    @staticmethod
    def _member(fs: pa.fs.FileSystem, path: str, entry: np.void, data: bytes) -> tuple[bytes | None, str | None]:
        error = None
        for _ in range(RETRIES + 1):
            if len(data) == entry["length"] and zlib.crc32(data) == entry["crc"]:
                return data, None
            error = "the member fails its CRC"
            try:
                with fs.open_input_file(path) as again:
                    data = again.read_at(int(entry["length"]), int(entry["offset"]))
            except OSError as e:
                error, data = str(e), b""
        return None, error


class MediaArchive(DataSource):
    """spark.read.format("media_archive").option("path", folder); option "range": bytes a partition."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, archive string, offset long, media binary, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return MediaReader(self.options["path"], int(self.options.get("range", RANGE)))


def read_archives(spark: SparkSession, uri: str, span: int = RANGE) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("path", uri).option("range", str(span)).load()


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each row of
    docs, from the bytes that were stored and read back. A member that stays unreadable fails the query."""
    spark = docs.sparkSession
    uri = f"{shared_dir(spark)}/evidencelake/media-{uuid.uuid4().hex}"
    write_archives(docs, uri)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image, error in zip(batch.column("media").to_pylist(), batch.column("error").to_pylist(), strict=True):
                if image is None:
                    raise OSError(error)
                samples = decode(image)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read_archives(spark, uri).select("doc_id", "n_bytes", "media", "error").mapInArrow(look, kinds)
