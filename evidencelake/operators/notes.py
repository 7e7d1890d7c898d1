"""The parsers of notes over tables: Arrow batches in, rows out, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from evidencelake.parse import notes


def _rows(docs: DataFrame, key: str, text: str, parse: Callable[[str], list[tuple]], fields: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *[f.split()[0] for f in fields.split(", ")]]
        for batch in batches:
            found = [(k, *row) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in parse(t or "")]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names)

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {fields}")


def chunks(docs: DataFrame, key: str = "path", text: str = "text", size: int = notes.CHUNK) -> DataFrame:
    return _rows(docs, key, text, lambda t: list(enumerate(notes.chunks(t, size))), "chunk long, content string")


def headings(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    return _rows(docs, key, text, notes.headings, "line long, level long, title string")


def links(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    return _rows(docs, key, text, notes.links, "kind string, target string, heading string, block string, line long")


def blocks(docs: DataFrame, key: str = "path", text: str = "text", size: int = notes.BLOCK) -> DataFrame:
    return _rows(docs, key, text, lambda t: notes.blocks(t, size), "lo long, hi long, chain string, body string")
