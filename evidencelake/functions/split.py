"""The tokens of whole Arrow columns at once: the same tokens as ``text.tokens``, for tasks that read texts in Python.

The tables (how letters fold, which are letters) are made by the driver and go to tasks with the function that uses them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_CODES = 0x110000
#: Stands for a mark that folding drops.
_DROPPED = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class Alphabet:
    """changed, folded: code points that fold to another one (or are dropped); letters: a bit for each that a token may have."""

    changed: np.ndarray
    folded: np.ndarray
    letters: bytes

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("changed", "folded", "letters")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    @cached_property
    def fold(self) -> np.ndarray:
        table = np.arange(_CODES, dtype=np.uint32)
        table[self.changed] = self.folded
        return table

    @cached_property
    def inside(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.letters, np.uint8))[:_CODES].astype(bool)

    def split(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The tokens of all texts, one after the other, and how many each text has; null as the empty text."""
        return self.split_pieces(column, np.ones(len(column), np.int64))[:2]

    def split_pieces(self, column: pa.Array, many: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The tokens of pieces of texts, one after the other, how many each piece has, and how many each text has, of which the pieces
        are many in a row: a token that goes on in the next piece is one of its text."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, raw = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        text = memoryview(raw)[at[0] : at[-1]].tobytes().decode() if raw is not None else ""
        codes = self.fold[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        keep = codes != _DROPPED
        if not keep.all():
            ends = np.append(0, np.cumsum(keep))[ends]
            codes = codes[keep]
        inside = self.inside[codes]
        before = np.append(False, inside)[: len(inside)]
        begins = np.append(0, ends)[:-1]
        piece = np.flatnonzero(begins < ends)
        first = np.cumsum(many) - many
        text = np.repeat(np.arange(len(many)), many)
        on = piece[(begins[piece] > begins[first[text[piece]]]) & inside[begins[piece]] & before[begins[piece]]]
        before[begins[piece]] = False  # two texts that touch with letters are two tokens
        start = np.flatnonzero(inside & ~before)
        letters = codes[inside]
        width = 1 + (letters >= 0x80).astype(np.int64) + (letters >= 0x800) + (letters >= 0x10000)
        byte = np.append(0, np.cumsum(width))
        places = np.append(byte[(np.cumsum(inside) - 1)[start]], byte[-1]).astype(np.int32)
        data = letters.tobytes().decode("utf-32-le").encode()
        tokens = pa.StringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(data))
        counts = np.bincount(np.searchsorted(ends, start, "right"), minlength=len(column))
        whole = np.append(0, np.cumsum(counts))
        return tokens, counts, whole[first + many] - whole[first] - np.bincount(text[on], minlength=len(many))


_made: dict[str, Alphabet] = {}


def alphabet(spark: SparkSession) -> Alphabet:
    """The tables of the session: letters are what its regular expressions take for such."""
    from .text import MARKED, PLAIN, TOKEN

    app = spark.sparkContext.applicationId
    if app not in _made:
        every = "".join(chr(c) for c in range(1, _CODES) if not 0xD800 <= c < 0xE000)
        kept = spark.range(1).select(F.array_join(F.regexp_extract_all(F.lit(every), F.lit(TOKEN), F.lit(0)), "")).first()[0]
        letters = np.zeros(_CODES, bool)
        letters[np.frombuffer(kept.encode("utf-32-le"), np.uint32)] = True
        changed = np.frombuffer(MARKED.encode("utf-32-le"), np.uint32)
        folded = np.full(len(changed), _DROPPED)
        folded[: len(PLAIN)] = np.frombuffer(PLAIN.encode("utf-32-le"), np.uint32)
        _made[app] = Alphabet(changed, folded, np.packbits(letters).tobytes())
    return _made[app]
