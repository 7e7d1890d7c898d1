"""Words of the letter class [0-9A-Za-z and all beyond ASCII], A-Z lower-cased, of whole Arrow columns at once, and their
places in a fixed vocabulary. Matches are compared byte by byte, so hashes only propose them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import _LOW_BYTE, _LOWER, U64, _powers, _prefix, mix

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


@dataclass
class Terms:
    """The words of several texts in order: their bytes [starts, ends) in data, and the number of their text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    rows: int

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def terms(column: pa.Array) -> Terms:
    """The words of all texts of a column; null as the empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    first, last = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    # Two texts that touch with letters are two words.
    seam = at[1:-1]
    seam = seam[inside[seam] & inside[seam + 1]]
    first[seam] = last[seam] = True
    starts = np.flatnonzero(first)
    return Terms(data, starts, np.flatnonzero(last), np.searchsorted(at, starts, "right") - 1, len(column))


def hashes(t: Terms) -> np.ndarray:
    p = _prefix(t.data, _LOW_BYTE)
    return mix((p[t.ends] - p[t.starts]) * _powers(max(1, len(t.data)))[1][t.starts] + (t.ends - t.starts).astype(U64))


class Vocabulary:
    """Distinct words by number, in the order given."""

    def __init__(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        own = terms(pa.array(raw, pa.large_binary()))
        assert len(own.starts) == len(raw), "each entry is one word"
        h = hashes(own)
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]
        assert len(np.unique(h)) == len(h), "entries differ"
        self.data, self.starts, self.sizes = _LOWER[own.data], own.starts, own.ends - own.starts

    def __len__(self) -> int:
        return len(self.order)

    def find(self, t: Terms) -> np.ndarray:
        """The number of each word, -1 for words that are not listed."""
        out = np.full(len(t.starts), -1, np.int64)
        if not len(self) or not len(out):
            return out
        h = hashes(t)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        which = self.order[at[hit]]
        same = self.sizes[which] == t.ends[hit] - t.starts[hit]
        hit, which = hit[same], which[same]
        left, place = np.arange(len(hit)), 0
        bad = np.zeros(len(hit), bool)
        while len(left):
            bad[left] |= _LOWER[t.data[t.starts[hit[left]] + place]] != self.data[self.starts[which[left]] + place]
            place += 1
            left = left[self.sizes[which[left]] > place]
        out[hit[~bad]] = which[~bad]
        return out
