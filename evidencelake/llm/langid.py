"""Language identification with spans of mixed-language text.

Training counts byte 4-grams of words by language over a bounded sample of the labelled documents (about ``SAMPLE`` a
language, a documented parameter; the sample is chosen by a hash of doc_id).  Counts become log probabilities in a table
of ``CELLS`` hashed 4-grams a language.

Prediction.  The ranges of code points of a word's letters give its script; a language is a candidate for the word if at least SCRIPT_SHARE
of its training words are in that script (all are, if none is).  Each candidate scores the word by the mean log
probability of its 4-grams times its number of letters.  Viterbi over the words, with a penalty for each switch, labels
spans of one language.  The document's language is the one with most bytes in its spans; ``score`` is that share.

Defined results: null text or text without a letter is ``und`` with score 0; ties go to the language first in code-point
order; repeated rows give equal results; without training data every text is ``und``; an empty table returns no rows;
columns with the names of results are replaced, others kept whatever their names; a null doc_id is the empty text where
the training documents are chosen; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _LOWER, _SPACE, released, texts

#: Documents a language that training looks at, in expectation.
SAMPLE = 2_000
CELLS = 1 << 15
#: Cost of a switch of language between two words, in log probability.
SWITCH = 12.0
SCRIPT_SHARE = 0.02
UNKNOWN = "und"
#: Where the letters of each script begin, up to the next entry (fixed values; "" has no letters, "other" is one script).
SCRIPT_STARTS = (
    (0x00C0, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"),
    (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"), (0x0800, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Cherokee"), (0x1400, "Canadian"), (0x1680, "other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1900, "other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, ""), (0x2C00, "other"), (0x2C60, "Latin"), (0x2C80, "Coptic"), (0x2D00, "Georgian"), (0x2D30, "Tifinagh"),
    (0x2D80, "Ethiopic"), (0x2DE0, "Cyrillic"), (0x2E00, ""), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3200, ""), (0x3400, "Han"),
    (0xA000, "Yi"), (0xA4D0, "other"), (0xA640, "Cyrillic"), (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0xFFE0, ""), (0x10000, "other"), (0x1F000, ""), (0x20000, "Han"),
)
#: Numbers of scripts: 0 has no letters, Latin is 1, so a word with letters of several has the number of another one.
_NAMES = ["", "Latin", *sorted({name for _, name in SCRIPT_STARTS} - {"", "Latin"})]
N_SCRIPTS = len(_NAMES)
_STARTS = np.array([0] + [start for start, _ in SCRIPT_STARTS])
_SCRIPT_OF = np.array([0] + [_NAMES.index(name) for _, name in SCRIPT_STARTS], np.int16)
_ASCII = np.zeros(256, np.int16)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1


def scripts(data: np.ndarray) -> np.ndarray:
    """The script of the character that starts at each byte of UTF-8; 0 within characters and where there is no letter."""
    out = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        wide = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
        first = wide[lead]
        low = [wide[lead + k] & 63 for k in (1, 2, 3)]
        two, three = (first & 31) << 6 | low[0], (first & 15) << 12 | low[0] << 6 | low[1]
        point = np.where(first < 0xE0, two, np.where(first < 0xF0, three, (first & 7) << 18 | low[0] << 12 | low[1] << 6 | low[2]))
        out[lead] = _SCRIPT_OF[np.searchsorted(_STARTS, point, "right") - 1]
    return out


def _cells(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell of the 4-gram at each byte, starts and ends of words, script of each word). White space is one byte value."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2], edges[1::2]
    low = np.full(len(data) + 3, 32, np.uint32)
    low[1:-2] = np.where(space[1:-1], 32, _LOWER[data])
    code = low[:-3] | low[1:-2] << np.uint32(8) | low[2:-1] << np.uint32(16) | low[3:] << np.uint32(24)
    code *= np.uint32(0x9E3779B1)
    script = np.maximum.reduceat(scripts(data), starts) if len(starts) else np.zeros(0, np.int16)
    return code >> np.uint32(32 - 15), starts, ends, script


@dataclass
class Model:
    """langs in code-point order; logp[cell, lang]; scripts[script, lang]: whether a language is a candidate."""

    langs: list[str]
    logp: np.ndarray
    scripts: np.ndarray


def in_training(doc_id: str = "doc_id") -> Column:
    """Whether a document may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from text and non-null lang of docs."""
    labelled = docs.filter("lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((CELLS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    share = F.lit(None)
    for x in langs:
        share = F.when(F.col("lang") == x, F.lit(min(1.0, sample / sizes[x]))).otherwise(share)
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(1_000_003)) / F.lit(1_000_003)
    chosen = labelled.filter(unit < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), CELLS), np.int64)
        scripts = np.zeros((len(langs), N_SCRIPTS), np.int64)
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                cell, starts, _, script = _cells(data)
                k = langs.index(lang)
                grams[k] += np.bincount(cell[: len(data)][~_SPACE[data]], minlength=CELLS)
                scripts[k] += np.bincount(script, minlength=N_SCRIPTS)
        both = np.concatenate((grams, scripts), axis=1)
        k, cell = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(both[k, cell])], ["k", "cell", "n"])

    counted = chosen.select("lang", "text").mapInArrow(released(count), "k int, cell int, n long").groupBy("k", "cell").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # (CELLS + N_SCRIPTS) rows a language at most
    both = np.zeros((len(langs), CELLS + N_SCRIPTS))
    k, cell, n = (table.column(c).to_numpy() for c in ("k", "cell", "n"))
    both[k, cell] = n
    grams, scripts = both[:, :CELLS], both[:, CELLS:]
    logp = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * CELLS))
    shares = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return Model(langs, logp.T.astype(np.float32).copy(), (shares >= SCRIPT_SHARE).T)


def _viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best label of each word of each document: all documents step through their words together."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lens = np.array([len(scores[i]) for i in order])
    steps, n = int(lens[0]) if len(lens) else 0, len(order)
    k = scores[0].shape[1]
    # Documents with at least t + 1 words are the first alive[t].
    alive = np.searchsorted(-lens, -np.arange(1, steps + 1), "right")
    flat = np.concatenate([np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(alive)])]).astype(np.int64)
    grid = np.empty((int(flat[-1]), k), np.float32)  # step after step
    for d, i in enumerate(order):
        grid[flat[: lens[d]] + d] = scores[i]
    came = np.empty((int(flat[-1]), k), np.int16)
    best = np.zeros((n, k), np.float32)
    own = np.arange(k, dtype=np.int16)
    for t in range(steps):
        m = alive[t]
        now = best[:m]
        top = now.argmax(axis=1)
        jump = now[np.arange(m), top] - np.float32(switch)
        stay = now >= jump[:, None]
        came[flat[t] : flat[t + 1]] = np.where(stay, own, top[:, None])
        now = np.where(stay, now, jump[:, None]) + grid[flat[t] : flat[t + 1]]
        best[:m] = now - now.max(axis=1, keepdims=True)
    label = best.argmax(axis=1)
    out = np.empty(int(flat[-1]), np.int16)
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        out[flat[t] : flat[t + 1]] = label[:m]
        label[:m] = came[np.arange(flat[t], flat[t + 1]), label[:m]]
    found: list[np.ndarray] = [np.zeros(0, np.int16)] * n
    for d, i in enumerate(order):
        found[i] = out[flat[: lens[d]] + d]
    return found


def word_scores(model: Model, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores[word, lang], starts, ends) of the words of data."""
    cell, starts, ends, script = _cells(data)
    if not len(starts):
        return np.zeros((0, len(model.langs)), np.float32), starts, ends
    # Sums over words: white space between words adds nothing.
    logp = model.logp[cell[: len(data)]]
    logp[_SPACE[data]] = 0
    scores = np.add.reduceat(logp, starts, axis=0)
    allowed = model.scripts[script]
    none = ~allowed.any(axis=1)
    allowed[none] = True
    scores = np.where(allowed, scores, scores.min(axis=1, keepdims=True) - 20)
    scores[script == 0] = 0  # no letters: no evidence
    return scores.astype(np.float32), starts, ends


#: Bytes of text that are decoded together.
TOGETHER = 2 << 20


def _labelled(model: Model, items: list[np.ndarray], switch: float) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) of each text. Spans: (start, end, language) in bytes."""
    out: list[tuple[str, float, list[tuple[int, int, str]]]] = [(UNKNOWN, 0.0, [])] * len(items)
    made = [word_scores(model, x) if model.langs else None for x in items]
    some = [i for i, m in enumerate(made) if m is not None and len(m[0])]
    paths = _viterbi([made[i][0] for i in some], switch) if some else []
    for i, path in zip(some, paths, strict=True):
        _, starts, ends = made[i]
        text = items[i].tobytes().decode("utf-8", "replace")
        if not any(map(str.isalpha, text)):
            continue
        share = np.bincount(path, weights=ends - starts, minlength=len(model.langs))
        cut = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1))
        last = np.concatenate((cut[1:] - 1, [len(path) - 1]))
        spans = [(int(starts[a]), int(ends[b]), model.langs[path[a]]) for a, b in zip(cut, last, strict=True)]
        out[i] = (model.langs[int(share.argmax())], float(share.max() / share.sum()), spans)
    return out


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """docs with lang_pred and score, and with ``spans`` also lang_spans, array of (start, end, lang) in bytes."""
    new = ["lang_pred", "score", *["lang_spans"] * spans]
    other = [c for c in docs.columns if c.lower() not in new]
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = list(texts(batch.column(1)))
            found, a, size = [], 0, 0
            for b, x in enumerate(items):
                size += len(x)
                if size >= TOGETHER or b == len(items) - 1:
                    found += _labelled(held.value, items[a : b + 1], switch)
                    a, size = b + 1, 0
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            if spans:
                columns.append(pa.array([[{"start": p, "end": q, "lang": x} for p, q, x in f[2]] for f in found], kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", *new])

    # The caller's columns travel as one, so that their names meet none of ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in other]).alias("row"), F.col("text").alias("text"))
    types = ["lang_pred string", "score double", *["lang_spans array<struct<start:bigint,end:bigint,lang:string>>"] * spans]
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(", ".join(types)).fields])
    return rows.mapInArrow(released(predict), schema).select("row.*", *new)


def digest(docs: DataFrame, sample: int = SAMPLE, switch: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs, learning from those not held out."""
    model = train(docs.filter(in_training()), sample)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, switch).select("doc_id", "held_out", "lang_pred", "score")
