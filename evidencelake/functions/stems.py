"""English stems by the published rules of 1980 (M. F. Porter, "An algorithm for suffix stripping"): steps of suffix rules with
conditions on what is left. A word is run through the steps once; callers stem distinct terms only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: The steps (fixed values): of the rules of a step the one with the longest matching suffix is taken, and its condition decides
#: whether it applies. m0, m1: a measure above 0, 1; v: a vowel; st: m1 after s or t; e1: m1, or m of 1 without an ending in
#: consonant, vowel, consonant (not w, x, y).
STEPS = [
    [("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", "")],
    [("eed", "ee", "m0"), ("ed", "", "v"), ("ing", "", "v")],
    [("y", "i", "v")],
    [
        ("ational", "ate", "m0"), ("tional", "tion", "m0"), ("enci", "ence", "m0"), ("anci", "ance", "m0"), ("izer", "ize", "m0"), ("bli", "ble", "m0"), ("alli", "al", "m0"),
        ("entli", "ent", "m0"), ("eli", "e", "m0"), ("ousli", "ous", "m0"), ("ization", "ize", "m0"), ("ation", "ate", "m0"), ("ator", "ate", "m0"), ("alism", "al", "m0"),
        ("iveness", "ive", "m0"), ("fulness", "ful", "m0"), ("ousness", "ous", "m0"), ("aliti", "al", "m0"), ("iviti", "ive", "m0"), ("biliti", "ble", "m0"), ("logi", "log", "m0"),
    ],
    [("icate", "ic", "m0"), ("ative", "", "m0"), ("alize", "al", "m0"), ("iciti", "ic", "m0"), ("ical", "ic", "m0"), ("ful", "", "m0"), ("ness", "", "m0")],
    [(s, "", "m1") for s in "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()] + [("ion", "", "st")],
    [("e", "", "e1")],
]
#: What may follow a step that has taken ``ed`` or ``ing`` away (fixed values).
RESTORED = ("at", "bl", "iz")


def _shape(word: str) -> str:
    """c or v for each letter; a y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _holds(condition: str, stem: str) -> bool:
    if condition == "v":
        return "v" in _shape(stem)
    m = _measure(stem)
    if condition == "e1":
        return m > 1 or (m == 1 and not _short(stem))
    return not condition or m > (condition != "m0") and (condition != "st" or stem[-1:] in ("s", "t"))


@cache
def _by_length(step: int) -> list[tuple[str, str, str]]:
    return sorted(STEPS[step], key=lambda rule: -len(rule[0]))


def stem(word: str) -> str:
    """The stem of a folded word; words of one or two letters, or with other letters than a to z, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    for step in range(len(STEPS)):
        for suffix, new, condition in _by_length(step):
            if not word.endswith(suffix) or word == suffix:  # something has to be left
                continue
            left = word[: len(word) - len(suffix)]
            if _holds(condition, left):
                word = left + new
                if step == 1 and suffix != "eed":
                    twice = len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz"
                    if word.endswith(RESTORED):
                        word += "e"
                    elif twice:
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
            break
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        return word[:-1]
    return word


def stems(terms: DataFrame, column: str = "term") -> DataFrame:
    """terms (distinct, one column) with ``stem``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            yield pa.RecordBatch.from_arrays([words, pa.array([None if w is None else stem(w) for w in words.to_pylist()], pa.string())], [column, "stem"])

    return terms.select(column).mapInArrow(run, f"`{column}` string, stem string")
