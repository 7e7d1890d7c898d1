"""Text expressions: folding, tokens, lines, sizes. All of them are column expressions inside the plan."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded(c: str) -> str:
    """A letter in lower case without its marks; a mark of its own becomes nothing."""
    return unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c.lower()) if unicodedata.category(x)[0] != "M"))


def _table() -> tuple[str, str]:
    """The letters that folding changes and what they become, then the marks, which it drops. One code point stands for one:
    what only compatibility takes apart (ligatures, full-width letters) stays."""
    changed, marks = [], []
    for n in range(sys.maxunicode + 1):
        c = chr(n)
        plain = c.lower() == c and not unicodedata.decomposition(c) and unicodedata.category(c)[0] != "M"
        if not plain and (f := _folded(c)) != c:
            (changed if f else marks).append((c, f))
    return "".join(c for c, _ in changed + marks), "".join(f for _, f in changed)


MARKED, PLAIN = _table()
TOKEN = r"[\p{L}\p{N}]+"


def fold(c: Column) -> Column:
    """Lower case without marks, for all scripts, letter by letter: a capital sigma is a small one wherever it stands."""
    return F.translate(c, MARKED, PLAIN)


def tokens(c: Column) -> Column:
    """The folded runs of letters and digits, in order."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def est_tokens(c: Column) -> Column:
    """Estimated tokens of a text: a quarter of its characters, rounded up."""
    return F.ceil(F.char_length(c) / 4).cast("long")


def occurrences(folded: Column, term: str) -> Column:
    """How often a folded term occurs in a folded text, without overlaps."""
    return ((F.char_length(folded) - F.char_length(F.replace(folded, F.lit(term), F.lit("")))) / len(term)).cast("long")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def span(c: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1) of a text."""
    return F.array_join(F.slice(lines(c), first, last - first + 1), "\n")
