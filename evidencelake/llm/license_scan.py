"""Licence scans with a generalised suffix automaton.

The words of all templates make one automaton, which is small and fixed, so each task has it. Texts stream through it: after each
word the state says the longest run of words ending there that some template holds (matching statistics), also which base
phrase ends there. Runs that cannot be prolonged and have LEAST words or more are anchors; for each template they are chained
in the order of its words, with gaps of at most GAP words of text, into spans. A span counts if it covers SHARE of its template and
at least FEW of its words (all, if it has fewer). No rows are exchanged.

Defined results: null and empty texts have no words, so no places and no labels; repeated rows and null ids are kept as they
are, each row for itself; of chains that cover equally much the one that ends first stays; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import PHRASES, TEXTS
from .terms import Vocabulary, terms

#: Words of an anchor and of a span at least, words of text between two anchors at most, covered share of a template.
LEAST, FEW, GAP, SHARE = 3, 8, 40, 0.6


class Span(NamedTuple):
    """Words first to last of a text that cover ``share`` of a template."""

    first: int
    last: int
    label: str
    share: float


def words_of(text: str) -> list[str]:
    t = terms(pa.array([text.encode()], pa.large_binary()))
    return [t.data[a:b].tobytes().lower().decode() for a, b in zip(t.starts, t.ends, strict=True)]


class Automaton:
    """The generalised suffix automaton of templates, each a list of numbers of words.

    State 0 is empty; arcs[s] leads on, link[s] is the state of the longest suffix that occurs in more places, size[s] the length
    of the longest run of s, ends[s] the (template, place of the last word) at which all runs of s end.
    """

    def __init__(self, templates: list[list[int]]) -> None:
        self.arcs: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, template in enumerate(templates):
            last = 0
            for place, word in enumerate(template):
                last = self._extend(last, word)
                self.ends[last].append((number, place))
        for s in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):  # a suffix occurs wherever the run does
            if self.link[s]:
                self.ends[self.link[s]] += self.ends[s]
        self.ends = [sorted(set(x)) for x in self.ends]

    def _new(self, size: int) -> int:
        self.arcs.append({})
        self.link.append(0)
        self.size.append(size)
        self.ends.append([])
        return len(self.size) - 1

    def _split(self, state: int, word: int) -> int:
        """The state that ``word`` leads to from ``state``, cut off so that its longest run is the one through state."""
        to = self.arcs[state][word]
        if self.size[to] == self.size[state] + 1:
            return to
        part = self._new(self.size[state] + 1)
        self.arcs[part], self.link[part] = dict(self.arcs[to]), self.link[to]
        self.link[to] = part
        while state >= 0 and self.arcs[state].get(word) == to:
            self.arcs[state][word] = part
            state = self.link[state]
        return part

    def _extend(self, last: int, word: int) -> int:
        if word in self.arcs[last]:  # an earlier template has this run
            return self._split(last, word)
        new, state = self._new(self.size[last] + 1), last
        while state >= 0 and word not in self.arcs[state]:
            self.arcs[state][word] = new
            state = self.link[state]
        self.link[new] = self._split(state, word) if state >= 0 else 0
        return new

    def walk(self, words: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, length) after each word: the longest run ending there that a template holds."""
        state = length = 0
        for word in words:
            while state and word not in self.arcs[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.arcs[state]:
                state, length = self.arcs[state][word], length + 1
            yield state, length


class Scanner:
    """The automaton of all templates and base phrases, and what its states mean."""

    def __init__(self, texts: list[tuple[str, str]] = TEXTS, phrases: list[tuple[str, str]] = PHRASES) -> None:
        both = [(label, words_of(text)) for label, text in (*texts, *phrases)]
        names = list(dict.fromkeys(w for _, ws in both for w in ws))
        number = {w: k for k, w in enumerate(names)}
        self.vocabulary = Vocabulary(names)
        self.labels, self.lengths = [label for label, _ in both], [len(ws) for _, ws in both]
        coded = [[number[w] for w in ws] for _, ws in both]
        self.texts = len(texts)
        self.automaton = Automaton(coded)
        self.pairs = np.zeros((len(names), len(names)), bool)
        for ws in coded:
            self.pairs[ws[:-1], ws[1:]] = True
        # The phrases that end where a state ends: theirs, and those of its suffixes.
        a = self.automaton
        own: dict[int, int] = {}
        for p, ws in enumerate(coded[self.texts :]):
            *_, (state, length) = a.walk(ws)
            assert length == len(ws)
            own[state] = p
        self.ending: list[list[int]] = [[] for _ in a.size]
        for s in range(1, len(a.size)):
            at = s
            while at > 0:
                if at in own:
                    self.ending[s].append(own[at])
                at = a.link[at]

    def scan(self, words: np.ndarray, begin: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[tuple[int, int]]]]]:
        """Of a run of listed words that starts at word ``begin`` of a text: (start, phrase) of the base phrases, and the anchors
        (first, last, ends)."""
        places, anchors, before = [], [], (0, 0)
        for k, (state, length) in enumerate([*self.automaton.walk(words.tolist()), (0, 0)]):
            if before[1] >= LEAST and length <= before[1]:  # cannot be prolonged
                anchors.append((begin + k - before[1], begin + k - 1, self.automaton.ends[before[0]]))
            before = (state, length)
            for p in self.ending[state]:
                size = self.lengths[self.texts + p]
                if size <= length:  # a state holds runs of several lengths
                    places.append((begin + k - size + 1, p))
        return places, anchors

    def spans(self, anchors: list[tuple[int, int, list[tuple[int, int]]]]) -> list[Span]:
        """The chains that cover enough of a template, one for each stretch of text that no gap divides."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for first, last, ends in anchors:
            for template, end in ends:
                if template < self.texts:
                    by.setdefault(template, []).append((first, last, end))
        out = []
        for template, found in sorted(by.items()):
            size = self.lengths[template]
            enough, best = max(SHARE * size, min(size, FEW)), None
            found.sort(key=lambda x: (x[1], x[0], x[2]))
            chains: list[tuple[int, int]] = []  # (words covered, first word of text) of the best chain up to each anchor
            for j, (first, last, end) in enumerate(found):
                length = last - first + 1
                covered, since = length, first
                for i in range(j - 1, -1, -1):
                    if found[i][1] < first - GAP:
                        break
                    more = min(length, last - found[i][1], end - found[i][2])  # what both text and template have beyond it
                    if more > 0 and chains[i][0] + more > covered:
                        covered, since = chains[i][0] + more, chains[i][1]
                chains.append((covered, since))
                if best and first > best[1] + GAP:
                    if best[0] >= enough:
                        out.append(Span(best[2], best[1], self.labels[template], min(1.0, best[0] / size)))
                    best = None
                if best is None or covered > best[0]:
                    best = (covered, last, since)
            if best and best[0] >= enough:
                out.append(Span(best[2], best[1], self.labels[template], min(1.0, best[0] / size)))
        return sorted(out)


_OUT = "n_words long, places array<struct<start:long,phrase:int>>, spans array<struct<first:long,last:long,label:string,share:double>>"


def scan(docs: DataFrame, text: str = "text", texts: list[tuple[str, str]] = TEXTS, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """The columns of docs as struct ``row``, then n_words, ``places`` (start, phrase) of the base phrases and ``spans`` (first,
    last, label, share) of the templates that the text covers, in the order of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(texts, phrases)
        for batch in batches:
            t = terms(batch.column(1))
            found = s.vocabulary.find(t)
            n = t.per_row()
            begins = np.cumsum(n) - n
            # Two neighbours in a template: only there can a match have two words or more.
            both = np.flatnonzero((found[:-1] >= 0) & (found[1:] >= 0) & (t.row[:-1] == t.row[1:]))
            both = both[s.pairs[found[both], found[both + 1]]]
            cuts = np.flatnonzero(np.diff(both) > 1) + 1
            places: list[list] = [[] for _ in range(t.rows)]
            anchors: list[list] = [[] for _ in range(t.rows)]
            for first, last in zip(both[np.concatenate(([0], cuts))].tolist(), both[np.concatenate((cuts - 1, [len(both) - 1]))].tolist(), strict=True) if len(both) else ():
                row = t.row[first]
                p, a = s.scan(found[first : last + 2], int(first - begins[row]))
                places[row] += p
                anchors[row] += a
            spans = [[x._asdict() for x in s.spans(a)] if a else [] for a in anchors]
            marks = [[{"start": at, "phrase": p} for at, p in x] for x in places]
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(marks, pa.list_(pa.struct([("start", pa.int64()), ("phrase", pa.int32())])))]
            columns.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "places", "spans"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
    own = docs.select(row, F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, f"row {own.schema['row'].dataType.simpleString()}, {_OUT}")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans): score is the largest share of a
    template that the text covers, 1 with a base phrase, which is a template of its own."""
    found = scan(docs.select("doc_id", "text"))
    name = F.array(*[F.lit(label) for label, _ in PHRASES])
    base = F.array_sort(F.array_distinct(F.transform("places.phrase", lambda p: F.get(name, p))))
    every = F.array_sort(F.array_union(base, F.col("spans.label")))
    share = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0)))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), share.alias("score"), F.size("spans").cast("long").alias("n_spans"),
    )
