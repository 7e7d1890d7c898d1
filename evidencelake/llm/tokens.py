"""Token ids of whole texts by a public tokenizer whose words never span white space."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

TOKENIZER = "word_bpe_49k.json"
#: Workers are processes; threads of the tokenizer would only contend.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: The id that ends every document.
END = 1
#: Words kept per worker (about 100 bytes each), and the longest word that is kept. Results do not depend on it.
CACHE, LONGEST = 400_000, 48
#: Punctuation that the tokenizer never joins to the letters before it.
_AFTER = "!#$%&*,.:;?"


def _is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Words:
    """Ids of texts as little-endian unsigned 32-bit bytes, from a cache of words."""

    def __init__(self, name: str) -> None:
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _letters(self, word: str) -> bool:
        return word.isascii() or self.tokenizer.normalizer.normalize_str(word).isalpha()

    def _learn(self, parts: list[list[str]]) -> list[str]:
        """Makes the ids of all words of parts known; returns the words for which there is no room afterwards."""
        known = self.known
        unknown = set().union(*parts).difference(known)
        if not unknown:
            return []
        # Letters and the punctuation after them are words of their own to the tokenizer, if its normaliser leaves
        # letters alone: some become a letter and a combining mark.
        split = {w: (s, w[len(s) :]) for w in unknown if len(s := w.rstrip(_AFTER)) < len(w) and s.isalpha() and self._letters(s)}
        single = list({x for w in unknown for x in split.get(w, (w,))}.difference(known))
        room = CACHE - len(known)
        known.update(zip(single, self.encode(single), strict=True))
        known.update([(w, known[stem] + known[end]) for w, (stem, end) in split.items()])
        new = [*single, *split]
        return [w for k, w in enumerate(new) if k >= room or len(w) > LONGEST]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, then END. Equal to encoding the texts at once: the normaliser of the tokenizer drops
        white space and its words end there. A text that could hold a special token is encoded at once."""
        whole = {i for i, t in enumerate(texts) if "<|" in t}
        parts = []
        for i, t in enumerate(texts):
            if _is_latin1(t):  # the tokenizer lower-cases; in this range that is the same letter by letter
                t = t.lower()
            parts.append([] if i in whole else t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
        over, end = self._learn(parts), END.to_bytes(4, "little")
        out = [b"".join(map(self.known.__getitem__, p)) + end for p in parts]
        for w in over:
            self.known.pop(w, None)
        for i in whole:
            out[i] = self.encode([texts[i]])[0] + end
        return out


_OPEN: dict[str, Words] = {}


def words(name: str = TOKENIZER) -> Words:
    """The worker's cache for this tokenizer."""
    if name not in _OPEN:
        _OPEN[name] = Words(name)
    return _OPEN[name]


def pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids) of a document: cut into runs of capacity tokens, the last may be shorter."""
    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
        yield piece, piece * capacity, ids[at : at + 4 * capacity]
