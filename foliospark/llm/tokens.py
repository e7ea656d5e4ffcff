"""Token ids of whole texts, with each distinct word encoded once per Python worker.

A pre-tokenizer that never joins text across white space encodes a text as the
chain of its words' ids. Words recur, so a table from word to ids replaces most
calls. ``Encoder`` applies to tokenizer files of that kind (``word_bpe_49k.json``).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from foliospark.llm.shared import give_back

#: Letters for which lower-casing is one to one and NFC changes nothing.
LETTERS = "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįĵķĺļľłńņňŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž"
#: What the pre-tokenizer cuts lower-cased words into; the line feed stands between words.
PIECES = re.compile(f"[{LETTERS}]+|\\n|[0-9]|[^{LETTERS}0-9\\n]+")
#: Words with other characters than these, such as an apostrophe, or with a special token's sign go through the whole tokenizer.
PLAIN = re.compile(f"[\\n!-&(-~{LETTERS}]")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def _chain(numbers: np.ndarray, ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries with these numbers, one after the other, and the bounds of each."""
    own = lengths[numbers]
    total = np.zeros(len(own) + 1, np.int64)
    np.cumsum(own, out=total[1:])
    at = np.repeat(begins[numbers] - total[:-1], own)
    at += np.arange(total[-1])
    return ids[at], total


class _Words(dict):
    """From word to its number; one not seen before gets the next number and waits in ``new``."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


class _Pieces(dict):
    """From piece to its number; a new piece is encoded at once. Number 0 is the line feed, which has no ids."""

    def __init__(self, model):
        self.model, self.bytes, self.ids, self.ends = model, _byte_letters(), array("I"), array("q", [0, 0])
        self["\n"] = 0

    def __missing__(self, piece: str) -> int:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes)
        self.ids.extend([t.id for t in self.model.tokenize(letters)])
        self.ends.append(len(self.ids))
        self[piece] = k = len(self)
        return k


class Encoder:
    """``encode(texts)`` gives the ids of all texts, one after the other, and each text's bounds.

    ``max_words`` bounds the tables of words and of their pieces; each starts anew beyond that.
    """

    def __init__(self, path: str, max_words: int = 250_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        self.plain = np.zeros(512, bool)
        self.plain[[c for c in range(511) if PLAIN.fullmatch(chr(c))]] = True
        self.clear()

    def clear(self) -> None:
        """Gives the tables' memory back."""
        self.pieces = _Pieces(self.tokenizer.model)
        self._clear_words()

    def _clear_words(self) -> None:
        self.words = _Words()
        self.ids, self.begins, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Adds the ids of new words to the table, most of them at once from their pieces."""
        text = b"\n".join([*words, b""]).decode("utf-8", "replace")
        low = text.lower()
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
        odd_signs = ~self.plain[np.minimum(codes, 511)]
        odd_signs[:-1] |= (codes[:-1] == ord("<")) & (codes[1:] == ord("|"))
        odd = np.unique(np.cumsum(codes == 10)[odd_signs])
        if len(odd):
            lines, skip = low.split("\n"), set(odd.tolist())
            low = "\n".join([x for i, x in enumerate(lines) if i not in skip])
        if len(self.pieces) > self.max_words:
            self.pieces = _Pieces(self.tokenizer.model)
        found = PIECES.findall(low)
        numbers = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        ends = np.array(self.pieces.ends)
        ids, total = _chain(numbers, np.array(self.pieces.ids, np.uint32), ends[:-1], np.diff(ends))
        lengths = np.zeros(len(words), np.int64)
        plain = np.ones(len(words), bool)
        plain[odd] = False
        lengths[plain] = np.diff(total[np.flatnonzero(numbers == 0)], prepend=0)
        begins = np.cumsum(lengths) - lengths
        more = []
        for i in odd.tolist():
            own = self.tokenizer.encode(words[i].decode("utf-8", "replace"), add_special_tokens=False).ids
            begins[i], lengths[i] = len(ids) + len(more), len(own)
            more += own
        self.begins = np.concatenate([self.begins, begins + len(self.ids)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids, np.array(more, np.uint32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > self.max_words:
            self._clear_words()
        split = [text.encode("utf-8", "surrogatepass").split() for text in texts]
        counts = np.fromiter(map(len, split), np.int64, len(texts))
        which = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, counts.sum())
        del split
        if self.words.new:
            self._learn(self.words.new)
            self.words.new = []
        ids, total = _chain(which, self.ids, self.begins, self.lengths)
        return ids, total[np.concatenate([[0], np.cumsum(counts)])]


_encoders: dict[str, Encoder] = {}


@contextmanager
def encoder(path: str, max_words: int) -> Iterator[Encoder]:
    """This Python worker's encoder for ``path``. The tokenizer stays loaded for the next task, the table does not:
    an idle worker would hold its memory while others work."""
    own = _encoders.get(path) or Encoder(path)
    _encoders[path], own.max_words = own, max_words
    try:
        yield own
    finally:
        own.clear()
        give_back()
