"""Whole-text byte-level BPE, word by word with a bounded cache.

The pre-tokenizer of a byte-level vocabulary never merges across a single space
between two visible characters, nor across a single newline there. So a text
without two white-space characters in a row is cut at those places, each piece
is encoded once by the tokenizers library, and its ids are kept. Other texts go
to the library whole. The ids are those of encoding the whole text.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

from dqstream.llm.common import quiet_tokenizers

# Pieces kept per Python worker in each of two generations.
CACHE_PIECES = 600_000
# Longer pieces are encoded but not kept.
CACHE_CHARS = 40

# Marks that are neither letters, numbers nor white space.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _plain(text: str) -> bool:
    """Whether all white space is single spaces and single newlines."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return text.replace("\n", "").isprintable()


def _byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in letters]
    return letters | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    `plain` takes the strings of special tokens inside a text as plain text.
    `kept` pieces are held in each of two generations.
    """

    def __init__(self, path: str, plain: bool = False, kept: int = CACHE_PIECES) -> None:
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = plain
        self._kept = kept
        self._word = self._whole.model.tokenize
        self._letters = _byte_letters()
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._newline = self._ids("\n")
        self._ends: dict[str, bytes] = {}
        # Cutting by words holds for a vocabulary of this kind only.
        self._cut = self._ids("ab cd.\nef") == b"".join(map(self._ids, ("ab", " cd", ".", "\n", "ef")))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self._cut or not _plain(text):
            return self._ids(text)
        # A piece stands for itself and the space before it, or the newline that it starts with.
        pieces = text.replace("\n", " \n").split(" ")
        known, piece = self._young.get, self._piece
        first = self._fresh(pieces[0], "") if pieces[0] else b""
        del pieces[0]
        return first + b"".join([known(p) or piece(p) for p in pieces])

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that is not among the young ones."""
        ids = self._young.get(piece) or self._old.get(piece)
        if ids is None:
            if piece[:1] == "\n":
                ids = self._newline + (self._fresh(piece[1:], "") if len(piece) > 1 else b"")
            else:
                ids = self._fresh(piece, " ")
        if len(piece) <= CACHE_CHARS:
            if len(self._young) >= self._kept:
                self._old, self._young = self._young, {}
            self._young[piece] = ids
        return ids

    def spelled(self) -> list[bytes]:
        """The bytes of every id."""
        byte_of = {letter: b for b, letter in self._letters.items()}
        held = self._whole.get_vocab(with_added_tokens=True)
        out = [b""] * (max(held.values()) + 1)
        for token, i in held.items():
            out[i] = bytes([byte_of[c] for c in token]) if all(c in byte_of for c in token) else token.encode()
        return out

    def _fresh(self, piece: str, before: str) -> bytes:
        word = piece.rstrip(_MARKS)
        end = piece[len(word) :]
        # Letters only, of the old blocks whose classes no Unicode version changes.
        if word.isalpha() and (word.isascii() or max(word) < "ɐ"):
            if end and before:
                ids = self._piece(word)
            elif word.isascii():
                ids = self._join(("Ġ" if before else "") + word)
            else:
                ids = self._join("".join([self._letters[b] for b in (before + word).encode()]))
            return ids + self._end(end) if end else ids
        return self._ids(before + piece)

    def _join(self, shown: str) -> bytes:
        return array("I", [t.id for t in self._word(shown)]).tobytes()

    def _end(self, marks: str) -> bytes:
        """Ids of marks that follow a word; there are few of them, so they are kept apart."""
        ids = self._ends.get(marks)
        if ids is None:
            ids = self._ids(marks)
            if len(self._ends) < 10_000 and len(marks) <= CACHE_CHARS:
                self._ends[marks] = ids
        return ids

    def _ids(self, text: str) -> bytes:
        return np.array(self._whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker; workers are used again by later tasks."""
    return Encoder(path)
