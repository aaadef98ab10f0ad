"""Exact sub-word encoding of whole texts with a bounded word memo.

The vocabulary files used here drop white space before they cut a text into words, so a text's ids are the
concatenation of the ids of its white-space separated pieces. ``WordEncoder`` uses that: a piece is encoded once
by the ``tokenizers`` library and remembered, and a text is a join of remembered byte strings. Pieces that are
plain Latin letters with trailing ASCII punctuation share the memo entry of their lower-case letters; everything else
goes to the library as it stands. Texts with control characters on whose white-space status Python and the
library differ are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)")

def _spelling() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte (a rule of the file format)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


SPELLING = _spelling()
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Memo entries kept by each Python worker; a full memo is emptied, which costs time and never changes an id.
MEMO_PIECES, MEMO_WORDS = 300_000, 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Text to little-endian unsigned 32-bit ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        """One lower-case word without its white space: the library's model, given the bytes as it spells them."""
        spelt = word if word.isascii() else "".join(map(SPELLING.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def learn(self, piece: str) -> bytes:
        """A piece that the memo lacks."""
        if len(self.pieces) > MEMO_PIECES:
            self.pieces.clear()
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        if piece.isalpha() and piece.isascii():
            parts = (piece, "")
        else:
            m = PLAIN.fullmatch(piece)
            parts = m.groups() if m else None
        if parts is None:
            ids = self.whole(piece)
        else:
            word, tail = parts[0].lower(), parts[1]
            ids = self.words.get(word)
            if ids is None:
                ids = self.words[word] = self.word(word)
            if tail:
                end = self.words.get(tail)
                if end is None:
                    end = self.words[tail] = self.whole(tail)
                ids += end
        self.pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in SEPARATORS):
            return self.whole(text)
        got = list(map(self.pieces.get, cut := text.split()))
        if None in got:
            learn, pieces = self.learn, self.pieces
            got = [x if x is not None else pieces.get(w) or learn(w) for x, w in zip(got, cut)]
        return b"".join(got)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this vocabulary file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Empties the memos of the worker's encoders, whose room tasks that encode nothing have better use for."""
    for model in _ENCODERS.values():
        model.pieces.clear()
        model.words.clear()
