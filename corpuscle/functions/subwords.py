"""Sub-word tokens of a vocabulary file, for windows whose texts are slices of the document.

Sub-words aren't joined by blanks, so a window isn't made by joining its tokens: it reaches from the first character of
its first token to the last of its last one. Characters are code points, as in Spark's ``length`` and ``substring``. A
character that several tokens make up together belongs to each of them. The file must be in the same place on all machines.

Where no token reaches over white space, a text's tokens are those of its white-space separated pieces. A worker remembers
how many tokens a piece has; windows need places only in the pieces where they begin and end. Texts of other vocabularies,
and those with control characters on whose white-space status Python and the library differ, are encoded whole.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Tokenizer

WINDOW = "struct<start_char:int,end_char:int,token_count:int,text:string>"
_WINDOWS = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("token_count", pa.int32()), ("text", pa.string())]))

#: Letters and trailing ASCII punctuation.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)")
#: Bytes that byte-level vocabularies spell as themselves, and the others in order.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
HIDDEN = [b for b in range(256) if b not in SHOWN]
#: A text by which a vocabulary file shows whether its tokens reach over white space.
PROBE = " Alphabet  strength, été?!\tÜBERGRÖSSE x\n\nIt's 42 words; Ñandú (Zq)  "
BLANKS, SEPARATORS = re.compile(r"(\s+)"), re.compile("[\x1c-\x1f]")
#: Pieces that a worker remembers, and the length of the longest of them; a full memo is emptied.
MEMO_PIECES, MEMO_LENGTH = 300_000, 64


@cache
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer as Library

    return Library.from_file(path)


def offsets(path: str, text: str | None) -> list[tuple[int, int]]:
    """First character of each token and the one after its last; none for null."""
    return [] if not text else _library(path).encode(text, add_special_tokens=False).offsets


def _starts(tokens: int, size: int, overlap: int) -> Iterable[int]:
    """The first token of each window."""
    return range(0, max(tokens - overlap - 1, 0) + 1, size - overlap) if tokens else ()


def cut(text: str | None, spans: list[tuple[int, int]], size: int, overlap: int) -> list[dict]:
    """Windows of ``size`` tokens that share ``overlap``; the last one reaches the last token."""
    out = []
    for start in _starts(len(spans), size, overlap):
        held = spans[start : start + size]
        first, last = held[0][0], held[-1][1]
        out.append({"start_char": first, "end_char": last, "token_count": len(held), "text": text[first:last]})
    return out


class _Counts:
    """Numbers of tokens of pieces; of plain Latin words, from those of their lower-case letters and their punctuation."""

    def __init__(self, path: str):
        self.library = _library(path)
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}
        together = [offsets(path, PROBE), [(m.start() + a, m.start() + b) for m in re.finditer(r"\S+", PROBE) for a, b in offsets(path, m[0])]]
        #: Whether tokens stay inside pieces, and whether the model takes words as ``spelt``.
        self.apart = together[0] == together[1]
        probes = [m for w in PROBE.split() if (m := PLAIN.fullmatch(w))]
        self.plain = self.apart and all(self.encoded(m[0]) == self.spelt(m[1].lower()) + (self.encoded(m[2]) if m[2] else 0) for m in probes)

    def encoded(self, piece: str) -> int:
        return len(self.library.encode(piece, add_special_tokens=False))

    def spelt(self, word: str) -> int:
        return len(self.library.model.tokenize(word if word.isascii() else "".join(chr(b if b in SHOWN else 256 + HIDDEN.index(b)) for b in word.encode())))

    def _kept(self, memo: dict[str, int], piece: str, n: int) -> int:
        if len(piece) <= MEMO_LENGTH:
            if len(memo) >= MEMO_PIECES:
                memo.clear()
            memo[piece] = n
        return n

    def learn(self, piece: str) -> int:
        """A piece that the memo lacks."""
        m = PLAIN.fullmatch(piece) if self.plain else None
        if m is None:
            return self._kept(self.pieces, piece, self.encoded(piece))
        word, tail = m[1].lower(), m[2]
        if (n := self.words.get(word)) is None:
            n = self._kept(self.words, word, self.spelt(word))
        if tail:
            n += self.words[tail] if tail in self.words else self._kept(self.words, tail, self.encoded(tail))
        return self._kept(self.pieces, piece, n)

    def sizes(self, pieces: list[str]) -> list[int]:
        got = list(map(self.pieces.get, pieces))
        if None in got:
            known, learn = self.pieces, self.learn
            for k, n in enumerate(got):
                if n is None:
                    got[k] = known[pieces[k]] if pieces[k] in known else learn(pieces[k])
        return got


@cache
def _counts(path: str) -> _Counts:
    """The worker's memo for this vocabulary file, kept between tasks."""
    return _Counts(path)


def count_of(path: str, text: str | None) -> int:
    """The number of a text's tokens; none for null."""
    if not text:
        return 0
    counts = _counts(path)
    return sum(counts.sizes(text.split())) if counts.apart and not SEPARATORS.search(text) else len(offsets(path, text))


def windows_of(path: str, text: str | None, size: int, overlap: int) -> list[dict]:
    """``cut`` of a text by its ``offsets``, which are looked up where windows begin and end."""
    if not text or not (counts := _counts(path)).apart or SEPARATORS.search(text):
        return cut(text, offsets(path, text), size, overlap)
    parts = BLANKS.split(text)  # pieces, and the blanks between them
    pieces = parts[::2]
    places = list(accumulate(map(len, parts), initial=0))[::2]
    ends = list(accumulate(counts.sizes(pieces)))

    def place(token: int) -> tuple[int, int]:
        k = bisect_right(ends, token)
        a, b = offsets(path, pieces[k])[token - (ends[k - 1] if k else 0)]
        return places[k] + a, places[k] + b

    out = []
    for start in _starts(ends[-1], size, overlap):
        stop = min(start + size, ends[-1])
        first, last = place(start)[0], place(stop - 1)[1]
        out.append({"start_char": first, "end_char": last, "token_count": stop - start, "text": text[first:last]})
    return out


@dataclass(frozen=True, init=False)
class Subwords(Tokenizer):
    """The tokens of the ``tokenizers`` library for a vocabulary file, in Arrow batches."""

    path: str = ""

    def __init__(self, path: str):
        @F.arrow_udf("array<string>")
        def pieces(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else [t[a:b] for a, b in offsets(path, t)] for t in texts.to_pylist()], pa.list_(pa.string()))

        object.__setattr__(self, "path", path)
        object.__setattr__(self, "split", pieces)
        object.__setattr__(self, "joiner", "")

    @property
    def key(self) -> str:
        """What an engine's tables count by."""
        return f"subwords:{os.path.basename(self.path)}"

    def count(self, text: Column | str) -> Column:
        path = self.path

        @F.arrow_udf("int")
        def counted(texts: pa.Array) -> pa.Array:
            return pa.array([count_of(path, t) for t in texts.to_pylist()], pa.int32())

        return counted(text)

    def windows(self, text: Column | str, size: int, overlap: int) -> Column:
        path = self.path

        @F.arrow_udf(f"array<{WINDOW}>")
        def windowed(texts: pa.Array) -> pa.Array:
            return pa.array([windows_of(path, t, size, overlap) for t in texts.to_pylist()], _WINDOWS)

        # as a deterministic one it would be evaluated a second time, in a filter that Spark infers from ``posexplode``
        return windowed.asNondeterministic()(text)
