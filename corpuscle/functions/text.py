"""Token, text and similarity expressions; all are built-in column expressions.

The default tokeniser splits at white space. A list of tokens should stand in a column of its own: lambdas that refer to
it more than once then read the column and don't split the text again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = " [TRUNCATED]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Tokenizer:
    """How texts become tokens, and what stands between tokens when they become a text again.

    ``split`` gives an array of strings without empty ones; it may be a built-in expression or a pandas UDF.
    """

    split: Callable[[Column], Column]
    joiner: str = " "

    def tokens(self, text: Column | str) -> Column:
        return self.split(_col(text))

    def count(self, text: Column | str) -> Column:
        return F.coalesce(F.size(self.tokens(text)), F.lit(0))

    def windows(self, text: Column | str, size: int, overlap: int) -> Column | None:
        """Arrays of (start_char, end_char, token_count, text), where windows aren't made by joining tokens."""
        return None


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(_col(text), r"\s+"), lambda x: x != "")


def count_tokens(text: Column | str) -> Column:
    return F.coalesce(F.size(tokens(text)), F.lit(0))


#: Tokens are what white space separates.
WHITE_SPACE = Tokenizer(tokens)


def joined(toks: Column, first: Column | int, n: Column | int, joiner: str = " ") -> Column:
    return F.array_join(F.slice(toks, first, n), joiner)


def truncated(text: Column, toks: Column, limit: int, marker: str = MARKER, joiner: str = " ") -> Column:
    """At most ``limit`` tokens with the marker's among them; a text that fits stays as it is."""
    room = limit - len(marker.split())
    cut = F.lit(marker.strip()) if room <= 0 else F.concat(joined(toks, 1, room, joiner), F.lit(marker))
    return F.when(F.size(toks) <= limit, text).otherwise(cut)


def shortened(text: Column, toks: Column, limit: int, suffix: str = "…") -> Column:
    """The second form of truncation: nothing for no room, no white space before the suffix."""
    if limit <= 0:
        return F.lit("")
    keep = max(0, limit - len(suffix.split()))
    cut = F.lit(suffix) if keep == 0 else F.concat(F.rtrim(joined(toks, 1, keep)), F.lit(suffix))
    return F.when(F.size(toks) <= limit, text).otherwise(cut)


def approx_tokens(text: Column | str) -> Column:
    n = F.length(_col(text))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n / 4.0).cast("int")))


def approx_fits(text: Column | str, limit: int) -> Column:
    return approx_tokens(text) <= int(limit * 0.9)


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def cleaned(text: Column | str) -> Column:
    """One line for an embedder: line feeds are blanks, blank texts a single one."""
    line = F.trim(F.replace(_col(text), F.lit("\n"), F.lit(" ")))
    return F.when(line == "", F.lit(" ")).otherwise(line)


def node_id(name: Column | str) -> Column:
    spaced = F.regexp_replace(F.lower(stripped(name)), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{N}_]", ""), "^_+|_+$", "")


def words(text: Column | str) -> Column:
    """Words for overlap scores: lower case, without punctuation."""
    return F.filter(F.split(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda x: x != "")


def lcs_length(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two array columns, named, by rows of the usual table."""
    n = f"size({b})"
    row = f"""aggregate(sequence(1, {n}), named_struct('row', array(0), 'left', 0), (s, j) ->
        named_struct('row', s.row || array(if(x = get({b}, j - 1), get(prev, j - 1) + 1, greatest(get(prev, j), s.left))),
                     'left', if(x = get({b}, j - 1), get(prev, j - 1) + 1, greatest(get(prev, j), s.left))), s -> s.row)"""
    return F.expr(f"if(size({a}) = 0 or {n} = 0, 0, aggregate({a}, array_repeat(0, {n} + 1), (prev, x) -> {row}, r -> get(r, {n})))")


def rouge_l(a: str, b: str) -> Column:
    """F1 of the longest common subsequence: 2 lcs / (n + m), which is what precision and recall come to."""
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * lcs_length(a, b) / total)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column | str) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(_col(v), lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))
