"""Claims of answers: overlap, removal of near-duplicates, clusters, and comparisons of systems."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsons as js
from ..functions import text as tx

DUPLICATE, THRESHOLDS = 0.85, (0.5, 0.6, 0.7, 0.8)


def parsed(responses: DataFrame, key: str) -> DataFrame:
    """(key, pos, claim): strings of more than ten characters in the list ``claims`` of JSON responses."""
    rows = responses.withColumn("v", js.parsed("response")).where(js.is_object(F.col("v")))
    rows = rows.select(key, F.posexplode(F.try_variant_get("v", "$.claims", "array<variant>")).alias("pos", "item"))
    rows = rows.where(F.schema_of_variant("item") == "STRING").select(key, "pos", tx.stripped(F.try_variant_get("item", "$", "string")).alias("claim"))
    return rows.where(F.length("claim") > 10)


def _words(text: str) -> list[str]:
    return re.sub(r"[^\w\s]", " ", text.lower()).split()


def _places(words: list[str]) -> dict[str, int]:
    """For each word the bits of its places."""
    found: dict[str, int] = {}
    for i, w in enumerate(words):
        found[w] = found.get(w, 0) | 1 << i
    return found


def _common(places: dict[str, int], n: int, other: list[str]) -> int:
    """Length of the longest common subsequence of ``n`` words, by their places, and others: a step of bits for each of those."""
    free = (1 << n) - 1
    for w in other:
        if hit := free & places.get(w, 0):
            free = (free + hit) | (free - hit)
    return n - (free & (1 << n) - 1).bit_count()


def _lcs(a: list[str], b: list[str]) -> int:
    return _common(_places(a), len(a), b)


def rouge_l(a: list[str], b: list[str]) -> float:
    """The overlap of two lists of words; 0 where there is nothing in common."""
    return 2 * _lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


class _Kept:
    """Claims so far, by their words, for which bounds on the overlap with another are had without comparing them.

    No subsequence is longer than the words that two claims have in common, so most pairs are ruled out by counts.
    """

    def __init__(self):
        self.words: list[list[str]] = []
        self.holders: dict[str, tuple[list[int], list[int]]] = {}
        self.sizes: list[int] = []

    def add(self, words: list[str]) -> None:
        for w, n in Counter(words).items():
            at, times = self.holders.setdefault(w, ([], []))
            at.append(len(self.words))
            times.append(n)
        self.words.append(words)
        self.sizes.append(len(words))

    def bounds(self, words: list[str]) -> np.ndarray:
        """For each claim kept the most that its overlap may be."""
        shared = np.zeros(len(self.words))
        for w, n in Counter(words).items():
            if w in self.holders:
                at, times = self.holders[w]
                shared[at] += np.minimum(times, n)
        return np.divide(2 * shared, np.array(self.sizes) + len(words), out=np.zeros(len(shared)), where=shared > 0)

    def overlap(self, places: dict[str, int], n: int, k: int) -> float:
        return 2 * _common(places, n, self.words[k]) / (n + self.sizes[k])


def _by_group(claims: DataFrame, by: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], extra: str) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in claims.schema) + extra
    return claims.groupBy(*by).applyInPandas(lambda pdf: fold(pdf.sort_values("pos")), schema)


def deduplicated(claims: DataFrame, by: list[str], threshold: float = DUPLICATE) -> DataFrame:
    """Claims that overlap no kept earlier one by more than ``threshold``; a fold over each answer's claims in order."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, keep = _Kept(), []
        for text in pdf["claim"]:
            words = _words(text)
            places = _places(words)
            near = np.flatnonzero(kept.bounds(words) > threshold)
            keep.append(not any(kept.overlap(places, len(words), k) > threshold for k in near))
            if keep[-1]:
                kept.add(words)
        return pdf[keep]

    return _by_group(claims, by, fold, "")


def clustered(claims: DataFrame, by: list[str], distance: float = 0.7) -> DataFrame:
    """Adds ``cluster``: that of the most similar earlier claim, if it is at least ``1 - distance`` similar, else a new one."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, labels, clusters = _Kept(), [], 0
        for text in pdf["claim"]:
            words = _words(text)
            places, bounds = _places(words), kept.bounds(words)
            # the most similar one, of several that of the first cluster; without any word in common all are alike
            best, of = (0.0, 0) if labels else (-1.0, -1)
            for k in np.argsort(-bounds, kind="stable"):
                if bounds[k] < max(best, 1 - distance) or not bounds[k]:
                    break
                score = kept.overlap(places, len(words), k)
                if score > best or score == best and labels[k] < of:
                    best, of = score, labels[k]
            if of < 0 or best < 1 - distance:
                of, clusters = clusters, clusters + 1
            labels.append(of)
            kept.add(words)
        return pdf.assign(cluster=labels)

    return _by_group(claims, by, fold, ", cluster int")


def cluster_counts(claims: DataFrame, by: list[str], thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(by, threshold, clusters) without a fold: a claim opens a cluster if no earlier one of its answer is similar enough."""
    rows = claims.withColumn("w", tx.words("claim"))
    earlier = rows.select(*by, F.col("pos").alias("_pos"), F.col("w").alias("v"))
    pairs = rows.join(earlier, by).where(F.col("_pos") < F.col("pos")).withColumn("f1", tx.rouge_l("w", "v"))
    best = rows.select(*by, "pos").join(pairs.groupBy(*by, "pos").agg(F.max("f1").alias("best")), [*by, "pos"], "left")
    best = best.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    opens = F.coalesce(F.col("best") < F.lit(1.0) - F.col("threshold"), F.lit(True))
    return best.groupBy(*by, "threshold").agg(F.count_if(opens).alias("clusters"))


def comparison(counts: DataFrame, first: str = "global", second: str = "local") -> DataFrame:
    """(question_id, system, claims, clusters) to a row for each question: both counts, difference, winner in claims and clusters."""
    pick = lambda c, s: F.coalesce(F.max(F.when(F.col("system") == s, F.col(c))), F.lit(0))
    rows = counts.groupBy("question_id").agg(pick("claims", first).alias("claims_first"), pick("claims", second).alias("claims_second"), pick("clusters", first).alias("clusters_first"), pick("clusters", second).alias("clusters_second"))
    winner = lambda a, b: F.when(F.col(a) > F.col(b), first).when(F.col(a) < F.col(b), second).otherwise("tie")
    return rows.withColumns({"delta": F.col("claims_first") - F.col("claims_second"), "winner": winner("claims_first", "claims_second"), "diversity_winner": winner("clusters_first", "clusters_second")})


def batch(rows: DataFrame, first: str = "global") -> DataFrame:
    """One row over all questions: mean claims and clusters, and the share of questions that ``first`` wins; null without questions."""
    mean = lambda c: F.round(F.avg(c), 2)
    return rows.agg(F.count("*").alias("questions"), mean("claims_first").alias("avg_claims_first"), mean("claims_second").alias("avg_claims_second"), mean("clusters_first").alias("avg_clusters_first"), mean("clusters_second").alias("avg_clusters_second"), F.round(F.try_divide(F.count_if(F.col("winner") == first), F.count("*")), 4).alias("claim_win_rate"), F.round(F.try_divide(F.count_if(F.col("diversity_winner") == first), F.count("*")), 4).alias("cluster_win_rate"))


def pairs(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Overlap of the word columns ``a_words`` and ``b_words`` of rows that share ``on``."""
    rows = a.join(b, on)
    return rows.withColumn("lcs", tx.lcs_length("a_words", "b_words")).withColumn("f1", tx.rouge_l("a_words", "b_words"))
