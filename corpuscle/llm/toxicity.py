"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon is learned from labelled documents: words and word beginnings with the numbers of toxic and of clean
documents that have them. A document's features are densities of lexicon hits at several strengths, the nearness of
hits to second-person words, capitals, punctuation, and rates of obfuscation (digits and signs inside words, stretched
letters, words spelt out letter by letter). A document that the lexicon was learned from is scored without its own
contribution to the counts, so that trees see features as they are on new texts. Scores are calibrated on documents
that no tree has seen.

Labels come from rows whose ``crc32(doc_id as text) mod 4`` isn't 2, ``SAMPLE`` of them at most (those with the
smallest hash of their id); that bounds what reaches the driver: a row of features for each, ``LEXICON`` entries, and the model.
Labels, language, source and id are no inputs of a score. Scoring reads every whole text.

Null and empty texts get the score of a document without words. Null ids are not held out, and have no label. With
repeated ids each row is scored by its text, and training takes the one text of the id that has the smallest hash. Ties in hash or score change
nothing but which documents the bounded sample takes. Without labels of both kinds, the score is the share of toxic
labels (0 without any). Other columns are not read.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, LEXICON, THRESHOLD = 20_000, 6000, 0.3
#: Word beginnings that the lexicon counts.
STEMS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
ODD_WORD = re.compile(r"[^\W\d_]+[\d@$!*#|+]+[^\W\d_][\w@$!*#|+]*")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
#: Words whose weights a worker remembers; a full memo is emptied, which costs time only.
MEMO = 400_000
#: Second-person words of the corpus's languages (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú tu te ti tus usted ustedes vosotros os".split())
#: Characters that stand for letters in disguised words (fixed values).
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "*": "", "#": "", "_": ""})
FEATURES = ("strong_density", "medium_density", "weak_density", "strong_hits", "best_hit", "second_hit", "sum_hits", "kinds", "near_you", "you_density", "capital_words", "capital_letters", "exclamations", "punctuation", "odd_words", "disguised_hits", "spelt_hits", "stretched", "log_words")


def train_rows(key: Column) -> Column:
    """Whether labels of these rows may be learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 != 2, F.lit(True))


def terms(text: str) -> set[str]:
    found = set(WORD.findall(text.lower()))
    return found | {w[:k] + "*" for w in found for k in STEMS if len(w) > k}


def weight(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    """How much likelier a toxic document has a term than a clean one, as a logarithm."""
    return math.log((toxic + 0.25) / (all_toxic + 1)) - math.log((clean + 0.25 * (all_clean + 1) / (all_toxic + 1)) / (all_clean + 1))


class Lexicon:
    """Terms with the numbers of toxic and clean documents that have them."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, clean: int):
        self.counts, self.toxic, self.clean = counts, toxic, clean
        self.weights = {t: weight(a, b, toxic, clean) for t, (a, b) in counts.items()}
        self.memo: dict[str, float] = {}

    def learn(self, word: str) -> float:
        """The weight of a lower-case word: the largest of its own and its beginnings'; a hundred more if a letter is stretched."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        w, n = self.weights.get, len(word)
        got = max(0.0, w(word, 0.0), *(w(word[:k] + "*", 0.0) for k in STEMS if n > k))
        if STRETCHED.search(word):
            got += 100.0
        self.memo[word] = got
        return got

    def of(self, word: str) -> float:
        got = self.memo.get(word)
        return (self.learn(word) if got is None else got) % 100.0

    def without(self, text: str, label: int) -> "Lexicon":
        """The lexicon as it would be without this text, as far as its own terms go."""
        toxic, clean = self.toxic - (label == 1), self.clean - (label == 0)
        out = Lexicon({}, toxic, clean)
        for t in terms(text):
            if t in self.counts:
                a, b = self.counts[t]
                out.weights[t] = weight(a - (label == 1), b - (label == 0), toxic, clean) if a - (label == 1) >= 2 else 0.0
        return out

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        lower = text.lower()
        words = WORD.findall(lower)
        n, of = max(1, len(words)), self.of
        weights = list(map(self.memo.get, words))
        if None in weights:
            learn = self.learn
            weights = [learn(words[k]) if w is None else w for k, w in enumerate(weights)]
        marked = [k for k, w in enumerate(weights) if w > 1.0]
        stretched = sum(weights[k] >= 100 for k in marked)
        weak = [k for k in marked if weights[k] % 100.0 > 1.0]
        hits = [k for k in weak if weights[k] % 100.0 > 2.0]
        strong = [k for k in hits if weights[k] % 100.0 > 4.0]
        spoken = [k for k, w in enumerate(words) if w in SECOND_PERSON]
        near = sum((i := bisect.bisect_left(spoken, k - 5)) < len(spoken) and spoken[i] <= k + 5 for k in hits)
        disguised = odd = 0
        for m in ODD_WORD.finditer(lower):
            plain = m[0].translate(DISGUISE)
            odd += 1
            disguised += of(plain) > 4
        # runs of four or more single letters are words spelt out
        spelt, run = 0, []
        for k in [k for k, w in enumerate(words) if len(w) == 1] + [-9]:
            if run and k != run[-1] + 1:
                spelt += len(run) > 3 and of("".join(words[i] for i in run)) > 4
                run = []
            run.append(k)
        top = sorted({words[k]: weights[k] % 100.0 for k in hits}.values(), reverse=True)
        signs = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)
        size = max(1, len(text))
        return [
            len(strong) / n,
            len(hits) / n,
            len(weak) / n,
            min(20.0, len(strong)),
            top[0] if top else 0.0,
            top[1] if len(top) > 1 else 0.0,
            min(100.0, sum(top)),
            min(20.0, len(top)),
            min(20.0, near),
            len(spoken) / n,
            sum(map(str.isupper, text.split())) / n,
            int(signs[65:91].sum()) / size,
            int(signs[33]) / n,
            int(signs[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()) / size,
            odd / n,
            min(20.0, disguised),
            min(20.0, spelt),
            stretched / n,
            math.log1p(len(words)),
        ]


class Trees:
    """Gradient boosting of small trees on logistic loss, over quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 3.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins)[:-1], method="lower")) for c in x.T]
        b, share = self._binned(x), min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = math.log(share / (1 - share))
        f = np.full(len(y), self.base)
        offsets = np.arange(x.shape[1]) * (self.bins + 1)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut, value = np.full(2**self.depth, -1), np.zeros(2**self.depth, int), np.zeros(2 ** (self.depth + 1))
            at = np.ones(len(y), int)
            for node in range(1, 2 ** (self.depth + 1)):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = gs / (hs + self.ridge)
                if node >= 2**self.depth:
                    continue
                where = (b[rows] + offsets).ravel()
                size = x.shape[1] * (self.bins + 1)
                gh = [np.bincount(where, np.repeat(v[rows], x.shape[1]), size).reshape(x.shape[1], -1).cumsum(axis=1) for v in (g, h)]
                gl, hl = gh[0], gh[1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                counts = np.bincount(where, minlength=size).reshape(x.shape[1], -1).cumsum(axis=1)
                gain[(counts < self.least) | (len(rows) - counts < self.least)] = 0
                j, k = divmod(int(gain.argmax()), self.bins + 1)
                if gain[j, k] > 1e-6:
                    feature[node], cut[node] = j, k
                    at[rows] = 2 * node + (b[rows, j] > k)
                else:
                    at[rows] = node * 2 ** (self.depth - int(math.log2(node)))
                    value[node * 2 ** (self.depth - int(math.log2(node)))] = value[node]
            self.trees.append((feature, cut, value))
            f += self.rate * value[self._leaves(b, feature, cut)]
        return self

    def _leaves(self, b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        at, rows = np.ones(len(b), int), np.arange(len(b))
        for _ in range(self.depth):
            split = feature[at] >= 0
            at = 2 * at + (split & (b[rows, feature[at]] > cut[at]))
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + self.rate * sum((v[self._leaves(b, f, c)] for f, c, v in self.trees), np.zeros(len(x)))


class Isotonic:
    """Pool-adjacent-violators fit, with straight lines between the pools; shares are drawn towards one half a little."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Isotonic":
        pools: list[list[float]] = []
        for v, t in sorted(zip(x.tolist(), y.tolist())):
            if pools and pools[-1][2] == v:
                pools[-1][0] += t
                pools[-1][1] += 1
            else:
                pools.append([t, 1, v, v])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                t2, n2, _, hi = pools.pop()
                pools[-1][0] += t2
                pools[-1][1] += n2
                pools[-1][3] = hi
        self.x = np.array([v for p in pools for v in p[2:]])
        self.y = np.array([(p[0] + 0.05) / (p[1] + 0.1) for p in pools for _ in (0, 1)])
        self.y = np.maximum.accumulate(self.y)
        return self

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


class Model:
    """Lexicon, trees and calibration; ``score`` takes texts to numbers from 0 to 1."""

    def __init__(self, lexicon: Lexicon, trees: Trees | None, calibration: Isotonic | None, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, texts) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        if not len(texts):
            return np.zeros(0)
        margin = self.trees.margin(np.array([self.lexicon.features(t) for t in texts]))
        # calibrated, with a little of the margin itself so that equal shares keep an order
        return np.clip(0.98 * self.calibration.of(margin) + 0.02 / (1 + np.exp(-margin)), 0, 1)


def _sample(labels: DataFrame, most: int) -> DataFrame:
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & train_rows(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lexicon: int = LEXICON) -> Model:
    """Learns from ``sample`` labelled documents at most."""
    spark = docs.sparkSession
    chosen = common.stored(_sample(labels, sample), "label-sample")
    texts = docs.select("doc_id", common.text_or_empty(F.col("text")).alias("text"))
    # the sample has at most ``sample`` rows of two numbers
    rows = texts.join(F.broadcast(chosen), "doc_id")
    # one text of each id, so that rows are as bounded as ids
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    rows = common.stored(rows.select("doc_id", "first.text", "toxic"), "labelled-texts")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Counter(), Counter()]
            for text, toxic in zip(batch["text"], batch["toxic"]):
                found[toxic].update(terms(text))
            every = list(found[0].keys() | found[1].keys())
            yield pd.DataFrame({"term": every, "toxic": [found[1][t] for t in every], "clean": [found[0][t] for t in every]})

    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    share = toxic / max(1, toxic + clean)
    if not toxic or not clean:
        return Model(Lexicon({}, toxic, clean), None, None, share)
    counts = rows.mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    excess = F.col("toxic") / toxic - 3 * F.col("clean") / clean
    best = counts.where((F.col("toxic") >= 2) & (excess > 0)).orderBy(excess.desc(), "term").limit(lexicon).collect()
    book = Lexicon({r["term"]: (r["toxic"], r["clean"]) for r in best}, toxic, clean)
    shared = spark.sparkContext.broadcast(book)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "x": [shared.value.without(t, y).features(t) for t, y in zip(batch["text"], batch["toxic"])]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = rows.mapInPandas(measure, f"doc_id {kind}, toxic int, x array<double>").toPandas()
    # an order that depends on ids and features only; sorting here keeps the features from being measured twice
    table = table.iloc[sorted(range(len(table)), key=lambda i: (zlib.crc32(str(table["doc_id"].iat[i]).encode()), tuple(table["x"].iat[i])))]
    x, y = np.array(table["x"].tolist()), table["toxic"].to_numpy(float)
    # every row calibrates trees that have not seen it, on folds of four; the final trees learn from all rows
    fold, margin = np.arange(len(y)) % 4, np.zeros(len(y))
    for k in range(4):
        margin[fold == k] = Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(book, Trees().fit(x, y), Isotonic().fit(margin, y), share)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores; keeps all rows and columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(texts.tolist()))

    return docs.withColumn(name, score(F.col("text").cast("string")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels, **parameters))
    return rows.select("doc_id", (~train_rows(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """The documents that aren't predicted to be toxic, with their columns as they are."""
    name = common.free_name(docs, "toxicity")
    return scored(docs, fit(docs, labels, **parameters), name).where(F.col(name) < threshold).drop(name)
