"""Toxicity: held-out accuracy, features, trees and calibration."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import toxicity as tox

CLEAN = [f"word{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
BAD = ["scoundrel", "dolt", "vermin", "halfwit"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for d in range(600):
        words = [rng.choice(CLEAN) for _ in range(rng.choice([5, 40, 200]))]
        bad = d % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice([*BAD, "grubox" + rng.choice(CLEAN)]))
        docs.append((d, " ".join(words), "y", float(bad)))
        if d % 10 != 9:
            labels.append((d, int(bad), 1))
    docs += [(1000, None, "n", 0.0), (1001, "", "n", 0.0), (None, "you scoundrel dolt vermin", "n", 0.0), (1002, "word " * 30000, "n", 0.0), (5, "wordak again", "n", 0.0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, toxicity double"), spark.createDataFrame([*labels, (None, 1, 1), (7, None, 0)], "doc_id long, toxic int, quality int")


def test_rows_and_accuracy(corpus):
    docs, labels = corpus
    got = tox.classify(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.97
    assert next(r for r in got if r.doc_id is None).predicted == 1
    kept = tox.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_labels_held_out_are_not_learned(corpus):
    docs, labels = corpus
    turned = labels.withColumn("toxic", F.when(tox.train_rows(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in tox.classify(docs.where("doc_id < 600 and length(text) > 20"), x).collect()} for x in (labels, turned))
    assert a == b


def test_table(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = tox.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.toxic for r in rows])
    order = sorted(rows, key=lambda r: -r.score)
    bad = sum(r.toxic for r in rows)
    assert right > 0.9 and sum(r.toxic for r in order[:bad]) >= 0.6 * bad


def test_odd_tables(spark, corpus):
    docs, labels = corpus
    assert tox.classify(docs.where("false"), labels).count() == 0
    assert {r.score for r in tox.classify(docs.limit(5), labels.where("false")).collect()} == {0.0}
    assert {r.score for r in tox.classify(docs, labels.where("toxic = 1")).collect()} == {1.0}


def test_repeated_ids_are_learned_once(spark, monkeypatch):
    sizes, fit = [], tox.Trees.fit
    monkeypatch.setattr(tox.Trees, "fit", lambda self, x, y: sizes.append(len(x)) or fit(self, x, y))
    docs = spark.range(400).selectExpr("id % 40 as doc_id", "concat('calm words ', id, if(id % 5 = 0, ' you dolt vermin', '')) as text")
    labels = spark.range(40).selectExpr("id as doc_id", "cast(id % 5 = 0 as int) as toxic")
    tox.fit(docs, labels)
    assert sizes[-1] == labels.where(tox.train_rows(F.col("doc_id"))).count()


def test_trees_equal_plain_search():
    """The first split of a tree is the best of all cuts of all features."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = np.round(rng.normal(size=(60, 3)), 1), rng.integers(0, 2, 60).astype(float)
        tree = tox.Trees(rounds=1, depth=1, bins=64)
        tree.fit(x, y)
        g, h = y - y.mean(), np.full(60, y.mean() * (1 - y.mean()))
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)  # noqa: B023, E731
        best = max((gain(x[:, j] <= v) + gain(x[:, j] > v) for j in range(3) for v in np.unique(x[:, j]) if 3 <= (x[:, j] <= v).sum() <= 57), default=0)
        feature, cut, _ = tree.trees[0]
        got = x[:, feature[1]] <= tree.edges[feature[1]][cut[1]]
        assert gain(got) + gain(~got) == pytest.approx(best)


def test_isotonic_equals_plain_fit():
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randint(1, 12)
        y = [float(rng.random() < 0.5) for _ in range(n)]
        # least squares among ascending sequences: the min-max formula
        want = [max(min(sum(y[a : b + 1]) / (b + 1 - a) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        fit = tox.Isotonic().fit(np.arange(n, dtype=float), np.array(y))
        sizes = [want.count(w) for w in want]
        assert fit.of(np.arange(n, dtype=float)) == pytest.approx([(w * k + 0.05) / (k + 0.1) for w, k in zip(want, sizes)], abs=0.06)


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = tox.Trees().fit(x[:2000], y[:2000]).margin(x[2000:])
    assert ((m > 0) == (y[2000:] > 0)).mean() > 0.95
    p = tox.Isotonic().fit(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0.0, 1, 0, 0, 1, 1])).of(np.array([0.0, 1, 2.5, 4, 5, 9]))
    assert (np.diff(p) >= 0).all() and p[0] < 0.1 and p[-1] > 0.9 and 0.3 < p[2] < 0.4


def test_features():
    book = tox.Lexicon({"dolt": (50, 0), "calm": (0, 50)}, 100, 900)
    f = dict(zip(tox.FEATURES, book.features("You DOLT!! d0lt and d o l t soooo 5 calm")))
    assert len(f) == len(tox.FEATURES) and f["strong_hits"] >= 1 and f["near_you"] >= 1 and f["disguised_hits"] == 1 and f["spelt_hits"] == 1 and f["stretched"] > 0 and f["exclamations"] > 0
    assert book.without("a dolt", 1).weights["dolt"] < book.weights["dolt"]


def test_large_samples_are_learned_whole(spark, monkeypatch):
    sizes, fit = [], tox.Trees.fit
    monkeypatch.setattr(tox.Trees, "fit", lambda self, x, y: sizes.append(len(x)) or fit(self, x, y))
    docs = spark.range(11_000).selectExpr("id as doc_id", "if(id % 5 = 0, 'you dolt vermin', 'calm words here') as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) as toxic")
    tox.fit(docs, labels)
    n = labels.where(tox.train_rows(F.col("doc_id"))).count()
    assert n >= 8000 and len(sizes) == 5 and sizes[-1] == n and sum(n - s for s in sizes[:4]) == n
