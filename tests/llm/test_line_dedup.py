"""Line dedup against brute force over all windows."""

import random

import pytest

from corpuscle.llm import line_dedup as ld


def slow(rows, min_words=5):
    """Texts without the lines of later copies; rows in order."""
    kept, seqs = [], []
    for text in rows:
        lines = (text or "").split("\n")
        seqs.append([(k, x.strip(" ")) for k, x in enumerate(lines) if x.strip(" ")])
    gone = [set() for _ in rows]
    for size in range(1, 1 + max(map(len, seqs), default=0)):
        seen, repeated = set(), False
        for d, seq in enumerate(seqs):
            for p in range(len(seq) - size + 1):
                window = tuple(x for _, x in seq[p : p + size])
                if window in seen:
                    repeated = True
                    if sum(x.count(" ") + 1 for x in window) >= min_words:
                        gone[d].update(range(seq[p][0], seq[p + size - 1][0] + 1))
                seen.add(window)
        if not repeated:
            break
    for text, g in zip(rows, gone):
        kept.append(None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in g))
    return kept


@pytest.mark.parametrize("seed, min_words", [(1, 5), (2, 5), (3, 1), (4, 9)])
def test_equals_brute_force(spark, seed, min_words):
    rng = random.Random(seed)
    pool = ["a", "b", " b ", "c d", "e f g", "this line has six words here", "another line that is long enough", "", "  ", "é ü"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 12, 60]))) for _ in range(25)] + [None, "", "\n", texts_of_one()]
    df = spark.createDataFrame([(k, t, k, "x") for k, t in enumerate(texts)], "doc_id long, text string, d int, number string").repartition(4)
    got = ld.dedup(df, min_words)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == dict(enumerate(slow(texts, min_words)))


def texts_of_one():
    return "\n".join(["one and the same line again"] * 300 + ["x"])


def test_repeated_and_null_ids(spark):
    rows = [(1, "first line with quite some words\nshort"), (1, "first line with quite some words\nshort"), (None, "first line with quite some words"), (2, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in ld.dedup(df).collect())
    # null ids come first and keep the line; of the two equal rows the second loses all that the first one has
    assert got == sorted([("None", "first line with quite some words"), ("None", "None"), ("1", "short"), ("1", ""), ("2", "None")])


def test_runs(spark):
    run = [f"line number {k} of a run" for k in range(9)]
    docs = spark.createDataFrame([(0, "\n".join(["own start of the first one", *run])), (1, "\n".join(["", *run, "an end of its own here"])), (2, "\n".join(run[2:5]))], "doc_id long, text string")
    assert sorted(map(tuple, ld.runs(docs).collect())) == [(1, 1, 9, 0), (2, 0, 2, 0)]
    assert {r.doc_id: r.text for r in ld.dedup(docs).collect()}[1] == "\nan end of its own here"


@pytest.mark.parametrize("n", range(2, 8))
def test_runs_of_any_length_go(spark, n):
    run = ["red apple", "green pear", "blue", "plum", "x", "y", "z"][:n]
    words = sum(x.count(" ") + 1 for x in run)
    docs = spark.createDataFrame([("a", "\n".join(["first one of its own", *run])), ("b", "\n".join([*run, "another of its own"]))], "doc_id string, text string")
    got = {r.doc_id: r.text for r in ld.dedup(docs, words).collect()}
    assert got == {"a": "\n".join(["first one of its own", *run]), "b": "another of its own"}


def test_suffix_array(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30))) for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(((r.rank, r.document, r.line, r.lcp) for r in ld.suffix_array(df, 4).collect()), key=lambda r: [(x is not None, x) for x in r[0]])
    suffix = lambda d, k: texts[d].split("\n")[k : k + 4]
    shared = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    assert len(got) == sum(len(t.split("\n")) for t in texts if t)
    for (_, d0, k0, _), (_, d1, k1, lcp) in zip(got, got[1:]):
        assert lcp == shared(suffix(d0, k0), suffix(d1, k1))
    # neighbours share as much as any two suffixes do
    for _, d, k, _ in got:
        best = max(shared(suffix(d, k), suffix(e, j)) for _, e, j, _ in got if (e, j) != (d, k))
        at = [(e, j) for _, e, j, _ in got].index((d, k))
        assert best == max(([got[at][3]] if at else []) + ([got[at + 1][3]] if at + 1 < len(got) else []))


def test_native(spark, sf):
    plan = ld.dedup(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_empty(spark):
    assert ld.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
