"""Near-copies against brute-force Jaccard similarity of 5-word shingles."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from corpuscle.llm import near_copies, simhash


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def slow_groups(texts):
    sets, root = [slow_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            union = sets[a] | sets[b]
            if not union or len(sets[a] & sets[b]) / len(union) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    shared, out = prose(40), [None, "", "One two", "one TWO", "one two three"]
    for _ in range(12):
        words = prose(rng.choice([6, 30, 100, 400]))
        if rng.random() < 0.5:
            words += shared  # a place that unlike documents crowd
        for _ in range(rng.choice([1, 2, 9])):
            out.append(" ".join(words))
            for k in sorted(rng.sample(range(len(words)), max(1, len(words) * rng.choice([1, 2, 3, 5]) // 100)), reverse=True):
                words[k : k + 1] = rng.choice([[], ["edited"], [words[k], "more"]])
    return out


@pytest.mark.parametrize("bucket", [64, 2])
@pytest.mark.parametrize("sample", [20_000, 10])
def test_groups_equal_brute_force(spark, texts, bucket, sample):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.groups(docs, bucket=bucket, sample=sample).collect()}
    want = slow_groups(texts)
    assert len(set(want)) < len(want) and got == dict(enumerate(want))


def test_stage_links_what_simhash_links(spark):
    """Two texts of Jaccard similarity 0.79 whose fingerprints differ in two bits at most are one group, as in op8."""
    rng, found = random.Random(3), None
    while found is None:
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        other = list(words)
        for k in (20, 50, 80):
            other[k] = "edited"
        pair = [" ".join(words), " ".join(other)]
        a, b = (int(x) for x in simhash.fingerprint(pair))
        x, y = map(slow_set, pair)
        if (a ^ b).bit_count() <= 2 and len(x & y) / len(x | y) < 0.8:
            found = pair
    docs = spark.createDataFrame([(1, found[0]), (2, found[1]), (3, "quite another text of some words")], "doc_id long, text string")
    linked = {r.doc_id: r.component_id for r in simhash.groups(docs).collect()}
    assert linked == {1: 1, 2: 1, 3: 3} == {r.doc_id: r.component_id for r in near_copies.groups(docs).collect()}
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]


def test_pairs_are_sent_once_a_run():
    """Three copies but for one word share all shingles of a prefix; their places send three pairs, not three for each shingle."""
    rows = np.array([[s, 100, k, at, 50 + at - 1 if at else 0] for at, s in enumerate(range(50, 60)) for k in (1, 2, 3)]).T
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["s", "size", "key", "at", "prev"])
    sent = [(a, b) for part in near_copies._meet(0.8, 64)(iter([batch])) for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
    assert sorted(sent) == [(1, 2), (1, 3), (2, 3)]


def test_signatures_bound_the_difference(texts):
    sets = [near_copies.shingles(t) for t in texts]
    for a in sets:
        for b in sets:
            assert near_copies.least_difference(near_copies.parities(a), near_copies.parities(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_stage_drops_edited_copies(spark, texts):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[-1], "y"), (None, "z", "y")], "doc_id long, text string, key string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, set(slow_groups(texts))), "None", "None"])
    assert corpus_pipeline.drop_near_copies(spark, docs.where("false"), "").count() == 0
