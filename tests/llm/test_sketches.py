"""Sketches and neighbours against plain Python."""

import hashlib
import re
from decimal import Decimal

import pytest
import xxhash
from pyspark.sql import functions as F

from corpuscle.llm import sketches

ODD = [(5, None), (6, ""), (7, " \n "), (8, "one"), (9, "Two  words"), (9, "two words"), (None, "no id here at all, none"), (12, "é" * 7 + " 𝒳 b"), (13, "w " * 30000), (14, "a b c d e f g"), (14, "a b c d e f g")]


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, own int, place string")
    got = sketches.compare_with_edits(df).collect()
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    tie = {t: h for t, h in [(r.t, r.h) for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]}
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, tie[x[1]]))
    want = []
    for k, (d, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert hashes and sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next, r.resemblance_edited, r.resemblance_next))
    by_text = {}
    for r in got:
        by_text.setdefault(r.edited_sha256, set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    return got


def slow_sketch(text, shingle=5, scale=8):
    """Hashes of shingles, each word's with the one before as its seed, below the threshold, or else the smallest."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    found = set()
    for k in range(max(1, len(words) - shingle + 1) if words else 0):
        h = 42
        for w in words[k : k + shingle]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        found.add(h >> 16)
    return sorted(h for h in found if h < (1 << 48) // scale) or sorted(found)[:1]


def test_fingerprints_and_likeness_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10_000 + k, t) for k, (_, t) in enumerate(ODD)]
    got = {r.doc_id: r for r in sketches.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spelt = lambda sketch: "".join(f"{h:012x}" for h in sketch)

    def share(a, b):
        n = min(len(a), len(b))
        return len(set(a) & set(b)) / n if n else float(len(a) == len(b))

    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        edit = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, changed = slow_sketch(t), slow_sketch(edit)
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (spelt(own), spelt(changed))
        assert got[d].near_edited == pytest.approx(share(own, changed)) and got[d].near_next == pytest.approx(share(own, slow_sketch(after)))


def test_merged_sketches_are_those_of_all_shingles(spark):
    texts = ["a", "a b", "one two three", " ".join(f"w{k}" for k in range(9)), " ".join(f"w{k}" for k in range(300)), ""]
    rows = [(i, x, y) for i, x in enumerate(texts) for y in texts]
    df = sketches.with_sketch(sketches.with_sketch(spark.createDataFrame(rows, "i int, x string, y string"), "x", "a"), "y", "b")
    full = lambda t: set(slow_sketch(t, scale=1))
    for r in df.select("x", "y", sketches.merge(F.col("a"), F.col("b")).alias("m")).collect():
        both = full(r.x) | full(r.y)
        assert r.m == (sorted(h for h in both if h < (1 << 48) // 8) or sorted(both)[:1])


@pytest.mark.parametrize("low", [2**60, -(2**63), 2**63 - 60])
def test_large_ids(spark, monkeypatch, low):
    monkeypatch.setattr(sketches, "BUCKET_ROWS", 5)
    check(spark, [(low + k, f"text number {k} of the table and more words") for k in range(60)])


@pytest.mark.parametrize(("kind", "make"), [("string", lambda k: f'mmlu "{k % 7}", é-{k}'), ("decimal(20,1)", lambda k: Decimal(k) / 2)])
def test_ids_of_other_types(spark, monkeypatch, kind, make):
    monkeypatch.setattr(sketches, "BUCKET_ROWS", 5)
    rows = [(make(k), f"text number {k} of the table and more words") for k in range(90)] + [(None, "no id"), (None, "no id either")]
    got = sketches.compare_with_edits(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(4)).collect()
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    # the two rows without an id stand first, in the order of their texts' hashes
    after = dict(zip([r[0] for r in order], [t for _, t in order[1:]]))
    found = {r.doc_id: r.edited_sha256 for r in got}
    assert len(got) == len(rows) and set(found) == {None, *(r[0] for r in order)}
    for d, t in order[:-1]:
        assert found[d] == hashlib.sha256((t[: len(t) - len(t) // 2] + after[d][: len(t) // 2]).encode()).hexdigest()
    half = len(order[-1][1]) // 2
    kept = order[-1][1][: len(order[-1][1]) - half]
    assert found[order[-1][0]] in {hashlib.sha256((kept + t[:half]).encode()).hexdigest() for t in ("no id", "no id either")}


def test_stand_ins_are_compared_by_all_shingles(spark):
    """Short passages that stand whole in the long text after them: contained, whatever their sketches say."""
    long = " ".join(f"w{k}" for k in range(2000))
    rows = [x for k in range(60) for x in ((2 * k, " ".join(f"w{10 * k + j}" for j in range(10))), (2 * k + 1, long))]
    got = {r.doc_id: r for r in sketches.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    short = [d for d, t in rows if t != long]
    assert all(got[d].contained_next == 1.0 for d in short)
    stood_in = [d for d in short if slow_sketch(rows[d][1])[0] >= (1 << 48) // 8]
    assert stood_in and any(got[d].near_next == 0.0 for d in stood_in)
    full = lambda t: set(slow_sketch(t, scale=1))
    for d in stood_in:
        t, after = rows[d][1], rows[d + 1][1]
        a, b = full(t), full(t[: len(t) - len(t) // 2] + after[: len(t) // 2])
        assert got[d].contained_edited == pytest.approx(len(a & b) / min(len(a), len(b)))


def test_columns_of_the_caller(spark):
    docs = spark.createDataFrame([(k, f"t{k}", k, k, k) for k in range(9)], "doc_id long, text string, edges int, own_key int, place int")
    got = sketches.with_next(docs, ["doc_id", "edges", "own_key", "place"], {"edges": "e", "place": "p"})
    assert sorted(map(tuple, got.collect())) == [(k, k, k, k, (k + 1) % 9, (k + 1) % 9) for k in range(9)]


def test_odd_rows(spark):
    got = check(spark, ODD)
    assert {r.fingerprint for r in got if r.doc_id in (5, 6, 7)} == {""}
    assert all(len(r.fingerprint) >= 12 for r in got if r.doc_id not in (5, 6, 7))


def test_buckets(spark, sf, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for size in (3, 50, 1000):
        monkeypatch.setattr(sketches, "BUCKET_ROWS", size)
        check(spark, rows + [(20, "again"), (20, "and again")])


def test_one_row_and_none(spark):
    check(spark, [(3, "only one row is here and it follows itself")])
    assert sketches.compare_with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates(spark):
    a, b = [f"w{k}" for k in range(3000)], [f"v{k}" for k in range(3000)]
    rows = [(0, " ".join(a)), (1, " ".join(a[:1500] + b[:1500])), (2, " ".join(a[:300])), (3, " ".join(a + b))]
    df = sketches.with_sketch(spark.createDataFrame(rows, "doc_id long, text string"), "text", "s")
    s = {r.doc_id: r.s for r in df.collect()}
    one = spark.createDataFrame([tuple(s[k] for k in range(4))], "a array<bigint>, b array<bigint>, c array<bigint>, d array<bigint>")
    r = one.select(sketches.containment(F.col("a"), F.col("b")), sketches.resemblance(F.col("a"), F.col("b")), sketches.containment(F.col("c"), F.col("a")), sketches.containment(F.col("d"), F.col("c")), F.size(sketches.merge(F.col("a"), F.col("b")))).head()
    assert r[0] == pytest.approx(0.5, abs=0.06) and r[1] == pytest.approx(1 / 3, abs=0.06) and r[2] == r[3] == 1.0
    assert len(s[0]) == pytest.approx(3000 / 8, rel=0.2) and r[4] == len({*s[0], *s[1]})
