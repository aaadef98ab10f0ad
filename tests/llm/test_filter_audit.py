"""The walk over orders and its cells against removal document by document."""

import itertools
import re

import numpy as np
import pytest

from corpuscle.llm import filter_audit as fa


@pytest.mark.parametrize("k", range(1, 7))
def test_swaps_visit_each_order_once(k):
    order, seen = list(range(k)), [tuple(range(k))]
    for at in fa.swaps(k):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(k)))


def removed(docs, order):
    """Step by step: (kept, removed, redundant, good, toxic) of rows (mask, good, toxic)."""
    left, out = list(docs), []
    for f in order:
        gone = [d for d in left if d[0] >> f & 1]
        failing = sum(d[0] >> f & 1 for d in docs)
        left = [d for d in left if not d[0] >> f & 1]
        out.append((len(left), len(gone), failing - len(gone), sum(d[1] for d in gone), sum(d[2] for d in gone)))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_walk(k):
    rng = np.random.default_rng(k)
    docs = [(int(m), int(g), int(t)) for m, g, t in zip(rng.integers(0, 1 << k, 300), rng.integers(0, 2, 300), rng.integers(0, 2, 300))]
    counts = np.zeros((1 << k, 3), np.int64)
    for m, g, t in docs:
        counts[m] += (1, g, t)
    letters = "ABCDE"[:k]
    got = {(r[0], r[1]): r[2:] for r in fa.walk(counts, letters)}
    orders = list(itertools.permutations(range(k)))
    want = {("".join(letters[f] for f in o), i + 1): (o[i], *x) for o in orders for i, x in enumerate(removed(docs, o))}
    assert set(got) == set(want)
    share = {f: sum(w[2] for w in want.values() if w[0] == f) for f in range(k)}
    for key, (f, kept, gone, redundant, good, toxic) in want.items():
        unique = sum(m == 1 << f for m, _, _ in docs)
        assert got[key] == (kept, gone, redundant, unique, good, toxic, share[f])


def fails(text, doc_id, every):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    first = min((d for d, t in every if d is not None and t == text), default=None)
    return [len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), doc_id is not None and doc_id > first]


def test_odd_rows(spark):
    long = " ".join(f"word{k}" for k in range(100))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "de"), (2, long, "en"), (None, long, "en"), (None, long, "en"), (3, None, None), (4, "", ""), (5, " \x0b\t", "en"), (6, "a\u00a0b " * 120, "fr"), (7, "Ä" * 9 + "A", "fr"), (8, "A" * 9, "fr"),
        (9, "x " * 200_000, "en"), (10, long + " #", "de"), (11, long.upper(), "de"), (11, "other", "de"), (-5, long, "es"), (12, "word\x1cword " * 100, "es"), (13, "x\u2028y", "es"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (None, 1, 1), (7, None, 1), (99, 1, 1), (11, 1, 0)]
    frame = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, lang string, n int, mask string").repartition(5)
    found = fa.interactions(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found.collect()}
    every = [(d, t or "") for d, t, _ in docs]
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    parts = {}
    for d, t, lang in docs:
        mask = sum(1 << k for k, x in enumerate(fails(t or "", d, every)) if x)
        parts.setdefault(lang or "", []).append((mask, d in good, d in toxic))
    assert len(got) == 600 * len(parts)
    for part, rows in parts.items():
        for o in itertools.permutations(range(5)):
            for i, x in enumerate(removed(rows, o)):
                r = got[part, "".join("ABCDE"[f] for f in o), i + 1]
                assert (r[0], r[1], r[2], r[4], r[5]) == x and r[3] == sum(m == 1 << o[i] for m, _, _ in rows)
        for f in "ABCDE":
            assert len({r[6] for (p, o, s), r in got.items() if p == part and o[s - 1] == f}) == 1
        assert sum({o[0]: r[6] for (p, o, s), r in got.items() if p == part and s == 1}.values()) == 120 * sum(m > 0 for m, _, _ in rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id string, text string, lang string")
    assert fa.interactions(docs, spark.createDataFrame([], "doc_id string, quality int, toxic int")).count() == 0
