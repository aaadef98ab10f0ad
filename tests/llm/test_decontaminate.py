"""Seeds and alignment against plain dynamic programming and planted copies."""

import random

import pytest

from corpuscle.llm import decontaminate as dc

VOCABULARY = [f"w{k}x" for k in range(400)]


def slow_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best / (2 * len(a)) if a and b else 0.0


def test_alignment():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        score, first, last = dc.align(a, b)
        assert score == slow_align(a, b)
        if score:
            assert slow_align(a, b[first:last]) == score


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    text = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = [text(40) for _ in range(12)] + [["short", "one"], []]
    docs, want = [], set()
    for d in range(120):
        ws = text(rng.choice([0, 3, 60, 400]))
        if d % 3 == 0:
            i = rng.randrange(12)
            copy = list(items[i])
            if d % 2:  # edited: some words changed, some left out, some put in
                for k in sorted(rng.sample(range(len(copy)), 6), reverse=True):
                    copy[k : k + 1] = rng.choice([[], ["edited"], [copy[k], "more"]])
            at = rng.randint(0, len(ws))
            ws[at:at] = [w.upper() + "," for w in copy]
            want.add((d, i))
        docs.append((d, " ".join(ws), "x", 0))
    docs += [(None, " ".join(items[0]), "x", 0), (300, None, "x", 0), (301, "word " * 50000 + " ".join(items[1]), "x", 0), (301, " ".join(items[1]), "x", 0)]
    want |= {(None, 0), (301, 1)}
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string, score int")
    return frame, spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(99, None), (None, "a b c d")], "item_id long, text string"), want


@pytest.mark.parametrize("exact, bits", [(dc.EXACT, dc.BITS), (0, 27), (0, 8)])
def test_finds_copies_and_nothing_else(planted, exact, bits):
    docs, items, want = planted
    found = dc.search(docs, items, exact=exact, bits=bits).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in found) == sorted((str(d), i) for d, i in want)
    assert all(0.5 <= r.score <= 1 for r in found)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(dc.words(r.text))
    assert all(any(" ".join(t[r.first_word : r.last_word + 1]) == r.passage for t in texts[r.doc_id]) for r in found)


def test_keeps_clean_documents(planted):
    docs, items, want = planted
    kept = dc.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id is not None and r.doc_id not in {d for d, _ in want})


def test_rows_are_judged_by_their_own_texts(spark, planted):
    _, items, _ = planted
    copy = items.where("item_id = 0").head().text
    rows = [(None, "a clean text"), (None, copy), (7, "another clean text"), (7, copy), (8, "clean"), (8, "clean")]
    docs = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, hash int, _found string")
    kept = dc.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.hash for r in kept.collect()) == [0, 2, 4, 5]


@pytest.mark.parametrize("share", [0.01, 0.1, 0.3, 0.6, 0.9])
def test_frequent_copies(spark, share):
    """However many documents hold a copy, all of them are found."""
    rng = random.Random(int(share * 100))
    copy = "the quick answer depends upon seven green turtles"
    docs = [" ".join(rng.choice(VOCABULARY) for _ in range(40)) + (" " + copy if rng.random() < share else "") for _ in range(2000)]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = dc.search(frame, spark.createDataFrame([("mmlu-1", copy)], "item_id string, text string")).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in found} == {(d, "mmlu-1", 1.0) for d, t in enumerate(docs) if copy in t}


def test_small_tables_and_text_ids(spark):
    copy = "what is the capital of the largest country"
    docs = spark.createDataFrame([("a", "some text"), ("b", f"see {copy}?"), ("c", copy), ("d", "the capital of it"), (None, None)], "doc_id string, text string")
    items = spark.createDataFrame([("x-1", copy), ("x-1", copy), ("x-2", copy.upper() + "!"), (None, copy)], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in dc.search(docs, items).collect()} == {(d, i) for d in "bc" for i in ("x-1", "x-2", None)}
    assert sorted(str(r.doc_id) for r in dc.keep_clean(docs, items).collect()) == ["None", "a", "d"]


def test_templates_make_no_pairs(spark, monkeypatch):
    """Items and documents that have only a template in common don't meet."""
    rng = random.Random(8)
    text = lambda n, k: " ".join(f"w{rng.randrange(4000)}{k}" for _ in range(n))
    items = [f"choose the correct {text(12, 'i')}" for _ in range(300)]
    docs = [f"choose the correct {text(12, 'd')}" for _ in range(300)] + [f"we {items[5]} so", " ".join(items)]
    rows, stored = [], dc.common.stored

    def counted(df, name):
        out = stored(df, name)
        if name in ("document-items", "near-places"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(dc.common, "stored", counted)
    frames = [spark.createDataFrame(list(enumerate(x)), f"{name} long, text string") for x, name in ((docs, "doc_id"), (items, "item_id"))]
    found = {(r.doc_id, r.item_id) for r in dc.search(*frames).collect()}
    assert found == {(300, 5), *((301, k) for k in range(300))} and max(rows) < 8000


def test_repetitive_items(spark):
    docs = spark.createDataFrame([(1, "so " * 20_000), (2, "a b c " * 3000), (3, "nothing else")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "so " * 500), (2, "a b c " * 200)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.search(docs, items).collect()} == {(1, 1), (2, 2)}


@pytest.mark.parametrize("edits", [0.05, 0.15, 0.25])
def test_recall_against_plain_alignment(spark, edits):
    """Every item aligned with every whole document finds hardly more than what the seeds lead to."""
    rng = random.Random(int(edits * 100))
    item = [[rng.choice(VOCABULARY) for _ in range(rng.randint(3, 50))] for _ in range(25)]
    docs = []
    for _ in range(60):
        ws = [rng.choice(VOCABULARY) for _ in range(rng.randint(0, 120))]
        copy = list(rng.choice(item))
        for k in range(len(copy) - 1, -1, -1):
            if rng.random() < edits:
                copy[k : k + 1] = rng.choice([[], ["edited"], [copy[k], "more"], [rng.choice(VOCABULARY)]])
        at = rng.randint(0, len(ws))
        ws[at:at] = copy
        docs.append(ws)
    want = {(d, i) for d, ws in enumerate(docs) for i, x in enumerate(item) if dc.align(x, ws)[0] >= dc.SCORE}
    frames = [spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], f"{name} long, text string") for rows, name in ((docs, "doc_id"), (item, "item_id"))]
    got = {(r.doc_id, r.item_id) for r in dc.search(*frames).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 40


def test_short_and_repeated_items(spark):
    common = "some words that fill the text of this document up "
    docs = spark.createDataFrame([(k, common * 200) for k in range(6)] + [(10, common + "Xylophone " + common), (11, common + "red zebra, " + common), (12, common + "zebra red"), (13, "this document")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "xylophone"), (2, "Red zebra"), (2, "of this document up xylophone"), (None, "red zebra some words"), (4, "words"), (5, "")], "item_id long, text string")
    got = sorted((r.doc_id, str(r.item_id), r.passage) for r in dc.search(docs, items, rare=1e-5).collect())
    assert got == [(10, "1", "xylophone"), (10, "2", "of this document up xylophone"), (11, "2", "red zebra"), (11, "None", "red zebra some words"), *[x for x in got if x[1] == "None" and x[0] != 11]] and ("4" not in {g[1] for g in got})


def test_empty(spark, planted):
    docs, items, _ = planted
    assert dc.search(docs.where("false"), items).count() == 0
    assert dc.search(docs, items.where("false")).count() == 0
