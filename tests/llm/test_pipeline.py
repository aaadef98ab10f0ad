"""The pipeline's stages, each on what the one before kept, against plain Python where it can be said."""

import corpus_pipeline
import pytest
from test_line_dedup import slow
from test_near_copies import slow_groups

from corpuscle.llm import common, decontaminate
from corpuscle.llm.tokens import default_path, encoder


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = common.read(spark, sf, "documents"), []
    out.append(docs.orderBy("doc_id").collect())
    for name, f in corpus_pipeline.STAGES:
        docs = common.stored(f(spark, docs, sf), "test-" + name)
        if name != "packing":
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        out.append(docs.orderBy("doc_id").collect())
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]


def test_toxic_documents_go(spark, sf, stages):
    toxic = {r.doc_id for r in common.read(spark, sf, "labels").where("toxic = 1").collect()}
    kept = {r.doc_id for r in stages[1]}
    gone = {r.doc_id for r in stages[0]} - kept
    assert len(gone & toxic) >= 0.5 * len(toxic) and len(gone - toxic) <= 0.1 * len(stages[0])


def test_lines(stages):
    assert [r.text for r in stages[2]] == slow([r.text for r in stages[1]])
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_copies(stages):
    rows = sorted(stages[2], key=lambda r: r.doc_id)
    root = slow_groups([r.text for r in rows])
    assert [r.doc_id for r in stages[3]] == [r.doc_id for k, r in enumerate(rows) if root[k] == k]


def test_benchmark(spark, sf, stages):
    items = [decontaminate.words(r.text) for r in common.read(spark, sf, "benchmark").collect()]
    holds = lambda text: any(" ".join(i) in text for i in items if len(i) >= 4)
    gone = {r.doc_id for r in stages[3]} - {r.doc_id for r in stages[4]}
    whole = {r.doc_id for r in stages[3] if holds(" ".join(decontaminate.words(r.text)))}
    assert whole <= gone and len(gone - whole) <= 0.02 * len(stages[3])


def test_packing(stages):
    e = encoder(default_path())
    want = sum(len(e.encode(r.text)) // 4 + 1 for r in stages[4])
    assert sum(r.length for r in stages[5]) == want and {r.doc_id for r in stages[5]} == {r.doc_id for r in stages[4]}


def test_run(spark, sf, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, stages[5]))
