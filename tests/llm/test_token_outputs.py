"""ORC token store and packing against plain encoding."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import packing, token_store
from corpuscle.llm.tokens import default_path, encoder

ODD = [None, "", "  \n ", "İstanbul ΣΑΣ don't it's 12a ² <|endoftext|>x éa a\x1cb", "the " * 9000, "Same. Text!", "Same. Text!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", k) for k, t in enumerate(ODD)] + [(None, "no id", "x", 0), (3, "an id again", "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, position int")


def plain(text, end):
    return [*encoder(default_path()).library.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_memo_equals_library(sf):
    texts = pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() + ODD[1:]
    e = encoder(default_path())
    assert all(e.encode(t) == e.whole(t) for t in texts)


def test_store_round_trip(spark, docs):
    got = token_store.digests(spark, docs, default_path()).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted((False, d, len(i), crc(i)) for d, i in ((r.doc_id, plain(r.text, 2)) for r in rows) if d is not None)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, 4, 5, 6]
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]


def test_store_prunes_by_id(spark, docs, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write(docs, path, default_path())
    found = token_store.read(spark, path).where("doc_id = 4")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4)]" in found._jdf.queryExecution().toString()
    assert found.head().ids == plain(ODD[4], 2)


def scanned(df):
    """Rows that the scan of ``df`` gives once it has skipped stripes and row groups."""
    rows = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return rows, sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_stripes_and_row_groups_are_skipped(spark, tmp_path):
    from pyarrow import orc

    path = f"file://{tmp_path}/store"
    rows = spark.range(0, 12_000, 2, 1).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 60), i -> concat('w', hash(id, i)))) as text")
    token_store.write(rows.coalesce(1), path, default_path(), stripe_bytes=100_000)
    files = sorted(tmp_path.glob("store/*.orc"))
    stripes = [orc.ORCFile(str(f)).nstripes for f in files]
    assert max(stripes) > 1
    store = token_store.read(spark, path)
    got, n = scanned(store.where("doc_id = 5000"))
    assert [r.doc_id for r in got] == [5000] and n <= token_store.ROW_GROUP
    # an odd id is inside a row group's range, but not in its Bloom filter
    assert sum(scanned(store.where(f"doc_id = {k}"))[1] for k in range(5001, 5041, 2)) <= 2 * token_store.ROW_GROUP
    first = store.agg(F.min("position")).head()[0]
    assert scanned(store.where(f"position = {first}"))[1] <= token_store.ROW_GROUP


def test_many_rows_of_one_id(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).selectExpr("7L as doc_id", "concat('text ', id) as text")
    path = f"file://{tmp_path}/store"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the test's partitions are tiny
    try:
        token_store.write(rows, path, default_path())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in token_store.read(spark, path).groupBy(F.shiftright("position", 33).alias("file")).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_first_fit_decreasing_equals_plain():
    rng = random.Random(1)
    for n in (1, 2, 5, 300):
        sizes, free, want = [rng.randint(1, 100) for _ in range(n)], [], {}
        for k in sorted(range(n), key=lambda i: -sizes[i]):
            b = next((b for b, f in enumerate(free) if f >= sizes[k]), len(free))
            if b == len(free):
                free.append(100)
            want[k] = (b, 100 - free[b])
            free[b] -= sizes[k]
        assert packing.first_fit_decreasing(sizes, 100) == [want[k] for k in range(n)]


def check_packing(rows, docs):
    want = sorted((str(r.doc_id), len(i), crc(i)) for r, i in ((r, plain(r.text, 1)) for r in docs))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 2048
    assert sum(r.length for r in rows) == sum(n for _, n, _ in want)
    return by_doc, by_sequence


def test_packing_whole_and_tight(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = packing.pack(docs, default_path()).collect()
    by_doc, by_sequence = check_packing(packed, docs.collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for (doc, n), pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert sum((r.ids for r in pieces), []) == plain(texts[int(doc)], 1)
    assert sum(r.length for r in packed) > 0.97 * 2048 * len(by_sequence)
    digests = {(r.doc_id, r.start): r for r in packing.digests(docs, default_path()).collect()}
    assert all(digests[r.doc_id, r.start].ids_crc32 == crc(r.ids) and digests[r.doc_id, r.start].sequence_id == r.sequence_id for r in packed)


def test_packing_odd_rows(spark, docs, monkeypatch):
    rows = packing.pack(docs, default_path()).collect()
    check_packing(rows, docs.collect())
    copies = docs.where("doc_id = 6").crossJoin(spark.range(50)).repartition(3)
    monkeypatch.setattr(packing, "GROUP_PIECES", 8)
    check_packing(packing.pack(copies, default_path()).collect(), copies.collect())


def test_equal_rows_go_to_many_groups(spark):
    rows = spark.range(0, 8000, 1, 4).selectExpr("7 as doc_id", "'the same text of some words' as text")
    got = packing.pack(rows, default_path(), groups=16, digest=True)
    assert got.select(F.shiftright("sequence_id", 36).alias("g")).groupBy("g").count().where("count > 1500").count() == 0
    assert got.count() == 8000


def test_full_pieces_are_not_shuffled(spark, tmp_path):
    rows = spark.createDataFrame([(k, " ".join(f"w{j}x{k}" for j in range(9000))) for k in range(6)], "doc_id long, text string")
    plain_rows = packing.pack(rows, default_path())
    got, digests = plain_rows.collect(), {(r.doc_id, r.start): r for r in packing.digests(rows, default_path()).collect()}
    assert sum(r.length == 2048 for r in got) > 10 and all((r.sequence_id < 0) == (r.length == 2048) for r in got)
    assert len({r.sequence_id for r in got if r.sequence_id < 0}) == sum(r.length == 2048 for r in got)
    assert all(digests[r.doc_id, r.start].ids_crc32 == crc(r.ids) and digests[r.doc_id, r.start].sequence_id == r.sequence_id for r in got)


def test_empty(spark, docs):
    none = docs.where("false")
    assert token_store.digests(spark, none, default_path()).count() == 0
    assert packing.pack(none, default_path()).count() == 0
