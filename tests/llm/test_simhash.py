"""SimHash fingerprints, links and components against brute force."""

import random
import re

import pytest
import xxhash

from corpuscle.llm import near_copies, simhash
from corpuscle.llm.components import components, lookup


def slow_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps, bits=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


ODD = [None, "", " \t\n ", "one", "One TWO", "one two three", "ÀB\xa0c d\x85e f", "x " * 60000, "a b c d e f g h i j k l m n o p"]


def test_fingerprints():
    assert [int(x) for x in simhash.fingerprint(ODD)] == [slow_fingerprint(t) for t in ODD]


@pytest.mark.parametrize("bits, bucket", [(2, 64), (2, 3), (1, 64), (1, 3), (0, 64)])
def test_components_of_random_values(spark, bits, bucket):
    rng = random.Random(bits)
    fps = {0, -1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            fps.add(x - 2**63)
            y = x
            for _ in range(rng.choice([1, 1, 2, 3])):
                y ^= 1 << rng.choice([rng.randrange(64), rng.randrange(3)])
            fps.add(y - 2**63)
            x = rng.choice([x, y])
    base = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    found = simhash.links(base, bits, bucket)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= bits for r in found.collect())
    got = {r.node: r.root for r in components(found).collect()}
    want = slow_components(sorted(fps), bits)
    sets = lambda of: sorted(sorted(f for f in fps if of[f] == r) for r in set(of.values()))
    assert sets({f: got.get(f, f) for f in fps}) == sets(want)


def test_groups_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "one two three"), (None, None), (7, "one")], "doc_id long, text string")
    both = docs.unionByName(odd).withColumn("fp", docs.doc_id * 0).withColumn("a", docs.doc_id)
    rows = both.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    root = slow_components(sorted(set(fps)))
    least = {}
    for r, f in zip(rows, fps):
        if r.doc_id is not None:
            least[root[f]] = min(least.get(root[f], r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", least[root[f]]) for r, f in zip(rows, fps))
    found = simhash.named(simhash.groups(both)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == want
    kept = simhash.keep_first(both)
    assert kept.columns == both.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values()))


def test_one_row_of_each_group_stays(spark):
    a, b, c = "one text of some words here", "quite another one with other words", "a third text that is like no other"
    rows = [(1, a), (5, a), (5, b), (6, b), (6, b), (7, c), (7, c), (None, a), (8, c), (5, b)]
    docs = spark.createDataFrame([(*r, "k", "m") for r in rows], "doc_id long, text string, key string, component string")
    want = sorted([(1, a), (5, b), (7, c)])
    for keep in (simhash.keep_first, near_copies.keep_first):
        kept = keep(docs)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()) == want
        assert kept.where("doc_id is null").count() == 1


def test_long_chain_and_star(spark):
    chain = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{k: 1000 for k in range(1000, 1100)}}


def test_lookup_of_hot_keys(spark):
    rows = spark.range(9000).selectExpr("id", "if(id < 5000, 1, id % 50) as k")
    table = rows.groupBy("k").count().selectExpr("k", "count as n", "k * 10 as v").where("k <> 7")
    got = lookup(rows, table, "k", "n", 9000).collect()
    assert len(got) == 9000 and all(r.v == (None if r.k == 7 else r.k * 10) for r in got)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(none).count() == 0 and simhash.keep_first(none).count() == 0
