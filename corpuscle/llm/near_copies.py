"""Near-copies by SimHash and by exact set similarity: fingerprints that link as in ``simhash`` (op8), and sets of 5-word shingles with a Jaccard similarity of 0.8 or more.

Fingerprints come first: what links at two or fewer differing bits is one component. Exact similarity follows for what two
bits don't reach, and links of both kinds chain.

Every whole text is a set of shingle hashes (64 bits; words as op8 cuts them, a shorter text is one shingle). Equal sets
are one. Two sets of at least the similarity share a shingle among the first ``n - ceil(similarity * n) + 1`` of each in
any order that all sets keep to, so sets meet by those, and no pair is missed whatever the order is. The order puts
shingles last that are frequent in a sample of documents, so that few meet that have only those in common, and goes by
hashes otherwise. Candidates are first held against signatures, the parities of a set's hashes in a few places for each
of them: two sets differ in at least as many shingles as their parities do, so what that rules out is no pair. The others
are verified by the whole sets.

The shingles before the first one that two sets share are in one of both only, so pairs with more of them than alike
sets may differ in aren't candidates. Two sets that had the same shingle just before have met there, so a pair is sent once
for each run of shingles that both have, not for each shingle. A place with up to ``BUCKET`` sets sends all
pairs left. A larger one first sends chains and the pairs with its hubs, the sets that crowd most, which connect it where
its sets are alike; then the pairs follow that these left in different components, so links are whole there too.

Null and empty texts are one group. Null and repeated ids are taken as in ``simhash``. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, lookup
from .simhash import fingerprint, first_of
from .simhash import links as bit_links

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Sets of one meeting place that are paired at once; a set of a larger place is a row and two pairs at most.
BUCKET = 16
#: Sets of a larger place that all others there are paired with.
HUBS = 4
#: Shingles that a worker holds at a time.
HELD = 200_000
#: Integers of 64 parities each that a crowded place's rows carry.
LONGS = 8
#: Documents in the sample, the number of those that make a shingle frequent, and the frequent shingles that are kept at most.
SAMPLE, FREQUENT, MOST = 20_000, 3, 100_000


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The text's set of shingle hashes, ascending."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    grams = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    data = b"".join(map(partial(xxhash.xxh64_digest, seed=SEED), map(b" ".join, grams)))
    return np.unique(np.frombuffer(data, ">i8").astype(np.int64))


def key_of(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64))


def prefix(found: np.ndarray, frequent: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The shingles by which a set meets those of at least the similarity; ``frequent`` ones, ascending, go last."""
    n = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
    if len(frequent) and len(found):
        last = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found
        found = np.concatenate((found[~last], found[last]))
    return found[:n]


def parities(found: np.ndarray) -> bytes:
    """Whether an odd number of hashes falls into each place; there are at least twice as many places as hashes."""
    places = max(64, 1 << (2 * len(found)).bit_length())
    return np.packbits(np.bincount(found & (places - 1), minlength=places).astype(np.uint8) & 1).tobytes()


def short_parities(found: np.ndarray) -> list[int]:
    """The parities in ``64 * LONGS`` places for sets of any size, as signed integers."""
    odd = np.bincount(found & (64 * LONGS - 1), minlength=64 * LONGS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).tolist()


def least_difference(x: bytes, y: bytes) -> int:
    """A number of shingles in which two sets differ at least; the longer signature is folded to the shorter one's places."""
    if len(x) < len(y):
        x, y = y, x
    a = int.from_bytes(y, "big")
    for k in range(0, len(x), len(y)):
        a ^= int.from_bytes(x[k : k + len(y)], "big")
    return a.bit_count()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and sets of some rows (doc_id, text) at a time: up to ``HELD`` shingles, or one row that alone has more."""
    for batch in batches:
        sets, held, since = [], 0, 0
        for row, text in enumerate(batch.column(1)):
            sets.append(shingles(text.as_py()))
            held += len(sets[-1])
            if held >= HELD or row == len(batch) - 1:
                yield batch.column(0).slice(since, len(sets)), sets
                sets, held, since = [], 0, row + 1


def _frequent(docs: DataFrame, sample: int) -> np.ndarray:
    """Shingles of several documents of a sample; only the order depends on them."""
    part = _texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, math.ceil(docs.count() / sample)))) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches):
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["s", "n"])

    counts = part.mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["s"] for r in counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(MOST).collect()), np.int64)


def _prefixes(docs: DataFrame, similarity: float, frequent: np.ndarray) -> DataFrame:
    """(doc_id, key, size, prefix, sign, short, fp) of each document's set; ``fp`` is the text's fingerprint."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, at = fingerprint(batch.column(1).to_pylist()).view(np.int64), 0
            for keys, sets in _sets(iter([batch])):
                columns = [pa.array([key_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([prefix(s, shared.value, similarity) for s in sets], pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.binary()), pa.array([short_parities(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([keys, *columns, pa.array(prints[at : at + len(sets)])], ["doc_id", "key", "size", "prefix", "sign", "short", "fp"])
                at += len(sets)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs).mapInArrow(run, f"doc_id {kind}, key long, size long, prefix array<long>, sign binary, short array<long>, fp long")


def _meet(similarity: float, bucket: int):
    """Over rows (s, size, key, at, prev) sorted by the first three: pairs (a, b), and (a, null, size, s, at) for the sets of a crowded place."""
    share = (1 - similarity) / (1 + similarity)

    def placed(rows):
        s, sizes, keys, at, prev = rows
        n = len(keys)
        if n <= bucket:
            i, k = np.triu_indices(n, 1)
            near = (at[i] + at[k] <= share * (sizes[i] + sizes[k]) + 1e-6) & ~((prev[i] == prev[k]) & (at[i] > 0) & (at[k] > 0))
        else:
            # each with the next and with the first that may still be alike
            first = np.searchsorted(sizes, similarity * sizes - 1e-9)
            i, k = np.concatenate((np.arange(n - 1), first)), np.concatenate((np.arange(1, n), np.arange(n)))
            near = i != k
        near &= sizes[i] >= similarity * sizes[k] - 1e-9
        a, b = keys[i[near]], keys[k[near]]
        nothing = np.full(len(a), -1)
        if n > bucket:
            yield np.stack((keys, keys, sizes, s, at))
        yield np.stack((np.minimum(a, b), np.maximum(a, b), nothing, nothing, nothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)

        def sent(rows, ends):
            out = [p for k in ends for p in placed(rows[:, k[0] : k[1]])]
            if out:
                a, b, size, s, at = np.concatenate(out, axis=1)
                crowd = size >= 0
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=crowd), *(pa.array(x, mask=~crowd) for x in (size, s, at))], ["a", "b", "size", "s", "at"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns])), axis=1)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(rows[0])) + 1))
            yield from sent(rows, [(cuts[k], cuts[k + 1]) for k in np.flatnonzero(np.diff(cuts) > 1)])
            held = rows[:, cuts[-1] :]
        if held.shape[1] > 1:
            yield from sent(held, [(0, held.shape[1])])

    return run


def _alike_sizes(a: str, b: str, similarity: float):
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9


def _by_hubs(crowd: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of each set of a crowded place with its ``HUBS`` hubs, the sets that crowd most: those of fewest edits."""
    crowded = crowd.join(crowd.groupBy("s").agg(F.count("*").alias("_n")), "s")
    score = crowded.groupBy("key").agg(F.sum("_n").alias("score"))
    scored = common.stored(crowd.join(score, "key"), "crowd-scores")
    hubs = None
    for _ in range(HUBS):
        left = scored if hubs is None else scored.join(hubs.select("s", F.col("hub").alias("key")), ["s", "key"], "left_anti")
        best = left.groupBy("s").agg(F.max_by(F.struct("key", "size"), F.struct("score", "key")).alias("_best")).select("s", F.col("_best.key").alias("hub"), F.col("_best.size").alias("_size"))
        hubs = common.stored(best if hubs is None else hubs.unionByName(best), "hubs")
    pairs = scored.join(hubs, "s").where("key <> hub").where(_alike_sizes("size", "_size", similarity))
    return pairs.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()


def _left_pairs(named: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of crowded places (s, key, size, at, root, short) that may be alike and have different roots.

    What a set has before the first shingle that it shares with another, the other doesn't have. So of two alike ones
    at least one is light there: it has few shingles before. Parities rule out most others in the join itself. A place's largest component is not paired with itself.
    """
    share = (1 - similarity) / (1 + similarity)
    sizes = named.groupBy("s", "root").agg(F.count("*").alias("_n"))
    most = sizes.groupBy("s").agg(F.max_by("root", F.struct("_n", "root")).alias("_most"))
    parts = [F.get("short", F.lit(k)).alias(f"p{k}") for k in range(LONGS)]
    rows = common.stored(named.join(most, "s").select("s", "key", "size", "at", "root", *parts, (F.col("root") == F.col("_most")).alias("big"), (F.col("at") <= F.lit(share) * F.col("size") + 1e-6).alias("light")), "crowd-rows")
    a, b = (rows.select("s", *(F.col(c).alias(f"{c}_{x}") for c in ("key", "size", "at", "root", "big", "light", *(f"p{k}" for k in range(LONGS))))) for x in "ab")
    most = F.lit(share) * (F.col("size_a") + F.col("size_b")) + 1e-6
    odd = sum(F.bit_count(F.col(f"p{k}_a").bitwiseXOR(F.col(f"p{k}_b"))) for k in range(LONGS))
    near = _alike_sizes("size_a", "size_b", similarity) & (F.col("at_a") + F.col("at_b") <= most) & (odd <= most)
    out = None
    # small with small, once; small with big; one of both is light
    for left, right, once in ((a.where("not big_a and light_a"), b.where("not big_b"), True), (a.where("not big_a and light_a"), b.where("big_b"), False), (a.where("not big_a and not light_a"), b.where("big_b and light_b"), False)):
        condition = near & (F.col("root_a") != F.col("root_b"))
        if once:
            condition = condition & (~F.col("light_b") | (F.col("key_a") < F.col("key_b")))
        found = left.join(right, "s").where(condition).select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))
        out = found if out is None else out.unionByName(found)
    return out


def _verified(docs: DataFrame, pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of at least the similarity, by the whole sets."""
    share = (1 - similarity) / (1 + similarity)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.add(batch.column(2).to_numpy(), batch.column(3).to_numpy()) * share + 1e-6
            found = [least_difference(x, y) <= t for x, y, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), total.tolist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(found, pa.bool_()))

    a, b = (distinct.select(F.col("key").alias(c), F.col("size").alias("_n" + c), F.col("sign").alias("_s" + c)) for c in "ab")
    signed = pairs.distinct().join(a, "a").join(b, "b").select("a", "b", "_na", "_nb", "_sa", "_sb")
    pairs = common.stored(signed.mapInArrow(possible, "a long, b long"), "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ids = distinct.join(wanted, "key", "left_semi").select(F.col("least").alias("_least")).distinct()
    kept = _texts(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array([key_of(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "found"])

    sets = common.stored(kept.mapInArrow(run, "key long, found array<long>").join(wanted, "key", "left_semi").dropDuplicates(["key"]), "sets")
    a, b = (sets.select(F.col("key").alias(c), F.col("found").alias("_" + c)) for c in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("_a", "_b")))
    alike = F.col("common") / (F.size("_a") + F.size("_b") - F.col("common")) >= similarity
    return common.stored(both.where(alike).select("a", "b"), "alike")


def _by_bits(found: DataFrame) -> DataFrame:
    """Links (a, b) between the sets (key, fp) whose fingerprints op8 puts into one component: each with the component's smallest."""
    prints = common.stored(found.select("key", "fp").distinct(), "prints")
    roots = components(bit_links(prints.select("fp").distinct())).withColumnRenamed("node", "fp")
    named = common.stored(prints.join(roots, "fp", "left").select("key", F.coalesce("root", "fp").alias("root")).distinct(), "print-roots")
    least = named.groupBy("root").agg(F.min("key").alias("a"), F.count("*").alias("n"))
    linked = lookup(named, least, "root", "n", named.count(), "inner").where("a <> key")
    return common.stored(linked.select("a", F.col("key").alias("b")), "bit-links")


def groups(docs: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, key, component_id): the text's key, and component_id is the smallest id that near-copies reach from the document, itself included."""
    path = common.fresh_dir(docs.sparkSession, "prefixes")
    _prefixes(docs, similarity, _frequent(docs, sample)).write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    rows = common.stored(found.select("doc_id", "key", "fp"), "keys")
    distinct = common.stored(found.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("sign").alias("sign"), F.first("short").alias("short")), "distinct")
    common.delete(docs.sparkSession, path)
    by_bits = _by_bits(rows)
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("prefix", 1, F.greatest(F.size("prefix") - 1, F.lit(0))))
    places = distinct.where(F.size("prefix") > 0).select(F.posexplode(F.arrays_zip(F.col("prefix").alias("s"), before.alias("prev"))).alias("at", "_x"), "size", "key")
    places = places.select("_x.s", "size", "key", F.col("at").cast("long").alias("at"), "_x.prev")
    places = places.repartition("s").sortWithinPartitions("s", "size", "key")
    met = common.stored(places.mapInArrow(_meet(similarity, bucket), "a long, b long, size long, s long, at long"), "met")
    links = by_bits.unionByName(_verified(docs, met.where("b is not null").select("a", "b"), distinct, similarity))
    crowd = met.where("b is null").select("s", F.col("a").alias("key"), "size", "at")
    if not crowd.isEmpty():
        links = common.stored(links.unionByName(_verified(docs, _by_hubs(crowd, similarity), distinct, similarity)), "links")
        roots = components(links).withColumnRenamed("node", "key")
        named = crowd.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        split = named.groupBy("s").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("s")
        named = common.stored(named.join(split, "s", "left_semi").join(distinct.select("key", "short"), "key"), "crowds")
        rest = _left_pairs(named, similarity)
        links = links.unionByName(_verified(docs, rest, distinct, similarity))
    roots = components(links)
    table = common.stored(distinct.select("key", "least", "copies").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "roots")
    least = table.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = lookup(table.select("key", "root", "copies"), least, "root", "members", distinct.count()).select("key", "component_id", "copies")
    return lookup(rows.drop("fp"), named, "key", "copies", rows.count()).select("doc_id", "key", "component_id")


def keep_first(docs: DataFrame, **parameters) -> DataFrame:
    """The rows that stay: of each group the one with the smallest id; see ``simhash.first_of``."""
    return first_of(docs, groups(docs, **parameters), lambda texts: [key_of(shingles(t)) for t in texts])
