"""SimHash near-duplicates by deletion-variant signatures.

``fingerprints`` gives each whole text a 64-bit SimHash of its 3-word shingles. Two fingerprints link at two or fewer
differing bits. For that, a fingerprint is cut into two 32-bit segments: of two differing bits at most one can fall
into the better segment. So each fingerprint is indexed under its 64 one-wildcard segment variants (a segment with one
bit deleted, and which), fingerprints with an equal variant meet, and full comparison verifies them. The
work is on distinct fingerprints; copies share one.

Meeting places stream past in sorted order. One with up to ``BUCKET`` fingerprints is verified pair by pair at once,
and only links that connect something new there are sent on. The fingerprints of a larger one are not paired: they go
to an exact second way, in which each is listed under all 65 values at one or no bit from it, since two values
differ in at most two bits exactly if they share such a value. Its cost is 65 rows a fingerprint, however large the
group is.

Null and empty texts have fingerprint zero and link like any other. Rows with a null id take part, and a group of
null ids only has a null component. Repeated ids are documents of their own that share an id. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components, lookup

SHINGLE, SEED, BITS = 3, 42, 2
#: Fingerprints of one meeting place that are compared pair by pair.
BUCKET = 64
#: Hashes that are unpacked to bits at a time.
BLOCK = 200_000


def fingerprint(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """SimHash of each text, as unsigned 64-bit integers."""
    import xxhash

    digest = partial(xxhash.xxh64_digest, seed=seed)
    ones, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, owner, many = [], [], 0

    def count():
        bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8)).reshape(-1, 64)
        cuts = np.cumsum([0] + [len(h) // 8 for h in held[:-1]])
        np.add.at(ones, owner, np.add.reduceat(bits, cuts, axis=0, dtype=np.int64))

    for row, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        grams = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
        sizes[row] = max(1, len(words) - shingle + 1)
        data = b"".join(map(digest, map(b" ".join, grams)))
        for at in range(0, len(data), 8 * BLOCK):
            held.append(data[at : at + 8 * BLOCK])
            owner.append(row)
            many += len(held[-1]) // 8
            if many >= BLOCK:
                count()
                held, owner, many = [], [], 0
    if held:
        count()
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprint(batch.column(1).to_pylist(), shingle, seed).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard segment variants; the key holds segment, deleted bit and the 31 bits left."""

    half = ("(fp & 4294967295L)", "shiftrightunsigned(fp, 32)")
    keys = F.array(*(F.expr(f"shiftleft({half[i // 32]} & {0xFFFFFFFF & ~(1 << i % 32)}L, 6) | {i}L") for i in range(64)))
    return fps.select(F.explode(keys).alias("key"), "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _linked(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what is within ``bits`` in one small meeting place: as few as do."""
    near = _popcount(fps[:, None] ^ fps[None, :]) <= bits
    left, out = set(range(len(fps))), []
    while left:
        top = left.pop()
        stack = [top]
        while stack:
            at = stack.pop()
            for to in [k for k in left if near[at, k]]:
                left.discard(to)
                stack.append(to)
                out.append((at, to))
    return out


def _meet(bits: int, bucket: int):
    """Over rows (key, fp) sorted by key: (a, b) that link, and (a, null) for those of a place too large for pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, members, large = None, np.zeros(0, np.int64), False

        def closed(key_runs):
            a, b, alone = [], [], []
            for fps in key_runs:
                if len(fps) == 2:
                    if _popcount(fps[:1] ^ fps[1:])[0] <= bits:
                        a.append(int(fps[0]))
                        b.append(int(fps[1]))
                else:
                    for i, k in _linked(fps, bits):
                        a.append(int(fps[i]))
                        b.append(int(fps[k]))
            return a, b

        def sent(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            edges = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            runs, several = [], np.diff(edges) > 1
            several[[0, -1]] = True  # the first may go on from the last batch, the last into the next one
            for k in np.flatnonzero(several).tolist():
                part = fps[edges[k] : edges[k + 1]]
                if keys[edges[k]] == open_key:
                    members = np.concatenate((members, part))
                else:
                    if not large and len(members) > 1:
                        runs.append(members)
                    open_key, members, large = keys[edges[k]], part, False
                if large or len(members) > bucket:
                    large = True
                    yield sent(members.tolist(), [None] * len(members))
                    members = np.zeros(0, np.int64)
            if runs:
                yield sent(*closed(runs))
        if not large and len(members) > 1:
            yield sent(*closed([members]))

    return run


def links(fps: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) between distinct fingerprints: enough links to connect all that are within ``bits``; ``bits`` is 2 at most."""
    if not 0 <= bits <= 2:
        raise ValueError("two segments with one wildcard find two differing bits at most")
    met = variants(fps).repartition("key").sortWithinPartitions("key").mapInArrow(_meet(bits, bucket), "a long, b long")
    met = common.stored(met, "links")
    found = met.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    crowd = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    return found.unionByName(_by_balls(crowd, bits))


def _by_balls(fps: DataFrame, bits: int) -> DataFrame:
    """Links without pairs: two values differ in two bits at most exactly if one value is within one bit of both."""
    if bits < 2:
        # within one bit: equal once one bit is deleted
        hubs = F.array(*(F.struct(F.lit(i).alias("i"), F.expr(f"fp & ~shiftleft(1L, {i})").alias("z")) for i in range(64 if bits else 0)))
    else:
        hubs = F.array(*(F.struct(F.lit(0).alias("i"), F.expr("fp" if i == 64 else f"fp ^ shiftleft(1L, {i})").alias("z")) for i in range(65)))
    if bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    listed = fps.select("fp", F.explode(hubs).alias("hub")).select("fp", "hub.i", "hub.z")
    least = listed.groupBy("i", "z").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1").drop("n")
    return listed.join(least, ["i", "z"]).where("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b")).distinct()


def groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id that links reach from the document, itself included."""
    rows = common.stored(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    roots = components(links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    table = common.stored(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = table.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = lookup(table.select("fp", "root", "copies"), least, "root", "members", distinct.count()).select("fp", "component_id", "copies")
    return lookup(rows, named, "fp", "copies", rows.count())


def keep_first(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """The rows that stay: of each group the one with the smallest id; see ``first_of``."""
    found = groups(docs, shingle, seed, bits).withColumnRenamed("fp", "key")
    return first_of(docs, found, lambda texts: fingerprint(texts, shingle, seed).view(np.int64).tolist())


def first_of(docs: DataFrame, grouped: DataFrame, keys: Callable[[list[str | None]], list[int]]) -> DataFrame:
    """One row of each group: the one with its smallest id, which is its ``component_id``. Rows with null ids all stay.

    ``grouped`` is (doc_id, key, component_id), with the number that ``keys`` gives a text. Where rows share an id,
    each is judged by its own text: of those in a group whose smallest id it is, one row stays, that of the smallest
    key and hash of the row.
    """
    first = common.stored(grouped.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    named = docs.where("doc_id is not null")
    repeated = common.stored(grouped.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    kept = named.join(first.select("doc_id").join(repeated, "doc_id", "left_anti"), "doc_id", "left_semi")
    if not repeated.isEmpty():
        kept = kept.unionByName(_first_rows(named.join(repeated, "doc_id", "left_semi"), grouped.join(repeated, "doc_id", "left_semi"), keys))
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def _first_rows(rows: DataFrame, grouped: DataFrame, keys) -> DataFrame:
    """``first_of`` for rows that share ids."""

    @F.pandas_udf("long")
    def key_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(keys(texts.tolist()), dtype="int64")

    key, print_, to = (common.free_name(rows, x) for x in ("key", "row_hash", "component"))
    hashed = [c for c in rows.columns if not isinstance(rows.schema[c].dataType, T.MapType)]
    rows = common.stored(rows.withColumn(key, key_of(F.col("text").cast("string"))).withColumn(print_, F.xxhash64(*hashed)), "rows-of-repeated-ids")
    group = grouped.select("doc_id", F.col("key").alias(key), F.col("component_id").alias(to)).distinct().where(F.col("doc_id") == F.col(to)).drop(to)
    mine = rows.join(group, ["doc_id", key])
    least = mine.groupBy("doc_id").agg(F.min(F.struct(key, print_)).alias("_least")).select("doc_id", F.col(f"_least.{key}").alias(key), F.col(f"_least.{print_}").alias(print_))
    return mine.join(least, ["doc_id", key, print_], "left_semi").dropDuplicates(["doc_id"]).drop(key, print_)


def named(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
