"""Benchmark decontamination: rare n-gram seeds join passages to test items, then Smith-Waterman alignment.

Whole texts are cut into words (letters, digits and underscores, in lower case). A test item's seeds are its 3-word
grams; an item of one or two words is a seed as a whole. One pass over the documents, whatever the size of the benchmark,
gives the places of grams that the benchmark has, and counts its words over all documents. A gram is rare if chance would
give it less than ``RARE`` times a word by those counts (an item of one word, if less than ``RARE_WORD`` of all words
are that word); words of full copies of items of five words or more don't count, so that frequent copies don't hide themselves. Seeds
that lead from documents to items are an item's rare grams, and the half of its grams (four at least) that has the fewest
places in documents, rare or not: however small a corpus is, some of an item's grams are its rarest. Grams of over ``MANY``
items, such as those of a common template, count for nothing, unless an item has no others.

For the pairs that seeds find, the items' other grams are looked up in the same places. A passage in which an item
has some of its grams close together, a seed among them, is cut out of its document: ``seeds`` different ones if one is rare
(one rare one in items of up to ``SHORT`` words), else a quarter of the item's, three at least or all it has, in items of five
words or more. It is aligned with the item word by word (match 2, mismatch and gap -1); an item whose alignment reaches
``score`` of what a perfect copy has is found, be it copied, edited or shortened. Joins deal out hot grams and hot items,
so a passage that a third of all documents have is no hot key.

What is broadcast tells which words and grams are worth a row: all hashes as they are up to ``EXACT`` of them (16 MB),
beyond that one bit for each in ``1 << BITS`` bits (16 MB); what chance lets through then falls out in the join. An item
whose grams are all common costs a row for each of their places; items of up to four common words are never found,
and items without words aren't either.

Null and empty texts hold nothing. Ids of both tables may be of any type. Null and repeated ids are documents like any other
in the search; results name documents by id, so rows with one id (null among them) share their finds, whereas
``keep_clean`` judges each row by its own text. Test items of the same words are one item; results name it by each
of its ids, null included. Ties go to the first passage. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

GRAM, SEEDS, SCORE, RARE, RARE_WORD = 3, 2, 0.5, 1e-6, 1e-4
#: Grams of so many items lead nowhere, an item has so many seeds at least, and one rare seed finds items of so many words.
MANY, FEWEST, SHORT = 100, 4, 12
#: Hashes that are broadcast as they are, and the logarithm of the number of bits that stand for more.
EXACT, BITS = 2_000_000, 27
#: Words whose hashes, and words whose counts, a worker remembers; a full memo is emptied, which costs time only.
MEMO = 400_000
WORD = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2, -1, -1


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of ``a`` and ``b``: score, and the last places in each (the first such pair)."""
    best, end_a, end_b = 0, -1, -1
    last, slope = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1) * -GAP
    for i, x in enumerate(a):
        now = np.zeros(len(b) + 1, np.int64)
        now[1:] = np.maximum(last[:-1] + np.where(b == x, MATCH, MISMATCH), last[1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope) - slope
        top = int(now.argmax())
        if now[top] > best:
            best, end_a, end_b = int(now[top]), i, top - 1
        last = now
    return best, end_a, end_b


def align(item: list[str], passage: list[str]) -> tuple[float, int, int]:
    """Share of a perfect copy's score, and the aligned passage's first word and the one after its last."""
    code: dict[str, int] = {}
    a, b = (np.array([code.setdefault(w, len(code)) for w in x], np.int64) for x in (item, passage))
    if not len(a) or not len(b):
        return 0.0, 0, 0
    best, end_a, end_b = _ends(a, b)
    if best <= 0:
        return 0.0, 0, 0
    _, _, back = _ends(a[: end_a + 1][::-1], b[: end_b + 1][::-1])
    return best / (MATCH * len(a)), end_b - back, end_b + 1


def code_of(word: str) -> int:
    """A word's hash, which is never 0."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1


def gram_codes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size`` words that follow each other, as signed numbers; 0 where one of them is 0."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code, known = np.full(n, size, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for k in range(size):
            part = ids[k : k + n]
            known &= part != 0
            code = (code ^ part) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
    return np.where(known, code | np.uint64(1), np.uint64(0)).view(np.int64)


class Filter:
    """Tells which hashes are in a set: for sure up to ``exact`` of them, beyond that with some that aren't."""

    def __init__(self, codes: DataFrame, exact: int, bits: int):
        """``codes`` has one column, code, of distinct values."""
        self.codes, self.bits = None, None
        if codes.count() <= exact:
            self.codes = np.sort(codes.toPandas()["code"].to_numpy(np.int64))
        else:
            slot, bit = F.col("code").bitwiseAND((1 << bits) - 1), F.col("code").bitwiseAND(63).cast("int")
            words = codes.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(code & 63 as int))")).alias("mask")).toPandas()
            self.bits = np.zeros(1 << max(0, bits - 6), np.uint64)
            self.bits[words["at"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)

    def has(self, codes: np.ndarray) -> np.ndarray:
        """Which of ``codes`` may be in the set; 0 isn't."""
        if self.codes is not None:
            if not len(self.codes):
                return np.zeros(len(codes), bool)
            return self.codes[np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)] == codes
        got = self.bits[(codes & (64 * len(self.bits) - 1)) >> 6] >> (codes & 63).astype(np.uint64)
        return ((got & np.uint64(1)) == 1) & (codes != 0)


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_no, words): test items of different words, numbered; and (item_no, item_id), their ids."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["item_id", "words"])

    rows = benchmark.select("item_id", common.text_or_empty(F.col("text")).alias("text"))
    rows = rows.mapInArrow(cut, f"item_id {kind}, words array<string>").where("size(words) > 0").distinct()
    rows = common.stored(rows, "item-rows")
    items = common.stored(rows.select("words").distinct().select(F.monotonically_increasing_id().alias("item_no"), "words"), "items")
    return items, common.stored(rows.join(items, "words").select("item_no", "item_id"), "item-ids")


def _seeds(items: DataFrame, gram: int) -> DataFrame:
    """(code, item_no, place, size, words): the items' seeds, with the hashes of their words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([code_of(w) for w in ws], np.uint64)
                size = min(gram, len(ids))
                signed = ids.view(np.int64).tolist()
                rows += [(c, item, k, len(ids), signed[k : k + size]) for k, c in enumerate(gram_codes(ids, size).tolist())]
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["code", "item_no", "place", "size", "words"])

    rows = items.select("item_no", "words").mapInArrow(cut, "code long, item_no long, place long, size long, words array<long>")
    return common.stored(rows, "seeds")


def _hits(docs: DataFrame, vocabulary: Filter, grams: Filter, sizes: list[int]) -> DataFrame:
    """(doc_id, hash, at, code) of the benchmark's grams in documents, and (word, n) with the counts of its words; word 0 counts all."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, grams))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (vocabulary, grams), counts, memo, total = shared.value, Counter(), {}, 0
        names, key_type = ["doc_id", "hash", "at", "code", "word", "n"], None

        def counted():
            found = pa.array(list(counts), pa.uint64()).cast(pa.int64(), safe=False)
            nothing = pa.nulls(len(found), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(found), key_type), nothing, nothing, nothing, found, pa.array(list(counts.values()), pa.int64())], names)

        def learn(fresh: list[str]):
            if len(memo) > MEMO:
                memo.clear()
            codes = np.array([code_of(w) for w in fresh], np.uint64)
            for w, c, known in zip(fresh, codes.tolist(), vocabulary.has(codes.view(np.int64)).tolist()):
                memo[w] = c if known else 0

        for batch in batches:
            key_type, rows, at, code = batch.column(0).type, [], [], []
            for row, text in enumerate(batch.column(2)):
                ws = words(text.as_py())
                total += len(ws)
                ids = list(map(memo.get, ws))
                if None in ids:
                    fresh = list({w for w, c in zip(ws, ids) if c is None})
                    learn(fresh)
                    ids = [memo[w] if c is None else c for w, c in zip(ws, ids)]
                counts.update(ids)
                ids = np.array(ids, np.uint64)
                for size in sizes:
                    codes = gram_codes(ids, size)
                    where = np.flatnonzero(codes)
                    where = where[grams.has(codes[where])]
                    rows.append(np.full(len(where), row))
                    at.append(where)
                    code.append(codes[where])
            found = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
            if len(found):
                nothing = pa.nulls(len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(found), batch.column(1).take(found), pa.array(np.concatenate(at)), pa.array(np.concatenate(code)), nothing, nothing], names)
            if len(counts) > MEMO:
                counts.pop(0, None)
                yield counted()
                counts.clear()
        if key_type is not None:
            counts[0] = total
            yield counted()

    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    return common.stored(rows.mapInArrow(scan, f"doc_id {kind}, hash long, at long, code long, word long, n long"), "hits")


def _chance(seeds: DataFrame, found: DataFrame, hits: DataFrame, rare: float, rare_word: float) -> DataFrame:
    """(code, rare): whether chance makes a gram rare, by the counts of its words over all documents but for full copies."""
    often = hits.groupBy("code").agg(F.count("*").alias("n"))
    # an item has no more full copies than its rarest gram has places; shorter ones may be a turn of phrase
    copies = seeds.where(F.col("size") >= GRAM + 2).join(often, "code", "left").groupBy("item_no").agg(F.min(F.coalesce("n", F.lit(0))).alias("copies")).where("copies > 0")
    own = F.when(F.col("place") + F.size("words") == F.col("size"), F.col("words")).otherwise(F.slice("words", 1, 1))  # each of an item's words once
    copied = seeds.join(copies, "item_no").select(F.explode(own).alias("word"), "copies").groupBy("word").agg(F.sum("copies").alias("copied"))
    counts = found.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).join(copied, "word", "left")
    counts = common.stored(counts.select("word", "n", F.coalesce("copied", F.lit(0)).alias("copied")), "word-counts")
    sums = counts.agg(F.max(F.when(F.col("word") == 0, F.col("n"))).alias("n"), F.sum("copied").alias("copied")).head()
    total = max(1, (sums["n"] or 1) - (sums["copied"] or 0))
    left = F.greatest(F.lit(1), F.coalesce(F.col("n") - F.col("copied"), F.lit(1)))
    distinct = seeds.select("code", "words").dropDuplicates(["code"])
    spread = distinct.select("code", F.posexplode("words").alias("k", "word")).join(counts, "word", "left")
    chance = spread.groupBy("code").agg(F.sum(F.log(left / F.lit(total))).alias("chance"), F.count("*").alias("words"))
    limit = F.when(F.col("words") == 1, math.log(rare_word)).otherwise(math.log(rare))
    return chance.select("code", (F.col("chance") <= limit).alias("rare"))


def _grams(seeds: DataFrame, hits: DataFrame, chance: DataFrame, many: int) -> DataFrame:
    """(item_no, code, first, last, size, of, rare, seed): grams that count, with their first and last places in their items.

    An item's grams are ranked in a window of its own: a test item is a text, and holds its words in one row anyway.
    """
    often = hits.groupBy("code").agg(F.count("*").alias("n"))
    one = seeds.groupBy("item_no", "code").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.first("size").alias("size"))
    shared = one.groupBy("code").agg((F.count("*") > many).alias("shared"))
    of_item = Window.partitionBy("item_no")
    rows = one.join(shared, "code").join(chance, "code").join(often, "code", "left")
    rows = rows.withColumn("common", F.min("shared").over(of_item)).where(F.col("shared") == F.col("common"))
    rows = rows.withColumn("of", F.count("*").over(of_item)).where("n is not null")  # grams that no document has lead nowhere
    rank = F.row_number().over(of_item.orderBy("n", "first"))
    half = F.greatest(F.lit(FEWEST), F.ceil(F.col("of") / 2))
    rows = rows.withColumn("seed", (rank <= half) | (F.col("rare") & ~F.col("shared")))
    return common.stored(rows.select("item_no", "code", "first", "last", "size", "of", "rare", "seed"), "grams")


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key")


def _passages(hits: DataFrame, grams: DataFrame, least: int) -> DataFrame:
    """(doc_id, hash, item_no, first, last): places of words that may hold an item."""
    by = ["doc_id", "hash", "item_no"]
    pairs = common.dealt(hits, grams.where("seed").select("code", "item_no"), ["code"]).select(_key(), "hash", "item_no").distinct()
    pairs = common.stored(pairs, "document-items")
    near = hits.withColumn("_key", _key()).join(pairs.select("_key", "hash").distinct(), ["_key", "hash"], "left_semi")
    near = common.stored(near, "near-places")
    # a place has a row for each item of its gram, MANY at most; those of items that no seed leads to go
    rows = common.dealt(near, grams, ["code"]).join(pairs, ["_key", "hash", "item_no"], "left_semi").drop("_key")
    order = Window.partitionBy(*by).orderBy("at", "code")
    rows = rows.withColumn("opens", F.coalesce(F.col("at") - F.lag("at").over(order) > F.col("size"), F.lit(True)).cast("int"))
    rows = rows.withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.min(F.col("at") - F.col("last")).alias("low"), F.max(F.col("at") - F.col("first")).alias("high")
    parts = rows.groupBy(*by, "part").agg(F.countDistinct("code").alias("seeds"), F.max("seed").alias("seed"), F.max("rare").alias("rare"), low, high, F.first("size").alias("size"), F.first("of").alias("of"))
    some = (F.col("size") <= SHORT) | (F.col("seeds") >= F.least(F.lit(least), F.col("of")))
    most = (F.col("size") >= GRAM + 2) & (F.col("seeds") >= F.least(F.col("of"), F.greatest(F.lit(GRAM), F.ceil(F.col("of") / 4))))
    parts = parts.where(F.col("seed") & ((F.col("rare") & some) | most))
    room = F.floor(F.col("size") / 4) + 2
    return common.stored(parts.select(*by, F.greatest(F.lit(0), F.col("low") - room).cast("long").alias("first"), (F.col("high") + F.col("size") + room).cast("long").alias("last")), "passages")


def _cut_out(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, hash, item_no, first, passage): the passages' words, from one reading of the documents that have any."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    one = F.struct("item_no", "first", "last")
    wanted = passages.groupBy(_key(), "hash").agg(F.collect_list(one).alias("wanted"))
    rows = docs.select("doc_id", _key(), F.xxhash64("text").alias("hash"), "text").join(wanted.select("_key", "hash"), ["_key", "hash"], "left_semi")
    # rows of one id and one text are one document here
    rows = rows.groupBy("doc_id", "_key", "hash").agg(F.first("text").alias("text")).join(wanted, ["_key", "hash"]).select("doc_id", "hash", "text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ws = words(batch.column(2)[row].as_py())
                got = [(w["item_no"], w["first"], " ".join(ws[w["first"] : w["last"]])) for w in batch.column(3)[row].as_py()]
                columns = [pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.int64(), pa.string()))]
                each = pa.array([row] * len(got))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(1).take(each), *columns], ["doc_id", "hash", "item_no", "first", "passage"])

    return common.stored(rows.mapInArrow(cut, f"doc_id {kind}, hash long, item_no long, first long, passage string"), "cut-out")


def aligned(docs: DataFrame, items: DataFrame, seeds: int = SEEDS, score: float = SCORE, rare: float = RARE, rare_word: float = RARE_WORD, exact: int = EXACT, bits: int = BITS, many: int = MANY) -> DataFrame:
    """(doc_id, hash, item_no, score, first_word, last_word, passage) of all passages found; ``hash`` is that of the text."""
    docs = docs.select("doc_id", common.text_or_empty(F.col("text")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seed_rows = _seeds(items, GRAM)
    vocabulary = Filter(seed_rows.select(F.explode("words").alias("code")).distinct(), exact, bits)
    sizes = sorted(r["n"] for r in seed_rows.select(F.size("words").alias("n")).distinct().collect())  # three at most
    found = _hits(docs, vocabulary, Filter(seed_rows.select("code").distinct(), exact, bits), sizes)
    hits = common.stored(found.where("code is not null").select("doc_id", "hash", "at", "code").distinct(), "places")
    passages = _passages(hits, _grams(seed_rows, hits, _chance(seed_rows, found, hits, rare, rare_word), many), seeds)
    rows = common.dealt(_cut_out(docs, passages), items, ["item_no"]).select("doc_id", "hash", "item_no", "first", "passage", "words")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = {}  # copies of one passage are aligned once
        for batch in batches:
            got = []
            for item, w, p in zip(batch["item_no"], batch["words"], batch["passage"]):
                if (item, p) not in memo:
                    if len(memo) > 10_000:
                        memo.clear()
                    memo[item, p] = align(list(w), p.split(" "))
                got.append(memo[item, p])
            out = batch[["doc_id", "hash", "item_no"]].assign(
                score=[g[0] for g in got], first_word=[f + g[1] for f, g in zip(batch["first"], got)], last_word=[f + g[2] - 1 for f, g in zip(batch["first"], got)],
                passage=[" ".join(p.split(" ")[g[1] : g[2]]) for p, g in zip(batch["passage"], got)],
            )
            yield out[out["score"] >= score]

    # copies of a passage go to a few tasks, which remember it
    spread = rows.repartition(F.xxhash64("item_no", "passage"), F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    return spread.mapInPandas(compare, f"doc_id {kind}, hash long, item_no long, score double, first_word long, last_word long, passage string")


def search(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, passage): the best passage of each item in each document."""
    items, ids = _items(benchmark)
    best = F.max_by(F.struct("score", "first_word", "last_word", "passage"), F.struct("score", -F.col("first_word"))).alias("best")
    rows = aligned(docs, items, **parameters).groupBy("doc_id", "item_no").agg(best)
    rows = common.dealt(common.stored(rows, "best-passages"), ids, ["item_no"])
    return rows.groupBy("doc_id", "item_id").agg(F.max_by("best", F.struct("best.score", -F.col("best.first_word"))).alias("best")).select("doc_id", "item_id", "best.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents in whose own texts no test item is found, whatever other rows have their ids."""
    found = aligned(docs, _items(benchmark)[0], **parameters).select(_key(), "hash").distinct()
    key, code = common.free_name(docs, "_found"), common.free_name(docs, "_code")
    found = common.stored(found, "contaminated").withColumnsRenamed({"_key": key, "hash": code})
    text = F.xxhash64(common.text_or_empty(docs["text"]))
    return docs.join(found, (F.coalesce(docs["doc_id"].cast("string"), F.lit("")) == F.col(key)) & (text == F.col(code)), "left_anti")
