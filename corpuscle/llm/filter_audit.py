"""How filters interact: every order of them, by adjacent transpositions over mask cells.

Each document's failures are a mask of bits, one a filter. Documents are counted by part and mask, at most 2^k cells for k
filters; whatever the number of documents, that is all an order's counts need. The k! orders are then visited
so that each differs from the one before by a swap of two neighbours. The swap changes what two steps remove, and nothing
before or after them; those two are worked out anew from the cells. A filter's share (Shapley value, times k!) is the
sum of what it removes over the walk.

The filters: A fewer than 100 words, B fewer than 80 distinct words in 100, C more than 10 letters A-Z in 100 code points,
D any of ``#$%&*|``, E the text of a smaller doc_id in the whole table. Words are what ASCII white space separates, in their
own case. A null text is empty. A null part is "". A null doc_id is neither smaller nor larger than another; rows of one
doc_id aren't copies of each other. Repeated rows count as often as they are there. Labels of one doc_id count as 1 if
any row says so; null ids have no labels. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def conditions(words: Column, text: Column) -> list[Column]:
    """What fails filters A to D."""
    n, different = F.size(words), F.size(F.array_distinct(words))
    return [n < 100, 100 * different < 80 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text), text.rlike(r"[#$%&*|]")]


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): documents by the filters they fail, E included.

    Rows of one text, doc_id and part are one before any text meets its copies, and the smallest doc_id of each text is found
    by partial minima; only rows with that very doc_id are joined with it, so a text of very many copies is no hot key.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), common.text_or_empty(F.col("text")).alias("text"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), "text", words.alias("words"))
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions(F.col("words"), F.col("text")))]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    rows = rows.select("doc_id", "part", "digest", mask.alias("mask")).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    rows = common.stored(rows, "masks")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = rows.join(first, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    marked = marked.select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), "n")
    return marked.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def cells(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those with labels, by part and mask."""
    marked = common.stored(marked, "marked")
    said = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("long").alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.groupBy("doc_id").agg(*said).where("good + toxic > 0")
    with_labels = marked.join(known, "doc_id").select("part", "mask", F.lit(0).cast("long").alias("n"), (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))
    zero = F.lit(0).cast("long")
    every = marked.select("part", "mask", "n", zero.alias("good"), zero.alias("toxic")).unionByName(with_labels)
    return every.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def swaps(k: int) -> Iterator[int]:
    """The k! - 1 places whose swaps with the next one lead through all orders of ``k``: each time the largest that can move does."""
    order, left = list(range(k)), [True] * k
    while True:
        for x in range(k - 1, -1, -1):
            at = order.index(x)
            to = at - 1 if left[x] else at + 1
            if 0 <= to < k and order[to] < x:
                break
        else:
            return
        order[at], order[to] = order[to], x
        for y in range(x + 1, k):
            left[y] = not left[y]
        yield min(at, to)


def walk(counts: np.ndarray, letters: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique, good_lost, toxic_lost, share) of all orders, from the 2^k rows (n, good, toxic)."""
    k = len(letters)
    mask = np.arange(1 << k)
    fails = [mask >> f & 1 == 1 for f in range(k)]
    failing = [int(counts[x, 0].sum()) for x in fails]
    unique = [int(counts[1 << f, 0]) for f in range(k)]

    def lost(f: int, before: int) -> tuple[int, int, int]:
        """Documents, good and toxic ones that filter ``f`` removes after the filters in ``before``."""
        return tuple(counts[fails[f] & (mask & before == 0)].sum(axis=0).tolist())

    order, before, left = list(range(k)), 0, int(counts[:, 0].sum())
    steps, kept, share, seen = [], [], [0] * k, []
    for f in order:
        steps.append(lost(f, before))
        before |= 1 << f
        left -= steps[-1][0]
        kept.append(left)

    def visit():
        for f, s in zip(order, steps):
            share[f] += s[0]
        seen.append((tuple(order), tuple(steps), tuple(kept)))

    visit()
    for at in swaps(k):
        order[at], order[at + 1] = order[at + 1], order[at]
        before = sum(1 << f for f in order[:at])
        left = kept[at] + steps[at][0]
        steps[at], steps[at + 1] = lost(order[at], before), lost(order[at + 1], before | 1 << order[at])
        kept[at] = left - steps[at][0]
        visit()
    return [
        ("".join(letters[f] for f in o), i + 1, left[i], s[i][0], failing[f] - s[i][0], unique[f], s[i][1], s[i][2], share[f])
        for o, s, left in seen for i, f in enumerate(o)
    ]


def audit(found: DataFrame, letters: str = FILTERS) -> DataFrame:
    """All orders and steps of each part of ``cells``; a part is one row of at most 2^k cells."""
    parts = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, rows in zip(batch["part"], batch["cells"]):
                counts = np.zeros((1 << len(letters), 3), np.int64)
                for r in rows:
                    counts[r["mask"]] = r["n"], r["good"], r["toxic"]
                yield pd.DataFrame([(part, *x) for x in walk(counts, letters)], columns=names)

    return parts.mapInPandas(run, SCHEMA)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E by language."""
    return audit(cells(masks(docs), labels))


SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), fails AS (
  SELECT d.part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM docs d LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
), cells AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL
), letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1]) AS before FROM orders, range(1, 6) t(step)
), counted AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (coalesce(before, 0)::INT | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted"""
