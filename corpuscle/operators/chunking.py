"""Documents to token windows, and windows filled up to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import tables

SIZE, OVERLAP = 600, 100


def chunk(docs: DataFrame, stem: Column, size: int = SIZE, overlap: int = OVERLAP, keep: tuple[str, ...] = ("doc_id",), limit: int | None = None, tokenizer: tx.Tokenizer = tx.WHITE_SPACE) -> DataFrame:
    """Sliding windows of ``size`` tokens that share ``overlap``; the last one reaches the text's end.

    ``limit`` keeps the first windows in the order of documents; 0 and None keep all.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller than size")
    if (windows := tokenizer.windows("text", size, overlap)) is not None:
        rows = docs.select(*keep, stem.alias("stem"), windows.alias("windows"))
        rows = rows.select(*keep, "stem", F.size("windows").alias("total_chunks"), F.posexplode("windows").alias("chunk_index", "w"))
        name = F.format_string("%s_%04d", "stem", "chunk_index").alias("chunk_id")
        rows = rows.select(*keep, name, "chunk_index", "total_chunks", "w.token_count", "w.start_char", "w.text", "w.end_char")
        return rows.orderBy(*keep, "chunk_index").limit(limit) if limit else rows
    step, between = size - overlap, len(tokenizer.joiner)
    rows = docs.select(*keep, stem.alias("stem"), tokenizer.tokens("text").alias("toks")).where(F.size("toks") > 0)
    rows = rows.withColumn("starts", F.expr(f"sequence(0, greatest(size(toks) - {overlap + 1}, 0), {step})"))
    # characters before each window: lengths of the steps before it, in a running sum
    sums = lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(F.array_join(F.slice("toks", x + 1, step), tokenizer.joiner)) + between))
    rows = rows.withColumn("chars", F.aggregate("starts", F.array(F.lit(0)), sums))
    rows = rows.select(*keep, "stem", "toks", "chars", F.size("starts").alias("total_chunks"), F.posexplode("starts").alias("chunk_index", "start"))
    part = tx.joined(F.col("toks"), F.col("start") + 1, size, tokenizer.joiner)
    rows = rows.select(
        *keep, F.format_string("%s_%04d", "stem", "chunk_index").alias("chunk_id"), "chunk_index", "total_chunks",
        F.least(F.lit(size), F.size("toks") - F.col("start")).alias("token_count"), F.get("chars", F.col("chunk_index")).alias("start_char"), part.alias("text"),
    )
    rows = rows.withColumn("end_char", F.col("start_char") + F.length("text"))
    return rows.orderBy(*keep, "chunk_index").limit(limit) if limit else rows


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.sum("token_count").alias("total_tokens"),
        F.bround(F.avg("token_count"), 1).alias("avg_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"),
    )


#: Parts that what is left of a group's partitions is cut in before it comes together.
SPREAD = 64


def leading(rows: DataFrame, cost: Column, budget: int, order: list, by: list[str] | None = None, separator: int = 0) -> DataFrame:
    """At least the first rows whose costs fit the budget, and the one after them; ``fill`` says which do.

    Costs are not negative, so a row that begins beyond the budget among some of its group's rows does so among all of
    them. Groups are cut so inside each input partition and then in ``SPREAD`` parts; what is left comes together in
    one task, about ``SPREAD`` budgets, however large the group is.
    """
    groups = by or []

    def cut(rows: DataFrame, part: Column) -> DataFrame:
        window = Window.partitionBy(*groups, "_part").orderBy(*order)
        rows = rows.withColumn("_part", part)
        rows = rows.withColumn("_before", F.sum("_cost").over(window.rowsBetween(Window.unboundedPreceding, -1)))
        return rows.where(F.coalesce("_before", F.lit(0)) <= budget).drop("_before")

    rows = rows.withColumn("_cost", cost + separator).withColumn("_home", F.spark_partition_id())
    rows = cut(rows, F.col("_home")).drop("_part")
    return cut(rows, F.pmod(F.col("_home"), F.lit(SPREAD))).drop("_part", "_home", "_cost")


def fill(rows: DataFrame, cost: Column, budget: int, order: list, by: list[str] | None = None, separator: int = 0, spread: bool = True) -> DataFrame:
    """The first rows whose costs fit the budget, with ``rank`` and ``used``; a separator costs from the second row on.

    Costs are not negative, so the running sum rises, and filtering by it is the same as stopping at the first overflow.
    With ``spread``, groups are cut by ``leading`` before they come together.
    """
    if spread:
        # without the first row's separator, so as not to cut too much
        rows = leading(rows, cost, budget + separator, order, by, separator)
    window = Window.partitionBy(*(by or [])).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(window))
    rows = rows.withColumn("_spent", cost + F.when(F.col("rank") > 1, separator).otherwise(0))
    rows = rows.withColumn("used", F.sum("_spent").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_spent")
    return rows.where(F.col("used") <= budget)


def pack(items: DataFrame, budget: int, by: str, order: list, separator: str = "\n\n", index: Column | None = None, tokenizer: tx.Tokenizer = tx.WHITE_SPACE) -> DataFrame:
    """Greedy context of each group: joined text, number of items, tokens, and whether something was left out.

    With ``index``, also the included items' ``indices``, in the context's order.
    """
    counted = items.withColumn("cost", tokenizer.count("text")).withColumn("_index", F.lit(0) if index is None else index)
    every = counted.groupBy(by).agg(F.count("*").alias("items"))
    kept = fill(counted, F.col("cost"), budget, order, [by], len(separator.split()))
    listed = F.array_sort(F.collect_list(F.struct("rank", "text", "_index")))
    kept = kept.groupBy(by).agg(listed.alias("_all"), F.count("*").alias("included"), F.max("used").alias("used"))
    rows = every.join(kept, by, "left")
    out = rows.select(
        by, F.coalesce(F.array_join(F.transform("_all", lambda x: x["text"]), separator), F.lit("")).alias("context"), F.coalesce("included", F.lit(0)).alias("included"),
        F.coalesce("used", F.lit(0)).alias("used_tokens"), (F.coalesce("included", F.lit(0)) < F.col("items")).alias("truncated"),
        F.transform("_all", lambda x: x["_index"]).alias("indices"),
    )
    return out if index is not None else out.drop("indices")


def shuffled(key: Column | str, seed: int = 42) -> Column:
    """An order without position bias that is the same in each run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))


def batches(rows: DataFrame, order: list, size: int, name: str = "batch") -> DataFrame:
    """Adds the number, from 0, of the batch of ``size`` rows that each row is in, in order; the last may be smaller."""
    if size < 1:
        raise ValueError("a batch has a row at least")
    return tables.numbered(rows, order, name).withColumn(name, F.floor(F.col(name) / size))
