"""Progress of a resumable run, kept as an append-only log, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from .connect import lookup

#: A line of a run's log: (at) orders a run's lines, each of which has its own. Chunk events name a chunk, stage events a stage.
EVENTS = "run string, at long, event string, stage string, chunk_id string, detail string"
EXTRACTED, FAILED, COMPLETE, RESET, RESET_ALL = "extracted", "failed", "stage_complete", "reset_stage", "reset_all"
STAGES = ("chunking", "extraction", "graph_construction", "community_detection", "summarization", "embedding")


def counting(log: DataFrame, run: str = "run", at: str = "at") -> DataFrame:
    """The lines of a log that no later reset voids; resets themselves don't stay.

    Resetting a stage voids what says that it is complete, resetting extraction also what is known of chunks, and resetting
    all voids all. A run's resets are one row of a line for each stage, which is joined with the run's other lines; a
    run of very many lines is looked up and not shuffled. A null run is a run like any other.
    """
    log = tables.stored(log.withColumn("_run", F.coalesce(F.col(run).cast("string"), F.lit("\0"))), "run-log")
    last = {"_all": F.col("event") == RESET_ALL, **{f"_{s}": (F.col("event") == RESET) & (F.col("stage") == s) for s in STAGES}}
    resets = log.groupBy("_run").agg(F.count("*").alias("_n"), *(F.max(F.when(c, F.col(at))).alias(k) for k, c in last.items()))
    rows = lookup(log.where(F.col("event").isin(EXTRACTED, FAILED, COMPLETE)), tables.stored(resets, "resets"), "_run", "_n", log.count(), "inner")
    of_stage = F.coalesce(*(F.when(F.when(F.col("event") == COMPLETE, F.col("stage")).otherwise("extraction") == s, F.col(f"_{s}")) for s in STAGES))
    void = F.greatest("_all", of_stage)
    return rows.where(void.isNull() | (F.col(at) > void)).drop("_run", *last)


def chunk_states(log: DataFrame, run: str = "run", at: str = "at") -> DataFrame:
    """(run, chunk_id, status, detail): what a log says last of each chunk; a success clears an earlier failure, and its error."""
    rows = counting(log, run, at).where(F.col("event").isin(EXTRACTED, FAILED) & F.col("chunk_id").isNotNull())
    last = rows.groupBy(run, "chunk_id").agg(F.max_by(F.struct("event", "detail"), at).alias("_last"))
    return last.select(run, "chunk_id", F.col("_last.event").alias("status"), F.when(F.col("_last.event") == FAILED, F.col("_last.detail")).alias("detail"))


def stage_states(log: DataFrame, run: str = "run", at: str = "at") -> DataFrame:
    """(run, stage, done, completed_at) of each of a run's stages."""
    rows = counting(log, run, at).where(F.col("event") == COMPLETE)
    done = rows.groupBy(run, "stage").agg(F.max(at).alias("completed_at"))
    every = log.select(run).distinct().select(run, F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    same = F.col(run).eqNullSafe(F.col("_run")) & (F.col("stage") == F.col("_stage"))
    found = every.join(done.select(F.col(run).alias("_run"), F.col("stage").alias("_stage"), "completed_at"), same, "left")
    return found.select(run, "stage", F.col("completed_at").isNotNull().alias("done"), "completed_at")


def latest(log: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The last row of each key in a log: later entries win."""
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_last")).select(key, "_last.*")


def pending(every: DataFrame, done: DataFrame, failed: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """Keys neither done nor failed; with ``retry_failed`` failed ones are pending too."""
    seen = done.select(key) if retry_failed else done.select(key).union(failed.select(key))
    return every.select(key).join(seen.distinct(), key, "left_anti")


def progress(every: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """One row: total, extracted, failed, pending and per cent done."""
    total = every.agg(F.countDistinct(key).alias("total"))
    seen = state.agg(F.count_if(F.col("status") == "extracted").alias("extracted"), F.count_if(F.col("status") == "failed").alias("failed"))
    rows = total.join(F.broadcast(seen))  # one row each
    done = F.coalesce(F.bround(F.try_divide(100.0 * F.col("extracted"), F.col("total")), 1), F.lit(0.0))
    return rows.withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("extracted") - F.col("failed"))).withColumn("percent", done)


def next_stage(stages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(stage) of the first stage in order that isn't complete, or null; ``stages`` has stage and done, for each of ``by``."""
    order = F.create_map(*(x for i, s in enumerate(STAGES) for x in (F.lit(s), F.lit(i))))
    return stages.groupBy(*(by or [])).agg(F.min_by("stage", F.when(~F.col("done"), F.try_element_at(order, F.col("stage")))).alias("stage"))


def ready(done: dict[str, bool]) -> dict[str, bool]:
    """Which kinds of questions the stages that are done let answer."""
    graph = done["graph_construction"] and done["community_detection"] and done["summarization"]
    return {"fully_indexed": all(done[s] for s in STAGES), "global_ready": graph, "local_ready": done["chunking"] and done["embedding"]}


def newest(runs: DataFrame, at: str, limit: int = 20) -> DataFrame:
    """The latest runs first, at most ``limit``."""
    return runs.orderBy(F.desc(at)).limit(limit)


def merged_runs(first: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Both lists of runs; a run in both counts as it is in ``first``."""
    return first.unionByName(other.join(first.select(key), key, "left_anti"), allowMissingColumns=True)


def pages(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page, counted from 1, of at most 100 rows; ``counted`` gives the number of all rows too."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("pages are counted from 1 and have 1 to 100 rows")
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def counted(rows: DataFrame, order: list, page: int, size: int) -> tuple[int, DataFrame]:
    """The number of all rows, and one page of them."""
    return rows.count(), pages(rows, order, page, size)
