"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import delete, fresh_dir, scratch, shared_dir, stored

__all__ = ["dealt", "delete", "fresh_dir", "free_name", "read", "scratch", "shared_dir", "stored", "text_or_empty"]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores put before it until no column of ``df`` has that name, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def dealt(rows: DataFrame, table: DataFrame, keys: list[str], least: int = 100_000) -> DataFrame:
    """Inner join of ``rows`` and ``table`` on ``keys`` in which no task gets very many rows of a key.

    Keys with over ``least`` rows, or 1/10,000 of all if that is more, are dealt out: their rows by hashes to as many shares as
    they need, and what ``table`` has for them to each share. There are 10,000 of them at most; only they and their
    numbers of shares are broadcast. ``rows`` is read twice and should be a stored table.
    """
    most = max(least, rows.count() // 10_000)
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("_n") / most).cast("bigint").alias("_shares")))
    share = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_shares")), F.lit(0))
    left = rows.join(hot, keys, "left").withColumn("_share", share).drop("_shares")
    shares = F.coalesce(F.col("_shares"), F.lit(1).cast("bigint"))
    right = table.join(hot, keys, "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1))).drop("_shares")
    return left.join(right, [*keys, "_share"]).drop("_share")


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
