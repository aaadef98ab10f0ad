"""Connected components by alternating large-star and small-star steps, and lookups that stand hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables

#: A key with at least this share of all rows is hot; there are at most as many hot keys as one over it.
HOT_SHARE = 10_000


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """Join of ``rows`` and ``table`` on ``key``, without ``weight``; ``table`` has each key once.

    ``weight`` is the number of ``rows`` that have the key, and ``total`` the number of all. Keys with 1/10,000 of all
    rows (100 at least) are broadcast: they are 10,000 at most, whatever the size of the data. Others are joined by a
    shuffle in which no key has more rows than that. ``rows`` is read twice and should be a stored table.
    """
    keys, heavy = [key] if isinstance(key, str) else key, max(100, total // HOT_SHARE)
    hot, cold = (table.where(c).drop(weight) for c in (F.col(weight) >= heavy, F.col(weight) < heavy))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys, how))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of ``edges``, the smallest node that it reaches. Loops and null ends count for nothing.

    Each round writes its edges to the shared folder, so that lineage stays short and a lost executor costs one round,
    and deletes those of the round before. A node with very many neighbours is looked up and not joined by a shuffle. It
    ends when edges are stars: no node has two roots, and no root has one.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = tables.fresh_dir(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    now, path = kept(_both(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))).where("u > v").distinct(), "edges")
    while True:
        ends, total = now.groupBy("u").agg(F.count("*").alias("n")), now.count()
        several = not ends.where("n > 1").isEmpty()
        if not several and now.select(F.col("v").alias("u")).distinct().join(ends, "u", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        # large star: every larger neighbour of u to the smallest of u and its neighbours
        near = _both(now)
        least = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = lookup(near, least, "u", "n", 2 * total, "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, large_path = kept(large, "large-star")
        # small star: u and its smaller neighbours to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = lookup(large, least, "u", "n", total, "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = [path, large_path]
        now, path = kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        for p in before:
            tables.delete(spark, p)


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
