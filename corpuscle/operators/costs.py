"""Prices of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: US dollars for a million tokens in and out, in the order in which prefixes are tried (fixed values).
PRICES = (
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-2024-08-06", 2.50, 10.00),
    ("gpt-4o-2024-05-13", 5.00, 15.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4o-mini-2024-07-18", 0.15, 0.60),
    ("gpt-4-turbo", 10.00, 30.00),
    ("gpt-4", 30.00, 60.00),
    ("gpt-3.5-turbo", 0.50, 1.50),
    ("text-embedding-3-small", 0.02, 0.00),
    ("text-embedding-3-large", 0.13, 0.00),
    ("text-embedding-ada-002", 0.10, 0.00),
)
#: The price of an unknown model (fixed value).
UNKNOWN = (10.00, 30.00)


def rounded(x: Column, digits: int) -> Column:
    """Halves go up, in plain arithmetic on doubles, so that every engine agrees."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def pricing(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, '{m}', {a}D, {b}D)" for i, (m, a, b) in enumerate(PRICES))
    return spark.sql(f"select * from values {rows} as t(ord, model_prefix, input_usd, output_usd)")


def priced(calls: DataFrame, longest: bool = True) -> DataFrame:
    """Calls (model, prompt_tokens, completion_tokens) with ``cost_usd``.

    A model has its own price, or that of a prefix of its name: the longest one, or with ``longest`` off the first in
    the table's order. The table is a handful of literals, so the price is looked up in an array, without a join.
    """
    table = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(m).alias("prefix"), F.lit(a).alias("i"), F.lit(b).alias("o")) for i, (m, a, b) in enumerate(PRICES)))
    fits = F.filter(table, lambda t: F.startswith(F.col("model"), t["prefix"]))
    exact = F.filter(fits, lambda t: t["prefix"] == F.col("model"))
    rank = lambda t: F.struct((-F.length(t["prefix"]) if longest else t["ord"]).alias("r"), t["i"].alias("i"), t["o"].alias("o"))
    found = F.coalesce(F.get(F.array_sort(F.transform(exact, rank)), F.lit(0)), F.get(F.array_sort(F.transform(fits, rank)), F.lit(0)))
    rows = calls.withColumn("_p", found)
    cost = F.col("prompt_tokens") / 1e6 * F.coalesce("_p.i", F.lit(UNKNOWN[0])) + F.col("completion_tokens") / 1e6 * F.coalesce("_p.o", F.lit(UNKNOWN[1]))
    return rows.withColumn("cost_usd", rounded(cost, 6)).drop("_p")


def pipeline_cost(params: DataFrame, model: tuple[float, float] = (2.50, 10.00), embedding: float = 0.02) -> DataFrame:
    """Closed-form cost of indexing and one question, from n_chunks, avg_tokens, rounds and n_communities of each row."""
    usd = lambda i, o: rounded(i / 1e6 * model[0] + o / 1e6 * model[1], 6)
    n, c = F.col("n_chunks"), F.col("n_communities")
    tokens = n * F.col("avg_tokens")
    parts: dict[str, Column] = {
        "extraction_usd": usd(tokens, n * 300 + n * F.col("rounds") * 201),
        "summarization_usd": usd(c * 6000, c * 1000),
        "map_query_usd": usd(c * 1500, c * 100),
        "reduce_query_usd": usd(F.lit(4000), F.lit(800)),
        "embeddings_usd": rounded(tokens / 1e6 * embedding, 6),
    }
    total = sum(parts.values(), F.lit(0.0))
    return params.select("*", *(rounded(v, 4).alias(k) for k, v in parts.items()), rounded(total, 4).alias("total_usd"))
