"""Entity graph: merges of mentions into nodes and of pairs into edges, degrees and statistics.

First-seen order is that of (chunk_ord, pos), whatever their types, so every tie has one answer whatever the partitioning.
Where a name was seen is a table of pairs (``provenance``), as a name may be in every chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import tables

#: Characters of a part of ``description_parts``.
PART = 1_000_000


def _ord() -> Column:
    return F.struct("chunk_ord", "pos")


def _texts(rows: DataFrame, keys: list[str], text: str = "description", budget: int | None = None) -> DataFrame:
    """Distinct texts of each key that aren't empty, in first-seen order, joined by blanks: all, or as many as fit a budget."""
    first = rows.where(F.col(text) != "").groupBy(*keys, text).agg(F.min("ord").alias("ord"))
    if budget is not None:
        # the running sum reads a key's texts as a stream, in the shuffle that brings them together anyway
        order = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        first = first.withColumn("_before", F.coalesce(F.sum(F.length(text) + 1).over(order), F.lit(0))).where(F.col("_before") + F.length(text) <= F.greatest(F.lit(budget), F.length(text)))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", text))), lambda x: x[text]), " ").alias(text))


def description_parts(rows: DataFrame, keys: list[str], text: str = "description", part: int = PART) -> DataFrame:
    """(keys…, part, text): distinct texts of each key in first-seen order, in parts that begin at multiples of ``part`` characters.

    ``rows`` have (keys…, text, ord). Joined by blanks in the order of parts they are the whole description, however
    long it is. Ranges of (key, ord) are summed apart, so a key that is in every chunk is in as many tasks; only keys that
    go on from one range to the next, one a range, need what came before.
    """
    first = rows.where(F.col(text) != "").groupBy(*keys, text).agg(F.min("ord").alias("ord"))
    placed = tables.stored(first.repartitionByRange(*keys, "ord").withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*keys, "_range").agg(F.sum(F.length(text) + 1).alias("_size"))
    of_key = Window.partitionBy(*keys).orderBy("_range")
    sums = sums.withColumn("_before", F.sum("_size").over(of_key.rowsBetween(Window.unboundedPreceding, -1))).where("_before is not null")
    inside = Window.partitionBy("_range", *keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length(text) + 1).over(inside), F.lit(0)) + F.coalesce("_before", F.lit(0))
    rows = placed.join(F.broadcast(sums.drop("_size")), [*keys, "_range"], "left").withColumn("part", F.floor(at / part))
    return rows.groupBy(*keys, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", text))), lambda x: x[text]), " ").alias(text))


def provenance(rows: DataFrame, *names: str) -> DataFrame:
    """The distinct (names…, chunk_ord) of mentions or pairs: names normalised, those of a pair in order."""
    ids = [tx.node_id(n) for n in names]
    if len(ids) == 2:
        ids = [F.least(*ids), F.greatest(*ids)]
    keys = ["node_id"] if len(ids) == 1 else ["src", "dst"]
    found = rows.select(*(c.alias(k) for c, k in zip(ids, keys)), "chunk_ord").distinct()
    return found.where(" and ".join(f"{k} <> ''" for k in keys) + (" and src <> dst" if len(keys) == 2 else ""))


def mentions(entities: DataFrame) -> DataFrame:
    """(node_id, chunk_ord, name, entity_type, description, n, ord): equal mentions of a chunk as one row, with the first's place."""
    rows = entities.withColumn("node_id", tx.node_id("name")).where("node_id <> ''").withColumn("ord", _ord())
    return rows.groupBy("node_id", "chunk_ord", "name", "entity_type", "description").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))


def nodes(entities: DataFrame, claims: DataFrame | None = None, min_mentions: int = 1, text_budget: int | None = None) -> DataFrame:
    """One row for each normalised name: longest name, commonest type, descriptions, number of chunks, mentions, claims.

    ``text_budget`` bounds the characters of a description; with None it is whole, as long as a row can hold it.
    ``description_parts`` of ``mentions`` has no such end.
    """
    rows = entities.withColumn("node_id", tx.node_id("name")).where("node_id <> ''").withColumn("ord", _ord())
    kinds = rows.groupBy("node_id", "entity_type").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    kind = kinds.groupBy("node_id").agg(F.min_by("entity_type", F.struct(-F.col("n"), "ord")).alias("entity_type"))
    # a chunk's mentions of a name are one row of the second step
    main = rows.groupBy("node_id", "chunk_ord").agg(F.min_by("name", F.struct(-F.length("name"), "ord")).alias("name"), F.min("ord").alias("ord"), F.count("*").alias("n"))
    longest = F.struct(-F.length("name"), "ord")
    main = main.groupBy("node_id").agg(
        F.min_by("name", longest).alias("name"), F.sum("n").alias("mention_count"), F.count("*").alias("n_chunks"),
        F.min("chunk_ord").alias("first_chunk"), F.min("ord").alias("first_ord"),
    )
    out = main.join(kind, "node_id").join(_texts(rows, ["node_id"], budget=text_budget), "node_id", "left")
    out = out.withColumn("description", F.coalesce("description", F.concat(F.lit("Entity: "), "name")))
    if claims is not None:
        found = claims.withColumn("node_id", tx.node_id("subject_entity")).withColumn("ord", _ord())
        found = found.join(main.select("node_id", "first_chunk"), "node_id").where("first_chunk <= chunk_ord")
        listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "claim_description"))), lambda x: x["claim_description"])
        out = out.join(found.groupBy("node_id").agg(listed.alias("claims")), "node_id", "left").withColumn("claims", F.coalesce("claims", F.array().cast("array<string>")))
    return out.where(F.col("mention_count") >= min_mentions) if min_mentions > 1 else out


def heads(entities: DataFrame) -> DataFrame:
    """(node_id, name, entity_type) of ``nodes``, in one pass over the mentions; a spelling is normalised once."""
    rows = entities.groupBy("name", "entity_type").agg(F.count("*").alias("n"), F.min(_ord()).alias("ord"))
    rows = rows.withColumn("node_id", tx.node_id("name")).where("node_id <> ''").withColumn("longest", F.struct((-F.length("name")).alias("size"), "ord", "name"))
    kinds = rows.groupBy("node_id", "entity_type").agg(F.sum("n").alias("n"), F.min("ord").alias("ord"), F.min("longest").alias("longest"))
    return kinds.groupBy("node_id").agg(F.min("longest")["name"].alias("name"), F.min_by("entity_type", F.struct(-F.col("n"), "ord")).alias("entity_type"))


def node_ids(entities: DataFrame, min_mentions: int = 1) -> DataFrame:
    """(node_id) of the nodes alone, for what only asks whether they exist."""
    rows = entities.select(tx.node_id("name").alias("node_id")).where("node_id <> ''").groupBy("node_id").agg(F.count("*").alias("n"))
    return rows.where(F.col("n") >= min_mentions).select("node_id")


def edges(relationships: DataFrame, node_table: DataFrame | None = None, text_budget: int | None = None, texts: bool = True, chunks: bool = True) -> DataFrame:
    """One row for each unordered pair of nodes: occurrences, mean strength, descriptions, number of chunks; no loops.

    Without ``node_table`` all ends are taken for nodes, as they are when pairs come from the mentions themselves.
    Equal descriptions of a pair become one row that carries counts, sums and first places, from which the pair's own follow;
    so pairs are extracted and shuffled once. Pairs may bring the node ids ``a`` and ``b`` of their ends. ``texts`` and ``chunks`` leave out descriptions and the number of chunks,
    which takes a second pass over the pairs.
    """
    rows = relationships
    if not {"a", "b"} <= set(rows.columns):
        rows = rows.withColumn("a", tx.node_id("source_entity")).withColumn("b", tx.node_id("target_entity"))
    rows = rows.where("a <> b and a <> '' and b <> ''")
    if node_table is not None:
        ids = node_table.select("node_id")
        rows = rows.join(ids.withColumnRenamed("node_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("node_id", "b"), "b", "left_semi")
    rows = rows.withColumn("src", F.least("a", "b")).withColumn("dst", F.greatest("a", "b")).withColumn("ord", _ord())
    keys, parts = ["src", "dst"], [F.sum("n").cast("double").alias("weight"), F.round(F.sum("strength") / F.sum("n"), 2).alias("avg_strength"), F.min("ord").alias("first_ord")]
    main = rows.groupBy(*keys, *(["description"] if texts else [])).agg(F.count("*").alias("n"), F.sum("strength").alias("strength"), F.min("ord").alias("ord"))
    if texts and text_budget is None:
        said = F.array_sort(F.collect_list(F.when(F.col("description") != "", F.struct("ord", "description"))))
        parts.append(F.nullif(F.array_join(F.transform(said, lambda x: x["description"]), " "), F.lit("")).alias("description"))
    out = main.groupBy(*keys).agg(*parts)
    if texts and text_budget is not None:
        out = out.join(_texts(rows, keys, budget=text_budget), keys, "left")
    if chunks:
        out = out.join(rows.select(*keys, "chunk_ord").distinct().groupBy(*keys).agg(F.count("*").alias("n_chunks")), keys)
    return out.withColumn("edge_id", F.concat_ws("__", *keys))


def degrees(node_table: DataFrame | None, edge_table: DataFrame) -> DataFrame:
    """(node_id, degree), 0 for isolated nodes; without ``node_table`` those of the edges' ends alone."""
    ends = edge_table.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    if node_table is None:
        return ends
    return node_table.select("node_id").join(ends, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def combined_degrees(edge_table: DataFrame, degree_table: DataFrame) -> DataFrame:
    d = degree_table
    rows = edge_table.join(d.select(F.col("node_id").alias("src"), F.col("degree").alias("_s")), "src").join(d.select(F.col("node_id").alias("dst"), F.col("degree").alias("_d")), "dst")
    return rows.withColumn("combined_degree", F.col("_s") + F.col("_d")).drop("_s", "_d")


def stats(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    d = degrees(node_table, edge_table).agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 2).alias("avg_degree"), F.max("degree").alias("max_degree"))
    e = edge_table.agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 2).alias("avg_weight"))
    return d.join(F.broadcast(e))  # one row each


def type_histogram(node_table: DataFrame) -> DataFrame:
    return node_table.groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type")


def top_entities(node_table: DataFrame, edge_table: DataFrame, n: int = 20) -> DataFrame:
    rows = degrees(node_table, edge_table).join(node_table.select("node_id", "name", "entity_type"), "node_id")
    return rows.orderBy(F.desc("degree"), "node_id").limit(n)


def node_context(node_table: DataFrame, edge_table: DataFrame, most: int = 50) -> DataFrame:
    """(node_id, context): the entity's head and its edges of highest combined degree."""
    edge = edge_table.select("src", "dst", "description", "combined_degree")
    both = edge.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), "description", "combined_degree").unionByName(edge.select(F.col("dst").alias("node_id"), F.col("src").alias("other"), "description", "combined_degree"))
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("combined_degree"), "other"))
    lines = both.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("line", F.concat(F.lit("- "), "other", F.lit(": "), "description"))
    lines = lines.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("Entity: "), "name", F.lit("\nType: "), "entity_type")
    return node_table.join(lines, "node_id", "left").select("node_id", F.concat_ws("\n", head, "lines").alias("context"))


