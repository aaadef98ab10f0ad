"""Tuple records of a text model, and a rule-based model for offline use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: The record format's marks (fixed values).
DONE, RECORD, FIELD = "<|COMPLETE|>", "##", "<|>"


def records(texts: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, pos, kind, parts) of each well-formed record of column ``text``."""
    body = F.split_part("text", F.lit(DONE), F.lit(1))
    rows = texts.select(key, F.posexplode(F.split(body, RECORD)).alias("pos", "raw"))
    bare = F.regexp_replace(F.trim("raw"), r"(?s)^\((.*)\)$", "$1")
    rows = rows.select(key, "pos", F.transform(F.split(bare, r"<\|>"), lambda x: F.trim(x)).alias("parts")).where(F.size("parts") >= 2)
    return rows.withColumn("kind", F.lower(F.trim(F.replace(F.get("parts", F.lit(0)), F.lit('"'), F.lit("")))))


def _part(k: int) -> Column:
    return F.get("parts", F.lit(k))


def entities(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    return rows.where("kind = 'entity' and size(parts) >= 4").select(key, "pos", _part(1).alias("name"), F.upper(_part(2)).alias("entity_type"), _part(3).alias("description"))


def strength(text: Column) -> Column:
    """A whole number from 1 to 10; 5 for what is no number; infinite ones are left out by ``relationships``."""
    d = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(d.isNull(), 5).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(10.0), d)).cast("int"))


def relationships(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    rows = rows.where("kind = 'relationship' and size(parts) >= 5").where(~F.lower(_part(4)).rlike(r"^[+-]?(inf|infinity)$"))
    return rows.select(key, "pos", _part(1).alias("source_entity"), _part(2).alias("target_entity"), _part(3).alias("description"), strength(_part(4)).alias("strength"))


def date(text: Column) -> Column:
    return F.when(F.upper(F.trim(text)).isin("NONE", "NULL", "", "N/A"), None).otherwise(F.trim(text))


def claims(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    rows = rows.where("kind = 'claim' and size(parts) >= 5")
    return rows.select(key, "pos", _part(1).alias("subject_entity"), _part(2).alias("claim_type"), _part(3).alias("claim_description"), _part(4).alias("status"), date(_part(5)).alias("start_date"), date(_part(6)).alias("end_date"))


NAMES = r"regexp_extract_all(text, '\\p{Lu}\\p{Ll}{3,}', 0)"


def mentions(docs: DataFrame) -> DataFrame:
    """(chunk_ord, pos, name, entity_type, description): capitalised words as entities, the offline rule."""
    rows = docs.select(F.col("doc_id").alias("chunk_ord"), "source", F.posexplode(F.expr(NAMES)).alias("pos", "name"))
    kind = F.element_at(F.array(*map(F.lit, ("ORGANIZATION", "PERSON", "LOCATION", "CONCEPT"))), F.length("name") % 4 + 1)
    return rows.select("chunk_ord", "pos", "name", kind.alias("entity_type"), F.concat(F.lit("seen in "), "source").alias("description"))


def adjacent(found: DataFrame) -> DataFrame:
    """(chunk_ord, pos, source_entity, target_entity, description, strength): neighbours in a chunk, the offline rule."""
    after = F.lead("name").over(Window.partitionBy("chunk_ord").orderBy("pos"))
    return _said(found.withColumn("target_entity", after).where("target_entity is not null"))


def _said(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("chunk_ord", "pos", F.col("name").alias("source_entity"), "target_entity", F.concat("name", F.lit(" before "), "target_entity").alias("description"), (F.length("name") % 10 + 1).alias("strength"), *more)


def adjacent_in(docs: DataFrame) -> DataFrame:
    """``adjacent`` of the ``mentions`` of whole documents, whose ids differ, with the node ids ``a`` and ``b`` of both ends.

    A document's neighbours lie in its own row, so nothing is shuffled or sorted, and a name is normalised once.
    """
    both = F.transform(F.expr(NAMES), lambda x: F.struct(x.alias("name"), tx.node_id(x).alias("id")))
    names = docs.select(F.col("doc_id").alias("chunk_ord"), F.explode(F.array(both)).alias("_n")).where("size(_n) > 1")
    pairs = F.arrays_zip(F.slice("_n", 1, F.size("_n") - 1).alias("x"), F.slice("_n", 2, F.size("_n") - 1).alias("y"))
    rows = names.select("chunk_ord", F.posexplode(pairs).alias("pos", "_p"))
    return _said(rows.select("chunk_ord", "pos", "_p.x.name", F.col("_p.y.name").alias("target_entity"), F.col("_p.x.id").alias("a"), F.col("_p.y.id").alias("b")), "a", "b")


def linked_in(docs: DataFrame) -> DataFrame:
    """(node_id, least): the node ids of each document that has several, with the smallest of them.

    All names of a document are linked through their neighbours, so ``community.linked`` of these are the components of
    ``adjacent_in``; they have a row for each name and not for each pair.
    """
    ids = F.array_distinct(F.transform(F.array_distinct(F.expr(NAMES)), tx.node_id))
    rows = docs.select(F.explode(F.array(F.filter(ids, lambda x: x != ""))).alias("_ids")).where("size(_ids) > 1")
    return rows.select(F.explode("_ids").alias("node_id"), F.array_min("_ids").alias("least")).distinct()


def merged_rounds(rows: DataFrame, keys: list[Column], by: str = "chunk_id") -> DataFrame:
    """Later rounds add only keys that no round before had; the base round 0 keeps all."""
    first = F.row_number().over(Window.partitionBy(by, *keys).orderBy("round", "pos"))
    return rows.withColumn("_first", first).where((F.col("_first") == 1) | (F.col("round") == 0)).drop("_first")


def normal(name: str) -> Column:
    return F.lower(tx.stripped(name))


def types_of(entities: DataFrame) -> DataFrame:
    """(entity_type, n): how many extracted entities are of each type, the commonest first."""
    return entities.groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type")


def distinct_in_order(rows: DataFrame, key: Column, order: list, by: list[str]) -> DataFrame:
    """The first row of each value of ``key`` in its group, in the order that the group had."""
    rank = F.row_number().over(Window.partitionBy(*by, key).orderBy(*order))
    return rows.withColumn("_first", rank).where("_first = 1").drop("_first")


def batch_result(rows: DataFrame, seconds: float) -> DataFrame:
    """``stats`` of a batch with its success rate (0 for an empty batch), its duration, and chunks a second."""
    found = stats(rows).withColumn("success_rate", F.coalesce(F.try_divide("successful", "total"), F.lit(0.0)))
    return found.withColumns({"elapsed_seconds": F.lit(float(seconds)), "chunks_per_second": F.col("total") / F.lit(seconds) if seconds > 0 else F.lit(0.0)})


def stats(rows: DataFrame) -> DataFrame:
    """Totals over extraction rows (chunk_id, entities, relationships, claims: counts; extraction_completed)."""
    per = lambda c: F.bround(F.try_divide(F.sum(F.when(F.col("extraction_completed"), F.col(c)).otherwise(0)), F.count_if("extraction_completed")), 1)
    total = lambda c: F.sum(F.when(F.col("extraction_completed"), F.col(c)).otherwise(0))
    return rows.agg(F.count("*").alias("total"), F.count_if("extraction_completed").alias("successful"), F.count_if(~F.col("extraction_completed")).alias("failed"), total("entities").alias("entities"), total("relationships").alias("relationships"), total("claims").alias("claims"), per("entities").alias("avg_entities"), per("relationships").alias("avg_relationships"))
