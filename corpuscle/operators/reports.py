"""Community contexts and reports, and the map and reduce steps of a global question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsons as js
from ..functions import text as tx
from .chunking import fill, leading


#: What the title of a report that could not be read ends with (a fixed value).
FAILED = " (generation failed)"


def _lines(rows: DataFrame, by: str, order: list, text: str, name: str, separator: str = "\n\n") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_rank", rank).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", text))), lambda x: x[text]), separator).alias(name))


def raw_context(membership: DataFrame, nodes: DataFrame, edges: DataFrame, internal: DataFrame, budget: int | None = None) -> DataFrame:
    """(community_id, raw): entities in order of their ids, then relationships by combined degree.

    With ``budget``, entities and relationships that begin beyond so many tokens are left out before a community's text
    comes together. What is cut to that budget afterwards is the same, and so is whether it has to be cut.
    """
    said = F.when(F.size("claims") > 0, F.concat(F.lit("\nClaims: "), F.array_join(F.slice("claims", 1, 3), " "))).otherwise("")
    entry = F.concat(F.lit("Entity: "), "name", F.lit("\nType: "), "entity_type", F.lit("\nDescription: "), "description", said)
    rows = membership.select("community_id", "node_id").join(nodes.select("node_id", "name", "entity_type", "description", "claims"), "node_id")
    rows = rows.select("community_id", "node_id", entry.alias("entry"))
    if budget is not None:
        rows = leading(rows, tx.count_tokens("entry"), budget, ["node_id"], ["community_id"])
    entities = _lines(rows, "community_id", ["node_id"], "entry", "entities")
    names = nodes.select("node_id", "name")
    rel = internal.select("community_id", "src", "dst").join(edges.select("src", "dst", "weight", "description", "combined_degree", "first_ord"), ["src", "dst"])
    rel = rel.join(names.select(F.col("node_id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("node_id").alias("dst"), F.col("name").alias("b")), "dst")
    line = F.concat(F.lit("Relationship: "), "a", F.lit(" ↔ "), "b", F.lit("\nStrength: "), F.format_string("%.1f", "weight"), F.lit("\nDescription: "), "description")
    order = [F.desc("combined_degree"), "first_ord", "src", "dst"]
    rel = rel.select("community_id", "combined_degree", "first_ord", "src", "dst", line.alias("line"))
    if budget is not None:
        rel = leading(rel, tx.count_tokens("line"), budget, order, ["community_id"])
    links = _lines(rel, "community_id", order, "line", "links")
    both = membership.groupBy("community_id").agg(F.count("*").alias("n")).join(entities, "community_id", "left").join(links, "community_id", "left")
    # the heads of the two parts are fixed values
    parts = F.concat_ws("\n\n", F.concat(F.lit("## Entities\n"), "entities"), F.concat(F.lit("## Relationships\n"), "links"))
    return both.select("community_id", F.when(parts == "", F.concat(F.lit("Community: "), "community_id", F.lit("\nNodes: "), F.col("n").cast("string"))).otherwise(parts).alias("raw"))


def sub_context(links: DataFrame, reports: DataFrame) -> DataFrame:
    """(community_id, sub): the reports of a community's children, in their order."""
    block = F.concat(F.lit("### "), "title", F.lit("\nLevel: "), "level", F.lit("\nSummary: "), "summary", F.lit("\nImpact Rating: "), F.format_string("%.1f", "impact_rating"))
    rows = links.join(reports.withColumnRenamed("community_id", "child"), "child").withColumn("block", block)
    found = _lines(rows, "parent", ["child"], "block", "blocks")
    # the head is a fixed value
    head = F.concat(F.lit("## Sub-community Summaries for "), "parent")
    return links.select("parent").distinct().join(found, "parent", "left").select(F.col("parent").alias("community_id"), F.concat_ws("\n\n", head, "blocks").alias("sub"))


def chosen_context(raw: DataFrame, sub: DataFrame, budget: int, any_reports: bool = True) -> DataFrame:
    """(community_id, context, was_truncated, used_sub): raw if it fits, else the children's reports, cut if need be, else raw cut."""
    rows = raw.join(sub, "community_id", "left").withColumn("rt", tx.tokens("raw")).withColumn("st", tx.tokens("sub"))
    children = F.col("sub").isNotNull() & F.lit(any_reports)
    fits, sub_fits = F.size("rt") <= budget, F.size("st") <= budget
    text = F.when(fits, F.col("raw")).when(children, tx.truncated(F.col("sub"), F.col("st"), budget, "")).otherwise(tx.truncated(F.col("raw"), F.col("rt"), budget, ""))
    return rows.select("community_id", text.alias("context"), (~fits & F.when(children, ~sub_fits).otherwise(True)).alias("was_truncated"), (~fits & children).alias("used_sub"))


def map_context(reports: DataFrame, window: int = 8000, reserve: int = 500) -> DataFrame:
    """(community_id, context): a report as the map step reads it."""
    findings = F.transform("findings", lambda f: F.concat(F.lit("- "), f["summary"], F.when(f["explanation"] != "", F.concat(F.lit(" ("), f["explanation"], F.lit(")"))).otherwise("")))
    text = F.concat(F.lit("Community: "), "title", F.lit("\nImpact Rating: "), F.format_string("%.1f", "impact_rating"), F.lit("/10\n\nSummary:\n"), "summary", F.lit("\n\nKey Findings:"), F.when(F.size("findings") > 0, F.concat(F.lit("\n"), F.array_join(findings, "\n"))).otherwise(""))
    rows = reports.withColumn("_text", text).withColumn("_toks", tx.tokens("_text"))
    return rows.select("community_id", tx.truncated(F.col("_text"), F.col("_toks"), window - reserve).alias("context"))


def map_points(responses: DataFrame, key: str = "community_id") -> DataFrame:
    """(key, pos, description, score 0..100) of the points in JSON responses; whatever cannot be read gives none."""
    v = js.parsed("response")
    rows = responses.select(key, v.alias("v")).where(js.is_object(F.col("v")))
    rows = rows.select(key, F.try_variant_get("v", "$.points", "variant").alias("points")).where(js.is_array(F.col("points")))
    rows = rows.select(key, F.posexplode(F.col("points").cast("array<variant>")).alias("pos", "item")).where(js.is_object(F.col("item")))
    score = F.try_variant_get("item", "$.score", "variant")
    rows = rows.select(key, "pos", tx.stripped(F.coalesce(F.try_variant_get("item", "$.description", "string"), F.lit(""))).alias("description"), js.whole(score, 0, 0, 100).alias("score"))
    return rows.where("description <> ''")


def helpful(points: DataFrame, threshold: int = 0) -> DataFrame:
    return points.where(F.col("score") > threshold)


def map_totals(metrics: DataFrame, contexts: DataFrame, key: str = "community_id") -> DataFrame:
    """One row: communities, points, helpful points, and the context tokens of communities with a helpful point."""
    rows = metrics.join(contexts.select(key, tx.count_tokens("context").alias("_tokens")), key, "left")
    used = F.when(F.col("helpful") > 0, F.coalesce("_tokens", F.lit(0))).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(F.count("*").alias("communities"), total("points").alias("points"), total("helpful").alias("helpful"), total(used).alias("context_tokens"))


def map_metrics(communities: DataFrame, points: DataFrame, threshold: int = 0, key: str = "community_id") -> DataFrame:
    """Of each community: points, helpful ones, best score (0 if none) and the first three helpful points as bullets."""
    good = F.col("score") > threshold
    rows = points.groupBy(key).agg(
        F.count("*").alias("points"), F.count_if(good).alias("helpful"), F.max(F.when(good, F.col("score"))).alias("best"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(good, F.struct("pos", "description")))), 1, 3), lambda x: F.concat(F.lit("- "), x["description"])), "\n").alias("partial"),
    )
    rows = communities.select(key).join(rows, key, "left")
    return rows.select(key, F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("helpful", F.lit(0)).alias("helpful"), F.coalesce("best", F.lit(0)).alias("best"), F.nullif("partial", F.lit("")).alias("partial"))


def reduce_context(points: DataFrame, budget: int, by: list[str] | None = None, key: str = "community_id") -> DataFrame:
    """Numbered lines of the points by score, as many as fit: rank, line, used."""
    # a line's number and score are three tokens, however large they are, so points are cut before they are numbered
    cost = tx.count_tokens("description") + 3
    kept = fill(points, cost, budget, [F.desc("score"), key, "pos"], by)
    return kept.withColumn("line", F.concat(F.col("rank").cast("string"), F.lit(". [Score: "), F.col("score").cast("string"), F.lit("] "), "description"))


def parsed_reports(responses: DataFrame) -> DataFrame:
    """Reports from JSON responses (community_id, level, node_count, response); what cannot be read gives a stand-in of rating 0."""
    v = F.col("v")
    text = lambda path, default: F.coalesce(F.try_variant_get("v", path, "string"), default)
    rows = responses.withColumn("v", js.parsed("response"))
    ok = F.coalesce(js.is_object(v), F.lit(False))
    items = F.coalesce(F.slice(F.try_variant_get("v", "$.findings", "array<variant>"), 1, 10), F.array().cast("array<variant>"))
    rows = rows.withColumn("ok", ok).withColumn("items", items)
    finding = lambda x, i: F.struct(i.alias("finding_id"), F.coalesce(F.try_variant_get(x, "$.summary", "string"), F.lit("")).alias("summary"), F.coalesce(F.try_variant_get(x, "$.explanation", "string"), F.lit("")).alias("explanation"), js.is_object(x).alias("is"))
    found = F.transform(F.filter(F.transform("items", finding), lambda x: x["is"]), lambda x: F.struct(x["finding_id"].alias("finding_id"), x["summary"].alias("summary"), x["explanation"].alias("explanation")))
    one = lambda s, e: F.array(F.struct(F.lit(0).alias("finding_id"), s.alias("summary"), e.alias("explanation")))
    none = one(F.lit("Members"), F.concat(F.lit("Community "), "community_id", F.lit(" contains "), F.col("node_count").cast("string"), F.lit(" entities.")))
    failed = one(F.lit("No findings"), F.lit("The response held no JSON object."))
    rows = rows.withColumn("found", found)
    return rows.select(
        "community_id",
        F.when(F.col("ok"), text("$.title", F.concat(F.lit("Community "), "community_id"))).otherwise(F.concat(F.lit("Community "), "community_id", F.lit(FAILED))).alias("title"),
        F.when(F.col("ok"), text("$.summary", F.lit(""))).otherwise(F.concat(F.lit("There is no report on "), "community_id", F.lit(" yet: the response held no JSON object."))).alias("summary"),
        F.when(F.col("ok"), js.real(F.try_variant_get("v", "$.rating", "variant"), 5.0, 0.0, 10.0)).otherwise(F.lit(0.0)).alias("impact_rating"),
        F.when(F.col("ok"), text("$.rating_explanation", F.lit(""))).otherwise(F.lit("Not rated.")).alias("rating_explanation"),
        F.when(~F.col("ok"), failed).when(F.size("found") == 0, none).otherwise(F.col("found")).alias("findings"),
    )


def report_stats(reports: DataFrame) -> DataFrame:
    return reports.groupBy("level").agg(F.count("*").alias("reports"), F.bround(F.avg("context_tokens"), 0).alias("avg_context_tokens"), F.bround(F.avg(F.size("findings")), 1).alias("avg_findings"), F.count_if("was_truncated").alias("truncated"), F.bround(F.count_if("was_truncated") / F.count("*"), 3).alias("truncation_rate"))


def level_counts(communities: DataFrame) -> DataFrame:
    return communities.groupBy("level").agg(F.countDistinct("community_id").alias("communities")).orderBy("level")


def preview(text: Column, n: int = 200) -> Column:
    return F.left(text, F.lit(n))
