"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontaminate, filter_audit, html_text, line_dedup, packing, simhash, sketches, token_store, toxicity, url_filter, warc_zip, whitening
from .tokens import default_path


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents through ORC files and back."""
    return token_store.digests(spark, common.read(spark, sf_dir, "documents"), default_path())


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with repaired roles, rendered."""
    return chat.repair(common.read(spark, sf_dir, "conversations"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.digests(common.read(spark, sf_dir, "documents"), default_path())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the runs of lines that repeat earlier ones."""
    found = line_dedup.dedup(common.read(spark, sf_dir, "documents").withColumn("before", F.col("text")), report="deleted")
    gone = F.coalesce(F.aggregate("deleted", F.lit(0), lambda n, r: n + r["last"] - r["at"] + 1), F.lit(0))
    return found.select("doc_id", F.size(F.split("before", "\n")).cast("long").alias("n_lines"), gone.cast("long").alias("n_deleted"), "text")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(common.read(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and their components at two or fewer differing bits."""
    return simhash.named(simhash.groups(common.read(spark, sf_dir, "documents")))


def op9_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold-scaled sketches of all documents and of their edited texts."""
    return sketches.compare_with_edits(common.read(spark, sf_dir, "documents"))


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC records in ZIP packages and back."""
    return warc_zip.round_trip(spark, common.read(spark, sf_dir, "pages"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return url_filter.verdicts(common.read(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, by language."""
    return filter_audit.interactions(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened."""
    return whitening.whiten(common.read(spark, sf_dir, "embeddings"))


OPERATORS = (op1_token_orc, op2_chat, op3_toxicity, op4_packing, op5_decontamination, op6_line_dedup, op7_html_text, op8_simhash, op9_sketches, op10_warc_zip, op11_url_filter, op12_filter_audit, op13_whitening)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
SQL: dict[str, str] = {"op6_line_dedup": line_dedup.SQL, "op11_url_filter": url_filter.SQL, "op12_filter_audit": filter_audit.SQL}
