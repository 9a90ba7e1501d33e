"""Queries of the operators on text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import abuse, boilerplate, leaks, lookalike, mojibake, packing
from strandline.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article blocks of every page."""
    return boilerplate.main_blocks(table(spark, sf_dir, "pages"), table(spark, sf_dir, "parsed"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and extracted fields that hold garbled text."""
    return mojibake.garbled(table(spark, sf_dir, "pages"), table(spark, sf_dir, "extracted"))


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled text, restored where it still can be."""
    return mojibake.restored(table(spark, sf_dir, "pages"), table(spark, sf_dir, "extracted"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of values made of other characters than they look."""
    return lookalike.deviating(table(spark, sf_dir, "extracted"), table(spark, sf_dir, "volunteers"))


def p4_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviating values in one form."""
    return lookalike.normalised(table(spark, sf_dir, "extracted"), table(spark, sf_dir, "volunteers"))


def p8_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of its pieces, for each capacity."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    containers = table(spark, sf_dir, "containers")
    return packing.fill(packing.pack(table(spark, sf_dir, "documents"), containers), containers)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items whose passage a document holds."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return abuse.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "flag_samples"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of such content by source and category."""
    return abuse.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "flag_samples"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_restored, p4_found, p4_normalised, p8_assigned, p8_fill, p9_found, p10_found, p10_rates)}
ORACLE: dict[str, str] = {}
