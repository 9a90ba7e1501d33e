"""Queries of the training-data operators that concern records in general."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import nested, packed, spikes, timestamps
from strandline.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings their own source could not have produced. Longer excursions and
    changes of level are no cases; ``p1_reasons`` has them."""
    found = spikes.flag_readings(table(spark, sf_dir, "series"))
    return found.where(F.col("reason").isin("spike", "frozen", "impossible")).select("obs_id").distinct()


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implausible readings counted by source and reason."""
    return spikes.flag_readings(table(spark, sf_dir, "series")).groupBy("name", "reason").count().withColumnRenamed("count", "n")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of reports and of volunteer answers."""
    return nested.report_children(table(spark, sf_dir, "reports")).unionByName(
        nested.volunteer_children(table(spark, sf_dir, "volunteers")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant in UTC of every time of pages and tasks."""
    pages = timestamps.page_values(table(spark, sf_dir, "pages"), table(spark, sf_dir, "sites"))
    return timestamps.instants(pages.unionByName(timestamps.task_values(table(spark, sf_dir, "tasks"))))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of tags, subjects and keywords, with their place."""
    volunteers, icons = table(spark, sf_dir, "volunteers"), table(spark, sf_dir, "icons")
    return (
        packed.split_packed(volunteers, "volunteers.tags", "response_id", "tags")
        .unionByName(packed.split_packed(volunteers, "volunteers.subjects", "response_id", "subjects"))
        .unionByName(packed.split_packed(icons, "icons.keywords", "icon_no", "keywords"))
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p5_found, p6_found, p7_found)}
ORACLE: dict[str, str] = {}
