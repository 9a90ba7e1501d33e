"""Sources: files with stated or inferred schemas, and series of any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import ordered


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A file or folder by its ending: parquet, orc, csv, json, xml or text.

    CSV has a header; without ``schema`` its cells stay text.
    """
    kind = path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.options(**options)
    if schema is not None and kind not in ("parquet", "orc"):
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind in ("json", "jsonl", "ndjson"):
        return (reader if kind != "json" else reader.option("multiLine", True)).json(path)
    if kind == "xml":
        return reader.option("rowTag", options.get("rowTag", "item")).xml(path)
    if kind in ("txt", "log"):
        return reader.text(path)
    return reader.format("orc" if kind == "orc" else "parquet").load(path)


def as_series(df: DataFrame, value: str, date: str, name: str | None = None) -> DataFrame:
    """``name, t, ts, value``: rows whose value and date can be read, in order
    of date; ``t`` counts from 0 within the name."""
    ts = F.coalesce(*(F.try_to_timestamp(F.col(date).cast("string"), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")), F.col(date).try_cast("timestamp"))
    label = F.lit(value) if name is None else F.col(name)
    read = df.select(label.alias("name"), ts.alias("ts"), F.col(value).try_cast("double").alias("value")).where("ts IS NOT NULL AND value IS NOT NULL")
    return ordered.indexed(read, ["name"], ["ts", "value"], "t")


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Wide columns as several series in long form."""
    return df.unpivot(list(ids), list(values), "name", "value")


def infer_series_columns(df: DataFrame, least: float = 0.7) -> tuple[str | None, str | None]:
    """The first column named like a date, and the first other column of which
    at least ``least`` of the filled cells are numbers, from one aggregation."""
    date = next((c for c in df.columns if "date" in c.lower() or "time" in c.lower()), None)
    rest = [c for c in df.columns if c != date]
    if not rest:
        return date, None
    shares = df.agg(*(F.avg(F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`").cast("string").try_cast("double").isNotNull().cast("double"))).alias(f"s{i}") for i, c in enumerate(rest))).first()
    return date, next((c for i, c in enumerate(rest) if (shares[i] or 0) >= least), None)
