"""Order books and causal strata as relational plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def call_auction(orders: DataFrame, by: Sequence[str]) -> DataFrame:
    """The price at which most is traded, the lowest on ties: ``price, volume``
    for each book, from ``side, price, qty``.

    Both curves are running sums over the distinct prices of a book, which are
    far fewer than its orders."""
    level = orders.where("price IS NOT NULL AND qty > 0").groupBy(*by, "price").agg(
        F.sum(F.when(F.col("side") == "buy", F.col("qty")).otherwise(0.0)).alias("b"), F.sum(F.when(F.col("side") == "sell", F.col("qty")).otherwise(0.0)).alias("s"))
    up = Window.partitionBy(*by).orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.desc("price")).rowsBetween(Window.unboundedPreceding, 0)
    traded = level.withColumn("volume", F.least(F.sum("b").over(down), F.sum("s").over(up)))
    return traded.groupBy(*by).agg(F.max_by(F.struct("price", "volume"), F.struct("volume", -F.col("price"))).alias("x")).select(*by, "x.price", "x.volume")


def walk_book(levels: DataFrame, by: Sequence[str], size: float) -> DataFrame:
    """What buying ``size`` out of the book's asks costs: ``filled, average``."""
    w = Window.partitionBy(*by).orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    taken = F.greatest(F.lit(0.0), F.least(F.col("qty"), F.lit(float(size)) - (F.col("cum") - F.col("qty"))))
    walked = levels.withColumn("cum", F.sum("qty").over(w)).withColumn("take", taken)
    return walked.groupBy(*by).agg(F.round(F.sum("take"), 6).alias("filled"), F.round(F.try_divide(F.sum(F.col("take") * F.col("price")), F.sum("take")), 6).alias("average"))


def adjusted_effect(df: DataFrame, treatment: str, outcome: str, strata: Sequence[str]) -> DataFrame:
    """Mean outcome under each treatment, adjusted for the strata: the sum over
    strata of the mean in it times its share; strata a treatment lacks are
    skipped."""
    ok = df.where(F.col(treatment).isNotNull() & F.col(outcome).isNotNull())
    cell = ok.groupBy(treatment, *strata).agg(F.avg(outcome).alias("m"))
    share = ok.groupBy(*strata).agg(F.count("*").alias("k"))
    n = share.agg(F.sum("k").alias("n")).withColumn("one", F.lit(1))
    j = cell.join(share, list(strata)).withColumn("one", F.lit(1)).join(n, "one")
    plain = ok.groupBy(treatment).agg(F.round(F.avg(outcome), 4).alias("plain"))
    return j.groupBy(treatment).agg(F.round(F.sum(F.col("m") * F.col("k") / F.col("n")), 4).alias("adjusted")).join(plain, treatment)


def topsis(df: DataFrame, key: str, criteria: dict[str, tuple[float, bool]]) -> DataFrame:
    """Closeness of each row to the best values of weighted criteria
    (``column: (weight, larger is better)``): ``key, closeness``."""
    names = list(criteria)
    norm = df.agg(*(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"n_{c}") for c in names), *(F.max(c).alias(f"hi_{c}") for c in names), *(F.min(c).alias(f"lo_{c}") for c in names)).withColumn("one", F.lit(1))
    j = df.withColumn("one", F.lit(1)).join(norm, "one")
    far = lambda best: F.sqrt(sum((F.pow(F.try_divide((F.col(c) - F.col(("hi_" if up == best else "lo_") + c)), F.col(f"n_{c}")) * w, 2) for c, (w, up) in criteria.items()), F.lit(0.0)))
    return j.select(key, F.round(F.try_divide(far(False), far(True) + far(False)), 6).alias("closeness"))


def expand_references(items: DataFrame, seeds: DataFrame, per_seed: int) -> DataFrame:
    """What seeds point to, at most ``per_seed`` in order for each, without the
    seeds: ``id, sources``; ``items`` has ``id, refs`` (an array)."""
    out = items.join(seeds.select("id"), "id", "left_semi").select(F.col("id").alias("seed"), F.explode(F.slice(F.array_distinct("refs"), 1, per_seed)).alias("id"))
    return out.join(seeds.select("id"), "id", "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("seed")).alias("sources"))
