"""Relational operators: search, ranking, joins, merging and grouping.

Each takes and returns DataFrames and leaves the physical choice to Catalyst:
no hint is given, so broadcast joins happen where the run-time size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import ordered
from strandline.session import settle


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows with the text in any column, whatever its case."""
    cells = F.array(*(F.lower(F.col(f"`{c}`").cast("string")) for c in df.columns))
    return df.where(F.exists(cells, lambda x: F.coalesce(x.contains(text.lower()), F.lit(False))))


def drop_internal(df: DataFrame, prefix: str = "_") -> DataFrame:
    """Without the columns whose names start with ``prefix``."""
    return df.select(*(f"`{c}`" for c in df.columns if not c.startswith(prefix)))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; ranks are cut map-side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= k)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``. Aggregates a struct instead of
    sorting each group, so a hot key is combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*order, *(c for c in rest if c not in order)))
    return df.groupBy(*keys).agg(first.alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))


def lookup(items: DataFrame, info: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Left join with the first matching row of ``info``."""
    return items.join(dedupe_first(info, [key], order), key, "left")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New keys are added; known keys only fill what they lack. ``action`` is
    added, filled or kept."""
    values = [c for c in old.columns if c != key]
    a, b = old.alias("a"), new.alias("b")
    gains = [F.col(f"a.{c}").isNull() & F.col(f"b.{c}").isNotNull() for c in values]
    action = F.when(F.col(f"a.{key}").isNull(), "added").when(
        F.col(f"b.{key}").isNotNull() & _any(gains), "filled").otherwise("kept")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in values), action.alias("action"))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, right_at: str, take: Sequence[str]) -> DataFrame:
    """Each left row with the last right row at or before it in its group.

    Both sides are merged into one ordered stream for each group and the right
    values are carried forward, inside blocks and then from block to block, so
    neither all pairs nor a whole group come together. Of right rows at the
    same time the last by the columns taken counts.
    """
    l = left.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).alias("__r"))
    r = right.select(*by, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).alias("__l"), F.struct(F.col(right_at), *take).alias("__r"))
    both = ordered.carried(l.unionByName(r), by, ["__at", "__side", "__r"], "__r", "__held")
    return both.where("__side = 1").select("__l.*", *(F.col(f"__held.{c}").alias(c) for c in [right_at, *take]))


def range_join(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Points within [start, end) of spans of the same group. Both are cut into
    cells of ``width``, which makes the join an equi-join."""
    cell = lambda c: F.floor(F.col(c).cast("double") / width).cast("long")
    p = points.withColumn("__cell", cell(at))
    s = spans.withColumn("__cell", F.explode(F.sequence(cell(start), cell(end))))
    return p.join(s, [*by, "__cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__cell")


def pivot_sum(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], measure: str) -> DataFrame:
    """Sums by rows and one column spread over ``values``, 0 where absent."""
    out = df.groupBy(*rows).pivot(column, list(values)).agg(F.round(F.sum(measure), 2))
    return out.select(*rows, *(F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(f"{column}_{v}".lower()) for v in values))


def allocate_fifo(demand: DataFrame, supply: DataFrame, by: Sequence[str], d_order: Sequence[str], s_order: Sequence[str], d_qty: str, s_qty: str) -> DataFrame:
    """Demand met from supply, first come first served: the columns of both
    sides, where each of their running totals begins and ends (``d_lo, d_hi,
    s_lo, s_hi``), and ``allocated``.

    Running totals make each row an interval, and the intervals of a side tile
    the line. So one sweep over the beginnings of both sides, with the last
    row of either carried forward, meets each overlapping pair once, where the
    later of the two begins.
    """
    def begun(df: DataFrame, order: Sequence[str], qty: str, name: str) -> DataFrame:
        rows = ordered.running_sum(df.where(F.col(qty) > 0), by, order, qty, f"{name}_hi")
        return rows.withColumn(f"{name}_lo", F.col(f"{name}_hi") - F.col(qty))

    d, s = begun(demand, d_order, d_qty, "d"), begun(supply, s_order, s_qty, "s")
    held = {n: [c for c in df.columns if c not in by] for n, df in (("d", d), ("s", s))}
    none = {n: F.lit(None).cast(df.select(F.struct(*held[n]).alias("x")).schema["x"].dataType) for n, df in (("d", d), ("s", s))}
    events = d.select(*by, F.col("d_lo").alias("__at"), F.lit(0).alias("__side"), F.struct(*held["d"]).alias("__d"), none["s"].alias("__s")).unionByName(
        s.select(*by, F.col("s_lo").alias("__at"), F.lit(1).alias("__side"), none["d"].alias("__d"), F.struct(*held["s"]).alias("__s")))
    both = ordered.carried(ordered.carried(events, by, ["__at", "__side"], "__d", "__dd"), by, ["__at", "__side"], "__s", "__ss")
    out = both.where("__dd IS NOT NULL AND __ss IS NOT NULL").select(*by, "__dd.*", "__ss.*")
    got = F.least("d_hi", "s_hi") - F.greatest("d_lo", "s_lo")
    return out.withColumn("allocated", got).where("allocated > 0").dropDuplicates([*by, "d_lo", "s_lo"])


def period_change(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Difference and relative change to the row before."""
    d = ordered.looking_back(df, by, [order], 1, {"__before": lambda w: F.lag(value).over(w)})
    before = F.col("__before")
    return d.withColumn("change", F.col(value) - before).withColumn("pct_change", F.try_divide(F.col(value) - before, before)).drop("__before")


def share_of_total(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Each row's share of its group's total."""
    total = df.groupBy(*by).agg(F.sum(value).alias("__total"))
    return df.join(total, list(by)).withColumn("share", F.try_divide(F.col(value), F.col("__total"))).drop("__total")


def cumulative_share(df: DataFrame, value: str, ties: Sequence[str], buckets: int = 64) -> DataFrame:
    """Running share of the total, largest value first (for ABC classes).

    The order is global, so the rows are range-partitioned by value, the part
    of each row is written down, and only the parts' totals are summed in one
    task, a row each.
    """
    b = settle(df.repartitionByRange(buckets, F.desc(value)).withColumn("__b", F.spark_partition_id()))
    totals = b.groupBy("__b").agg(F.sum(value).alias("__x"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__x").over(ahead), F.lit(0.0))).withColumn("__all", F.sum("__x").over(Window.partitionBy(F.lit(0)))).drop("__x")
    own = Window.partitionBy("__b").orderBy(F.desc(value), *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = b.withColumn("__own", F.sum(value).over(own)).join(totals, "__b")
    return out.withColumn("cum_share", (F.col("__before") + F.col("__own")) / F.col("__all")).drop("__b", "__own", "__before", "__all")
