"""Order-wise operators that never put a group into one task.

Rows are range-partitioned by group and order, so a group that holds a third of
all rows is cut into blocks. Only one row for each block, its count or sum, is
put in order by a window; everything else is a window inside a block.

``order`` must tell rows of a group apart where the result depends on ties.
The blocks are settled, as their bounds come from a sample that a second run of
the plan need not repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import settle

#: Rows of a stretch for operators that look back a few rows.
STRETCH = 4096


def blocks(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``__block``: rows of a group in ascending blocks of its order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in [*by, *order]]
    return settle(df.repartitionByRange(n, *keys).withColumn("__block", F.spark_partition_id()))


def _before(totals: DataFrame, by: Sequence[str], column: str, zero: Column) -> DataFrame:
    """Sum of ``column`` over the blocks before each."""
    ahead = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("__ahead", F.coalesce(F.sum(column).over(ahead), zero)).drop(column)


def _same(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group and block, null groups with themselves."""
    other = b.select(*(F.col(c).alias(f"__o_{c}") for c in by), F.col("__block").alias("__o_block"), *(c for c in b.columns if c not in (*by, "__block")))
    on = F.col("__block") == F.col("__o_block")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    return a.join(other, on, how).drop("__o_block", *(f"__o_{c}" for c in by))


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and with each row of its group."""
    b = blocks(df, by, order)
    zero = F.lit(0).cast(dict(df.agg(F.sum(value).alias("x")).dtypes)["x"])
    totals = _before(b.groupBy(*by, "__block").agg(F.sum(value).alias("__x")), by, "__x", zero)
    own = Window.partitionBy(*by, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _same(b.withColumn("__own", F.sum(value).over(own)), totals, by).withColumn(out, F.col("__ahead") + F.coalesce("__own", zero)).drop("__own", "__ahead", "__block")


def indexed(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "__pos") -> DataFrame:
    """Add ``out``: the place of each row in its group, from 0."""
    b = blocks(df, by, order)
    totals = _before(b.groupBy(*by, "__block").agg(F.count("*").alias("__x")), by, "__x", F.lit(0).cast("long"))
    own = Window.partitionBy(*by, "__block").orderBy(*order)
    return _same(b.withColumn("__own", F.row_number().over(own)), totals, by).withColumn(out, F.col("__ahead") + F.col("__own") - 1).drop("__own", "__ahead", "__block")


def looking_back(df: DataFrame, by: Sequence[str], order: Sequence[str], reach: int, columns: dict, size: int = STRETCH) -> DataFrame:
    """Add columns over frames of at most ``reach`` rows back: each is given
    the window of a stretch. Groups are cut into stretches by place, and the
    last rows of a stretch are copied to the next."""
    if reach >= size:
        raise ValueError("the reach of a frame must be below the size of a stretch")
    d = indexed(df, by, order)
    here = F.floor(F.col("__pos") / size).cast("long")
    d = d.withColumn("__stretch", F.explode(F.array_compact(F.array(here, F.when(F.col("__pos") % size >= size - reach, here + 1)))))
    w = Window.partitionBy(*by, "__stretch").orderBy("__pos")
    for name, build in columns.items():
        d = d.withColumn(name, build(w))
    return d.where(F.col("__stretch") == here).drop("__stretch", "__pos")


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the last non-null ``value`` up to and with each row."""
    b = blocks(df, by, order)
    last = b.where(F.col(value).isNotNull()).groupBy(*by, "__block").agg(F.max_by(value, F.struct(*order)).alias("__c_last"))
    held = _same(b.select(*by, "__block").distinct(), last, by, "left")
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__c_held", F.last("__c_last", ignorenulls=True).over(before)).drop("__c_last")
    own = Window.partitionBy(*by, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _same(b.withColumn("__c_own", F.last(value, ignorenulls=True).over(own)), held, by).withColumn(out, F.coalesce("__c_own", "__c_held")).drop("__c_own", "__c_held", "__block")


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Linear percentiles of each group: ``by, p`` (an array in the order of
    ``shares``). Equal values are counted first, the counts are summed in
    order, and each percentile lies between the two counted values that its
    rank falls on; no group is gathered. Nulls do not count."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__k"))
    up = running_sum(counts, by, ["__v"], "__k", "__upto")
    total = counts.groupBy(*by).agg(F.sum("__k").alias("__n"))
    on = [F.col(c).eqNullSafe(F.col(f"__t_{c}")) for c in by]
    t = total.select(*(F.col(c).alias(f"__t_{c}") for c in by), "__n")
    joined = up.join(t, on) if on else up.crossJoin(F.broadcast(t))  # one row
    ranks = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(s) * (F.col("__n") - 1)).alias("r")) for i, s in enumerate(shares)))
    first = F.col("__upto") - F.col("__k")  # ranks first .. upto - 1 have the value
    parts = joined.select(*by, "__v", first.alias("__a"), F.col("__upto").alias("__b"), F.explode(ranks).alias("x")).where(
        ((F.floor("x.r") >= F.col("__a")) & (F.floor("x.r") < F.col("__b"))) | ((F.ceil("x.r") >= F.col("__a")) & (F.ceil("x.r") < F.col("__b"))))
    ends = parts.groupBy(*by, F.col("x.i").alias("i"), F.col("x.r").alias("r")).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("r") - F.floor("r"))
    return ends.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", at.alias("v")))), lambda s: s["v"]).alias("p"))
