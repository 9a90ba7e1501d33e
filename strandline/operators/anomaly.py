"""Outliers, change points and drift in ordered or grouped numbers.

Group-wise limits come from one aggregation joined back, percentiles from counts
summed in order (``ordered.percentiles``); order-wise ones from windows inside
blocks or stretches, so no group is one task. The exception is CUSUM, which
starts anew at places that depend on all rows before.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import ordered


def zscore(df: DataFrame, by: Sequence[str], value: str, limit: float = 3.0) -> DataFrame:
    """Rows at least ``limit`` sample deviations from their group's mean."""
    s = df.groupBy(*by).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("sd")).where("sd > 0")
    return df.join(s, list(by)).withColumn("z", (F.col(value) - F.col("m")) / F.col("sd")).where(F.abs("z") >= limit).drop("m", "sd")


def iqr(df: DataFrame, by: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by more than ``k`` interquartile ranges."""
    s = ordered.percentiles(df, by, value, (0.25, 0.75)).select(*by, F.col("p")[0].alias("q1"), F.col("p")[1].alias("q3")).where("q3 > q1")
    j = df.join(s, list(by))
    gap = F.col("q3") - F.col("q1")
    return j.where((F.col(value) < F.col("q1") - k * gap) | (F.col(value) > F.col("q3") + k * gap)).drop("q1", "q3")


def mad(df: DataFrame, by: Sequence[str], value: str, limit: float = 3.5) -> DataFrame:
    """Rows whose modified z-score reaches ``limit``."""
    med = ordered.percentiles(df, by, value, (0.5,)).select(*by, F.col("p")[0].alias("med"))
    off = df.join(med, list(by)).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    scale = ordered.percentiles(off, by, "dev", (0.5,)).select(*by, F.col("p")[0].alias("mad"))
    return off.join(scale, list(by)).withColumn("score", 0.6745 * (F.col(value) - F.col("med")) / F.greatest("mad", F.lit(1e-12))).where(F.abs("score") >= limit).drop("med", "dev", "mad")


def percentile_band(df: DataFrame, by: Sequence[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows outside a percentile band of their group."""
    s = ordered.percentiles(df, by, value, (low, high)).select(*by, F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    return df.join(s, list(by)).where((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi"))).drop("lo", "hi")


def ensemble(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Votes of three detectors on every row: ``votes, confidence``."""
    s = df.groupBy(*by).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("sd")).join(
        ordered.percentiles(df, by, value, (0.25, 0.5, 0.75)).withColumnRenamed("p", "q"), list(by))
    j = df.join(s, list(by)).withColumn("dev", F.abs(F.col(value) - F.col("q")[1]))
    scale = ordered.percentiles(j, by, "dev", (0.5,)).select(*by, F.col("p")[0].alias("mad"))
    gap = F.col("q")[2] - F.col("q")[0]
    vote = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    votes = (
        vote(F.abs(F.try_divide(F.col(value) - F.col("m"), F.col("sd"))) >= 3)
        + vote((gap > 0) & ((F.col(value) < F.col("q")[0] - 1.5 * gap) | (F.col(value) > F.col("q")[2] + 1.5 * gap)))
        + vote(0.6745 * F.col("dev") / F.greatest("mad", F.lit(1e-12)) >= 3.5))
    return j.join(scale, list(by)).withColumn("votes", votes).withColumn("confidence", F.round(F.col("votes") / 3, 4)).drop("m", "sd", "q", "dev", "mad")


def moving_average(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, window: int = 10, limit: float = 2.0) -> DataFrame:
    """Rows at least ``limit`` deviations from the rows before them."""
    over = lambda f: lambda w: f(value).over(w.rowsBetween(-window, -1))
    scored = ordered.looking_back(df, by, order, window, {"m": over(F.avg), "sd": over(F.stddev_samp), "k": over(F.count)})
    return scored.where((F.col("k") == window) & (F.col("sd") > 0) & (F.abs(F.col(value) - F.col("m")) / F.col("sd") >= limit)).drop("m", "sd", "k")


def cusum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, limit: float = 4.0, drift: float = 0.0) -> DataFrame:
    """Alarms of the two-sided cumulative sum of standardised values, which
    starts anew after each: the rows, with ``direction``.

    The sum depends on every row before, so a group is one task; its mean and
    deviation come from an aggregation before."""
    s = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__sd")).where("__sd > 0")
    j = df.join(s, list(by)).withColumn("__z", (F.col(value) - F.col("__m")) / F.col("__sd")).drop("__m", "__sd")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        up = down = 0.0
        out = []
        for z in pdf["__z"].to_numpy():
            up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
            hit = 1 if up > limit else -1 if down > limit else 0
            if hit:
                up = down = 0.0
            out.append(hit)
        pdf = pdf.drop(columns="__z").assign(direction=np.array(out, np.int32))
        return pdf[pdf["direction"] != 0]

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*j.drop("__z").columns).dtypes) + ", direction int"
    return j.groupBy(*by).applyInPandas(run, schema)


def ks_two_sample(a: DataFrame, b: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Largest distance of the empirical distributions of two samples, by
    group: ``n_a, n_b, ks``. Equal values are counted together."""
    both = a.select(*by, F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*by, F.col(value).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    c = both.where("v IS NOT NULL").groupBy(*by, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = c.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    up = ordered.running_sum(ordered.running_sum(c, by, ["v"], "a", "ra"), by, ["v"], "b", "rb")
    d = up.join(total, list(by)).withColumn("d", F.abs(F.col("ra") / F.col("na") - F.col("rb") / F.col("nb")))
    return d.groupBy(*by).agg(F.max("na").alias("n_a"), F.max("nb").alias("n_b"), F.round(F.max("d"), 6).alias("ks"))


def drift_score(base: DataFrame, current: DataFrame, by: Sequence[str], value: str, bins: int = 20) -> DataFrame:
    """Divergence of a current histogram from the base's, in its bins and
    capped at 1: ``drift``."""
    lim = base.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * bins))).cast("int")
    hist = lambda d, n: d.join(lim, list(by)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias(n))
    j = hist(base, "p").join(hist(current, "q"), [*by, "bin"], "full")
    g = Window.partitionBy(*by)
    p, q = F.coalesce("p", F.lit(0)) + 1e-6, F.coalesce("q", F.lit(0)) + 1e-6
    k = j.withColumn("pp", p / F.sum(p).over(g)).withColumn("qq", q / F.sum(q).over(g))
    return k.groupBy(*by).agg(F.round(F.least(F.lit(1.0), F.sum(F.col("pp") * F.log(F.col("pp") / F.col("qq"))) / float(np.log(bins))), 6).alias("drift"))


def mean_breaks(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The split of each ordered group that lowers the squared error most, from
    running sums: ``at`` rows before the break, ``gain`` relative to all."""
    total = df.groupBy(*by).agg(F.count("*").alias("nn"), F.sum(value).alias("ss"), (F.var_pop(value) * F.count("*")).alias("tot"))
    placed = ordered.indexed(df, by, order, "n").withColumn("n", F.col("n") + 1)
    d = ordered.running_sum(placed, by, ["n"], value, "s").join(total, list(by)).where((F.col("n") < F.col("nn")) & (F.col("tot") > 0))
    between = F.pow(F.col("s") / F.col("n") - (F.col("ss") - F.col("s")) / (F.col("nn") - F.col("n")), 2) * F.col("n") * (F.col("nn") - F.col("n")) / F.col("nn")
    return d.withColumn("gain", F.round(between / F.col("tot"), 6)).groupBy(*by).agg(F.max_by(F.struct(F.col("n").alias("at"), "gain"), F.struct("gain", -F.col("n"))).alias("b")).select(*by, F.col("b.at").cast("bigint").alias("at"), "b.gain")


def grubbs(df: DataFrame, by: Sequence[str], key: str, value: str, alpha: float = 0.05, most: int = 10) -> DataFrame:
    """Outliers by Grubbs' test, one at a time: ``by, key, value, round``.

    Only the ``most`` values farthest from the centre at either end can fall,
    so a group reaches its test as its moments and these; everything else stays
    in the cluster."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).withColumn("lo", F.row_number().over(w.orderBy(F.asc(value), key))).withColumn("hi", F.row_number().over(w.orderBy(F.desc(value), key)))
    ends = ranked.where((F.col("lo") <= most) | (F.col("hi") <= most)).groupBy(*by).agg(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col(key).cast("long").alias("k"))).alias("ends"))
    sums = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("var"))

    def test(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                n, s, q = r["n"], r["n"] * r["m"], r["n"] * (r["var"] + r["m"] ** 2)
                left = sorted((e["v"], e["k"]) for e in r["ends"])
                for turn in range(1, most + 1):
                    if n < 3 or not left:
                        break
                    m = s / n
                    sd = np.sqrt(max(q - n * m * m, 0) / (n - 1))
                    v, k = max(left, key=lambda e: (abs(e[0] - m), -e[1]))
                    t = _student(alpha / (2 * n), n - 2)
                    if sd == 0 or abs(v - m) / sd <= (n - 1) / np.sqrt(n) * np.sqrt(t * t / (n - 2 + t * t)):
                        break
                    rows.append((*(r[b] for b in by), k, v, turn))
                    left.remove((v, k))
                    n, s, q = n - 1, s - v, q - v * v
            if rows:
                yield pd.DataFrame(rows, columns=[*by, key, value, "round"])

    types = dict(df.dtypes)
    return sums.join(ends, list(by)).mapInPandas(test, ", ".join(f"`{b}` {types[b]}" for b in by) + f", `{key}` long, `{value}` double, round int")


def _student(p: float, free: float) -> float:
    """Upper quantile of Student's distribution, by bisection of its tail."""
    from math import lgamma

    c = np.exp(lgamma((free + 1) / 2) - lgamma(free / 2)) / np.sqrt(free * np.pi)
    # Substituting x = tan(u) makes the tail a finite integral.
    def tail(x: float) -> float:
        u = np.linspace(np.arctan(x / np.sqrt(free)), np.pi / 2, 2001)
        f = np.cos(u) ** (free - 1)
        h = (u[1] - u[0]) / 3
        return float(c * np.sqrt(free) * h * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()))

    lo, hi = 0.0, 1e3
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > p else (lo, mid)
    return (lo + hi) / 2


def sequence_profile(df: DataFrame, by: Sequence[str], order: Sequence[str], item: str) -> DataFrame:
    """Shape of each sequence: length, share of distinct items, entropy of
    items and of steps in bits, share of repeats."""
    w = Window.partitionBy(*by).orderBy(*order)
    s = df.where(F.col(item).isNotNull()).withColumn("before", F.lag(item).over(w))
    bits = lambda c, name: c.groupBy(*by).agg((F.log2(F.sum("k")) - F.sum(F.col("k") * F.log2("k")) / F.sum("k")).alias(name))
    items = s.groupBy(*by, item).agg(F.count("*").alias("k"))
    steps = s.where("before IS NOT NULL").groupBy(*by, "before", item).agg(F.count("*").alias("k"))
    base = s.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("before") == F.col(item)).cast("double")).alias("rep"))
    distinct = items.groupBy(*by).agg(F.count("*").alias("d"))
    j = base.join(distinct, list(by)).join(bits(items, "h"), list(by)).join(bits(steps, "ht"), list(by), "left")
    return j.select(*by, "n", F.round(F.col("d") / F.col("n"), 6).alias("unique_ratio"), F.round("h", 6).alias("entropy"), F.round(F.coalesce("ht", F.lit(0.0)), 6).alias("step_entropy"), F.round(F.coalesce("rep", F.lit(0.0)), 6).alias("repeat_rate"))
