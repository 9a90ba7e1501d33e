"""Series in long form ``(name, t, value)`` with ``t`` a dense index.

A name may hold a third of all points, so ordered operators never put a name
into one task. ``stretched`` cuts names into stretches by index and copies the
last ``reach`` points of a stretch to the next one, so that any frame of that
reach is whole; prefix operators (running maximum and sum) combine stretch
totals, of which there are few, with a window inside the stretch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import ordered

STRETCH = 4096


def clean(series: DataFrame, unit: str | None = None) -> DataFrame:
    """``name, t, value``: finite points, repeats once, positive for prices."""
    v = F.col("close_value")
    ok = series.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & F.col("name").isNotNull() & F.col("t").isNotNull())
    if unit is not None:
        ok = ok.where(F.col("unit") == unit)
    if unit == "price":
        ok = ok.where(v > 0)
    return ok.groupBy("name", "t").agg(F.min("close_value").alias("value"), F.min("ts").alias("ts"))


def stretched(df: DataFrame, reach: int, size: int = STRETCH) -> DataFrame:
    """Add ``stretch`` and ``core``: a point is in the core of its own stretch
    and, if near its end, in the margin of the next."""
    if reach >= size:
        raise ValueError("the reach of a frame must be below the size of a stretch")
    own = F.floor(F.col("t") / size).cast("long")
    copies = F.array_compact(F.array(own, F.when(F.col("t") % size >= size - reach, own + 1)))
    return df.withColumn("own", own).withColumn("stretch", F.explode(copies)).withColumn("core", F.col("own") == F.col("stretch")).drop("own")


def framed(df: DataFrame, reach: int, columns: dict[str, Callable[[Window], Column]]) -> DataFrame:
    """Columns over frames that look back at most ``reach`` points; each is
    given the window of a stretch."""
    w = Window.partitionBy("name", "stretch").orderBy("t")
    out = stretched(df, reach)
    for name, build in columns.items():
        out = out.withColumn(name, build(w))
    return out.where("core").drop("core", "stretch")


def previous(df: DataFrame, column: str, lag: int = 1) -> DataFrame:
    """Add ``before``: the value ``lag`` indices earlier, null in a gap."""
    pick = lambda w: F.max(column).over(w.rangeBetween(-lag, -lag))
    return framed(df, lag, {"before": pick})


def log_returns(df: DataFrame) -> DataFrame:
    """``name, t, ts, r``: differences of logarithms of neighbouring points."""
    return previous(df, "value").where("before IS NOT NULL").select("name", "t", "ts", F.log(F.col("value") / F.col("before")).alias("r"))


def running(df: DataFrame, column: str, how: Callable[[Column | str], Column], combine: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """A prefix aggregate along each name, from stretch totals."""
    s = df.withColumn("stretch", F.floor(F.col("t") / STRETCH).cast("long"))
    total = s.groupBy("name", "stretch").agg(how(column).alias("x"))
    before = total.withColumn("carried", how("x").over(Window.partitionBy("name").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))).drop("x")
    own = how(column).over(Window.partitionBy("name", "stretch").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("own", own).join(before, ["name", "stretch"]).withColumn(
        out, F.when(F.col("carried").isNull(), F.col("own")).otherwise(combine(F.col("carried"), F.col("own")))).drop("stretch", "own", "carried")


def running_max(df: DataFrame, column: str, out: str) -> DataFrame:
    return running(df, column, F.max, F.greatest, out)


def running_sum(df: DataFrame, column: str, out: str) -> DataFrame:
    return running(df, column, F.sum, lambda a, b: a + b, out)


def drawdowns(df: DataFrame) -> DataFrame:
    """``name, max_drawdown, at``: the deepest fall below the highest point before."""
    d = running_max(df, "value", "peak").withColumn("dd", F.col("value") / F.col("peak") - 1)
    return d.groupBy("name").agg(F.round(F.min("dd"), 8).alias("max_drawdown"), F.min_by("t", F.struct("dd", "t")).alias("at"))


def summary(df: DataFrame) -> DataFrame:
    """Moments of each name; skewness and kurtosis corrected for bias."""
    n = F.count("value")
    g1, g2 = F.skewness("value"), F.kurtosis("value")
    return df.groupBy("name").agg(
        n.alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.round(F.when((n > 2) & (F.stddev_pop("value") > 0), g1 * F.sqrt(n * (n - 1)) / (n - 2)), 4).alias("skew"),
        F.round(F.when((n > 3) & (F.stddev_pop("value") > 0), ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))), 4).alias("kurt"))


def value_at_risk(returns: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Historical, normal and Cornish-Fisher value at risk and the expected
    shortfall of each name, all signed returns."""
    z = _norm_ppf(alpha)
    m = returns.groupBy("name").agg(
        F.count("r").alias("n"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("s"), F.kurtosis("r").alias("k"))
    m = m.join(ordered.percentiles(returns, ["name"], "r", (alpha,)).select("name", F.col("p")[0].alias("hist")), "name")
    tail = returns.join(m.select("name", "hist"), "name").where("r <= hist").groupBy("name").agg(F.avg("r").alias("cvar"))
    zc = z + (z**2 - 1) * F.col("s") / 6 + (z**3 - 3 * z) * F.col("k") / 24 - (2 * z**3 - 5 * z) * F.col("s") * F.col("s") / 36
    return m.join(tail, "name").select(
        "name", "n", F.round("hist", 8).alias("historical"), F.round(F.col("mu") + z * F.col("sd"), 8).alias("normal"),
        F.round(F.col("mu") + zc * F.col("sd"), 8).alias("cornish_fisher"), F.round("cvar", 8).alias("shortfall"))


def _norm_ppf(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def performance(returns: DataFrame, periods: float = 252.0) -> DataFrame:
    """Annual mean, volatility, Sharpe and Sortino ratio of each name."""
    down = F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(0.0)))
    mu, sd = F.avg("r") * periods, F.stddev_pop("r") * float(np.sqrt(periods))
    return returns.groupBy("name").agg(
        F.count("r").alias("n"), F.round(mu, 6).alias("annual_return"), F.round(sd, 6).alias("annual_volatility"),
        F.round(F.try_divide(mu, sd), 6).alias("sharpe"), F.round(F.try_divide(mu, down * float(np.sqrt(periods))), 6).alias("sortino"))


def autocorrelation(returns: DataFrame, lags: int = 5) -> DataFrame:
    """``name, lag, acf``: covariance over n - lag, divided by the variance."""
    m = returns.groupBy("name").agg(F.avg("r").alias("mu"), F.var_pop("r").alias("v")).where("v > 0")
    d = returns.join(m, "name").withColumn("d", F.col("r") - F.col("mu"))
    pairs = framed(d, lags, {f"l{k}": (lambda w, k=k: F.max("d").over(w.rangeBetween(-k, -k))) for k in range(1, lags + 1)})
    rows = F.array(*(F.struct(F.lit(k).alias("lag"), (F.col("d") * F.col(f"l{k}")).alias("p")) for k in range(1, lags + 1)))
    long = pairs.select("name", "v", F.explode(rows).alias("x")).where("x.p IS NOT NULL")
    return long.groupBy("name", F.col("x.lag").alias("lag")).agg((F.round(F.avg("x.p") / F.max("v"), 6) + 0.0).alias("acf"))


def rolling(returns: DataFrame, size: int) -> DataFrame:
    """Mean and sample deviation of the last ``size`` indices, where all are held."""
    frame = lambda w: w.rangeBetween(-(size - 1), 0)
    out = framed(returns, size - 1, {
        "k": lambda w: F.count("r").over(frame(w)), "mean": lambda w: F.round(F.avg("r").over(frame(w)), 8) + 0.0, "sd": lambda w: F.round(F.stddev_samp("r").over(frame(w)), 8)})
    return out.where(F.col("k") == size).drop("k")


def market(returns: DataFrame) -> DataFrame:
    """``ts, m``: mean return over all names at a time."""
    return returns.groupBy("ts").agg(F.avg("r").alias("m"))


def betas(returns: DataFrame) -> DataFrame:
    """Regression of each name on the market: ``name, n, beta, alpha, r2``."""
    j = returns.join(market(returns), "ts")
    return j.groupBy("name").agg(
        F.count("*").alias("n"), F.round(F.regr_slope("r", "m"), 6).alias("beta"), F.round(F.regr_intercept("r", "m"), 8).alias("alpha"), F.round(F.regr_r2("r", "m"), 6).alias("r2"))


def rolling_beta(returns: DataFrame, size: int = 60) -> DataFrame:
    """Slope on the market over the last ``size`` indices."""
    j = returns.join(market(returns), "ts")
    f = lambda c: (lambda w: c.over(w.rangeBetween(-(size - 1), 0)))
    out = framed(j, size - 1, {"k": f(F.count("r")), "cov": f(F.covar_pop("r", "m")), "var": f(F.var_pop("m"))})
    return out.where((F.col("k") == size) & (F.col("var") > 1e-18)).select("name", "t", F.round(F.col("cov") / F.col("var"), 6).alias("beta"))


def runs_test(returns: DataFrame) -> DataFrame:
    """Sign runs of each name: ``name, n_up, n_down, n_runs, z``; zero counts up."""
    s = returns.withColumn("up", (F.col("r") >= 0).cast("int"))
    d = framed(s, 1, {"before": lambda w: F.lag("up").over(w)})
    a = d.groupBy("name").agg(F.sum("up").alias("n_up"), F.sum(1 - F.col("up")).alias("n_down"), F.sum((F.col("before").isNull() | (F.col("before") != F.col("up"))).cast("int")).alias("n_runs"))
    n = F.col("n_up") + F.col("n_down")
    mu = 2.0 * F.col("n_up") * F.col("n_down") / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    return a.where((F.col("n_up") > 0) & (F.col("n_down") > 0)).withColumn("z", F.round((F.col("n_runs") - mu) / F.sqrt(var), 6))


def variance_ratio(returns: DataFrame, q: int) -> DataFrame:
    """Variance of overlapping ``q``-sums over ``q`` times the variance."""
    m = returns.groupBy("name").agg(F.avg("r").alias("mu"), F.var_pop("r").alias("v")).where("v > 0")
    f = lambda c: (lambda w: c.over(w.rangeBetween(-(q - 1), 0)))
    s = framed(returns, q - 1, {"k": f(F.count("r")), "x": f(F.sum("r"))}).where(F.col("k") == q).join(m, "name")
    return s.groupBy("name").agg(F.round(F.avg(F.pow(F.col("x") - q * F.col("mu"), 2)) / (q * F.max("v")), 6).alias("ratio"))


def half_life(df: DataFrame) -> DataFrame:
    """Half-life of mean reversion, from the slope of changes on levels."""
    d = previous(df, "value").where("before IS NOT NULL")
    return d.groupBy("name").agg(F.regr_slope(F.col("value") - F.col("before"), F.col("before")).alias("b")).select(
        "name", F.round(F.when(F.col("b") < 0, -F.log(F.lit(2.0)) / F.col("b")), 4).alias("half_life"))


def roll_spread(df: DataFrame) -> DataFrame:
    """Roll's spread: twice the root of the negative covariance of changes."""
    d = previous(df, "value").where("before IS NOT NULL").select("name", "t", "ts", (F.col("value") - F.col("before")).alias("value"))
    c = previous(d, "value").where("before IS NOT NULL").groupBy("name").agg(F.covar_samp("value", "before").alias("c"))
    return c.select("name", F.round(F.when(F.col("c") < 0, 2 * F.sqrt(-F.col("c"))).otherwise(0.0), 6).alias("spread"))


def correlations(returns: DataFrame) -> DataFrame:
    """``a, b, corr`` of names over their common times; for a bounded set of
    names, as the result has a row for each pair."""
    x, y = returns.select("ts", F.col("name").alias("a"), F.col("r").alias("x")), returns.select("ts", F.col("name").alias("b"), F.col("r").alias("y"))
    return x.join(y, "ts").where("a < b").groupBy("a", "b").agg(F.round(F.corr("x", "y"), 6).alias("corr"))


def least_squares(df: DataFrame, y: str, xs: list[str]) -> dict[str, float]:
    """Coefficients (``intercept`` first), ``r2`` and ``n`` of a regression.

    The cross products are one distributed aggregation; only a matrix of the
    number of columns reaches the driver."""
    cols = [F.lit(1.0), *(F.col(x) for x in xs)]
    ok = df.where(F.col(y).isNotNull())
    for x in xs:
        ok = ok.where(F.col(x).isNotNull())
    aggs = [F.sum(a * b).alias(f"x{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    aggs += [F.sum(a * F.col(y)).alias(f"y{i}") for i, a in enumerate(cols)] + [F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n")]
    row = ok.agg(*aggs).first()
    k = len(cols)
    if not row["n"]:
        return {"n": 0.0}
    a = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([row[f"y{i}"] for i in range(k)])
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    mean = b[0] / row["n"]
    total = row["yy"] - row["n"] * mean**2
    return dict(zip(["intercept", *xs], beta.tolist(), strict=True)) | {"r2": float(1 - (row["yy"] - beta @ b) / total) if total > 0 else 0.0, "n": float(row["n"])}


def autoregression(df: DataFrame, order: int = 3, steps: int = 5) -> DataFrame:
    """AR(p) of the changes of each name by Yule-Walker, and its forecast:
    ``name, step, forecast``. Lag products are summed in the cluster; a name
    arrives at its solver as ``order`` numbers and its last points."""
    d = previous(df, "value").where("before IS NOT NULL").select("name", "t", "value", (F.col("value") - F.col("before")).alias("d"))
    lagged = framed(d, order, {f"l{k}": (lambda w, k=k: F.max("d").over(w.rangeBetween(-k, -k))) for k in range(1, order + 1)})
    sums = lagged.groupBy("name").agg(
        F.avg(F.col("d") * F.col("d")).alias("c0"), *(F.avg(F.col("d") * F.col(f"l{k}")).alias(f"c{k}") for k in range(1, order + 1)),
        F.max_by(F.struct("value", "d", *(f"l{k}" for k in range(1, order))), "t").alias("last"))

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                c = np.array([r[f"c{k}"] for k in range(order + 1)], float)
                c = np.where(np.isfinite(c), c, 0.0)
                gamma = c[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))] + np.eye(order) * (1e-9 + 1e-9 * c[0])
                phi = np.linalg.solve(gamma, c[1:])
                last = r["last"]
                hist = [last["d"], *(last[f"l{k}"] for k in range(1, order))]
                hist = [0.0 if h is None or not np.isfinite(h) else float(h) for h in hist]
                level = last["value"]
                for s in range(1, steps + 1):
                    move = float(np.dot(phi, hist[:order]))
                    hist.insert(0, move)
                    level += move
                    rows.append((r["name"], s, round(level, 6)))
            yield pd.DataFrame(rows, columns=["name", "step", "forecast"])

    return sums.mapInPandas(solve, "name string, step int, forecast double")


def band_pass(df: DataFrame, low: int = 6, high: int = 32, reach: int = 12) -> DataFrame:
    """Symmetric filter that keeps cycles of ``low`` to ``high`` points:
    ``name, t, cycle``, where all neighbours are held. A weighted sum over a
    frame, the same on any stretch."""
    a, b = 2 * np.pi / high, 2 * np.pi / low
    k = np.arange(1, reach + 1)
    half = (np.sin(b * k) - np.sin(a * k)) / (np.pi * k)
    weights = np.concatenate((half[::-1], [(b - a) / np.pi], half))
    weights -= weights.mean()
    near = lambda i: (lambda w: F.max("value").over(w.rangeBetween(-i, -i)))
    d = framed(df, 2 * reach, {f"v{i}": near(i) for i in range(2 * reach + 1)})
    total = sum((F.col(f"v{i}") * float(w) for i, w in enumerate(weights)), F.lit(0.0))
    return d.select("name", (F.col("t") - reach).alias("t"), F.round(total, 6).alias("cycle")).where("cycle IS NOT NULL")


def unit_root(df: DataFrame) -> DataFrame:
    """Dickey-Fuller statistic of each name without lags: ``name, n, slope,
    stat``; the regression of changes on levels comes from sums alone."""
    d = previous(df, "value").where("before IS NOT NULL").select("name", (F.col("value") - F.col("before")).alias("y"), F.col("before").alias("x"))
    a = d.groupBy("name").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"))
    err = F.sqrt((F.col("syy") - F.col("b") * F.col("b") * F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    return a.where("n > 2 AND sxx > 0").select("name", "n", F.round("b", 8).alias("slope"), F.round(F.try_divide(F.col("b"), err), 4).alias("stat"))
