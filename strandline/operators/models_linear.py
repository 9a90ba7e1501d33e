"""Linear models from cross-products, by group.

Everything these models need of the data are sums of products, which Spark
combines map-side; the small systems are solved one row a group, so a group of
any size costs one row in Python. Lagged products come from stretches
(``series.stretched``), so that no series is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import series as S


def moments(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``by, n, xx``: the products of all pairs of ``columns`` and a one in
    front, summed over rows without nulls, as the upper triangle."""
    held = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    all_ = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    sums = [F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(all_) for j, b in enumerate(all_) if j >= i]
    out = held.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    return out.select(*by, "n", F.array(*(c for c in out.columns if c not in (*by, "n"))).alias("xx"))


def square(xx: Sequence[float], k: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = xx
    return m + np.triu(m, 1).T


def each_group(df: DataFrame, by: Sequence[str], schema: str, solve: Callable[[dict], list[tuple]]) -> DataFrame:
    """Rows of ``solve`` for each row of ``df``; a group that cannot be solved
    gives none."""
    types = dict(df.dtypes)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                try:
                    rows += [(*(r[b] for b in by), *x) for x in solve(r)]
                except np.linalg.LinAlgError:
                    continue
            if rows:
                yield pd.DataFrame(rows, columns=[*by, *(c.split()[0] for c in schema.split(", "))])

    return df.mapInPandas(work, ", ".join(f"`{b}` {types[b]}" for b in by) + ", " + schema)


def regress(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], intercept: bool = True) -> DataFrame:
    """Least squares by group: ``by, term, coefficient, std_error, t, r2, n``,
    one row a term (``intercept`` first). Groups with no more rows than terms,
    or with dependent columns, have none; rows with nulls do not count."""
    xs, k = list(xs), len(xs) + 1
    terms = ["intercept", *xs] if intercept else xs

    def solve(r: dict) -> list[tuple]:
        m, n = square(r["xx"], k + 1), int(r["n"])
        a = m[:k, :k] if intercept else m[1:k, 1:k]
        b = m[:k, k] if intercept else m[1:k, k]
        if n <= len(a) or np.linalg.cond(a) > 1e13:
            return []
        beta = np.linalg.solve(a, b)
        rss = max(m[k, k] - beta @ b, 0.0)
        tss = m[k, k] - (m[0, k] ** 2 / n if intercept else 0.0)
        se = np.sqrt(np.maximum(np.diag(np.linalg.inv(a)), 0) * rss / (n - len(a)))
        r2 = 1 - rss / tss if tss > 0 else None
        return [(t, float(c), float(s), float(c / s) if s > 0 else None, r2, n) for t, c, s in zip(terms, beta, se, strict=True)]

    return each_group(moments(df, by, [*xs, y]), by, "term string, coefficient double, std_error double, t double, r2 double, n long", solve)


# ------------------------------------------------------------------- factors


def style_factors(returns: DataFrame) -> DataFrame:
    """Factors by time from the cross-section: ``ts, mkt, smb, hml``. The market
    is the mean; the others are mean returns of names with a price in the lower
    half less the upper half, and of names whose last return was low less high."""
    before = S.previous(returns, "r")
    half = returns.groupBy("name").agg(F.avg(F.abs("r")).alias("size"))
    mid = half.agg(F.avg("size").alias("mid"))
    j = before.join(half, "name").crossJoin(F.broadcast(mid))  # one row
    pick = lambda c: F.avg(F.when(c, F.col("r")))
    return j.groupBy("ts").agg(
        F.avg("r").alias("mkt"), (F.coalesce(pick(F.col("size") < F.col("mid")), F.lit(0.0)) - F.coalesce(pick(F.col("size") >= F.col("mid")), F.lit(0.0))).alias("smb"),
        (F.coalesce(pick(F.col("before") < 0), F.lit(0.0)) - F.coalesce(pick(F.col("before") >= 0), F.lit(0.0))).alias("hml"))


# -------------------------------------------------------------------- systems


def lagged(df: DataFrame, columns: Sequence[str], lags: int) -> DataFrame:
    """Add ``{column}_{lag}`` for each lag, null where the index has a gap."""
    build = {}
    for c in columns:
        for k in range(1, lags + 1):
            build[f"{c}_{k}"] = lambda w, c=c, k=k: F.max(c).over(w.rangeBetween(-k, -k))
    return S.framed(df, lags, build)


def vector_autoregression(df: DataFrame, columns: Sequence[str], most: int = 3) -> DataFrame:
    """Vector autoregression of ``columns`` of each name, of the order up to
    ``most`` with the least BIC on common rows: ``name, p, n, coef`` (equations
    by lag and column, no intercept), ``sigma`` and ``tail`` (the last rows,
    newest first)."""
    cols, k = list(columns), len(columns)
    with_lags = lagged(df, cols, most)
    terms = [f"{c}_{i}" for i in range(1, most + 1) for c in cols]
    m = moments(with_lags, ["name"], [*terms, *cols])
    newest = with_lags.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*terms, *cols])).groupBy("name").agg(
        F.max_by(F.array(*(F.col(c).cast("double") for c in [*cols, *terms])), "t").alias("tail"))
    size = 1 + len(terms) + k

    def solve(r: dict) -> list[tuple]:
        x, n, best = square(r["xx"], size), int(r["n"]), None
        y = x[1 + k * most:, 1 + k * most:]
        for p in range(1, most + 1):
            at = slice(1, 1 + k * p)
            a, b = x[at, at], x[at, 1 + k * most:]
            if n <= k * p + 1 or np.linalg.cond(a) > 1e13:
                continue
            coef = np.linalg.solve(a, b).T
            sigma = (y - coef @ b) / n
            sign, logdet = np.linalg.slogdet(sigma)
            if sign <= 0:
                continue
            bic = logdet + np.log(n) * k * k * p / n
            if best is None or bic < best[0]:
                best = (bic, p, coef, sigma)
        if best is None:
            return []
        _, p, coef, sigma = best
        return [(p, n, coef.ravel().tolist(), sigma.ravel().tolist(), list(r["tail"])[:k * p])]

    return each_group(m.join(newest, "name"), ["name"], "p int, n long, coef array<double>, sigma array<double>, tail array<double>", solve)


def _companion(coef: Sequence[float], k: int, p: int) -> np.ndarray:
    c = np.zeros((k * p, k * p))
    c[:k] = np.asarray(coef).reshape(k, k * p)
    c[k:, :-k] = np.eye(k * (p - 1))
    return c


def responses(coef: Sequence[float], sigma: Sequence[float], k: int, p: int, steps: int) -> np.ndarray:
    """Responses to orthogonal shocks: step, variable, shock."""
    c, root = _companion(coef, k, p), np.linalg.cholesky(np.asarray(sigma).reshape(k, k))
    power, out = np.eye(k * p), []
    for _ in range(steps + 1):
        out.append(power[:k, :k] @ root)
        power = power @ c
    return np.array(out)


def impulse_responses(model: DataFrame, columns: Sequence[str], steps: int = 10) -> DataFrame:
    """``name, step, variable, shock, response, share``: the response to a unit
    shock and the shock's share of the variable's forecast variance so far."""
    cols, k = list(columns), len(columns)

    def solve(r: dict) -> list[tuple]:
        psi = responses(r["coef"], r["sigma"], k, int(r["p"]), steps)
        total = np.cumsum(psi**2, axis=0)
        share = total / np.maximum(total.sum(axis=2, keepdims=True), 1e-300)
        return [(h, cols[i], cols[j], float(psi[h, i, j]), float(share[h, i, j])) for h in range(steps + 1) for i in range(k) for j in range(k)]

    return each_group(model, ["name"], "step int, variable string, shock string, response double, share double", solve)


def system_forecast(model: DataFrame, columns: Sequence[str], steps: int = 10) -> DataFrame:
    """``name, step, variable, forecast``, iterated from the last rows."""
    cols, k = list(columns), len(columns)

    def solve(r: dict) -> list[tuple]:
        p = int(r["p"])
        c, state, rows = _companion(r["coef"], k, p), np.asarray(r["tail"], float), []
        for h in range(1, steps + 1):
            state = c @ state
            rows += [(h, cols[i], float(state[i])) for i in range(k)]
        return rows

    return each_group(model, ["name"], "step int, variable string, forecast double", solve)


# --------------------------------------------------------------- cointegration


def engle_granger(df: DataFrame, y: str, x: str) -> DataFrame:
    """``name, n, slope, t, cointegrated``: Dickey-Fuller test of the residuals
    of y on x, against the five per cent point for two variables. Names whose
    residuals are nought have none."""
    fit = regress(df, ["name"], y, [x]).groupBy("name").agg(
        F.max(F.when(F.col("term") == "intercept", F.col("coefficient"))).alias("a"), F.max(F.when(F.col("term") == x, F.col("coefficient"))).alias("b"))
    e = df.join(fit, "name").withColumn("e", F.col(y) - F.col("a") - F.col("b") * F.col(x)).select("name", "t", "e", "b")
    e = e.join(e.groupBy("name").agg(F.var_pop("e").alias("spread")).where("spread > 1e-18").select("name"), "name")
    step = S.previous(e, "e").withColumn("de", F.col("e") - F.col("before"))
    test = regress(step, ["name"], "de", ["before"], intercept=False).select("name", "n", "t")
    return test.join(fit, "name").select("name", "n", F.col("b").alias("slope"), "t", (F.col("t") < -3.34).alias("cointegrated"))


def error_correction(df: DataFrame, y: str, x: str) -> DataFrame:
    """Both equations of the error-correction model with one lag:
    ``name, equation, term, coefficient, t``."""
    fit = regress(df, ["name"], y, [x]).groupBy("name").agg(
        F.max(F.when(F.col("term") == "intercept", F.col("coefficient"))).alias("a"), F.max(F.when(F.col("term") == x, F.col("coefficient"))).alias("b"))
    e = df.join(fit, "name").withColumn("gap", F.col(y) - F.col("a") - F.col("b") * F.col(x)).select("name", "t", F.col(y).alias("y"), F.col(x).alias("x"), "gap")
    l = lagged(e, ["y", "x", "gap"], 2).select(
        "name", (F.col("y") - F.col("y_1")).alias("dy"), (F.col("x") - F.col("x_1")).alias("dx"), "gap_1", (F.col("y_1") - F.col("y_2")).alias("dy_1"), (F.col("x_1") - F.col("x_2")).alias("dx_1"))
    terms = ["gap_1", "dy_1", "dx_1"]
    out = [regress(l, ["name"], d, terms).select("name", F.lit(d).alias("equation"), "term", "coefficient", "t") for d in ("dy", "dx")]
    return out[0].unionByName(out[1])


#: Five per cent points of the trace statistic, by the number of remaining relations.
TRACE_POINTS = (3.84, 15.49, 29.80, 47.86, 69.82)


def johansen(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trace test of cointegration with one lag: ``name, rank_at_most,
    eigenvalue, trace, rejected``, at most five columns."""
    cols, k = list(columns), len(columns)
    if k > len(TRACE_POINTS):
        raise ValueError("at most five columns have critical values")
    l = lagged(df, cols, 1).select("name", *((F.col(c) - F.col(f"{c}_1")).alias(f"d{c}") for c in cols), *(f"{c}_1" for c in cols))
    names = [*(f"d{c}" for c in cols), *(f"{c}_1" for c in cols)]

    def solve(r: dict) -> list[tuple]:
        m, n = square(r["xx"], 1 + 2 * k), int(r["n"])
        if n <= 2 * k + 1:
            return []
        c = m[1:, 1:] / n - np.outer(m[0, 1:], m[0, 1:]) / n**2
        s00, s01, s11 = c[:k, :k], c[:k, k:], c[k:, k:]
        root = np.linalg.inv(np.linalg.cholesky(s11))
        ev = np.clip(np.linalg.eigvalsh(root @ s01.T @ np.linalg.solve(s00, s01) @ root.T)[::-1], 0, 1 - 1e-12)
        trace = [-n * float(np.log(1 - ev[i:]).sum()) for i in range(k)]
        return [(i, float(ev[i]), trace[i], trace[i] > TRACE_POINTS[k - i - 1]) for i in range(k)]

    return each_group(moments(l, ["name"], names), ["name"], "rank_at_most int, eigenvalue double, trace double, rejected boolean", solve)


def select_order(df: DataFrame, value: str, most: int = 6) -> DataFrame:
    """Order of an autoregression of the values and of their differences by the
    least AIC on common rows: ``name, d, p, aic, n``."""
    d1 = S.previous(df.select("name", "t", F.col(value).cast("double").alias("v")), "v").select("name", "t", "v", (F.col("v") - F.col("before")).alias("dv"))
    parts = None
    for d, c in enumerate(("v", "dv")):
        l = lagged(d1.where(f"{c} IS NOT NULL").select("name", "t", F.col(c).alias("y")), ["y"], most)
        m = moments(l, ["name"], [*(f"y_{i}" for i in range(1, most + 1)), "y"]).withColumn("d", F.lit(d))
        parts = m if parts is None else parts.unionByName(m)

    def solve(r: dict) -> list[tuple]:
        m, n, best = square(r["xx"], most + 2), int(r["n"]), None
        for p in range(most + 1):
            a, b = m[:p + 1, :p + 1], m[:p + 1, most + 1]
            if n <= p + 2 or np.linalg.cond(a) > 1e14:
                continue
            rss = m[most + 1, most + 1] - np.linalg.solve(a, b) @ b
            if rss <= 0:
                continue
            aic = n * np.log(rss / n) + 2 * (p + 1)
            if best is None or aic < best[1] - 1e-9:
                best = (p, float(aic))
        return [(best[0], best[1], n)] if best else []

    return each_group(parts, ["name", "d"], "p int, aic double, n long", solve)


# ------------------------------------------------------------- filters by part


def hp_filter(df: DataFrame, value: str, smooth: float = 100.0, margin: int = 96) -> DataFrame:
    """``name, t, trend, cycle`` of Hodrick and Prescott. The filter's weights
    die out within a few dozen points (at ``smooth`` 100 by a factor 1e-9 over
    the margin), so it is solved stretch by stretch with margins on both sides."""
    here = F.floor(F.col("t") / S.STRETCH).cast("long")
    near = F.array_compact(F.array(
        here, F.when((F.col("t") % S.STRETCH < margin) & (here > 0), here - 1), F.when(F.col("t") % S.STRETCH >= S.STRETCH - margin, here + 1)))
    d = df.where(F.col(value).isNotNull()).select("name", "t", F.col(value).cast("double").alias("v"), F.explode(near).alias("stretch"))
    size = S.STRETCH

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y, n = pdf["v"].to_numpy(), len(pdf)
        trend = y.copy() if n < 3 else _penalised(y, smooth)
        out = pd.DataFrame({"name": pdf["name"], "t": pdf["t"], "trend": trend, "cycle": y - trend})
        return out[(pdf["t"] // size == pdf["stretch"]).to_numpy()]

    return d.groupBy("name", "stretch").applyInPandas(solve, "name string, t long, trend double, cycle double")


def _penalised(y: np.ndarray, smooth: float) -> np.ndarray:
    """Solves (I + smooth D'D) x = y for second differences, by elimination in
    the five bands."""
    n = len(y)
    d0, d1, d2 = np.full(n, 1 + 6 * smooth), np.full(n - 1, -4 * smooth), np.full(max(n - 2, 0), smooth)
    d0[[0, -1]] = 1 + smooth
    if n > 3:
        d0[[1, -2]] = 1 + 5 * smooth
    else:
        d0[1] = 1 + 4 * smooth
    d1[[0, -1]] = -2 * smooth
    x, d0, d1, d2 = y.astype(float).copy(), d0.tolist(), d1.tolist(), d2.tolist()
    x = x.tolist()
    for i in range(n):
        if i + 1 < n:
            f = d1[i] / d0[i]
            d0[i + 1] -= f * d1[i]
            x[i + 1] -= f * x[i]
            if i + 2 < n:
                d1[i + 1] -= f * d2[i]
        if i + 2 < n:
            f = d2[i] / d0[i]
            d0[i + 2] -= f * d2[i]
            x[i + 2] -= f * x[i]
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= d1[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= d2[i] * x[i + 2]
        x[i] /= d0[i]
    return np.array(x)


def wave_phase(filtered: DataFrame) -> DataFrame:
    """``name, phase`` from the sign and slope of the last cycle."""
    w = Window.partitionBy("name").orderBy(F.desc("t"))
    last = filtered.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("name").agg(
        F.max(F.when(F.col("k") == 1, F.col("cycle"))).alias("now"), F.max(F.when(F.col("k") == 2, F.col("cycle"))).alias("before"))
    up = F.col("now") > F.col("before")
    return last.where("before IS NOT NULL").select("name", F.when((F.col("now") >= 0) & up, "expansion").when(F.col("now") >= 0, "recession").when(up, "recovery").otherwise("depression").alias("phase"))


def spectrum(df: DataFrame, value: str, size: int = 1024) -> DataFrame:
    """Mean amplitudes by frequency over Hann-windowed stretches of ``size``:
    ``name, k, period, amplitude``; a name with only a part of a stretch uses that.
    Parts of fewer than 8 points have no spectrum and do not count."""
    d = df.where(F.col(value).isNotNull()).select("name", "t", F.col(value).cast("double").alias("v"), F.floor(F.col("t") / size).cast("long").alias("stretch"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("t")["v"].to_numpy()
        if len(y) < 8:
            return pd.DataFrame({"name": pd.Series(dtype=object), "k": pd.Series(dtype=np.int64), "amplitude": pd.Series(dtype=float), "n": pd.Series(dtype=np.int64)})  # typed, as Arrow takes no empty string column of floats
        a = np.abs(np.fft.rfft((y - y.mean()) * np.hanning(len(y)), size)) * 2 / len(y)
        return pd.DataFrame({"name": pdf["name"].iloc[0], "k": np.arange(1, len(a)), "amplitude": a[1:], "n": len(y)})

    parts = d.groupBy("name", "stretch").applyInPandas(work, "name string, k long, amplitude double, n long")
    return parts.groupBy("name", "k").agg((F.sum(F.col("amplitude") * F.col("n")) / F.sum("n")).alias("amplitude")).select("name", "k", (F.lit(float(size)) / F.col("k")).alias("period"), "amplitude")


# ---------------------------------------------------------------- macro rules


def policy_rule(df: DataFrame, by: Sequence[str], rate: str, inflation: str, gap: str, target: float = 0.02) -> DataFrame:
    """Fitted rule of a policy rate: ``by, phi_pi, phi_y, natural, r2, n``; the
    natural rate is what the intercept leaves at the target."""
    t = regress(df, by, rate, [inflation, gap])
    pick = lambda name: F.max(F.when(F.col("term") == name, F.col("coefficient")))
    w = t.groupBy(*by).agg(pick(inflation).alias("phi_pi"), pick(gap).alias("phi_y"), pick("intercept").alias("a"), F.max("r2").alias("r2"), F.max("n").alias("n"))
    return w.select(*by, "phi_pi", "phi_y", (F.col("a") + (F.col("phi_pi") - 1) * target).alias("natural"), "r2", "n")


def phillips_curve(df: DataFrame, by: Sequence[str], inflation: str, unemployment: str, before: str) -> DataFrame:
    """Inflation on its last value and unemployment: ``by, slope, persistence,
    nairu, r2``; the rate at which inflation rests is null without a slope."""
    t = regress(df, by, inflation, [unemployment, before])
    pick = lambda name: F.max(F.when(F.col("term") == name, F.col("coefficient")))
    w = t.groupBy(*by).agg((-pick(unemployment)).alias("slope"), pick(before).alias("persistence"), pick("intercept").alias("a"), F.max("r2").alias("r2"))
    return w.select(*by, "slope", "persistence", F.try_divide(F.col("a"), F.col("slope")).alias("nairu"), "r2")


def price_impact(df: DataFrame, by: Sequence[str], flow: str, change: str) -> DataFrame:
    """Slope of price changes on signed flow and its fit: ``by, impact, r2, n``."""
    return regress(df, by, change, [flow]).where(F.col("term") == flow).select(*by, F.col("coefficient").alias("impact"), "r2", "n")
