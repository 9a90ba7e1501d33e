"""Models from distributed reductions, and portfolios from their moments.

The cluster reduces the rows to sums of the size of the columns (cross
products, cluster sums, lag products); what is solved on the driver has that
size and no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import series as S


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of the arrays ``a`` of all tasks, added up in the cluster place
    by place; empty if there is none."""
    rows = parts.select(F.posexplode("a").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for i, v in rows:
        out[i] = v
    return out


def cross_products(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross products of columns, of rows without null."""
    names = list(columns)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, x = 0, np.zeros(len(names)), np.zeros((len(names), len(names)))
        for pdf in batches:
            a = pdf[names].dropna().to_numpy(float)
            n, s, x = n + len(a), s + a.sum(axis=0), x + a.T @ a
        if n:
            yield pd.DataFrame({"a": [[float(n), *s.tolist(), *x.ravel().tolist()]]})

    a, k = _added(df.select(*names).mapInPandas(work, "a array<double>")), len(names)
    if not len(a):
        return 0, np.zeros(k), np.zeros((k, k))
    return int(a[0]), a[1:k + 1], a[k + 1:].reshape(k, k)


def vector_moments(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance of a vector column; one matrix a task, added
    up in the cluster."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, x = 0, None, None
        for pdf in batches:
            if len(pdf):
                a = np.array(pdf["v"].tolist(), float)
                s, x, n = (a.sum(axis=0), a.T @ a, len(a)) if s is None else (s + a.sum(axis=0), x + a.T @ a, n + len(a))
        if n:
            yield pd.DataFrame({"a": [[float(n), *s.tolist(), *x.ravel().tolist()]]})

    a = _added(df.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).mapInPandas(work, "a array<double>"))
    if not len(a):
        return 0, np.zeros(0), np.zeros((0, 0))
    n, k = int(a[0]), int((-1 + np.sqrt(4 * len(a) - 3)) / 2)
    mean = a[1:k + 1] / n
    return n, mean, a[k + 1:].reshape(k, k) / n - np.outer(mean, mean)


def principal_components(df: DataFrame, key: str, column: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """Scores on the ``k`` first components, and the share each explains. A
    component points where its largest loading is positive."""
    _, mean, cov = vector_moments(df, column)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    basis = vectors[:, order]
    basis *= np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(len(order))])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"key": pdf["key"], "scores": ((np.array(pdf["v"].tolist(), float) - mean) @ basis).round(6).tolist()})

    scores = df.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).alias("v")).mapInPandas(work, "key long, scores array<double>")
    return scores.withColumnRenamed("key", key), np.maximum(values[order], 0) / max(values.sum(), 1e-300)


def k_means(df: DataFrame, key: str, column: str, k: int, rounds: int = 10) -> DataFrame:
    """``key, cluster, distance``. Centres start at the rows of the smallest
    keys' hashes and move by sums made in the tasks."""
    held = df.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(column).alias("v"))
    centres = np.array([r.v for r in held.orderBy(F.xxhash64("key"), "key").limit(k).collect()], float)

    def near(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.maximum((a**2).sum(1)[:, None] - 2 * a @ c.T + (c**2).sum(1), 0)
        return d.argmin(1), np.sqrt(d.min(1))

    for _ in range(rounds):
        now = centres

        def sums(batches: Iterator[pd.DataFrame], c: np.ndarray = now) -> Iterator[pd.DataFrame]:
            total, count = np.zeros_like(c), np.zeros(len(c))
            for pdf in batches:
                if len(pdf):
                    a = np.array(pdf["v"].tolist(), float)
                    at, _ = near(a, c)
                    np.add.at(total, at, a)
                    count += np.bincount(at, minlength=len(c))
            yield pd.DataFrame({"a": [[*count.tolist(), *total.ravel().tolist()]]})

        a = _added(held.mapInPandas(sums, "a array<double>"))
        if not len(now):
            break
        count, total = a[:len(now)], a[len(now):].reshape(now.shape)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], now)
        if np.allclose(centres, now, atol=1e-9):
            break

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at, far = near(np.array(pdf["v"].tolist(), float), centres)
                yield pd.DataFrame({"key": pdf["key"], "cluster": at.astype(np.int32), "distance": far.round(6)})

    return held.mapInPandas(label, "key long, cluster int, distance double").withColumnRenamed("key", key)


# ---------------------------------------------------------------- time series


def granger(df: DataFrame, lags: int = 2) -> DataFrame:
    """Whether the past of ``x`` helps to tell ``y``: ``name, n, f``, from a
    table ``name, t, x, y``. Lags are frames over stretches; each name reaches
    its solver as one matrix of lag products."""
    cols = {f"{c}{k}": (lambda w, c=c, k=k: F.max(c).over(w.rangeBetween(-k, -k))) for c in "xy" for k in range(1, lags + 1)}
    names = ["one", *(f"y{k}" for k in range(1, lags + 1)), *(f"x{k}" for k in range(1, lags + 1)), "y"]
    d = S.framed(df, lags, cols).withColumn("one", F.lit(1.0)).dropna(subset=names)
    flat = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = d.groupBy("name").agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in flat))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                g = np.zeros((len(names), len(names)))
                for i, j in flat:
                    g[i, j] = g[j, i] = r[f"p{i}_{j}"]
                sse = []
                for p in (1 + lags, 1 + 2 * lags):
                    b = np.linalg.lstsq(g[:p, :p], g[:p, -1], rcond=None)[0]
                    sse.append(g[-1, -1] - b @ g[:p, -1])
                n = int(g[0, 0])
                free = n - 1 - 2 * lags
                rows.append((r["name"], n, round((sse[0] - sse[1]) / lags / (sse[1] / free), 6) if free > 0 and sse[1] > 0 else None))
            if rows:
                yield pd.DataFrame(rows, columns=["name", "n", "f"])

    return sums.mapInPandas(solve, "name string, n long, f double")


def transfer_entropy(df: DataFrame, bins: int = 8) -> DataFrame:
    """Bits the past of ``x`` tells of ``y`` beyond its own past, in equal-width
    bins: ``name, bits``, from a table ``name, t, x, y`` and counts alone."""
    lim = df.groupBy("name").agg(F.min("x").alias("xl"), F.max("x").alias("xh"), F.min("y").alias("yl"), F.max("y").alias("yh"))
    cell = lambda v, lo, hi: F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(v) - F.col(lo), F.col(hi) - F.col(lo)) * bins)).cast("int"), F.lit(0))
    b = df.join(lim, "name").select("name", "t", cell("x", "xl", "xh").alias("bx"), cell("y", "yl", "yh").alias("by"))
    back = lambda c: (lambda w: F.max(c).over(w.rangeBetween(-1, -1)))
    d = S.framed(b, 1, {"x1": back("bx"), "y1": back("by")}).where("x1 IS NOT NULL AND y1 IS NOT NULL")
    full = d.groupBy("name", "by", "y1", "x1").agg(F.count("*").alias("k"))
    part = lambda *keys: full.groupBy("name", *keys).agg(F.sum("k").alias("k")).groupBy("name").agg(F.sum(F.col("k") * F.log2("k")).alias("s"))
    n = full.groupBy("name").agg(F.sum("k").alias("n"))
    j = n.join(part("by", "y1", "x1").withColumnRenamed("s", "s3"), "name").join(part("y1", "x1").withColumnRenamed("s", "sx"), "name")
    j = j.join(part("by", "y1").withColumnRenamed("s", "sy"), "name").join(part("y1").withColumnRenamed("s", "s1"), "name")
    return j.select("name", F.round(F.greatest(F.lit(0.0), (F.col("s3") - F.col("sx") - F.col("sy") + F.col("s1")) / F.col("n")), 6).alias("bits"))


def ewma_volatility(returns: DataFrame, decay: float = 0.94, warm: int = 512) -> DataFrame:
    """Exponentially weighted volatility of each point: ``name, t, vol``.

    The recursion starts ``warm`` points before each stretch; what came earlier
    weighs decay ** warm, below double precision at the default."""
    d = S.stretched(returns.select("name", "t", "r"), warm)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        v, out = None, np.empty(len(pdf))
        for i, r in enumerate(pdf["r"].to_numpy()):
            v = r * r if v is None else decay * v + (1 - decay) * r * r
            out[i] = v
        pdf = pdf.assign(vol=np.sqrt(out).round(10))
        return pdf.loc[pdf["core"], ["name", "t", "vol"]]

    return d.groupBy("name", "stretch").applyInPandas(run, "name string, t long, vol double")


# ------------------------------------------------------------------ portfolios


def return_moments(returns: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, mean and sample covariance over the times all names have. For a
    bounded set of names; the pivot lists them."""
    names = [r[0] for r in returns.select("name").distinct().orderBy("name").collect()]
    wide = returns.groupBy("ts").pivot("name", names).agg(F.first("r"))
    n, s, x = cross_products(wide, names)
    mean = s / n
    return names, mean, (x - n * np.outer(mean, mean)) / (n - 1)


def _simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    k = np.arange(1, len(v) + 1)
    rho = np.flatnonzero(u - (np.cumsum(u) - 1) / k > 0)[-1]
    return np.maximum(v - (np.cumsum(u)[rho] - 1) / (rho + 1), 0)


def mean_variance(mean: np.ndarray, cov: np.ndarray, aversion: float, steps: int = 3000) -> np.ndarray:
    """Long-only weights that maximise mean less ``aversion`` / 2 variance."""
    w = np.full(len(mean), 1 / len(mean))
    rate = 1 / max(aversion * float(np.linalg.eigvalsh(cov)[-1]), 1e-12)
    for _ in range(steps):
        w = _simplex(w + rate * (mean - aversion * cov @ w))
    return w


def minimum_variance(cov: np.ndarray) -> np.ndarray:
    return mean_variance(np.zeros(len(cov)), cov / max(np.trace(cov), 1e-300), 1.0)


def maximum_sharpe(mean: np.ndarray, cov: np.ndarray, free: float = 0.0) -> np.ndarray:
    """The best Sharpe ratio on the long-only frontier."""
    best = None
    scale = float(np.sqrt(np.mean(np.diag(cov))))
    for a in np.geomspace(0.05, 500, 40):
        w = mean_variance((mean - free) / scale, cov / scale**2, a, 800)
        sharpe = (w @ mean - free) / math.sqrt(max(w @ cov @ w, 1e-300))
        if best is None or sharpe > best[0]:
            best = (sharpe, w)
    return best[1]


def risk_parity(cov: np.ndarray, steps: int = 500) -> np.ndarray:
    """Weights with equal contributions to risk, by cyclic descent."""
    w = 1 / np.sqrt(np.diag(cov))
    for _ in range(steps):
        for i in range(len(w)):
            rest = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-rest + math.sqrt(rest**2 + 4 * cov[i, i] / len(w))) / (2 * cov[i, i])
    return w / w.sum()


def hierarchical_parity(cov: np.ndarray) -> np.ndarray:
    """Weights by bisection along a single-linkage ordering of correlations."""
    sd = np.sqrt(np.diag(cov))
    dist = np.sqrt(np.maximum(0.5 * (1 - cov / np.outer(sd, sd)), 0))
    groups = [[i] for i in range(len(cov))]
    while len(groups) > 1:
        a, b = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: (dist[np.ix_(groups[p[0]], groups[p[1]])].min(), p))
        groups[a] += groups.pop(b)
    w, todo = np.ones(len(cov)), [groups[0]]

    def variance(items: list[int]) -> float:
        inv = 1 / np.diag(cov)[items]
        inv /= inv.sum()
        return float(inv @ cov[np.ix_(items, items)] @ inv)

    while todo:
        items = todo.pop()
        if len(items) < 2:
            continue
        left, right = items[:len(items) // 2], items[len(items) // 2:]
        share = 1 - variance(left) / (variance(left) + variance(right))
        w[left] *= share
        w[right] *= 1 - share
        todo += [left, right]
    return w / w.sum()


def kelly_weights(mean: np.ndarray, cov: np.ndarray, fraction: float = 1.0) -> np.ndarray:
    return fraction * np.linalg.solve(cov + 1e-12 * np.eye(len(cov)), mean)


def black_litterman(prior: np.ndarray, cov: np.ndarray, views: dict[int, tuple[float, float]], tau: float = 0.05) -> np.ndarray:
    """Posterior means from views ``asset: (return, confidence)``."""
    if not views:
        return prior
    p = np.zeros((len(views), len(prior)))
    q, omega = np.zeros(len(views)), np.zeros(len(views))
    for k, (asset, (value, confidence)) in enumerate(sorted(views.items())):
        p[k, asset], q[k] = 1, value
        omega[k] = (1 - confidence) / max(confidence, 1e-9) * tau * cov[asset, asset] + 1e-18
    inv, precise = np.linalg.inv(tau * cov + 1e-15 * np.eye(len(cov))), p.T @ np.diag(1 / omega)
    return np.linalg.solve(inv + precise @ p, inv @ prior + precise @ q)


def spanning_tree(names: list[str], corr: np.ndarray) -> list[tuple[str, str, float]]:
    """Minimum spanning tree on 1 - abs(correlation), by Prim."""
    held, out = {0}, []
    while len(held) < len(names):
        d, i, j = min((1 - abs(corr[i, j]), i, j) for i in held for j in range(len(names)) if j not in held)
        held.add(j)
        out.append((names[i], names[j], float(d)))
    return out


def simulate_paths(spark, paths: int, start: float, mu: float, sigma: float, years: float, seed: int) -> DataFrame:
    """Final values of geometric Brownian paths, made where they are used:
    ``path, value``. The increments of a path are independent and normal, so
    their sum is drawn at once."""
    end = start * F.exp((mu - sigma**2 / 2) * years + sigma * math.sqrt(years) * F.randn(seed))
    return spark.range(paths).select(F.col("id").alias("path"), end.alias("value"))


def frontier(mean: np.ndarray, cov: np.ndarray, points: int = 50) -> list[tuple[float, float, list[float]]]:
    """Return, deviation and weights of the portfolios of least variance at
    ``points`` returns from that of least variance up to the largest mean,
    weights free of sign and summing to one."""
    inverse = np.linalg.pinv(cov + 1e-12 * np.trace(cov) / len(cov) * np.eye(len(cov)))
    one = np.ones(len(mean))
    a, b, c = one @ inverse @ one, one @ inverse @ mean, mean @ inverse @ mean
    d = a * c - b * b
    out = []
    for target in np.linspace(b / a, max(float(mean.max()), b / a), points):
        w = inverse @ (one * (c - b * target) + mean * (a * target - b)) / d if d > 1e-18 else inverse @ one / a
        out.append((float(mean @ w), float(np.sqrt(max(w @ cov @ w, 0.0))), w.tolist()))
    return out


def market_line(mean: np.ndarray, cov: np.ndarray, free: float, points: int = 100) -> list[tuple[float, float]]:
    """Deviation and return from the free rate through the tangent portfolio to
    twice its deviation."""
    w = maximum_sharpe(mean, cov, free)
    top, spread = float(mean @ w), float(np.sqrt(max(w @ cov @ w, 1e-300)))
    return [(float(x), float(free + (top - free) / spread * x)) for x in np.linspace(0, 2 * spread, points)]


def partial_correlations(cov: np.ndarray) -> np.ndarray:
    """Correlations of pairs with all others held, from the inverse."""
    p = np.linalg.pinv(cov + 1e-12 * np.trace(cov) / len(cov) * np.eye(len(cov)))
    s = np.sqrt(np.diag(p))
    out = -p / np.outer(s, s)
    np.fill_diagonal(out, 1.0)
    return out


def skeleton(corr: np.ndarray, n: int, limit: float = 1.96) -> list[tuple[int, int]]:
    """Pairs that stay dependent given nothing and given any one other variable,
    by Fisher's z against ``limit``."""
    def z(r: float, held: int) -> float:
        r = min(max(r, -0.999999999), 0.999999999)
        return abs(np.arctanh(r)) * np.sqrt(max(n - held - 3, 0))

    k, out = len(corr), []
    for i in range(k):
        for j in range(i + 1, k):
            kept = z(corr[i, j], 0) > limit
            for h in range(k):
                if kept and h not in (i, j):
                    r = (corr[i, j] - corr[i, h] * corr[j, h]) / np.sqrt(max((1 - corr[i, h] ** 2) * (1 - corr[j, h] ** 2), 1e-12))
                    kept = z(r, 1) > limit
            if kept:
                out.append((i, j))
    return out
