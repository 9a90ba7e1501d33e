import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import models, neardup

WORDS = "the maintainer noted that a spread looked noisy after many observations while volume stayed broad and rows were clean".split()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    base = [[rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(60)] for _ in range(25)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for k in (1, 2, 4, 8):
            c = b[:]
            for i in rng.sample(range(60), k):
                c[i] = "changed"
            texts.append(" ".join(c))
    texts += [texts[0], texts[0].upper(), "", "", "one two", "One  two", None, "国语文本" * 30, "国语文本" * 31]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1), (0, texts[0], 1)], "doc_id long, text string, class_id int")
    sets = [frozenset(neardup.shingles(t or "")) for t in texts]
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    links = {}
    for i, a in enumerate(sets):
        for j in range(i):
            s = len(a & sets[j]) / len(a | sets[j])
            if s >= 0.8:
                x, y = sorted((root(i), root(j)))
                group[y] = x
                if a != sets[j]:
                    links.setdefault(a, set()).add(sets[j])
                    links.setdefault(sets[j], set()).add(a)
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(df, "doc_id", "text").collect()}
    assert got == {i: (root(i), len(links.get(sets[i], ()))) for i in range(len(texts))}


def test_near_duplicates_of_nothing(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def vectors(spark, n=200, d=6):
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, (n, d)) @ np.diag([5, 3, 1, 1, 0.5, 0.1]) + 2
    return a, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)] + [(n, None)], "vec_id long, embedding array<double>")


def test_components_equal_numpy(spark):
    a, df = vectors(spark)
    scores, share = models.principal_components(df, "vec_id", "embedding", 2)
    _, s, vt = np.linalg.svd(a - a.mean(axis=0), full_matrices=False)
    want = (a - a.mean(axis=0)) @ vt[:2].T
    got = np.array([r.scores for r in scores.orderBy("vec_id").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-4)
    assert np.allclose(share, (s**2 / (s**2).sum())[:2])


def test_clusters_separate_what_is_apart(spark):
    rng = np.random.default_rng(2)
    a = np.concatenate([rng.normal(m, 0.1, (40, 3)) for m in (0, 5, 10)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "vec_id long, embedding array<double>")
    label = [r.cluster for r in models.k_means(df, "vec_id", "embedding", 6).orderBy("vec_id").collect()]
    assert not set(label[:40]) & set(label[40:80]) and not set(label[40:80]) & set(label[80:])


def frame(spark, n=300):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, n), np.zeros(n)
    for t in range(1, n):
        y[t] = 0.3 * y[t - 1] + 0.8 * x[t - 1] + rng.normal(0, 0.3)
    z = rng.normal(0, 1, n)
    rows = [("told", t, float(x[t]), float(y[t])) for t in range(n)] + [("free", t, float(x[t]), float(z[t])) for t in range(n)] + [("short", 0, 1.0, 1.0)]
    return x, y, spark.createDataFrame(rows, "name string, t long, x double, y double")


def test_granger_equals_least_squares(spark):
    x, y, df = frame(spark)
    got = {r.name: (r.n, r.f) for r in models.granger(df, 2).collect()}
    a = np.array([[1, y[t - 1], y[t - 2], x[t - 1], x[t - 2]] for t in range(2, len(x))])
    sse = [float(np.sum((y[2:] - a[:, :p] @ np.linalg.lstsq(a[:, :p], y[2:], rcond=None)[0]) ** 2)) for p in (3, 5)]
    assert got["told"][1] == pytest.approx((sse[0] - sse[1]) / 2 / (sse[1] / (len(x) - 2 - 5)), rel=1e-6)
    assert got["told"][1] > 50 > got["free"][1] and "short" not in got


def test_transfer_entropy_has_a_direction(spark):
    _, _, df = frame(spark)
    got = {r.name: r.bits for r in models.transfer_entropy(df, 3).collect()}
    assert got["told"] > 3 * got["free"]


def test_volatility_over_stretches(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(0, 0.01, 4500)
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(r)], "name string, t long, r double")
    got = [x.vol for x in models.ewma_volatility(df).orderBy("t").collect()]
    v, want = None, []
    for q in r:
        v = q * q if v is None else 0.94 * v + 0.06 * q * q
        want.append(math.sqrt(v))
    assert np.allclose(got, want, atol=1e-9)


def moments(k=4):
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, (k, k))
    return rng.uniform(0.01, 0.1, k), a @ a.T / 10 + 0.05 * np.eye(k)


def test_portfolios():
    mean, cov = moments()
    grid = [np.array([a, b, c, 1 - a - b - c]) for a in np.linspace(0, 1, 21) for b in np.linspace(0, 1 - a, 21) for c in np.linspace(0, 1 - a - b, 21)]
    low = models.minimum_variance(cov)
    assert low.min() >= 0 and low.sum() == pytest.approx(1) and low @ cov @ low <= min(w @ cov @ w for w in grid) + 1e-6
    sharp = models.maximum_sharpe(mean, cov)
    ratio = lambda w: w @ mean / math.sqrt(w @ cov @ w)
    assert ratio(sharp) >= max(map(ratio, grid)) - 2e-3
    even = models.risk_parity(cov)
    parts = even * (cov @ even)
    assert np.allclose(parts, parts.mean(), rtol=1e-6)
    tree = models.hierarchical_parity(cov)
    assert tree.min() > 0 and tree.sum() == pytest.approx(1)
    assert np.allclose(models.black_litterman(mean, cov, {}), mean)
    sure = models.black_litterman(mean, cov, {0: (0.5, 0.999999)})
    assert sure[0] == pytest.approx(0.5, abs=1e-3)
    assert np.allclose(cov @ models.kelly_weights(mean, cov), mean, atol=1e-9)


def test_moments_of_returns_and_tree(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(0, 1, (50, 3))
    t0 = datetime(2024, 1, 1)
    rows = [(n, t0 + timedelta(days=i), float(a[i, k])) for k, n in enumerate("abc") for i in range(50)] + [("a", t0 + timedelta(days=99), 5.0)]
    names, mean, cov = models.return_moments(spark.createDataFrame(rows, "name string, ts timestamp, r double"))
    assert names == ["a", "b", "c"] and np.allclose(mean, a.mean(axis=0)) and np.allclose(cov, np.cov(a.T))
    tree = models.spanning_tree(names, np.array([[1, 0.9, 0.1], [0.9, 1, 0.5], [0.1, 0.5, 1]]))
    assert [(x, y) for x, y, _ in tree] == [("a", "b"), ("b", "c")]


def test_simulated_prices(spark):
    out = models.simulate_paths(spark, 20_000, 100.0, 0.05, 0.2, 1.0, 3).agg(F.avg("value").alias("m"), F.count("*").alias("n")).first()
    assert out.n == 20_000 and out.m == pytest.approx(100 * math.exp(0.05), rel=0.01)


def test_profiles_bound_what_sets_share(spark):
    rng = np.random.default_rng(5)
    some = np.unique(rng.integers(0, 2**63, 40_000).astype(np.uint64))
    assert neardup._profile(some) == b""  # more than a byte holds: never left out
    a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    other = np.unique(np.concatenate([a[:100], rng.integers(0, 2**63, 100).astype(np.uint64)]))
    near = np.unique(np.concatenate([a[:185], rng.integers(0, 2**63, 15).astype(np.uint64)]))
    faced = [(1, a, other), (2, a, near), (3, a, some), (4, a, a)]
    pdf = pd.DataFrame({"src": [i for i, _, _ in faced], "dst": 9, "x": [neardup._profile(x) for _, x, _ in faced], "y": [neardup._profile(y) for _, _, y in faced]})
    assert [i for out in neardup._within(0.8)([pdf]) for i in out["src"]] == [2, 3, 4]


def test_near_duplicates_send_only_sets_within_bounds(spark):
    rng = random.Random(3)
    part = " ".join(f"shared{i}" for i in range(12))  # eight shingles of each text's fifty
    texts = [" ".join([part, *(f"w{rng.randint(0, 10**6)}" for _ in range(42))]) for _ in range(40)]
    texts.append(texts[0] + " end")
    src = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    from strandline.session import settle

    counted = settle(src.mapInPandas(neardup._count, "id long, sign long, chunk int, counts binary"))
    heads = counted.where("chunk < 0").select("sign", F.col("id").alias("head"))
    pairs = neardup._similar(src, heads, 0.8, counted)
    assert [(r.src, r.dst) for r in pairs.collect()] == [(0, 40)]
    # The whole sets that were written: those of one pair, not of every text.
    sets = [f for f in pairs.inputFiles()]
    assert spark.read.parquet(*{f.rsplit("/", 1)[0] for f in sets if "set" in spark.read.parquet(f).columns}).count() == 2
