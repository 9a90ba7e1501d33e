"""Ordered blocks, linear models, networks, health and matching against plain Python."""

import itertools
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import match as M
from strandline.operators import health as H
from strandline.operators import models_linear as L
from strandline.operators import network as N
from strandline.operators import ordered as O
from strandline.operators import relational as R
from strandline.plans import linear


@pytest.fixture(scope="module")
def points(spark):
    """One group holds most rows; values tie and are missing."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", None]), i, rng.choice([None, 1.0, 2.0, 2.0, 5.5, -3.0])) for i in range(400)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, i int, v double").repartition(4)


def by_group(rows):
    out = {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(g, []).append((i, v))
    return out


def test_running_sum_places_and_carried(points):
    rows, df = points
    groups = by_group(rows)
    got = {(r.g, r.i): r for r in O.carried(O.indexed(O.running_sum(df, ["g"], ["i"], "v", "s"), ["g"], ["i"], "p"), ["g"], ["i"], "v", "c").collect()}
    assert len(got) == len(rows)
    for g, own in groups.items():
        total, last = 0.0, None
        for k, (i, v) in enumerate(own):
            total, last = total + (v or 0.0), v if v is not None else last
            r = got[g, i]
            assert r.p == k and r.c == last and r.s == pytest.approx(total)


def test_looking_back_over_stretches(points):
    rows, df = points
    out = O.looking_back(df, ["g"], ["i"], 3, {"m": lambda w: F.count("i").over(w.rowsBetween(-3, -1)), "b": lambda w: F.lag("i").over(w)}, size=16)
    got = {(r.g, r.i): (r.m, r.b) for r in out.collect()}
    for g, own in by_group(rows).items():
        for k, (i, _) in enumerate(own):
            assert got[g, i] == (min(k, 3), own[k - 1][0] if k else None)


def test_percentiles_equal_numpy(points):
    rows, df = points
    got = {r.g: r.p for r in O.percentiles(df, ["g"], "v", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    for g, own in by_group(rows).items():
        assert got[g] == pytest.approx(np.percentile([v for _, v in own if v is not None], (0, 25, 50, 90, 100)).tolist())
    whole = O.percentiles(df, [], "v", (0.5,)).collect()
    assert whole[0].p[0] == np.median([v for _, _, v in rows if v is not None])
    assert O.percentiles(df.limit(0), ["g"], "v", (0.5,)).count() == 0


def test_fifo_equals_plain_allocation(spark):
    rng = random.Random(5)
    demand = [("p" if rng.random() < 0.7 else "q", i, rng.choice([0, 1, 2, 7])) for i in range(60)]
    supply = [("p" if rng.random() < 0.7 else "q", i, rng.choice([0, 3, 5])) for i in range(40)]
    got = R.allocate_fifo(spark.createDataFrame(demand, "g string, d int, dq long"), spark.createDataFrame(supply, "g string, s int, sq long"), ["g"], ["d"], ["s"], "dq", "sq")
    want = set()
    for g in "pq":
        left = [[i, q] for h, i, q in supply if h == g]
        for d, q in ((i, q) for h, i, q in demand if h == g):
            while q and left:
                take = min(q, left[0][1])
                if take:
                    want.add((g, d, left[0][0], take))
                q, left[0][1] = q - take, left[0][1] - take
                if not left[0][1]:
                    left.pop(0)
    assert {(r.g, r.d, r.s, r.allocated) for r in got.collect()} == want


# ------------------------------------------------------------------- models


def test_regression_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(0, 0.1, 200)
    rows = [("g", float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [("one", 1.0, 2.0, 3.0), ("g", None, 1.0, 1.0)]
    got = {(r.g, r.term): r for r in L.regress(spark.createDataFrame(rows, "g string, a double, b double, y double"), ["g"], "y", ["a", "b"]).collect()}
    beta = np.linalg.lstsq(np.column_stack((np.ones(200), x)), y, rcond=None)[0]
    assert [got["g", t].coefficient for t in ("intercept", "a", "b")] == pytest.approx(beta.tolist())
    assert got["g", "a"].n == 200 and not any(g == "one" for g, _ in got)


def simulated(spark, n=3000):
    rng = np.random.default_rng(2)
    a = np.array([[0.5, 0.2], [0.0, 0.3]])
    z = np.zeros((n, 2))
    for t in range(1, n):
        z[t] = a @ z[t - 1] + rng.normal(0, 1, 2)
    return a, z, spark.createDataFrame([("n", i, float(u), float(v)) for i, (u, v) in enumerate(z)], "name string, t long, y double, x double")


def test_vector_autoregression(spark):
    a, z, df = simulated(spark)
    model = L.vector_autoregression(df, ["y", "x"], 2)
    r = model.collect()[0]
    assert r.p == 1 and np.allclose(np.reshape(r.coef, (2, 2)), a, atol=0.05)
    f = {(x.step, x.variable): x.forecast for x in L.system_forecast(model, ["y", "x"], 2).collect()}
    assert f[1, "y"] == pytest.approx(float(np.reshape(r.coef, (2, 2))[0] @ z[-1]))
    psi = [x for x in L.impulse_responses(model, ["y", "x"], 3).collect() if x.variable == "y"]
    for h in range(4):
        assert sum(x.share for x in psi if x.step == h) == pytest.approx(1)
    root = np.linalg.cholesky(np.reshape(r.sigma, (2, 2)))
    assert next(x.response for x in psi if x.step == 1 and x.shock == "y") == pytest.approx(float((np.reshape(r.coef, (2, 2)) @ root)[0, 0]))


def test_cointegration_of_tied_and_of_free_walks(spark):
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=1500))
    tied, free = 2 * x + rng.normal(size=1500), np.cumsum(rng.normal(size=1500))
    rows = [(n, i, float(y), float(v)) for n, ys in (("tied", tied), ("free", free)) for i, (y, v) in enumerate(zip(ys, x, strict=True))]
    df = spark.createDataFrame(rows, "name string, t long, y double, x double")
    assert {r.name: r.cointegrated for r in L.engle_granger(df, "y", "x").collect()} == {"tied": True, "free": False}
    trace = {(r.name, r.rank_at_most): r.rejected for r in L.johansen(df, ["y", "x"]).collect()}
    assert trace["tied", 0] and not trace["free", 0]
    gap = {(r.name, r.equation, r.term): r for r in L.error_correction(df, "y", "x").collect()}
    assert gap["tied", "dy", "gap_1"].t < -10


def test_order_and_filters(spark):
    rng = np.random.default_rng(6)
    v = np.zeros(4000)
    for t in range(2, 4000):
        v[t] = 0.6 * v[t - 1] - 0.4 * v[t - 2] + rng.normal()
    df = spark.createDataFrame([("n", i, float(x)) for i, x in enumerate(v)], "name string, t long, v double")
    order = {r.d: r.p for r in L.select_order(df, "v", 4).collect()}
    assert order[0] in (2, 3, 4)
    y = v[:300]
    d = np.diff(np.eye(300), 2, axis=0)
    want = np.linalg.solve(np.eye(300) + 100 * d.T @ d, y)
    assert np.allclose(L._penalised(y, 100.0), want)
    for n in (3, 4):
        e = np.diff(np.eye(n), 2, axis=0)
        assert np.allclose(L._penalised(y[:n], 100.0), np.linalg.solve(np.eye(n) + 100 * e.T @ e, y[:n]))
    wave = spark.createDataFrame([("n", i, float(np.sin(2 * np.pi * i / 32))) for i in range(1024)], "name string, t long, v double")
    top = L.spectrum(wave, "v").orderBy(F.desc("amplitude")).first()
    assert top.period == 32


def test_spectrum_beside_parts_of_few_points(spark):
    # 1,024 points and three of the next stretch; a name of two points only.
    wave = [("n", i, float(np.sin(2 * np.pi * i / 32))) for i in range(1027)]
    df = spark.createDataFrame([*wave, ("few", 0, 1.0), ("few", 1, 2.0), ("part", 5000, 1.0), *(("part", i, float(i % 2)) for i in range(8)), ("part", 9, None)], "name string, t long, v double")
    got = {(r.name, r.k): r.amplitude for r in L.spectrum(df, "v").collect()}
    assert {n for n, _ in got} == {"n", "part"} and len(got) == 2 * 512
    for name, y in (("n", np.array([v for _, _, v in wave[:1024]])), ("part", np.arange(8) % 2)):
        want = np.abs(np.fft.rfft((y - y.mean()) * np.hanning(len(y)), 1024)) * 2 / len(y)
        assert np.allclose([got[name, k] for k in range(1, 513)], want[1:])


def test_series_spectrum_of_prices_with_short_ends(spark, tmp_path):
    # Returns of a name reach 6 points into its second stretch; another has 3 prices; bad and repeated rows do not count.
    rng = np.random.default_rng(9)
    steps = {"long": rng.normal(size=1030) / 50, "small": rng.normal(size=9) / 50, "three": np.zeros(3)}
    rows = [(n, i, float(v), "price") for n, y in steps.items() for i, v in enumerate(100 * np.exp(np.cumsum(y)))]
    rows += [rows[5], ("small", 9, float("nan"), "price"), ("small", 10, -1.0, "price"), (None, 0, 1.0, "price"), *(("rate", i, 1.0 + i, "pct") for i in range(20))]
    df = spark.createDataFrame(rows, "name string, t long, close_value double, unit string")
    df.withColumn("ts", F.timestamp_seconds("t")).write.parquet(str(tmp_path / "series.parquet"))
    got = {(r.name, r.k): (r.period, r.amplitude) for r in linear.series_spectrum(spark, str(tmp_path)).collect()}
    assert set(got) == {(n, k) for n in ("long", "small") for k in range(1, 513)}
    for name, y in (("long", steps["long"][1:1024]), ("small", steps["small"][1:])):
        want = np.abs(np.fft.rfft((y - y.mean()) * np.hanning(len(y)), 1024)) * 2 / len(y)
        assert np.allclose([got[name, k] for k in range(1, 513)], [(1024 / k, want[k]) for k in range(1, 513)])


# ----------------------------------------------------------------- networks


def graph(seed, n=14, m=17):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def distances(edges, start):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, front = {start: 0}, [start]
    while front:
        front = [y for x in front for y in near.get(x, ()) if y not in out and out.setdefault(y, out[x] + 1)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_bridges_and_betweenness(spark, seed):
    edges = graph(seed)
    df = spark.createDataFrame(edges, "src long, dst long")
    nodes = sorted({x for e in edges for x in e})
    want = {e for e in edges if e[1] not in distances([f for f in edges if f != e], e[0])}
    assert {(r.src, r.dst) for r in N.bridges(df).collect()} == want
    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        d = distances(edges, s)
        if t not in d:
            continue
        paths = [[s]]
        for _ in range(d[t]):
            paths = [[*p, b] for p in paths for e in edges for a, b in (e, e[::-1]) if a == p[-1] and d.get(b) == len(p)]
        paths = [p for p in paths if p[-1] == t]
        for p in paths:
            for x in p[1:-1]:
                score[x] += 1 / len(paths)
    got = {r.id: r.betweenness for r in N.betweenness(df, spark.createDataFrame([(x,) for x in nodes], "id long")).collect()}
    assert got == pytest.approx(score)


def test_distress_spread_and_trees(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.8), (2, 4, 0.5), (3, 4, 1.0), (4, 1, 1.0), (None, 2, 1.0), (5, 5, 1.0)], "src long, dst long, weight double")
    ranks = N.debt_rank(e, spark.createDataFrame([(1,), (None,)], "id long"))
    assert {r.id: r.distress for r in ranks.collect()} == {1: 1.0, 2: 0.5, 3: 0.8, 4: 1.0}
    assert [(r.reached, round(r.impact, 6)) for r in N.systemic_risk(ranks, 4).collect()] == [(3, round(2.3 / 3, 6))]
    tree = {r.id: (r.depth, r.parent) for r in N.hierarchy(e, spark.createDataFrame([(1,)], "id long")).collect()}
    assert tree == {1: (0, None), 2: (1, 1), 3: (1, 1), 4: (2, 2)}
    star = spark.createDataFrame([(0, i) for i in range(1, 5)], "src long, dst long")
    central = {r.id: r.centrality for r in N.eigenvector_centrality(star, 30).collect()}
    assert central[0] == pytest.approx(2**-0.5, abs=1e-3) and central[1] == pytest.approx(8**-0.5, abs=1e-3)
    spread = {r.id: r for r in N.epidemic(star, spark.createDataFrame([(0,)], "id long"), 0.3, 0.5, 1).collect()}
    assert spread[1].i == pytest.approx(0.3) and spread[0].r == pytest.approx(0.5)


# ------------------------------------------------------- health and matching


def test_beta_interval(spark):
    df = spark.createDataFrame([(3, 1), (0, 0), (400, 20)], "p long, f long")
    i = H.beta_interval(F.col("p"), F.col("f"))
    got = [(r.lo, r.hi) for r in df.select(i["low"].alias("lo"), i["high"].alias("hi")).collect()]
    for (p, f), (lo, hi) in zip(((3, 1), (0, 0), (400, 20)), got, strict=True):
        x = np.linspace(0, 1, 200_001)
        w = x**p * (1 - x) ** f
        c = np.cumsum(w / w.sum())
        assert lo == pytest.approx(x[np.searchsorted(c, 0.025)], abs=2e-3) and hi == pytest.approx(x[np.searchsorted(c, 0.975)], abs=2e-3)


def test_next_run(spark):
    now, made = datetime(2024, 1, 31, 12, 0), datetime(2024, 1, 31, 6, 0)
    rows = [("once", 0, "13:00", 0, 1), ("once", 0, "11:00", 0, 1), ("interval", 5400, None, 0, 1), ("daily", 0, "11:00", 0, 1), ("weekly", 0, "11:00", 2, 1), ("monthly", 0, "11:00", 0, 31), ("cron", 0, "11:00", 0, 1), (None, 0, None, None, None)]
    df = spark.createDataFrame(rows, "k string, s int, c string, w int, d int")
    got = df.select(H.next_run(F.col("k"), F.lit(now), F.lit(made), F.col("s"), F.col("c"), F.col("w"), F.col("d")).cast("string").alias("x")).collect()
    assert [r.x for r in got] == ["2024-01-31 13:00:00", None, "2024-01-31 13:30:00", "2024-02-01 11:00:00", "2024-02-07 11:00:00", "2024-02-29 11:00:00", None, None]


def test_matching(spark):
    df = spark.createDataFrame([(1, "a long haystack", "hay"), (2, "a long haystcak", "haystack"), (3, "", "x"), (4, None, "x"), (5, "abc", "")], "k int, h string, n string")
    got = {r.k: r.s for r in df.select("k", M.contains(F.col("h"), F.col("n")).alias("s")).collect()}
    assert got[1] == 1.0 and 0.6 < got[2] < 1 and got[3] == 0.0 and got[4] is None and got[5] == 0.0
    classes = M.classify(spark.createDataFrame([(1, "Alpha beta"), (2, None)], "k int, t string"), "k", "t", {"x": ("alpha", "beta"), "y": ("beta", "gamma"), "z": ("delta",)})
    assert [(r.k, r["class"], r.score) for r in classes.collect()] == [(1, "x", 1.0), (1, "y", 0.5)]
    weights, ratio = M.ahp_weights([[(1, 1, 1), (2, 2, 2), (4, 4, 4)], [(0.5, 0.5, 0.5), (1, 1, 1), (2, 2, 2)], [(0.25, 0.25, 0.25), (0.5, 0.5, 0.5), (1, 1, 1)]])
    assert weights == pytest.approx([4 / 7, 2 / 7, 1 / 7]) and ratio == pytest.approx(0)


def test_frontier_and_dependencies():
    from strandline.operators import models

    rng = np.random.default_rng(8)
    a = rng.normal(size=(5000, 1))
    b, c = a + rng.normal(0, 0.5, (5000, 1)), rng.normal(size=(5000, 1))
    x = np.hstack((a, b, c, b + rng.normal(0, 0.5, (5000, 1))))
    cov, corr = np.cov(x.T), np.corrcoef(x.T)
    assert models.skeleton(corr, 5000) == [(0, 1), (1, 3)]
    assert abs(models.partial_correlations(cov)[0, 3]) < 0.05 < models.partial_correlations(cov)[0, 1]
    mean = np.array([0.1, 0.2, 0.15, 0.05])
    line = models.frontier(mean, cov, 20)
    for m, d, w in line:
        assert sum(w) == pytest.approx(1) and d == pytest.approx(float(np.sqrt(np.array(w) @ cov @ np.array(w))))
    assert [d for _, d, _ in line] == sorted(d for _, d, _ in line)
    other = rng.dirichlet(np.ones(4), 2000)
    assert all(np.sqrt(w @ cov @ w) >= line[0][1] - 1e-9 for w in other)
