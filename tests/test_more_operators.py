import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from strandline.operators import anomaly, graph, market, series


def test_grubbs_finds_what_stands_out(spark):
    rng = random.Random(3)
    rows = [("a", i, rng.gauss(0, 1)) for i in range(60)] + [("a", 100, 9.0), ("a", 101, -12.0)] + [("b", i, rng.gauss(0, 1)) for i in range(40)] + [("c", 1, 1.0), ("d", 1, 2.0), ("d", 2, 2.0), ("d", 3, 2.0), ("e", 1, None)]
    got = {(r.g, r.i, r["round"]) for r in anomaly.grubbs(spark.createDataFrame(rows, "g string, i long, v double"), ["g"], "i", "v").collect()}
    want = set()
    for g in "abcde":
        left = [(v, i) for h, i, v in rows if h == g and v is not None]
        for turn in range(1, 11):
            n = len(left)
            if n < 3:
                break
            m = sum(v for v, _ in left) / n
            sd = math.sqrt(sum((v - m) ** 2 for v, _ in left) / (n - 1))
            worst = max(left, key=lambda e: abs(e[0] - m))
            t = anomaly._student(0.05 / (2 * n), n - 2)
            if sd == 0 or abs(worst[0] - m) / sd <= (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t)):
                break
            want.add((g, worst[1], turn))
            left.remove(worst)
    assert got == want >= {("a", 101, 1), ("a", 100, 2)}


@pytest.mark.parametrize(("p", "free", "want"), [(0.025, 10, 2.2281), (0.05, 5, 2.0150), (0.005, 30, 2.7500)])
def test_student_quantile(p, free, want):
    assert anomaly._student(p, free) == pytest.approx(want, abs=1e-3)


def test_band_pass_equals_convolution(spark, monkeypatch):
    monkeypatch.setattr(series.stretched, "__defaults__", (64,))
    v = [10 * math.sin(i / 2) + i + 5 * math.sin(i / 40) for i in range(150)]
    df = spark.createDataFrame([("a", i, datetime(2024, 1, 1) + timedelta(days=i), x) for i, x in enumerate(v)], "name string, t long, ts timestamp, value double")
    k = np.arange(1, 13)
    half = (np.sin(2 * np.pi / 6 * k) - np.sin(2 * np.pi / 32 * k)) / (np.pi * k)
    w = np.concatenate((half[::-1], [(2 * np.pi / 6 - 2 * np.pi / 32) / np.pi], half))
    want = np.convolve(v, w - w.mean(), "valid")
    got = {r.t: r.cycle for r in series.band_pass(df).collect()}
    assert set(got) == set(range(12, 138)) and np.allclose([got[t] for t in range(12, 138)], want, atol=1e-5)


def test_communities_split_cliques(spark):
    e = [(a, b) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w")]
    df = spark.createDataFrame(e, "src string, dst string")
    got = {r.id: r.community for r in graph.communities(graph.nodes_of(df), df).collect()}
    assert len({got[x] for x in "abc"}) == 1 and len({got[x] for x in "xyz"}) == 1 and got["a"] != got["z"]


def test_references_are_capped_and_exclude_seeds(spark):
    items = spark.createDataFrame([(1, [2, 3, 3, 4, 5]), (2, [3]), (9, [7])], "id long, refs array<long>")
    got = {r.id: r.sources for r in market.expand_references(items, spark.createDataFrame([(1,), (2,)], "id long"), 3).collect()}
    assert got == {3: [1, 2], 4: [1]}


def test_books_without_orders(spark):
    empty = spark.createDataFrame([], "book string, side string, price double, qty double")
    assert market.call_auction(empty, ["book"]).count() == 0
    one = spark.createDataFrame([("a", "buy", 10.0, 5.0), ("a", "sell", 9.0, 3.0), ("a", "sell", 11.0, 9.0), ("a", "buy", None, 1.0)], "book string, side string, price double, qty double")
    r = market.call_auction(one, ["book"]).first()
    assert (r.price, r.volume) == (9.0, 3.0)
