from datetime import datetime, timedelta

import numpy as np

from strandline.operators import spikes

T0 = datetime(2024, 1, 1)


def series(spark, values, unit="price", name="n", start=0, stretch_ts=True):
    rows = [(start + i, name, i, T0 + timedelta(hours=i), None if v is None else float(v), "hourly", unit, T0 + timedelta(hours=i, minutes=1)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "obs_id long, name string, t long, ts timestamp, close_value double, frequency string, unit string, ingested_at timestamp")


def walk(n, seed=1, scale=1.0):
    return 500 + np.cumsum(np.random.default_rng(seed).normal(0, scale, n))


def found(df):
    return {(r.obs_id, r.reason) for r in spikes.flag_readings(df).collect()}


def test_spikes_shift_and_limits(spark):
    v = walk(400)
    v[100] += 40
    v[150:153] += 60
    v[200:] += 80  # for good
    v[250] = -3
    v[260] = np.inf
    data = list(v)
    data[300] = None
    got = found(series(spark, data))
    assert {i for i, r in got if r == "spike"} == {100, 150, 151, 152}
    assert {i for i, r in got if r == "impossible"} == {250, 260}
    assert {i for i, r in got if r == "level shift"} == {200}


def test_longer_excursions_and_shifts_by_themselves():
    for length in (4, 5, 8, 40):
        v = walk(600, 11)
        v[200:200 + length] += 60
        v[450:] -= 50
        short, longer, shifted = spikes.judge(v)
        assert not short.any() or length == 4
        assert set(np.flatnonzero(short | longer)) == set(range(200, 200 + length)) or length < spikes.HOLD
        assert list(np.flatnonzero(shifted)) == [450]


def test_many_spikes_need_many_rounds():
    v = walk(4000, 2)
    at = np.arange(20, 3980, 12)
    v[at] += 45 * np.where(at % 24 < 12, 1, -1)
    assert spikes.excursions(v)[at].mean() > 0.98


def test_readings_without_index_are_cut_into_stretches(spark, monkeypatch):
    monkeypatch.setattr(spikes, "STRETCH", 512)
    v = walk(1500, 9)
    v[300] += 60
    v[1018:1032] = v[1018]
    df = series(spark, v).drop("t").selectExpr("*", "CAST(NULL AS BIGINT) AS t")
    got = found(df.unionByName(df))
    assert {i for i, r in got if r == "spike"} == {300}
    assert {i for i, r in got if r == "frozen"} == set(range(1019, 1032))


def test_frozen_run_over_a_border(spark):
    n = spikes.STRETCH + 300
    v = walk(n, 3)
    a = spikes.STRETCH - 6
    v[a:a + 14] = v[a]
    got = {i for i, r in found(series(spark, v)) if r == "frozen"}
    assert got == set(range(a + 1, a + 14))


def test_sticky_source_is_normal(spark):
    rng = np.random.default_rng(5)
    v = np.round(100 + np.cumsum(rng.choice([0, 0, 0, 0.5, -0.5], 800)), 1)
    assert not {i for i, r in found(series(spark, v)) if r == "frozen"}


def test_repeats_empty_and_short(spark):
    v = list(walk(200))
    v[50] += 50
    df = series(spark, v)
    assert found(df.unionByName(df)) == found(df) == {(50, "spike")}
    assert found(df.limit(0)) == set()
    assert found(series(spark, [1.0, 2.0])) == set()
    assert found(series(spark, [150.0, None, 50.0], unit="pct")) == {(0, "impossible")}
