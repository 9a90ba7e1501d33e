"""Implausible readings in measurement series, relative to their own source.

A source is cut into stretches of ``STRETCH`` readings by its dense index, each
with a margin of ``MARGIN`` neighbours on both sides, so that a source holding
a third of all readings spreads over many tasks. In a stretch

* a robust autoregression of the differences is fitted by iteratively
  reweighted least squares;
* blocks of one to three readings are tested as additive outliers: every
  reading of the block must lie far (in local innovation scales) from the
  forecast out of the past and from the backcast out of the future, on the same
  side of both, while the reading after the block agrees with the forecast. A
  level shift agrees with the backcast, so it fails this test. Accepted blocks
  are replaced by the blend of both predictions and the tests are repeated
  until nothing new is found;
* what is left is tested for level shifts: an innovation is one if the
  readings after it hold the new level. Its size is estimated from these,
  taken out, and the test repeated until nothing new is found. A shift that a
  later one of the stretch takes back is a longer excursion, of any length;
  the others are lasting changes of level;
* readings impossible for the unit are flagged one by one;
* runs of equal readings are measured. Runs that touch a stretch's border are
  joined to their neighbour by an equi-join on (source, stretch).

A run is frozen if it has at least ten readings and stands clear of the run
lengths normal for the source: going up the source's distinct run lengths, the
first that is ``RUN_JUMP`` times its predecessor ends the normal ones. Only
distinct lengths, not runs, are gathered per source.

Null readings are no cases and do not interrupt a run. A repeated reading (same
id) counts once, the first loaded. Rows without id or source are ignored. Rows
without index get one of their own, in order of time, from counts by source and
day, and form stretches of their own. A source of fewer than five readings has
no movement to judge by: only impossible readings are flagged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 4096
MARGIN = 128
ORDER = 4
REACH = 3
CUT = 6.5
RUN_LEAST = 10
RUN_JUMP = 2.2
#: Readings that must hold a new level, and the share of the step they must keep.
HOLD, KEPT = 8, 0.5
#: How far the step back may differ from the step, as a share of it.
BACK = 0.4
#: The readings possible for a unit, and whether the ends are. A
#: unit with None has the range of the source's own differences.
LIMITS = {"price": (0.0, np.inf, False), "pct": (0.0, 100.0, True), "spread": None}
#: Half-range beyond which a difference is impossible, in ranges from the tenth to the ninth tenth.
SPREAD = 6
#: Shorter runs cannot move the limit above ``RUN_LEAST``.
RUN_KEPT = 5

_OUT = pa.schema([
    ("name", pa.string()), ("stretch", pa.int64()), ("reason", pa.string()), ("value", pa.float64()),
    ("length", pa.int64()), ("left", pa.bool_()), ("right", pa.bool_()), ("ids", pa.list_(pa.int64())),
])
_OUT_SQL = "name string, stretch long, reason string, value double, length long, left boolean, right boolean, ids array<long>"


def rolling_mean(x: np.ndarray, half: int) -> np.ndarray:
    """Mean over the ``half`` values before and after each, cut at the ends."""
    total = np.concatenate(([0.0], np.cumsum(x)))
    i = np.arange(len(x))
    a, b = np.maximum(i - half, 0), np.minimum(i + half + 1, len(x))
    return (total[b] - total[a]) / (b - a)


def median_filter(x: np.ndarray, half: int) -> np.ndarray:
    padded = np.pad(x, half, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)


def fit_autoregression(x: np.ndarray, order: int) -> np.ndarray:
    """Coefficients of the differences of ``x``, by bisquare reweighting."""
    d = np.diff(x)
    if len(d) < 8 * order:
        return np.zeros(order)
    lags = np.lib.stride_tricks.sliding_window_view(d[:-1], order)[:, ::-1]
    y = d[order:]
    w = np.ones(len(y))
    coef = np.zeros(order)
    ridge = np.eye(order) * (1e-9 + 1e-6 * float(np.mean(d * d)))
    for _ in range(4):
        a = lags * w[:, None]
        coef = np.linalg.solve(a.T @ lags + ridge, a.T @ y)
        e = y - lags @ coef
        scale = innovation_scale(e)
        if scale == 0:
            break
        w = np.square(np.maximum(0.0, 1 - np.square(e / (5 * scale))))
    return coef


def innovation_scale(e: np.ndarray) -> float:
    """Robust standard deviation that stays positive where most values are zero."""
    q50, q90 = np.quantile(np.abs(e), (0.5, 0.9)) if len(e) else (0.0, 0.0)
    return float(max(1.4826 * q50, q90 / 1.645))


def forecasts(x: np.ndarray, coef: np.ndarray, steps: int) -> np.ndarray:
    """``out[k, t]``: x[t + k] as foreseen from x[..t - 1]."""
    n, p = len(x), len(coef)
    d = np.concatenate((np.zeros(p + 1), np.diff(x)))  # d[p + t] = x[t] - x[t - 1]
    lag = [d[p - k:p - k + n] for k in range(1, p + 1)]
    level = np.concatenate((x[:1], x[:-1]))
    out = np.empty((steps, n))
    for k in range(steps):
        move = sum(c * v for c, v in zip(coef, lag, strict=True)) if p else np.zeros(n)
        level = level + move
        out[k] = level
        lag = [move, *lag[:-1]] if p else lag
    return out


def local_scale(x: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Innovation scale around each reading."""
    e = np.abs(x - forecasts(x, coef, 1)[0])
    whole = innovation_scale(e[1:])
    if whole == 0:
        whole = float(np.mean(e)) or 1e-9
    local = rolling_mean(np.minimum(e, 4 * whole), 50) * 1.2533
    return np.maximum(local, 0.5 * whole)


def excursions(x: np.ndarray, cut: float = CUT) -> np.ndarray:
    """Mask of readings in short excursions from the path of the series."""
    return judge(x, cut)[0]


def judge(x: np.ndarray, cut: float = CUT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks of readings in short excursions, of readings in longer ones, and
    of the first readings of lasting changes of level."""
    n = len(x)
    found = np.zeros(n, bool)
    if n < 5:
        return found, found.copy(), found.copy()
    centre = median_filter(x, 3)
    rough = x - centre
    gross = np.abs(rough) > 8 * max(innovation_scale(rough), 1e-12)
    clean = np.where(gross, centre, x)
    coef = fit_autoregression(clean, ORDER)
    scale = local_scale(clean, coef)
    wide = median_filter(clean, 10)
    y = x.copy()
    while True:
        ahead = forecasts(y, coef, REACH + 1)
        back = forecasts(y[::-1], coef, REACH)[:, ::-1]  # back[k, u]: y[u - k] out of y[u + 1..]
        best = np.zeros(n)
        size = np.zeros(n, int)
        for length in range(1, REACH + 1):
            starts = np.arange(1, n - length)
            if not len(starts):
                break
            ends = starts + length - 1
            score = np.full(len(starts), np.inf)
            for j in range(length):
                r = starts + j
                f, b = y[r] - ahead[j, starts], y[r] - back[length - 1 - j, ends]
                off = np.minimum(np.abs(f), np.abs(b)) * (f * b > 0)
                far = np.abs(y[r] - wide[r]) >= 0.5 * off
                score = np.minimum(score, off * far / scale[r])
            after = np.abs(y[ends + 1] - ahead[length, starts]) / scale[starts]
            score[after > np.maximum(0.6 * score, 3 * np.sqrt(length + 1))] = 0
            better = score > best[starts]
            best[starts[better]], size[starts[better]] = score[better], length
        hits = np.flatnonzero(best > cut)
        if not len(hits):
            break
        taken = np.zeros(n, bool)
        for t in hits[np.argsort(-best[hits], kind="stable")]:
            k = size[t]
            if taken[max(t - ORDER, 0):t + k + ORDER].any():
                continue
            taken[t:t + k] = True
            share = np.arange(1, k + 1) / (k + 1)
            y[t:t + k] = (1 - share) * ahead[:k, t] + share * back[:k, t + k - 1][::-1]
            found[t:t + k] = True
    longer, shifted = np.zeros(n, bool), np.zeros(n, bool)
    open_steps: list[tuple[int, float]] = []
    for t, size in level_shifts(y, coef, scale, cut):
        taken_back = next((k for k in range(len(open_steps) - 1, -1, -1) if abs(open_steps[k][1] + size) <= BACK * abs(size)), None)
        if taken_back is None:
            open_steps.append((t, size))
        else:
            longer[open_steps[taken_back][0]:t] = True
            del open_steps[taken_back:]
    for t, _ in open_steps:
        shifted[t] = True
    return found, longer & ~found, shifted


def level_shifts(y: np.ndarray, coef: np.ndarray, scale: np.ndarray, cut: float = CUT) -> list[tuple[int, float]]:
    """Steps to a level that the readings after it hold: place and size, in
    order of place."""
    y, n = y.copy(), len(y)
    out: dict[int, float] = {}
    refused: set[int] = set()
    while True:
        ahead = forecasts(y, coef, HOLD)
        far = np.abs(y - ahead[0]) / scale
        far[:ORDER + 1] = 0
        found = False
        last = n
        for t in np.flatnonzero(far > cut)[::-1].tolist():
            m = min(HOLD, n - t)
            if t in refused or m < HOLD or t + HOLD > last:
                continue
            steps = y[t:t + m] - ahead[:m, t]
            size = float(np.median(steps))
            if size == 0 or (steps * np.sign(size) < KEPT * abs(size)).any() or abs(size) < cut * scale[t] * KEPT:
                refused.add(t)
                continue
            out[t] = out.get(t, 0.0) + size
            refused.add(t)
            y[t:] -= size
            found, last = True, t
        if not found:
            return sorted(out.items())




def impossible(x: np.ndarray, unit: str | None) -> np.ndarray:
    """Mask of readings no source of the unit can have."""
    bad = ~np.isfinite(x)
    if unit not in LIMITS:
        return bad
    with np.errstate(invalid="ignore"):
        if LIMITS[unit] is not None:
            low, high, ends = LIMITS[unit]
            bad |= (x < low) | (x > high) if ends else (x <= low) | (x >= high)
        else:
            fine = x[~bad]
            if len(fine) >= 20:
                low, mid, high = np.quantile(fine, (0.1, 0.5, 0.9))
                bad |= np.abs(x - mid) > SPREAD * max(high - low, 1e-9)
    return bad


def _stretch(key: tuple, part: pa.Table) -> pa.Table:
    name, stretch = key[0].as_py(), key[1].as_py()
    t, obs = part["t"].to_numpy(), part["obs_id"].to_numpy()
    order = np.lexsort((part["loaded"].to_numpy(), obs, t))
    keep = np.ones(len(order), bool)
    keep[1:] = obs[order][1:] != obs[order][:-1]
    order = order[keep]
    t, obs = t[order], obs[order]
    column = part["value"].combine_chunks()
    held = ~column.is_null().to_numpy(zero_copy_only=False)[order]
    x = column.to_numpy(zero_copy_only=False)[order][held]
    t, obs = t[held], obs[held]
    unit = part["unit"][0].as_py()
    core = (t // STRETCH) == (stretch if stretch >= 0 else -1 - stretch)
    rows: list[tuple] = []
    bad = impossible(x, unit)
    if bad.any():
        rows += [(name, stretch, "impossible", None, 1, False, False, [i]) for i in obs[bad & core].tolist()]
    t, x, obs, core = t[~bad], x[~bad], obs[~bad], core[~bad]
    if core.any():
        for reason, mask in zip(("spike", "excursion", "level shift"), judge(x), strict=True):
            rows += [(name, stretch, reason, None, 1, False, False, [i]) for i in obs[mask & core].tolist()]
        at = np.flatnonzero(core)
        v, o = x[at[0]:at[-1] + 1], obs[at[0]:at[-1] + 1]
        ends = np.concatenate((np.flatnonzero(v[1:] != v[:-1]), [len(v) - 1]))
        begins = np.concatenate(([0], ends[:-1] + 1))
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            left, right = a == 0 and stretch not in (0, -1), b == len(v) - 1
            if b - a + 1 >= RUN_KEPT or left or right:
                rows.append((name, stretch, "run", float(v[a]), b - a + 1, left, right, o[a:b + 1].tolist()))
    return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(_OUT), schema=_OUT)


def _pieces(series: DataFrame) -> DataFrame:
    """Findings and runs of every stretch of every source. Stretches of readings
    that came without index are numbered from -1 downwards."""
    last = STRETCH - MARGIN
    held = series.where(F.col("obs_id").isNotNull() & F.col("name").isNotNull()).select(
        F.col("obs_id").cast("long").alias("obs_id"), "name", "unit", F.col("close_value").cast("double").alias("value"),
        F.unix_micros(F.coalesce("ingested_at", F.timestamp_micros(F.lit(0)))).alias("loaded"), "ts", F.col("t").cast("long").alias("t"))
    indexed = held.where("t >= 0").drop("ts").withColumn("own", F.lit(False)).unionByName(
        _index(held.where("t IS NULL OR t < 0")).withColumn("own", F.lit(True)))
    t, here = F.col("t"), F.floor(F.col("t") / STRETCH).cast("long")
    stretches = F.array_compact(F.array(
        here,
        F.when((t % STRETCH < MARGIN) & (here > 0), here - 1),
        F.when(t % STRETCH >= last, here + 1),
    ))
    cut = (
        indexed.select("obs_id", "name", "unit", "value", "loaded", "t", "own", F.explode(stretches).alias("stretch"))
        .withColumn("stretch", F.when(F.col("own"), -1 - F.col("stretch")).otherwise(F.col("stretch"))).drop("own")
    )
    return cut.groupBy("name", "stretch").applyInArrow(_stretch, _OUT_SQL)


def _index(readings: DataFrame) -> DataFrame:
    """A dense index ``t`` in order of time for each source: ranks within a day
    on top of the counts of the days before. Repeats of a reading share one."""
    keys = ["name", "day"]
    days = readings.withColumn("day", F.to_date("ts")).groupBy(*keys, "obs_id").agg(
        F.min("ts").alias("ts"), F.collect_list(F.struct("unit", "value", "loaded")).alias("rows"))
    before = Window.partitionBy("name").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.groupBy(*keys).agg(F.count("*").alias("k")).withColumn("offset", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    offsets = offsets.select(F.col("name").alias("o_name"), F.col("day").alias("o_day"), "offset")
    ranked = days.withColumn("own", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "obs_id")) - 1)
    joined = ranked.join(offsets, (F.col("name") == F.col("o_name")) & F.col("day").eqNullSafe(F.col("o_day"))).select(
        "obs_id", "name", (F.col("own") + F.col("offset")).cast("long").alias("t"), F.explode("rows").alias("r"))
    return joined.select("obs_id", "name", "r.unit", "r.value", "r.loaded", "t")


def _joined_runs(runs: DataFrame) -> DataFrame:
    """Runs with the part beyond the border of their stretch counted in."""
    edge = lambda side, name, step: (
        runs.where(side).select(
            "name", (F.col("stretch") + F.when(F.col("stretch") < 0, -step).otherwise(step)).alias("stretch"), F.col("value"), F.col("length").alias(name))
    )
    inner = runs.where(~F.col("left") & ~F.col("right")).select("name", "length", F.lit(True).alias("opens"), "ids")
    border = (
        runs.where("left OR right")
        .join(edge("right", "before", 1), ["name", "stretch", "value"], "left")
        .join(edge("left", "behind", -1), ["name", "stretch", "value"], "left")
        .withColumn("before", F.when(F.col("left"), F.col("before")))
        .withColumn("behind", F.when(F.col("right"), F.col("behind")))
        .select(
            "name", (F.col("length") + F.coalesce("before", F.lit(0)) + F.coalesce("behind", F.lit(0))).alias("length"),
            F.col("before").isNull().alias("opens"), "ids")
    )
    return inner.unionByName(border).where(F.col("length") >= RUN_KEPT)


def _run_limits(runs: DataFrame) -> DataFrame:
    """The shortest frozen run of each source: ``name, limit``."""
    lengths = runs.select("name", "length").distinct().groupBy("name").agg(
        F.array_sort(F.collect_list("length")).alias("lengths"))
    limit = F.aggregate(
        "lengths", F.struct(F.lit(RUN_KEPT - 1).cast("long").alias("most"), F.lit(None).cast("long").alias("limit")),
        lambda a, n: F.struct(
            F.when(a["limit"].isNull(), n).otherwise(a["most"]).alias("most"),
            F.coalesce(a["limit"], F.when((n >= RUN_LEAST) & (n >= a["most"] * RUN_JUMP), n)).alias("limit")),
    )["limit"]
    return lengths.select("name", limit.alias("limit")).where(F.col("limit").isNotNull())


def flag_readings(series: DataFrame) -> DataFrame:
    """Implausible readings with their reason: ``obs_id, name, reason``.

    ``reason`` is ``impossible``, ``spike`` (at most ``REACH`` readings),
    ``frozen``, or, where the series itself may have moved, ``excursion`` (a
    longer one) or ``level shift`` (the first reading of a lasting change); a
    reading may have more than one.
    """
    from strandline.session import settle

    pieces = settle(_pieces(series))
    single = pieces.where("reason <> 'run'").select(F.explode("ids").alias("obs_id"), "name", "reason")
    runs = _joined_runs(pieces.where("reason = 'run'"))
    frozen = (
        runs.join(_run_limits(runs), "name").where(F.col("length") >= F.col("limit"))
        .select(F.explode(F.expr("CASE WHEN opens THEN slice(ids, 2, size(ids)) ELSE ids END")).alias("obs_id"), "name")
        .withColumn("reason", F.lit("frozen"))
    )
    return single.unionByName(frozen).distinct()
