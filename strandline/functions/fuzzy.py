"""Fuzzy matching of strings and fuzzy membership of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro similarity with the bonus for a common prefix of up to four."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    taken, hit = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hit.append(c)
                break
    if not hit:
        return 0.0
    other = [b[j] for j in range(m) if taken[j]]
    swaps = sum(x != y for x, y in zip(hit, other, strict=True)) // 2
    k = len(hit)
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * min(scale, 0.25) * (1 - jaro)


def similarity(a: Column, jw: Column, b: Column) -> Column:
    """0.6 Jaro-Winkler and 0.4 of one minus the relative edit distance."""
    longest = F.greatest(F.length(a), F.length(b))
    edit = 1 - F.try_divide(F.levenshtein(a, b), longest)
    return F.when(longest == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(0.6 * jw + 0.4 * edit)


def search(df: DataFrame, key: str, column: str, query: str, least: float = 0.6) -> DataFrame:
    """Rows whose value resembles the query: ``key, value, score``.

    The distinct values are scored, not the rows; the edit distance, which is
    native, goes first and bounds what the rest can reach.
    """
    q = query.lower()
    values = df.where(F.col(column).isNotNull()).select(F.lower(F.col(column)).alias("value")).distinct()
    longest = F.greatest(F.length("value"), F.lit(len(q)), F.lit(1))
    edit = 1 - F.levenshtein(F.col("value"), F.lit(q)) / longest
    near = values.withColumn("edit", edit).where(0.6 + 0.4 * F.col("edit") >= least)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(jw=[jaro_winkler(q, v) for v in pdf["value"]])

    scored = near.mapInPandas(work, "value string, edit double, jw double").withColumn("score", F.round(0.6 * F.col("jw") + 0.4 * F.col("edit"), 6)).where(F.col("score") >= least)
    return df.withColumn("value", F.lower(F.col(column))).join(scored.select("value", "score"), "value").select(key, "value", "score")


def triangular(x: Column, a: float, b: float, c: float) -> Column:
    return F.when((x <= a) | (x >= c), 0.0).when(x < b, (x - a) / (b - a)).otherwise((c - x) / (c - b))


def trapezoidal(x: Column, a: float, b: float, c: float, d: float) -> Column:
    return F.when((x <= a) | (x >= d), 0.0).when(x < b, (x - a) / (b - a)).when(x <= c, 1.0).otherwise((d - x) / (d - c))


def gaussian(x: Column, mean: float, sigma: float) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / sigma, 2))


def sigmoid(x: Column, steep: float, centre: float) -> Column:
    return 1 / (1 + F.exp(-steep * (x - centre)))


def fuzzy_and(*grades: Column) -> Column:
    return F.least(*grades) if len(grades) > 1 else grades[0]


def fuzzy_or(*grades: Column) -> Column:
    return F.greatest(*grades) if len(grades) > 1 else grades[0]


def mamdani(rules: list[tuple[Column, tuple[float, float, float]]], low: float, high: float, points: int = 101) -> Column:
    """Centroid of triangular outputs, clipped at the strength of their rules
    and joined by maximum; 0 if no rule fires."""
    grid = [low + (high - low) * i / (points - 1) for i in range(points)]

    def shape(x: float, t: tuple[float, float, float]) -> float:
        a, b, c = t
        return 0.0 if x < a or x > c else (x - a) / (b - a) if x < b else (c - x) / (c - b) if c > b else 1.0

    heights = F.array(*(F.greatest(*(F.least(s, F.lit(shape(x, t))) for s, t in rules), F.lit(0.0)) for x in grid))
    top = F.aggregate(F.zip_with(heights, F.array(*map(F.lit, grid)), lambda h, x: h * x), F.lit(0.0), lambda p, v: p + v)
    total = F.aggregate(heights, F.lit(0.0), lambda p, v: p + v)
    return F.coalesce(F.try_divide(top, total), F.lit(0.0))
