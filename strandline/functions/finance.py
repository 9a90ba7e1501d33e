"""Closed forms of option pricing, credit and macro rules as expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal tail, to double precision.
_NUMERATOR = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DENOMINATOR = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(z: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * z + c
    return out


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    """Normal distribution function, without leaving the JVM."""
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    near = e * _horner(z, _NUMERATOR) / _horner(z, _DENOMINATOR)
    far = e / ((z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) * 2.506628274631)
    tail = F.when(z > 37, 0.0).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def _d1(s: Column, k: Column, t: Column, r: Column, v: Column) -> Column:
    return (F.log(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))


def call(s: Column, k: Column, t: Column, r: Column, v: Column) -> Column:
    """European call; the intrinsic value at or after expiry."""
    d1 = _d1(s, k, t, r, v)
    return F.when((t <= 0) | (v <= 0), F.greatest(s - k, F.lit(0.0))).otherwise(s * norm_cdf(d1) - k * F.exp(-r * t) * norm_cdf(d1 - v * F.sqrt(t)))


def put(s: Column, k: Column, t: Column, r: Column, v: Column) -> Column:
    d1 = _d1(s, k, t, r, v)
    return F.when((t <= 0) | (v <= 0), F.greatest(k - s, F.lit(0.0))).otherwise(k * F.exp(-r * t) * norm_cdf(v * F.sqrt(t) - d1) - s * norm_cdf(-d1))


def greeks(s: Column, k: Column, t: Column, r: Column, v: Column) -> Column:
    """delta, gamma, vega, theta and rho of a call."""
    d1 = _d1(s, k, t, r, v)
    d2 = d1 - v * F.sqrt(t)
    return F.struct(
        norm_cdf(d1).alias("delta"), (norm_pdf(d1) / (s * v * F.sqrt(t))).alias("gamma"), (s * norm_pdf(d1) * F.sqrt(t)).alias("vega"),
        (-s * norm_pdf(d1) * v / (2 * F.sqrt(t)) - r * k * F.exp(-r * t) * norm_cdf(d2)).alias("theta"), (k * t * F.exp(-r * t) * norm_cdf(d2)).alias("rho"))


def _np_norm_cdf(x: np.ndarray) -> np.ndarray:
    """``norm_cdf`` by arrays."""
    z = np.abs(x)
    e = np.exp(-z * z / 2)
    horner = lambda c: reduce(lambda out, k: out * z + k, c[1:], c[0])
    near = e * horner(_NUMERATOR) / horner(_DENOMINATOR)
    far = e / ((z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) * 2.506628274631)
    tail = np.where(z > 37, 0.0, np.where(z < 7.07106781186547, near, far))
    return np.where(x > 0, 1 - tail, tail)


def _bisected(rounds: int) -> Callable[[Iterator[tuple[pd.Series, ...]]], Iterator[pd.Series]]:
    def work(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            price, s, k, t, r, ratio, paid = (c.to_numpy(float) for c in columns)
            lo, hi = np.full(len(s), 1e-4), np.full(len(s), 5.0)
            with np.errstate(all="ignore"):
                root = np.sqrt(t)
                for _ in range(rounds):
                    mid = (lo + hi) / 2
                    d1 = (ratio + (r + mid * mid / 2) * t) / (mid * root)
                    worth = np.where(t <= 0, np.maximum(s - k, 0.0), s * _np_norm_cdf(d1) - paid * _np_norm_cdf(d1 - mid * root))
                    above = worth > price
                    lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
            yield pd.Series((lo + hi) / 2)

    return work


def implied_volatility(price: Column, s: Column, k: Column, t: Column, r: Column, rounds: int = 40) -> Column:
    """Volatility of a call by bisection, null where something is missing.

    The rounds run over arrays, as a fold would evaluate the whole closed form
    node by node in every round. Logarithm and discount come from the JVM, so
    that far in the money, where the price hardly depends on the volatility,
    both sides of a comparison are rounded alike."""
    inputs = [c.cast("double") for c in (price, s, k, t, r, F.log(s / k), k * F.exp(-r * t))]
    held = reduce(lambda a, c: a & c.isNotNull(), inputs[1:], inputs[0].isNotNull())
    return F.when(held, F.pandas_udf(_bisected(rounds), "double")(*inputs))


def zero_coupon(r: Column, t: Column, kappa: float, theta: float, sigma: float) -> Column:
    """Vasicek price of a bond without coupon."""
    b = (1 - F.exp(-kappa * t)) / kappa
    a = F.exp((theta - sigma**2 / (2 * kappa**2)) * (b - t) - sigma**2 * b * b / (4 * kappa))
    return a * F.exp(-b * r)


def kelly(win: Column, odds: Column, fraction: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), (odds * win - (1 - win)) / odds) * fraction


def altman_z(wc_ta: Column, re_ta: Column, ebit_ta: Column, mv_de: Column, sales_ta: Column) -> Column:
    return 1.2 * wc_ta + 1.4 * re_ta + 3.3 * ebit_ta + 0.6 * mv_de + sales_ta


def taylor_rate(inflation: Column, gap: Column, target: float = 0.02, natural: float = 0.01, phi_pi: float = 1.5, phi_y: float = 0.5) -> Column:
    return natural + target + phi_pi * (inflation - target) + phi_y * gap


def prospect_value(x: Column, alpha: float = 0.88, loss: float = 2.25, beta: float = 0.88) -> Column:
    return F.when(x >= 0, F.pow(x, alpha)).otherwise(-loss * F.pow(-x, beta))


def gompertz(t: Column, a: float, b: float, c: float) -> Column:
    return a * F.exp(-b * F.exp(-c * t))
