"""Closed forms on financial statements, capital, resources, games and fuzzy
numbers, as column expressions. Undefined ratios are null unless said."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ------------------------------------------------------------- distress scores


def altman_general(wc_ta: Column, re_ta: Column, ebit_ta: Column, value_de: Column) -> Column:
    """For firms that make nothing, private or of emerging markets."""
    return 6.56 * wc_ta + 3.26 * re_ta + 6.72 * ebit_ta + 1.05 * value_de + 3.25


def altman_zone(z: Column, manufacturing: bool = True) -> Column:
    safe, distress = (2.99, 1.81) if manufacturing else (2.60, 1.10)
    return F.when(z > safe, "safe").when(z >= distress, "grey").when(z.isNotNull(), "distress")


def ratio_index(now: Column, before: Column) -> Column:
    """Growth of a level or a ratio: now over before."""
    return F.try_divide(now, before)


def margin_index(now: Column, before: Column) -> Column:
    return F.try_divide(before, now)


def asset_quality_index(assets: Column, plant: Column, assets_before: Column, plant_before: Column) -> Column:
    return F.try_divide(1 - F.try_divide(plant, assets), 1 - F.try_divide(plant_before, assets_before))


def depreciation_index(spent: Column, plant: Column, spent_before: Column, plant_before: Column) -> Column:
    rate = lambda d, p: F.try_divide(d, d + p)
    return F.try_divide(rate(spent_before, plant_before), rate(spent, plant))


def accruals(income: Column, cash: Column, assets: Column) -> Column:
    return F.try_divide(income - cash, assets)


def beneish_score(dsri: Column, gmi: Column, aqi: Column, sgi: Column, depi: Column, sgai: Column, lvgi: Column, tata: Column) -> Column:
    """The eight-variable score; an undefined index counts as 1, undefined accruals as 0."""
    one = lambda c: F.coalesce(c, F.lit(1.0))
    return (
        -4.84 + 0.92 * one(dsri) + 0.528 * one(gmi) + 0.404 * one(aqi) + 0.892 * one(sgi) + 0.115 * one(depi)
        - 0.172 * one(sgai) + 4.679 * F.coalesce(tata, F.lit(0.0)) - 0.327 * one(lvgi))


def manipulation_probability(m: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.exp(-7.89 + 2.53 * m)))


# --------------------------------------------------------- capital and banking


def levered(unlevered: Column, debt: Column, asset_rate: float, debt_rate: float, tax: float = 0.0) -> dict[str, Column]:
    """Modigliani-Miller with taxes: value, cost of equity, weighted cost."""
    value = unlevered + tax * debt
    equity = value - debt
    cost = F.lit(asset_rate) + (asset_rate - debt_rate) * (1 - tax) * F.try_divide(debt, equity)
    return {"value": value, "equity_cost": cost, "wacc": F.try_divide(equity * cost + debt * debt_rate * (1 - tax), value)}


def pecking_order(need: Column, internal: Column, borrowable: Column) -> dict[str, Column]:
    """Funds, then debt, then equity."""
    own = F.least(need, internal)
    debt = F.least(need - own, borrowable)
    return {"internal": own, "debt": debt, "equity": need - own - debt}


def best_debt(unlevered: Column, tax: float, distress: float, levels: int = 200) -> Column:
    """Debt level (of ``levels`` shares of the value) at which tax shield less
    expected distress, which grows with the square of the share, is largest;
    the smallest of equals."""
    grid = F.sequence(F.lit(0), F.lit(levels - 1))
    worth = lambda i: unlevered * (tax * i / (levels - 1.0) - distress * F.pow(i / (levels - 1.0), 2))
    best = F.aggregate(grid, F.struct(F.lit(-1e300).alias("v"), F.lit(0).alias("i")), lambda a, i: F.when(worth(i) > a["v"], F.struct(worth(i).alias("v"), i.alias("i"))).otherwise(a))
    return best["i"] * unlevered / (levels - 1.0)


# Shares of risk-weighted assets that capital must reach.
BASEL = {"common": 0.045, "tier1": 0.06, "total": 0.08, "buffer": 0.025}


def capital_needs(weighted_assets: Column, held: Column) -> dict[str, Column]:
    out = {k: weighted_assets * v for k, v in BASEL.items()}
    return out | {"surplus": held - weighted_assets * (BASEL["total"] + BASEL["buffer"])}


def coverage(liquid: Column, outflow: Column) -> dict[str, Column]:
    """Liquidity coverage, infinite without outflow, and whether it is enough."""
    share = F.when(outflow == 0, float("inf")).otherwise(F.try_divide(liquid, outflow))
    return {"coverage": share, "covered": share >= 1}


def leverage(tier1: Column, exposure: Column) -> dict[str, Column]:
    share = F.try_divide(tier1, exposure)
    return {"leverage": share, "enough": share >= 0.03}


# ------------------------------------------------------- resources, growth, risk


def hotelling_price(price: Column, cost: Column, rate: float, t: Column) -> Column:
    return cost + (price - cost) * F.pow(F.lit(1 + rate), t)


def reserve_value(reserves: Column, price: Column, cost: Column, rate: float, years: int) -> Column:
    """Present value of equal yearly extraction."""
    return reserves / years * (price - cost) * sum((1 + rate) ** -t for t in range(1, years + 1))


def doublings(current: Column, t: Column, period: float = 2.0) -> Column:
    return current * F.pow(F.lit(2.0), t / period)


def years_to(current: Column, target: float, period: float = 2.0) -> Column:
    return period * F.log2(target / current)


def physical_risk(value: Column, chances: Sequence[float], damages: Sequence[float]) -> Column:
    return value * sum(p * d for p, d in zip(chances, damages, strict=True))


def carbon_exposure(weight: Column, intensity: Column, degrees: float) -> Column:
    return weight * intensity * 0.5 * degrees**2


def composite_risk(economic: Column, financial: Column, political: Column) -> dict[str, Column]:
    s = 0.25 * economic + 0.25 * financial + 0.5 * political
    return {"composite": s, "risk": F.when(s >= 80, "very low").when(s >= 70, "low").when(s >= 60, "moderate").when(s >= 50, "high").otherwise("very high")}


def overconfidence(trades: Column, hits: Column, market_hits: Column) -> Column:
    return trades * F.greatest(hits - market_hits, F.lit(0.0))


def disposition(gains: Column, losses: Column, paper_gains: Column, paper_losses: Column) -> Column:
    """Share of gains realised less share of losses realised."""
    return F.coalesce(F.try_divide(gains, gains + paper_gains), F.lit(0.0)) - F.coalesce(F.try_divide(losses, losses + paper_losses), F.lit(0.0))


# ------------------------------------------------------------------- options


def payoff(price: Column, legs: Sequence[tuple[str, float, float]]) -> Column:
    """Payoff at expiry of legs (call or put, strike, number)."""
    out = F.lit(0.0)
    for kind, strike, number in legs:
        out = out + number * F.greatest(price - strike if kind == "call" else strike - price, F.lit(0.0))
    return out


#: Legs of common strategies around strikes.
def bull_call_spread(k1: float, k2: float) -> list[tuple[str, float, float]]:
    return [("call", k1, 1.0), ("call", k2, -1.0)]


def straddle(k: float) -> list[tuple[str, float, float]]:
    return [("call", k, 1.0), ("put", k, 1.0)]


def iron_condor(k1: float, k2: float, k3: float, k4: float) -> list[tuple[str, float, float]]:
    return [("put", k1, 1.0), ("put", k2, -1.0), ("call", k3, -1.0), ("call", k4, 1.0)]


def butterfly(k1: float, k2: float, k3: float) -> list[tuple[str, float, float]]:
    return [("call", k1, 1.0), ("call", k2, -2.0), ("call", k3, 1.0)]


def binomial_call(s: Column, k: Column, t: float, r: float, v: float, steps: int = 100) -> Column:
    """European call on the tree of Cox, Ross and Rubinstein."""
    import math

    dt = t / steps
    u = math.exp(v * math.sqrt(dt))
    p = (math.exp(r * dt) - 1 / u) / (u - 1 / u)
    weights = [math.exp(math.lgamma(steps + 1) - math.lgamma(i + 1) - math.lgamma(steps - i + 1) + i * math.log(p) + (steps - i) * math.log(1 - p)) for i in range(steps + 1)]
    ends = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(u ** (2 * i - steps)).alias("g")) for i, w in enumerate(weights)))
    return math.exp(-r * t) * F.aggregate(ends, F.lit(0.0), lambda a, e: a + e["w"] * F.greatest(s * e["g"] - k, F.lit(0.0)))


# --------------------------------------------------------------------- games


def pure_equilibria(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Equilibria of a two by two game, payoffs by rows: array of "ij"."""
    keep = []
    for i in range(2):
        for j in range(2):
            best = (a[2 * i + j] >= a[2 * (1 - i) + j]) & (b[2 * i + j] >= b[2 * i + 1 - j])
            keep.append(F.when(best, f"{i}{j}"))
    return F.array_compact(F.array(*keep))


def mixed_equilibrium(a: Sequence[Column], b: Sequence[Column]) -> dict[str, Column]:
    """Chance of the first action of each player that leaves the other
    indifferent; null without such a chance."""
    chance = lambda x: F.when((x >= 0) & (x <= 1), x)
    p = chance(F.try_divide(b[3] - b[2], b[0] - b[1] - b[2] + b[3]))
    q = chance(F.try_divide(a[3] - a[1], a[0] - a[1] - a[2] + a[3]))
    return {"row": F.when(q.isNotNull(), p), "column": F.when(p.isNotNull(), q)}


def cournot(a: Column, b: Column, c1: Column, c2: Column) -> dict[str, Column]:
    """Two producers at demand price a - b (q1 + q2)."""
    q1 = F.greatest(F.lit(0.0), (a - 2 * c1 + c2) / (3 * b))
    q2 = F.greatest(F.lit(0.0), (a - 2 * c2 + c1) / (3 * b))
    price = a - b * (q1 + q2)
    share = lambda q: F.try_divide(q, q1 + q2)
    return {"q1": q1, "q2": q2, "price": price, "profit1": (price - c1) * q1, "profit2": (price - c2) * q2, "concentration": share(q1) * share(q1) + share(q2) * share(q2)}


def second_price(bids: DataFrame, by: Sequence[str], bidder: str, bid: str, reserve: float = 0.0) -> DataFrame:
    """The best bid of each lot wins and pays the second best or the reserve:
    ``by, winner, price``. Of equal bids the smaller bidder wins; a lot whose
    best bid is below the reserve has no row. Two rows of a lot are kept
    before anything moves."""
    w = Window.partitionBy(*by).orderBy(F.desc(bid), F.asc(bidder))
    two = bids.where(F.col(bid).isNotNull()).withColumn("__k", F.row_number().over(w)).where("__k <= 2")
    won = two.groupBy(*by).agg(
        F.max(F.when(F.col("__k") == 1, F.col(bidder))).alias("winner"), F.max(F.when(F.col("__k") == 1, F.col(bid))).alias("__best"),
        F.max(F.when(F.col("__k") == 2, F.col(bid))).alias("__next"))
    return won.where(F.col("__best") >= reserve).select(*by, "winner", F.greatest(F.coalesce("__next", F.lit(reserve)), F.lit(reserve)).alias("price"))


def shares_of_worth(df: DataFrame, player: str, worth: str) -> DataFrame:
    """Shapley values of an additive game: each player's mean contribution."""
    return df.groupBy(player).agg(F.avg(worth).alias("value"))


# -------------------------------------------------------------- fuzzy numbers


def fuzzy_cut(a: Column, b: Column, c: Column, alpha: float) -> dict[str, Column]:
    """Interval of a triangular number at a level."""
    return {"low": a + alpha * (b - a), "high": c - alpha * (c - b)}


def fuzzy_sum(x: Sequence[Column], y: Sequence[Column]) -> list[Column]:
    return [p + q for p, q in zip(x, y, strict=True)]


def fuzzy_difference(x: Sequence[Column], y: Sequence[Column]) -> list[Column]:
    return [x[0] - y[2], x[1] - y[1], x[2] - y[0]]


def fuzzy_product(x: Sequence[Column], y: Sequence[Column]) -> list[Column]:
    """By the products of the supports' ends and of the peaks."""
    ends = [x[0] * y[0], x[0] * y[2], x[2] * y[0], x[2] * y[2]]
    return [F.least(*ends), x[1] * y[1], F.greatest(*ends)]


def fuzzy_centroid(x: Sequence[Column]) -> Column:
    return (x[0] + x[1] + x[2]) / 3
