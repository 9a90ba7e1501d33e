"""Health of collections: drifting, odd and failing batches; quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import ordered
from strandline.operators.nested import let


def entropy_jumps(df: DataFrame, by: Sequence[str], order: Sequence[str], text: str, window: int = 5, limit: float = 0.3) -> DataFrame:
    """Texts whose character entropy is ``limit`` bits or more from the mean of
    the ``window`` before them: the keys, ``entropy`` and ``expected``. Empty and
    null texts have the entropy 0."""
    counts = F.aggregate(F.array_distinct(F.split(F.col(text), "")), F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(
        a - _share(text, c) * F.log2(_share(text, c))))
    d = df.select(*by, *order, F.coalesce(counts, F.lit(0.0)).alias("entropy"))
    d = ordered.looking_back(d, by, order, window, {
        "expected": lambda w: F.avg("entropy").over(w.rowsBetween(-window, -1)), "k": lambda w: F.count("entropy").over(w.rowsBetween(-window, -1))})
    return d.where((F.col("k") == window) & (F.abs(F.col("entropy") - F.col("expected")) >= limit)).drop("k")


def _share(text: str, char: Column) -> Column:
    n = F.length(text)
    return (n - F.length(F.replace(F.col(text), char, F.lit("")))) / n


def profile_anomalies(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, limit: float = 2.0, least: int = 3) -> DataFrame:
    """Batches whose measure is ``limit`` sample deviations or more from all
    batches before them, of which there must be ``least``: the rows with ``z``.
    Running sums over blocks, so that no history is gathered."""
    d = df.withColumn("__one", F.when(F.col(value).isNotNull(), 1)).withColumn("__sq", F.col(value) * F.col(value))
    for c, out in (("__one", "__n"), (value, "__s"), ("__sq", "__q")):
        d = ordered.running_sum(d, by, order, c, out)
    n, s, q = F.col("__n") - 1, F.col("__s") - F.col(value), F.col("__q") - F.col("__sq")
    sd = F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
    z = F.when((F.col("__n") > least) & (sd > 0), (F.col(value) - s / n) / sd)
    return d.withColumn("z", z).drop("__one", "__sq", "__n", "__s", "__q").where(F.abs("z") >= limit)


def collection_health(events: DataFrame, by: Sequence[str], failed: Column, time: str, size: str, items: str, address: str) -> DataFrame:
    """One row for each source: the five shares that are looked at, a penalty
    for each beyond its limit, and ``score`` (1 less a fifth for each):
    ``errors`` over 0.1, ``slow`` and ``odd_size`` (outside the quartiles by 1.5
    ranges) over 0.05, ``empty`` results over 0.2, ``repeated`` addresses over
    0.5. A source is ``healthy`` from 0.6 on. Nulls are no outliers."""
    by = list(by)
    q = None
    for c in (time, size):
        p = ordered.percentiles(events, by, c, (0.25, 0.75)).select(
            *by, (F.col("p")[0] - 1.5 * (F.col("p")[1] - F.col("p")[0])).alias(f"lo_{c}"), (F.col("p")[1] + 1.5 * (F.col("p")[1] - F.col("p")[0])).alias(f"hi_{c}"))
        q = p if q is None else q.join(p, by, "full")
    outside = lambda c: F.coalesce((F.col(c) < F.col(f"lo_{c}")) | (F.col(c) > F.col(f"hi_{c}")), F.lit(False)).cast("double")
    d = events.join(q, by, "left").groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.coalesce(failed, F.lit(True)).cast("double")).alias("errors"), F.avg(outside(time)).alias("slow"), F.avg(outside(size)).alias("odd_size"),
        F.avg((F.coalesce(F.col(items), F.lit(0)) == 0).cast("double")).alias("empty"))
    distinct = events.where(F.col(address).isNotNull()).select(*by, address).distinct().groupBy(*by).agg(F.count("*").alias("addresses"))
    d = d.join(distinct, by, "left").withColumn("repeated", 1 - F.coalesce("addresses", F.lit(0)) / F.col("n")).drop("addresses")
    penalty = sum(((F.col(c) > lim).cast("int") for c, lim in (("errors", 0.1), ("slow", 0.05), ("odd_size", 0.05), ("empty", 0.2), ("repeated", 0.5))), F.lit(0))
    return d.withColumn("score", F.round(1 - penalty / 5, 4)).withColumn("healthy", F.col("score") >= 0.6)


# ------------------------------------------------------------------- quality


def top_issues(counts: DataFrame, total: Column, limit: int = 3) -> DataFrame:
    """The fields with most faults, ``field, faults, ratio, severity``; ties by
    name. The report is a top list, so the limit is its feature."""
    ratio = F.col("faults") / total
    severity = F.when(ratio >= 0.5, "critical").when(ratio >= 0.25, "high").when(ratio >= 0.1, "medium").otherwise("low")
    return counts.where("faults > 0").withColumn("ratio", ratio).withColumn("severity", severity).orderBy(F.desc("faults"), "field").limit(limit)


def complexity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``field, entropy, cardinality, density, score`` of each column: entropy
    over the logarithm of the rows, distinct over filled values, filled over all."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*")
    k = long.groupBy("field", "v").agg(F.count("*").alias("k"))
    filled = F.sum(F.when(F.col("v").isNotNull(), F.col("k")))
    e = F.log(filled) - F.sum(F.when(F.col("v").isNotNull(), F.col("k") * F.log("k"))) / filled
    s = k.groupBy("field").agg(
        F.coalesce(F.try_divide(e, F.log(filled)), F.lit(0.0)).alias("entropy"), F.coalesce(F.try_divide(F.count("v"), filled), F.lit(0.0)).alias("cardinality"),
        (F.coalesce(filled, F.lit(0)) / F.sum("k")).alias("density"))
    return s.withColumn("score", 0.4 * F.col("entropy") + 0.35 * F.col("cardinality") + 0.25 * F.col("density"))


def suggestions(scores: DataFrame, limits: dict[str, tuple[float, str]]) -> DataFrame:
    """What to do about the dimensions below their limit: ``dimension, score, advice``."""
    advice = F.coalesce(*(F.when((F.col("dimension") == d) & (F.col("score") < lim), F.lit(text)) for d, (lim, text) in limits.items()))
    return scores.withColumn("advice", advice).where("advice IS NOT NULL")


def beta_interval(passed: Column, failed: Column, mass: float = 0.95, points: int = 400) -> dict[str, Column]:
    """Equal-tailed interval of a Beta(1 + passed, 1 + failed) share, from its
    density on a grid of logits around the mode; null where a count is."""
    shape = F.struct((1.0 + passed).alias("a"), (1.0 + failed).alias("b"))

    def ends(p: Column) -> Column:
        centre, spread = F.log(p["a"] / p["b"]), F.sqrt(1 / p["a"] + 1 / p["b"])
        # Density of the logit x: sigma(x)^a (1 - sigma(x))^b, over its value at the centre.
        log_density = lambda x: -p["a"] * F.log1p(F.exp(-x)) - p["b"] * F.log1p(F.exp(x))
        place = lambda i: centre + spread * (i * (16.0 / points) - 8)
        cells = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.struct(place(i).alias("x"), F.exp(log_density(place(i)) - log_density(centre)).alias("w")))

        def quantile(cs: Column, total: Column, q: float) -> Column:
            step = spread * (16.0 / points)
            walk = F.aggregate(cs, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("x")), lambda acc, c: F.struct(
                (acc["s"] + c["w"]).alias("s"),
                F.coalesce(acc["x"], F.when(acc["s"] + c["w"] >= q * total, c["x"] - step * ((acc["s"] + c["w"] - q * total) / c["w"] - 0.5))).alias("x")))
            return 1 / (1 + F.exp(-walk["x"]))

        return let(cells, lambda cs: let(
            F.aggregate(cs, F.lit(0.0), lambda s, c: s + c["w"]),
            lambda total: F.struct(quantile(cs, total, (1 - mass) / 2).alias("low"), quantile(cs, total, (1 + mass) / 2).alias("high"))))

    both = let(shape, ends)
    return {"low": both["low"], "high": both["high"]}


# ---------------------------------------------------------------- schedules


def next_run(kind: Column, now: Column, created: Column, every_seconds: Column, clock: Column, weekday: Column, day: Column) -> Column:
    """When a task runs next, null if never: ``once`` at its clock time of the
    day created if that is to come; ``interval`` after whole intervals from the
    creation; ``daily``, ``weekly`` (0 is Monday) and ``monthly`` (a day beyond a
    month's end is its last) at the clock time. ``clock`` is HH:MM."""
    at = lambda d: F.try_to_timestamp(F.concat(d.cast("string"), F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm"))
    every_seconds = every_seconds.cast("long")
    today = F.to_date(now)
    once = at(F.to_date(created))
    passed = F.floor((F.unix_micros(now) - F.unix_micros(created)) / (every_seconds * 1_000_000))
    interval = F.timestamp_micros((F.unix_micros(created) + (F.greatest(passed, F.lit(-1)) + 1) * every_seconds * 1_000_000).cast("long"))
    daily = F.when(at(today) > now, at(today)).otherwise(at(F.date_add(today, 1)))
    ahead = F.pmod(weekday - F.weekday(today), F.lit(7)).cast("int")
    weekly = F.when(at(F.date_add(today, ahead)) > now, at(F.date_add(today, ahead))).otherwise(at(F.date_add(today, ahead + 7)))
    in_month = lambda first: F.date_add(first, (F.least(day, F.dayofmonth(F.last_day(first))) - 1).cast("int"))
    this, following = F.trunc(today, "month"), F.add_months(F.trunc(today, "month"), 1)
    monthly = F.when(at(in_month(this)) > now, at(in_month(this))).otherwise(at(in_month(following)))
    return F.when(kind == "once", F.when(once > now, once)).when((kind == "interval") & (every_seconds > 0), interval).when(kind == "daily", daily).when(kind == "weekly", weekly).when(kind == "monthly", monthly)


def back_off(errors: Column, successes: Column, base: float, factor: float, ease: float, low: float, high: float) -> Column:
    """Delay after so many errors in a row and then successes in a row."""
    after = F.least(F.lit(high), base * F.pow(F.lit(factor), errors))
    return F.greatest(F.lit(low), after * F.pow(F.lit(ease), successes))
