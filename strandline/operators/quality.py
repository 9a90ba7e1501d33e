"""Data quality: completeness, validity, uniqueness, timeliness, information.

Column-wise measures are single aggregations; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a column's name says about its values.
NAMED = {
    "url": r"^https?://[^\s/]+\S*$", "link": r"^https?://[^\s/]+\S*$", "email": r"^[\w.+-]+@[\w-]+\.[\w.]+$",
    "date": r"^\d{4}-\d{2}-\d{2}", "price": r"^-?\d+(?:\.\d+)?$", "count": r"^-?\d+$",
}


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) == ""


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, nulls, blanks and the share of filled cells of each column:
    ``field, n_rows, n_null, n_blank, filled``."""
    names = list(columns or df.columns)
    one = df.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(names)),
                 *(F.count_if(blank(c)).alias(f"blank_{i}") for i, c in enumerate(names)))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"null_{i}").alias("n_null"), F.col(f"blank_{i}").alias("n_blank")) for i, c in enumerate(names)))
    return one.select("n_rows", F.explode(rows).alias("f")).select(
        "f.field", "n_rows", "f.n_null", "f.n_blank", F.round(1 - F.try_divide(F.col("f.n_blank"), F.col("n_rows")), 6).alias("filled"))


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column, counted once over an unpivoted table so
    that many columns share one shuffle: ``field, n_distinct, n_filled``."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns))).alias("x")).select("x.*")
    return long.where("v IS NOT NULL").groupBy("field", "v").agg(F.count("*").alias("k")).groupBy("field").agg(F.count("*").alias("n_distinct"), F.sum("k").alias("n_filled"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def redundancy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The share of rows that repeat another row: ``n_rows, n_distinct, ratio``."""
    per = df.groupBy(*columns).agg(F.count("*").alias("k"))
    return per.agg(F.sum("k").alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("ratio", F.round(1 - F.col("n_distinct") / F.col("n_rows"), 6))


def validity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled cells that break the pattern their column's name implies:
    ``field, n_checked, n_invalid``."""
    checked = [(c, next((p for k, p in NAMED.items() if k in c.lower()), None)) for c in columns]
    parts = [
        df.agg(F.count_if(~blank(c)).alias("n_checked"), F.count_if(~blank(c) & ~F.col(f"`{c}`").cast("string").rlike(p)).alias("n_invalid")).select(F.lit(c).alias("field"), "*")
        for c, p in checked if p]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reference_misses(df: DataFrame, column: str, reference: DataFrame, ref_column: str) -> DataFrame:
    """Values outside a reference set, with how often."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return values.join(reference.select(F.col(ref_column).alias("value")).distinct(), "value", "left_anti")


def timeliness(df: DataFrame, column: str, now: str, half_life_days: float = 30.0) -> DataFrame:
    """Mean age in days and the score exp(-ln 2 * age / half-life)."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(column).cast("timestamp"))) / 86400.0
    return df.agg(F.avg(age).alias("a")).select(F.round("a", 4).alias("age_days"), F.round(F.exp(-F.log(F.lit(2.0)) * F.col("a") / half_life_days), 6).alias("score"))


def entropy(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Shannon entropy of a column in nats, by group."""
    c = df.groupBy(*by, column).agg(F.count("*").alias("k"))
    return c.groupBy(*by).agg(F.round(F.log(F.sum("k")) - F.sum(F.col("k") * F.log("k")) / F.sum("k"), 6).alias("entropy"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Entropies and mutual information of two columns, in nats, from one
    table of joint counts."""
    joint = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("k"))
    part = lambda d: d.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("s")).select((F.log("n") - F.col("s") / F.col("n")).alias("h"), F.lit(1).alias("one"))
    hx, hy, hxy = part(joint.groupBy("x").agg(F.sum("k").alias("k"))), part(joint.groupBy("y").agg(F.sum("k").alias("k"))), part(joint)
    j = hx.withColumnRenamed("h", "hx").join(hy.withColumnRenamed("h", "hy"), "one").join(hxy.withColumnRenamed("h", "hxy"), "one")
    return j.select(F.round("hx", 6).alias("h_x"), F.round("hy", 6).alias("h_y"), F.round(F.col("hxy") - F.col("hy"), 6).alias("h_x_given_y"),
                    F.round(F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy")), 6).alias("mutual_information"))


def kl_divergence(p: DataFrame, q: DataFrame, key: str, weight: str) -> DataFrame:
    """Divergence of two weighted distributions over a key, in nats; absent
    keys count 1e-12."""
    a, b = p.groupBy(key).agg(F.sum(weight).alias("wp")), q.groupBy(key).agg(F.sum(weight).alias("wq"))
    j = a.join(b, key, "full").select(F.greatest(F.coalesce("wp", F.lit(0.0)), F.lit(1e-12)).alias("p"), F.greatest(F.coalesce("wq", F.lit(0.0)), F.lit(1e-12)).alias("q"))
    sums = j.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("s"))
    return sums.select(F.round(F.col("s") / F.col("sp") - F.log(F.col("sp") / F.col("sq")), 6).alias("kl"))


def beta_score(df: DataFrame, by: Sequence[str], passed: Column, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Beta-Bernoulli score of a check by group: ``n, n_passed, score, confidence``."""
    a, b = F.col("n_passed") + alpha, F.col("n") - F.col("n_passed") + beta
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(passed).alias("n_passed")).select(
        *by, "n", "n_passed", F.round(a / (a + b), 6).alias("score"), F.round(1 - F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6).alias("confidence"))


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins of a column by group: ``bin, n``."""
    bounds = df.groupBy(*by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    j = df.join(bounds, list(by)) if by else df.withColumn("one", F.lit(1)).join(bounds.withColumn("one", F.lit(1)), "one")
    at = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(column) - F.col("lo"), F.col("hi") - F.col("lo")) * bins)).cast("int")
    return j.where(F.col(column).isNotNull()).groupBy(*by, F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
