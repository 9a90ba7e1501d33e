"""Fuzzy containment and keyword classes of texts, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(haystack: Column, needle: Column) -> Column:
    """1 where the needle stands in the text, else the best edit similarity of
    a window as long as the needle, at every quarter of it; 0 for an empty
    needle or text, null for a null."""
    h, n = F.lower(haystack), F.lower(needle)
    size = F.length(n)
    step = F.greatest(F.lit(1), F.floor(size / 4).cast("int"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(h) - size + 1, F.lit(1)), step)
    best = F.array_max(F.transform(starts, lambda i: 1 - F.levenshtein(F.substr(h, i, size), n) / F.greatest(size, F.lit(1))))
    return F.when(haystack.isNull() | needle.isNull(), None).when((size == 0) | (F.length(h) == 0), 0.0).when(F.contains(h, n), 1.0).otherwise(best)


def classify(df: DataFrame, key: str, text: str, classes: dict[str, Sequence[str]], most: int = 5) -> DataFrame:
    """``key, class, score``: the share of a class's keywords in the text, the
    ``most`` best classes with any; ties by name."""
    t = F.lower(F.col(text))
    scored = F.array(*(
        F.struct((-sum((F.coalesce(F.contains(t, F.lit(k.lower())), F.lit(False)).cast("double") for k in keys), F.lit(0.0)) / len(keys)).alias("s"), F.lit(c).alias("c"))
        for c, keys in classes.items()))
    best = F.slice(F.sort_array(F.filter(scored, lambda x: x["s"] < 0)), 1, most)
    return df.select(key, F.explode(best).alias("x")).select(key, F.col("x.c").alias("class"), (-F.col("x.s")).alias("score"))


def completeness(columns: Sequence[str]) -> Column:
    """Share of the cells of a row that are not blank."""
    return sum(((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").cast("double") for c in columns), F.lit(0.0)) / len(columns)


def consistency(rules: Sequence[Column]) -> Column:
    """Share of the rules that a row keeps; an undecided rule is broken."""
    return sum((F.coalesce(r, F.lit(False)).cast("double") for r in rules), F.lit(0.0)) / len(rules)


def ahp_weights(comparisons: Sequence[Sequence[tuple[float, float, float]]]) -> tuple[list[float], float]:
    """Weights of criteria from pairwise triangular judgements, by geometric
    means of their centroids, and the consistency ratio."""
    import numpy as np

    m = np.array([[sum(x) / 3 for x in row] for row in comparisons])
    n = len(m)
    w = np.exp(np.log(m).mean(axis=1))
    w /= w.sum()
    top = float(np.mean(m @ w / w))
    # Mean consistency of random judgements by number of criteria.
    chance = {3: 0.58, 4: 0.90, 5: 1.12, 6: 1.24, 7: 1.32, 8: 1.41, 9: 1.45}.get(n, 0.0)
    return w.tolist(), ((top - n) / (n - 1) / chance if chance else 0.0)
