"""Queries of near-duplicates, models and portfolios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import models as M
from strandline.operators import neardup
from strandline.operators import series as S
from strandline.plans.quant import _R, returns
from strandline.plans.registry import registry
from strandline.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registry(QUERIES, ORACLE)


@query()
def text_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return neardup.classes(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def model_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on their first three components."""
    scores, _ = M.principal_components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3)
    return scores


@query()
def model_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in eight clusters."""
    return M.k_means(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


def _with_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns(spark, sf_dir)
    return r.join(S.market(r), "ts").select("name", "t", F.col("m").alias("x"), F.col("r").alias("y"))


@query()
def model_granger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the market's past helps to tell each name."""
    return M.granger(_with_market(spark, sf_dir))


@query(f"""WITH {_R}, m AS (SELECT ts, avg(r) AS m FROM r GROUP BY 1), j AS (SELECT name, t, m AS x, r AS y FROM r JOIN m USING(ts)), l AS (SELECT name, min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM j GROUP BY 1),
 b AS (SELECT name, t, coalesce(least(7,floor((x-xl)/nullif(xh-xl,0)*8)),0) AS bx, coalesce(least(7,floor((y-yl)/nullif(yh-yl,0)*8)),0) AS by_ FROM j JOIN l USING(name)), d AS (SELECT a.name, a.by_ AS yy, p.by_ AS y1, p.bx AS x1 FROM b a JOIN b p ON a.name=p.name AND p.t=a.t-1),
 f AS (SELECT name, yy, y1, x1, count(*) AS k FROM d GROUP BY ALL), s3 AS (SELECT name, sum(k) AS n, sum(k*log2(k)) AS s FROM f GROUP BY 1), sx AS (SELECT name, sum(k*log2(k)) AS s FROM (SELECT name, y1, x1, sum(k) AS k FROM f GROUP BY ALL) GROUP BY 1), sy AS (SELECT name, sum(k*log2(k)) AS s FROM (SELECT name, yy, y1, sum(k) AS k FROM f GROUP BY ALL) GROUP BY 1), s1 AS (SELECT name, sum(k*log2(k)) AS s FROM (SELECT name, y1, sum(k) AS k FROM f GROUP BY ALL) GROUP BY 1)
 SELECT name, round(greatest(0.0,(s3.s-sx.s-sy.s+s1.s)/n),6) AS bits FROM s3 JOIN sx USING(name) JOIN sy USING(name) JOIN s1 USING(name)""")
def model_transfer_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits from the market to each name."""
    return M.transfer_entropy(_with_market(spark, sf_dir))


@query()
def model_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially weighted volatility of every return."""
    return M.ewma_volatility(returns(spark, sf_dir))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"), F.date_trunc("day", "ts").alias("ts")).agg(F.sum("value").alias("r"))
    return d.withColumn("r", F.col("r") / 1000)


@query()
def portfolio_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the kinds of events under five rules, taken as assets."""
    names, mean, cov = M.return_moments(_kinds(spark, sf_dir))
    rules = {"minimum_variance": M.minimum_variance(cov), "maximum_sharpe": M.maximum_sharpe(mean, cov), "risk_parity": M.risk_parity(cov), "hierarchical": M.hierarchical_parity(cov), "equal": np.full(len(names), 1 / len(names))}
    return spark.createDataFrame([(r, n, round(float(w), 4)) for r, ws in rules.items() for n, w in zip(names, ws, strict=True)], "rule string, name string, weight double")


@query()
def portfolio_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least deviation by return, and the market line at no free rate."""
    _, mean, cov = M.return_moments(_kinds(spark, sf_dir))
    rows = [("frontier", i, round(d, 8), round(m, 8)) for i, (m, d, _) in enumerate(M.frontier(mean, cov))]
    rows += [("market line", i, round(d, 8), round(m, 8)) for i, (d, m) in enumerate(M.market_line(mean, cov, 0.0))]
    return spark.createDataFrame(rows, "line string, point int, deviation double, mean double")


@query()
def portfolio_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means after a view that the first kind gains a tenth, with their best and Kelly weights."""
    names, mean, cov = M.return_moments(_kinds(spark, sf_dir))
    after = M.black_litterman(mean, cov, {0: (float(mean[0]) * 1.1, 0.6)})
    return spark.createDataFrame(
        [(n, round(float(a), 8), round(float(b), 6), round(float(k), 6)) for n, a, b, k in zip(names, after, M.maximum_sharpe(after, cov), M.kelly_weights(after, cov, 0.5), strict=True)],
        "name string, mean double, weight double, kelly double")


@query()
def graph_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial correlations of the kinds of events, and whether a link stays."""
    r = _kinds(spark, sf_dir)
    names, _, cov = M.return_moments(r)
    sd = np.sqrt(np.diag(cov))
    part, kept = M.partial_correlations(cov), set(M.skeleton(cov / np.outer(sd, sd), r.select("ts").distinct().count()))
    return spark.createDataFrame(
        [(names[i], names[j], round(float(part[i, j]), 6), (i, j) in kept) for i in range(len(names)) for j in range(i + 1, len(names))],
        "a string, b string, partial double, linked boolean")


@query()
def portfolio_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum spanning tree of the kinds of events by correlation."""
    names, _, cov = M.return_moments(_kinds(spark, sf_dir))
    sd = np.sqrt(np.diag(cov))
    return spark.createDataFrame([(a, b, round(d, 6)) for a, b, d in M.spanning_tree(names, cov / np.outer(sd, sd))], "a string, b string, distance double")


@query()
def portfolio_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of simulated prices, from the mean and deviation of orders."""
    o = table(spark, sf_dir, "orders").agg(F.avg("o_totalprice").alias("m"), F.stddev("o_totalprice").alias("s")).first()
    paths = M.simulate_paths(spark, 100_000, o.m, 0.05, o.s / o.m, 1.0, 7)
    return paths.agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("mean"), F.round(F.percentile("value", 0.05), 2).alias("p05"), F.round(F.percentile("value", 0.95), 2).alias("p95"))
