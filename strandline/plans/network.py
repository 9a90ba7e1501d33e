"""Queries of the network operators on the graph of parts, suppliers,
customers, nations and regions, whole tables all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import network as N
from strandline.plans.graphs import links
from strandline.plans.registry import registry, rnd
from strandline.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registry(QUERIES, ORACLE)


def _named(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions to nations, nations to their suppliers and customers."""
    pairs = (("nation", "r", "n_regionkey", "n", "n_nationkey"), ("supplier", "n", "s_nationkey", "s", "s_suppkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"))
    out = None
    for name, a, x, b, y in pairs:
        e = table(spark, sf_dir, name).select(_named(a, x).alias("src"), _named(b, y).alias("dst"))
        out = e if out is None else out.unionByName(e)
    return out


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).unionByName(links(spark, sf_dir)[1].select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(_named("r", "r_regionkey").alias("id"))


@query("""WITH s AS (SELECT l_partkey, min('s' || l_suppkey) AS p FROM lineitem GROUP BY 1)
 SELECT 'r' || r_regionkey AS id, 0 AS depth, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 1, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 2, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 2, 'n' || c_nationkey FROM customer UNION ALL SELECT 'p' || l_partkey, 3, p FROM s""")
def graph_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree from the regions down to the parts."""
    return N.hierarchy(_all(spark, sf_dir), _regions(spark, sf_dir))


@query()
def graph_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies on the shortest paths from the regions."""
    return N.betweenness(_all(spark, sf_dir), _regions(spark, sf_dir)).select("id", rnd("betweenness", 6).alias("betweenness"))


@query()
def graph_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose loss parts the graph."""
    return N.bridges(_all(spark, sf_dir))


_SHARES = "e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, sum(l_extendedprice)/any_value(t.t) AS weight FROM lineitem JOIN (SELECT l_suppkey AS k, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1) t ON t.k=l_suppkey GROUP BY 1,2)"


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    total = l.groupBy("l_suppkey").agg(F.sum("v").alias("t"))
    return l.join(total, "l_suppkey").select(_named("s", "l_suppkey").alias("src"), _named("p", "l_partkey").alias("dst"), (F.col("v") / F.col("t")).alias("weight"))


@query(f"WITH {_SHARES} SELECT src AS seed, dst AS id, round(least(1.0,weight),8) AS distress FROM e UNION ALL SELECT DISTINCT src, src, 1.0 FROM e")
def graph_debt_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distress that each supplier spreads over its parts."""
    e = _shares(spark, sf_dir)
    return N.debt_rank(e, e.select(F.col("src").alias("id")).distinct()).select("seed", "id", rnd("distress", 8).alias("distress"))


@query(f"WITH {_SHARES}, n AS (SELECT count(DISTINCT src)+count(DISTINCT dst) AS n FROM e) SELECT src AS seed, count(*) AS reached, round(sum(least(1.0,weight))/(any_value(n)-1),8) AS impact FROM e, n GROUP BY 1")
def graph_systemic_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the loss of a supplier reaches."""
    e = _shares(spark, sf_dir)
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().count()
    return N.systemic_risk(N.debt_rank(e, e.select(F.col("src").alias("id")).distinct()), n).select("seed", "reached", rnd("impact", 8).alias("impact"))


@query()
def graph_eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centrality of parts and suppliers by their neighbours'."""
    return N.eigenvector_centrality(links(spark, sf_dir)[1], 12).select("id", rnd("centrality", 6).alias("centrality"))


@query()
def graph_epidemic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread from one part over the part-supplier graph."""
    e = links(spark, sf_dir)[1]
    seed = e.agg(F.min("src").alias("id"))
    return N.epidemic(e, seed, 0.05, 0.2, 6).select("id", *(rnd(c, 6).alias(c) for c in "sir"))
