"""Queries of the graph operators, over the trade graph of parts, suppliers,
customers and their nations, with SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import graph as G
from strandline.plans.registry import registry, rnd
from strandline.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registry(QUERIES, ORACLE)

_E = """e AS (SELECT DISTINCT 'n' || s_nationkey AS src, 'n' || c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey WHERE s_nationkey<>c_nationkey),
 n AS (SELECT 'n' || n_nationkey AS id FROM nation)"""
_L = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), n AS (SELECT DISTINCT src AS id FROM e UNION SELECT DISTINCT dst FROM e)"


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations, and deliveries between them, from all lines."""
    l, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, l.l_suppkey == s.s_suppkey)
    edges = j.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id")), G.simple_edges(edges)


def links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts and the suppliers that deliver them."""
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    return G.nodes_of(e), e


@query(f"WITH {_L} SELECT id, coalesce(o,0) AS out_degree, coalesce(i,0) AS in_degree FROM n LEFT JOIN (SELECT src AS id, count(*) AS o FROM e GROUP BY 1) USING(id) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM e GROUP BY 1) USING(id)")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(*links(spark, sf_dir))


@query(f"WITH {_L} SELECT n_nodes, n_edges, round(n_edges/(n_nodes*(n_nodes-1)),8) AS density, round(n_edges/n_nodes,6) AS mean_out_degree FROM (SELECT count(*) AS n_nodes FROM n), (SELECT count(*) AS n_edges FROM e)")
def graph_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.connectivity(*links(spark, sf_dir))


@query(f"WITH {_E} SELECT id FROM n WHERE id NOT IN (SELECT dst FROM e)")
def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes nothing leads to."""
    nodes, edges = trade(spark, sf_dir)
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


@query(f"WITH {_E} SELECT id FROM n WHERE id NOT IN (SELECT src FROM e)")
def graph_dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that lead nowhere."""
    nodes, edges = trade(spark, sf_dir)
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def _pagerank_sql(rounds: int) -> str:
    steps = [f"WITH {_L}, k AS (SELECT src, count(*) AS k FROM e GROUP BY 1), c AS (SELECT count(*) AS c FROM n), r0 AS (SELECT id, 1.0/c AS rank FROM n, c)"]
    for i in range(rounds):
        steps.append(
            f"l{i} AS (SELECT coalesce(sum(rank),0.0) AS lost FROM r{i} WHERE id NOT IN (SELECT src FROM k)), g{i} AS (SELECT dst AS id, sum(rank/k) AS got FROM e JOIN k USING(src) JOIN r{i} ON r{i}.id=e.src GROUP BY 1), "
            f"r{i + 1} AS MATERIALIZED (SELECT id, 0.15/c+0.85*(coalesce(got,0.0)+lost/c) AS rank FROM n LEFT JOIN g{i} USING(id), l{i}, c)")
    return ", ".join(steps) + f" SELECT id, round(rank,8) AS rank FROM r{rounds}"


@query(_pagerank_sql(20))
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(*links(spark, sf_dir)).withColumn("rank", rnd("rank", 8))


def _hits_sql(rounds: int) -> str:
    steps = [f"WITH {_L}, s0 AS (SELECT id, 1.0 AS hub, 1.0 AS authority FROM n)"]
    for i in range(rounds):
        steps.append(
            f"x{i} AS (SELECT id, coalesce(a,0.0) AS a, coalesce(h,0.0) AS h FROM n LEFT JOIN (SELECT dst AS id, sum(hub) AS a FROM e JOIN s{i} ON id=src GROUP BY 1) USING(id) LEFT JOIN (SELECT src AS id, sum(authority) AS h FROM e JOIN s{i} ON id=dst GROUP BY 1) USING(id)), "
            f"s{i + 1} AS MATERIALIZED (SELECT id, h/(SELECT sqrt(sum(h*h)) FROM x{i}) AS hub, a/(SELECT sqrt(sum(a*a)) FROM x{i}) AS authority FROM x{i})")
    return ", ".join(steps) + f" SELECT id, round(hub,6) AS hub, round(authority,6) AS authority FROM s{rounds}"


@query(_hits_sql(20))
def graph_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hits(*links(spark, sf_dir)).select("id", rnd("hub", 6).alias("hub"), rnd("authority", 6).alias("authority"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || student_id AS a, 'p' || province AS b FROM volunteers WHERE student_id IS NOT NULL AND province IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, seen) AS (SELECT DISTINCT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a=r.seen)
 SELECT id, min(seen) AS component FROM r GROUP BY 1""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students connected by the provinces they asked about."""
    e = table(spark, sf_dir, "volunteers").where("student_id IS NOT NULL AND province IS NOT NULL").select(F.concat(F.lit("c"), "student_id").alias("src"), F.concat(F.lit("p"), "province").alias("dst"))
    return G.components(G.nodes_of(e), e)


@query(f"WITH RECURSIVE {_E}, r(id, depth) AS (SELECT 'n0', 0 UNION SELECT e.dst, r.depth+1 FROM r JOIN e ON e.src=r.id WHERE r.depth<25) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def graph_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from one nation."""
    _, edges = trade(spark, sf_dir)
    return G.depths(edges, spark.createDataFrame([("n0",)], "id string"))


@query(f"""WITH {_E}, u AS (SELECT DISTINCT least(src,dst) AS a, greatest(src,dst) AS b FROM e), w AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u), d AS (SELECT a AS id, count(*) AS deg FROM w GROUP BY 1), t AS (SELECT x.a AS id, count(*) AS t FROM w x JOIN w y ON x.a=y.a AND x.b<y.b JOIN u ON u.a=x.b AND u.b=y.b GROUP BY 1)
 SELECT id, coalesce(t,0) AS triangles, round(coalesce(coalesce(t,0)/nullif(deg*(deg-1)/2,0),0.0),6) AS coefficient FROM n LEFT JOIN d USING(id) LEFT JOIN t USING(id)""")
def graph_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clustering(*trade(spark, sf_dir))


@query()
def graph_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of failure out of one nation."""
    nodes, edges = trade(spark, sf_dir)
    return G.cascade(nodes, edges, spark.createDataFrame([("n0",), ("n1",)], "id string"), 0.2)


@query()
def graph_topological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the nations, edges pointing to larger names."""
    nodes, edges = trade(spark, sf_dir)
    return G.topological_levels(nodes, edges.where("src < dst"))


@query()
def graph_orphans_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the whole part-supplier graph nothing leads to."""
    nodes, edges = links(spark, sf_dir)
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


@query()
def graph_dead_ends_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the whole part-supplier graph that lead nowhere."""
    nodes, edges = links(spark, sf_dir)
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


@query()
def graph_depths_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from one part, either way, on the whole part-supplier graph."""
    _, edges = links(spark, sf_dir)
    return G.depths(G.both_ways(edges), spark.createDataFrame([("p1",)], "id string"))
