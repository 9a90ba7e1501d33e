"""Further queries: filters and tests of series, books, strata and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import anomaly as A
from strandline.operators import graph as G
from strandline.operators import market as K
from strandline.operators import series as S
from strandline.plans.graphs import _E, trade
from strandline.plans.quant import _P, prices
from strandline.plans.registry import registry, rnd
from strandline.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registry(QUERIES, ORACLE)


@query(f"WITH {_P}, d AS (SELECT a.name, a.value-b.value AS y, b.value AS x FROM p a JOIN p b ON a.name=b.name AND b.t=a.t-1), s AS (SELECT name, count(*) AS n, regr_slope(y,x) AS b, regr_sxx(y,x) AS sxx, regr_syy(y,x) AS syy FROM d GROUP BY 1) SELECT name, n, round(b,8) AS slope, round(b/sqrt((syy-b*b*sxx)/(n-2)/sxx),4) AS stat FROM s WHERE n>2 AND sxx>0")
def series_unit_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unit_root(prices(spark, sf_dir))


@query()
def series_band_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.band_pass(prices(spark, sf_dir))


@query("""WITH o AS (SELECT l_returnflag AS book, CASE WHEN l_linestatus='F' THEN 'buy' ELSE 'sell' END AS side, round(l_extendedprice/l_quantity) AS price, l_quantity AS qty FROM lineitem), l AS (SELECT book, price, sum(CASE WHEN side='buy' THEN qty ELSE 0.0 END) AS b, sum(CASE WHEN side='sell' THEN qty ELSE 0.0 END) AS s FROM o GROUP BY 1,2),
 t AS (SELECT book, price, least(sum(b) OVER (PARTITION BY book ORDER BY price DESC ROWS UNBOUNDED PRECEDING), sum(s) OVER (PARTITION BY book ORDER BY price ROWS UNBOUNDED PRECEDING)) AS volume FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY volume DESC, price) AS rn FROM t) SELECT book, price, volume FROM r WHERE rn=1""")
def market_call_auction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as orders: the clearing price of each flag's book."""
    o = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("book"), F.when(F.col("l_linestatus") == "F", "buy").otherwise("sell").alias("side"), F.round(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"))
    return K.call_auction(o, ["book"])


@query("""WITH l AS (SELECT l_returnflag AS book, round(l_extendedprice/l_quantity) AS price, sum(l_quantity) AS qty FROM lineitem GROUP BY 1,2), c AS (SELECT *, greatest(0.0, least(qty, 5000.0-(sum(qty) OVER (PARTITION BY book ORDER BY price ROWS UNBOUNDED PRECEDING)-qty))) AS take FROM l) SELECT book, round(sum(take),6) AS filled, round(sum(take*price)/nullif(sum(take),0),6) AS average FROM c GROUP BY 1""")
def market_walk_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("book"), F.round(F.col("l_extendedprice") / F.col("l_quantity")).alias("price")).agg(F.sum("l_quantity").alias("qty"))
    return K.walk_book(l, ["book"], 5000)


@query("""WITH c AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY 1,2), s AS (SELECT o_orderpriority, count(*) AS k FROM orders GROUP BY 1), p AS (SELECT o_orderstatus, round(avg(o_totalprice),4) AS plain FROM orders GROUP BY 1) SELECT o_orderstatus, round(sum(m*k/(SELECT sum(k) FROM s)),4) AS adjusted, max(plain) AS plain FROM c JOIN s USING(o_orderpriority) JOIN p USING(o_orderstatus) GROUP BY 1""")
def causal_adjusted_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by status, adjusted for priority."""
    return K.adjusted_effect(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", ["o_orderpriority"])


@query("""WITH n AS (SELECT sqrt(sum(p_size*p_size)) AS ns, max(p_size) AS hs, min(p_size) AS ls, sqrt(sum(p_retailprice*p_retailprice)) AS np, max(p_retailprice) AS hp, min(p_retailprice) AS lp FROM part), d AS (SELECT p_partkey, sqrt(pow((p_size-hs)/ns*0.6,2)+pow((p_retailprice-lp)/np*0.4,2)) AS best, sqrt(pow((p_size-ls)/ns*0.6,2)+pow((p_retailprice-hp)/np*0.4,2)) AS worst FROM part, n) SELECT p_partkey, round(worst/(best+worst),6) AS closeness FROM d""")
def rank_topsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by size (large) and price (low)."""
    p = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return K.topsis(p, "p_partkey", {"p_size": (0.6, True), "p_retailprice": (0.4, False)})


@query()
def anomaly_grubbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grubbs(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value")


@query("""WITH s AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), i AS (SELECT user_id, event_type, count(*) AS k FROM s GROUP BY 1,2), t AS (SELECT user_id, before, event_type, count(*) AS k FROM s WHERE before IS NOT NULL GROUP BY 1,2,3),
 b AS (SELECT user_id, count(*) AS n, avg(CASE WHEN before IS NULL THEN NULL WHEN before=event_type THEN 1.0 ELSE 0.0 END) AS rep FROM s GROUP BY 1), hi AS (SELECT user_id, count(*) AS d, log2(sum(k))-sum(k*log2(k))/sum(k) AS h FROM i GROUP BY 1), ht AS (SELECT user_id, log2(sum(k))-sum(k*log2(k))/sum(k) AS h FROM t GROUP BY 1)
 SELECT user_id, n, round(d/n,6) AS unique_ratio, round(hi.h,6)+0.0 AS entropy, round(coalesce(ht.h,0.0),6)+0.0 AS step_entropy, round(coalesce(rep,0.0),6) AS repeat_rate FROM b JOIN hi USING(user_id) LEFT JOIN ht USING(user_id)""")
def anomaly_sequence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.sequence_profile(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return out.withColumn("entropy", F.col("entropy") + 0.0).withColumn("step_entropy", F.col("step_entropy") + 0.0)


@query(f"""WITH RECURSIVE {_E}, w AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r(root, id, d) AS (SELECT id, id, 0 FROM n UNION SELECT r.root, w.b, r.d+1 FROM r JOIN w ON w.a=r.id WHERE r.d<6), m AS (SELECT root, id, min(d) AS d FROM r GROUP BY 1,2) SELECT root AS id, round(coalesce((count(*)-1)/nullif(sum(d),0),0.0),6) AS closeness FROM m GROUP BY 1""")
def graph_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.closeness(*trade(spark, sf_dir))


@query()
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students and provinces by label propagation."""
    e = table(spark, sf_dir, "volunteers").where("student_id IS NOT NULL AND province IS NOT NULL").select(F.concat(F.lit("c"), "student_id").alias("src"), F.concat(F.lit("p"), "province").alias("dst"))
    return G.communities(G.nodes_of(e), e)


@query("SELECT schedule_type, enabled, count(*) AS n, CAST(sum(total_runs) AS BIGINT) AS runs, count(*) FILTER (last_run IS NULL) AS never FROM tasks GROUP BY 1,2")
def rel_task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tasks").groupBy("schedule_type", "enabled").agg(F.count("*").alias("n"), F.sum(F.col("total_runs").cast("long")).alias("runs"), F.count_if(F.col("last_run").isNull()).alias("never"))


@query("SELECT site, code, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, round(100.0*count(*) FILTER (code<>200)/count(*),1) AS error_pct FROM pages GROUP BY 1,2")
def rel_page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy("site", "code").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), rnd(100.0 * F.count_if(F.col("code") != 200) / F.count("*"), 1).alias("error_pct"))
