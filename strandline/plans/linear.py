"""Queries of the linear models, with SQL where two regressors allow closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import models_linear as L
from strandline.plans.modelling import _with_market
from strandline.plans.quant import _P, prices, returns
from strandline.plans.registry import registry, rnd
from strandline.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registry(QUERIES, ORACLE)

_TWO = "(var_pop(b)*covar_pop(a,y)-covar_pop(a,b)*covar_pop(b,y))/(var_pop(a)*var_pop(b)-pow(covar_pop(a,b),2)) AS ba, (var_pop(a)*covar_pop(b,y)-covar_pop(a,b)*covar_pop(a,y))/(var_pop(a)*var_pop(b)-pow(covar_pop(a,b),2)) AS bb, covar_pop(a,y) AS ay, covar_pop(b,y) AS by_, var_pop(y) AS yy, avg(y) AS my, avg(a) AS ma, avg(b) AS mb"


@query(f"""WITH d AS (SELECT l_returnflag, l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem), f AS (SELECT l_returnflag, count(*) AS n, {_TWO} FROM d GROUP BY 1)
 SELECT l_returnflag, 'l_quantity' AS term, round(ba,4)+0.0 AS coefficient, round((ba*ay+bb*by_)/yy,6) AS r2, n FROM f UNION ALL SELECT l_returnflag, 'l_discount', round(bb,4)+0.0, round((ba*ay+bb*by_)/yy,6), n FROM f UNION ALL SELECT l_returnflag, 'intercept', round(my-ba*ma-bb*mb,4)+0.0, round((ba*ay+bb*by_)/yy,6), n FROM f""")
def model_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of lines by quantity and discount."""
    r = L.regress(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", ["l_quantity", "l_discount"])
    return r.select("l_returnflag", "term", (rnd("coefficient") + 0.0).alias("coefficient"), rnd("r2", 6).alias("r2"), "n")


_MONTHS = "m AS (SELECT o_orderpriority AS g, date_trunc('month', o_orderdate) AS month, avg(o_totalprice)/1e6 AS p, count(*)/1e3 AS q, count(*) FILTER (o_orderstatus='F')/CAST(count(*) AS DOUBLE) AS u FROM orders GROUP BY 1,2)"


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("g"), F.date_trunc("month", "o_orderdate").alias("month")).agg(
        (F.avg("o_totalprice") / 1e6).alias("p"), (F.count("*") / 1e3).alias("q"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("u"))


@query(f"WITH {_MONTHS}, f AS (SELECT g, count(*) AS n, {_TWO.replace('(a,', '(p,').replace('(b,', '(q,').replace(',b)', ',q)').replace(',y)', ',u)').replace('(a)', '(p)').replace('(b)', '(q)').replace('(y)', '(u)')} FROM m GROUP BY 1) SELECT g, round(ba,6)+0.0 AS phi_pi, round(bb,6)+0.0 AS phi_y, round(my-ba*ma-bb*mb+(ba-1)*0.02,6)+0.0 AS natural, round((ba*ay+bb*by_)/yy,6) AS r2, n FROM f")
def macro_policy_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule fitted to monthly orders of each priority."""
    r = L.policy_rule(_months(spark, sf_dir), ["g"], "u", "p", "q")
    return r.select("g", *((rnd(c, 6) + 0.0).alias(c) for c in ("phi_pi", "phi_y", "natural")), rnd("r2", 6).alias("r2"), "n")


@query(f"WITH {_MONTHS}, l AS (SELECT g, p AS y, u AS a, lag(p) OVER (PARTITION BY g ORDER BY month) AS b FROM m), f AS (SELECT g, {_TWO} FROM l WHERE b IS NOT NULL GROUP BY 1) SELECT g, round(-ba,6)+0.0 AS slope, round(bb,6)+0.0 AS persistence, round((my-ba*ma-bb*mb)/(-ba),4)+0.0 AS nairu, round((ba*ay+bb*by_)/yy,6) AS r2 FROM f")
def macro_phillips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve fitted to monthly orders of each priority."""
    from strandline.operators import ordered

    m = ordered.looking_back(_months(spark, sf_dir), ["g"], ["month"], 1, {"before": lambda w: F.lag("p").over(w)})
    r = L.phillips_curve(m, ["g"], "p", "u", "before")
    return r.select("g", *((rnd(c, 6) + 0.0).alias(c) for c in ("slope", "persistence")), (rnd("nairu") + 0.0).alias("nairu"), rnd("r2", 6).alias("r2"))


@query("SELECT l_suppkey, round(regr_slope(l_extendedprice, CASE WHEN l_returnflag='R' THEN -l_quantity ELSE l_quantity END),4)+0.0 AS impact, round(regr_r2(l_extendedprice, CASE WHEN l_returnflag='R' THEN -l_quantity ELSE l_quantity END),6) AS r2, count(*) AS n FROM lineitem GROUP BY 1")
def market_price_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of prices on signed quantities, by supplier."""
    l = table(spark, sf_dir, "lineitem").withColumn("flow", F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")))
    return L.price_impact(l, ["l_suppkey"], "flow", "l_extendedprice").select("l_suppkey", (rnd("impact") + 0.0).alias("impact"), rnd("r2", 6).alias("r2"), "n")


@query()
def risk_style_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name's exposure to market, size and reversal factors."""
    r = returns(spark, sf_dir)
    return L.regress(r.join(L.style_factors(r), "ts"), ["name"], "r", ["mkt", "smb", "hml"])


@query()
def model_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector autoregression of each name and the market."""
    return L.vector_autoregression(_with_market(spark, sf_dir), ["y", "x"])


@query()
def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impulse responses and variance shares of these systems."""
    return L.impulse_responses(model_system(spark, sf_dir), ["y", "x"])


@query()
def model_system_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of these systems."""
    return L.system_forecast(model_system(spark, sf_dir), ["y", "x"], 5)


def _with_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log prices of each name beside the mean log price of all at its time."""
    p = prices(spark, sf_dir).withColumn("y", F.log("value"))
    return p.join(p.groupBy("ts").agg(F.avg("y").alias("x")), "ts").select("name", "t", "y", "x")


@query(f"""WITH {_P}, l AS (SELECT name, t, ts, ln(value) AS y FROM p), m AS (SELECT ts, avg(y) AS x FROM l GROUP BY 1), j AS (SELECT name, t, y, x FROM l JOIN m USING(ts)), f AS (SELECT name, regr_slope(y,x) AS b, regr_intercept(y,x) AS a FROM j GROUP BY 1 HAVING count(*)>2 AND var_pop(x)>0),
 e AS (SELECT name, t, y-a-b*x AS e, b FROM j JOIN f USING(name)), s AS (SELECT u.name, u.e-v.e AS de, v.e AS e1 FROM e u JOIN e v ON u.name=v.name AND v.t=u.t-1), q AS (SELECT name, count(*) AS n, sum(de*e1)/sum(e1*e1) AS c, sum(de*de) AS dd, sum(de*e1) AS d1, sum(e1*e1) AS ee FROM s GROUP BY 1)
 SELECT name, n, round(b,4)+0.0 AS slope, round(c/sqrt((dd-c*d1)/(n-1)/ee),3)+0.0 AS t, c/sqrt((dd-c*d1)/(n-1)/ee)<-3.34 AS cointegrated FROM q JOIN f USING(name) WHERE n>1 AND ee>1e-18*n AND dd-c*d1>0""")
def model_cointegration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether log prices of a name move with the mean of all."""
    r = L.engle_granger(_with_level(spark, sf_dir), "y", "x")
    return r.where("t IS NOT NULL").select("name", "n", (rnd("slope") + 0.0).alias("slope"), (rnd("t", 3) + 0.0).alias("t"), "cointegrated")


@query()
def model_error_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both equations by which name and mean return to each other."""
    return L.error_correction(_with_level(spark, sf_dir), "y", "x")


@query()
def model_cointegration_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace test of name and mean."""
    return L.johansen(_with_level(spark, sf_dir), ["y", "x"])


@query()
def series_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of autoregressions of log prices and their differences."""
    return L.select_order(prices(spark, sf_dir).withColumn("y", F.log("value")), "y")


@query()
def series_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend and cycle of log prices."""
    return L.hp_filter(prices(spark, sf_dir).withColumn("y", F.log("value")), "y")


@query()
def series_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase of the last cycle of each name."""
    return L.wave_phase(series_trend(spark, sf_dir))


@query()
def series_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitudes by period of the returns of each name."""
    return L.spectrum(returns(spark, sf_dir), "r")
