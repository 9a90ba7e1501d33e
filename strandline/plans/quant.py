"""Queries of the series and risk operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import series as S
from strandline.plans.registry import registry
from strandline.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registry(QUERIES, ORACLE)

_P = "p AS (SELECT name, t, min(close_value) AS value, min(ts) AS ts FROM series WHERE close_value IS NOT NULL AND isfinite(close_value) AND close_value > 0 AND unit='price' GROUP BY 1,2)"
_R = _P + ", r AS (SELECT a.name, a.t, a.ts, ln(a.value/b.value) AS r FROM p a JOIN p b ON a.name=b.name AND b.t=a.t-1)"


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clean(table(spark, sf_dir, "series"), "price")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.log_returns(prices(spark, sf_dir))


@query(f"WITH {_R} SELECT name, t, round(r,8) AS r FROM r")
def series_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).select("name", "t", F.round("r", 8).alias("r"))


@query(f"WITH {_P} SELECT name, count(*) AS n, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS sd, min(value) AS low, max(value) AS high, round(CASE WHEN count(*)>2 AND stddev_pop(value)>0 THEN skewness(value) END,4) AS skew, round(CASE WHEN count(*)>3 AND stddev_pop(value)>0 THEN kurtosis(value) END,4) AS kurt FROM p GROUP BY 1")
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary(prices(spark, sf_dir))


@query(f"WITH {_P}, d AS (SELECT name, t, value/max(value) OVER (PARTITION BY name ORDER BY t ROWS UNBOUNDED PRECEDING)-1 AS dd FROM p) SELECT name, round(min(dd),8) AS max_drawdown, arg_min(t, struct_pack(dd := dd, t := t)) AS at FROM d GROUP BY 1")
def series_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drawdowns(prices(spark, sf_dir))


@query(f"WITH {_R} SELECT name, t, round(mean,8)+0.0 AS mean, round(sd,8) AS sd FROM (SELECT name, t, count(r) OVER w AS k, avg(r) OVER w AS mean, stddev_samp(r) OVER w AS sd FROM r WINDOW w AS (PARTITION BY name ORDER BY t RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE k=20")
def series_rolling_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rolling(returns(spark, sf_dir), 20).select("name", "t", "mean", "sd")


@query(f"WITH {_R}, m AS (SELECT ts, avg(r) AS m FROM r GROUP BY 1), j AS (SELECT name, t, r, m FROM r JOIN m USING(ts)) SELECT name, t, round(cov/var,6) AS beta FROM (SELECT name, t, count(r) OVER w AS k, covar_pop(r,m) OVER w AS cov, var_pop(m) OVER w AS var FROM j WINDOW w AS (PARTITION BY name ORDER BY t RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE k=60 AND var>1e-18")
def series_rolling_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rolling_beta(returns(spark, sf_dir), 60)


@query(f"WITH {_R}, m AS (SELECT ts, avg(r) AS m FROM r GROUP BY 1) SELECT name, count(*) AS n, round(regr_slope(r,m),6) AS beta, round(regr_intercept(r,m),8) AS alpha, round(regr_r2(r,m),6) AS r2 FROM r JOIN m USING(ts) GROUP BY 1")
def risk_betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.betas(returns(spark, sf_dir))


_Z = S._norm_ppf(0.05)


@query(f"""WITH {_R}, m AS (SELECT name, count(r) AS n, avg(r) AS mu, stddev_samp(r) AS sd, stddev_pop(r) AS sp, quantile_cont(r,0.05) AS hist, avg(r*r*r) AS m3, avg(r*r) AS m2, avg(r*r*r*r) AS m4 FROM r GROUP BY 1),
 k AS (SELECT *, (m3-3*mu*m2+2*mu*mu*mu)/pow(sp,3) AS s, (m4-4*mu*m3+6*mu*mu*m2-3*mu*mu*mu*mu)/pow(sp,4)-3 AS kk FROM m), c AS (SELECT name, avg(r) AS cvar FROM r JOIN m USING(name) WHERE r<=hist GROUP BY 1)
 SELECT name, n, round(hist,8) AS historical, round(mu+{_Z}*sd,8) AS normal, round(mu+({_Z}+({_Z**2 - 1})*s/6+({_Z**3 - 3 * _Z})*kk/24-({2 * _Z**3 - 5 * _Z})*s*s/36)*sd,8) AS cornish_fisher, round(cvar,8) AS shortfall FROM k JOIN c USING(name)""")
def risk_value_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.value_at_risk(returns(spark, sf_dir))


@query(f"WITH {_R} SELECT name, count(r) AS n, round(avg(r)*252,6) AS annual_return, round(stddev_pop(r)*sqrt(252),6) AS annual_volatility, round(avg(r)*252/nullif(stddev_pop(r)*sqrt(252),0),6) AS sharpe, round(avg(r)*252/nullif(sqrt(avg(CASE WHEN r<0 THEN r*r ELSE 0.0 END))*sqrt(252),0),6) AS sortino FROM r GROUP BY 1")
def risk_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.performance(returns(spark, sf_dir))


@query(f"WITH {_R}, m AS (SELECT name, avg(r) AS mu, var_pop(r) AS v FROM r GROUP BY 1), d AS (SELECT name, t, r-mu AS d, v FROM r JOIN m USING(name) WHERE v>0), l AS (SELECT unnest(range(1,6)) AS lag) SELECT a.name, CAST(lag AS INTEGER) AS lag, round(avg(a.d*b.d)/max(a.v),6)+0.0 AS acf FROM d a CROSS JOIN l JOIN d b ON a.name=b.name AND b.t=a.t-lag GROUP BY 1,2")
def series_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.autocorrelation(returns(spark, sf_dir), 5)


@query(f"""WITH {_R}, s AS (SELECT name, t, CASE WHEN r>=0 THEN 1 ELSE 0 END AS up FROM r), b AS (SELECT *, lag(up) OVER (PARTITION BY name ORDER BY t) AS before FROM s), a AS (SELECT name, CAST(sum(up) AS BIGINT) AS n_up, CAST(sum(1-up) AS BIGINT) AS n_down, CAST(sum(CASE WHEN before IS NULL OR before<>up THEN 1 ELSE 0 END) AS BIGINT) AS n_runs FROM b GROUP BY 1),
 k AS (SELECT *, 2.0*n_up*n_down/(n_up+n_down)+1 AS mu FROM a WHERE n_up>0 AND n_down>0) SELECT name, n_up, n_down, n_runs, round((n_runs-mu)/sqrt((mu-1)*(mu-2)/(n_up+n_down-1)),6) AS z FROM k""")
def series_runs_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.runs_test(returns(spark, sf_dir))


@query(f"WITH {_R}, m AS (SELECT name, avg(r) AS mu, var_pop(r) AS v FROM r GROUP BY 1), s AS (SELECT name, count(r) OVER w AS k, sum(r) OVER w AS x FROM r WINDOW w AS (PARTITION BY name ORDER BY t RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT name, round(avg(pow(x-4*mu,2))/(4*max(v)),6) AS ratio FROM s JOIN m USING(name) WHERE k=4 AND v>0 GROUP BY 1")
def series_variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.variance_ratio(returns(spark, sf_dir), 4)


@query(f"WITH {_P}, d AS (SELECT a.name, a.value-b.value AS d, b.value AS l FROM p a JOIN p b ON a.name=b.name AND b.t=a.t-1), s AS (SELECT name, regr_slope(d,l) AS b FROM d GROUP BY 1) SELECT name, round(CASE WHEN b<0 THEN -ln(2.0)/b END,4) AS half_life FROM s")
def series_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.half_life(prices(spark, sf_dir))


@query(f"WITH {_P}, d AS (SELECT a.name, a.t, a.value-b.value AS d FROM p a JOIN p b ON a.name=b.name AND b.t=a.t-1), c AS (SELECT a.name, covar_samp(a.d,b.d) AS c FROM d a JOIN d b ON a.name=b.name AND b.t=a.t-1 GROUP BY 1) SELECT name, round(CASE WHEN c<0 THEN 2*sqrt(-c) ELSE 0.0 END,6) AS spread FROM c")
def series_roll_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.roll_spread(prices(spark, sf_dir))


@query("""WITH d AS (SELECT event_type AS name, date_trunc('day', ts) AS ts, sum(value) AS r FROM events GROUP BY 1,2) SELECT x.name AS a, y.name AS b, round(corr(x.r,y.r),6) AS corr FROM d x JOIN d y ON x.ts=y.ts AND x.name<y.name GROUP BY 1,2""")
def series_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by their daily sums."""
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"), F.date_trunc("day", "ts").alias("ts")).agg(F.sum("value").alias("r"))
    return S.correlations(d)


@query()
def series_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.autoregression(prices(spark, sf_dir))


@query("""WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS mq, avg(l_discount) AS md, covar_pop(l_quantity,l_quantity) AS qq, covar_pop(l_discount,l_discount) AS dd, covar_pop(l_quantity,l_discount) AS qd, covar_pop(l_quantity,l_extendedprice) AS qy, covar_pop(l_discount,l_extendedprice) AS dy FROM lineitem),
 b AS (SELECT *, (qy*dd-dy*qd)/(qq*dd-qd*qd) AS bq, (dy*qq-qy*qd)/(qq*dd-qd*qd) AS bd FROM s)
 SELECT 'intercept' AS term, round(my-bq*mq-bd*md,3) AS coefficient FROM b UNION ALL SELECT 'l_quantity', round(bq,3) FROM b UNION ALL SELECT 'l_discount', round(bd,3) FROM b""")
def risk_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of a line on quantity and discount."""
    fit = S.least_squares(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return spark.createDataFrame([(k, round(fit[k], 3)) for k in ("intercept", "l_quantity", "l_discount")], "term string, coefficient double")
