"""Queries of the streams, fuzzy matching and closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import finance as N
from strandline.functions import fuzzy as Z
from strandline.plans.registry import registry, rnd
from strandline.session import table
from strandline.streaming import streams as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registry(QUERIES, ORACLE)


def _utc(*columns: str):
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in columns]


@query("SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2,3) WHERE window_end <= (SELECT max(ts) FROM events)")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hours of the event stream."""
    return S.run(S.windowed(S.read_events(spark, sf_dir))).select(*_utc("window_start", "window_end"), "event_type", "n", "total")


@query("""WITH o AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events), g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM o),
 k AS (SELECT user_id, s, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY 1,2) SELECT user_id, session_start, session_end, n FROM k WHERE session_end <= (SELECT max(ts) FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions of the event stream."""
    return S.run(S.sessions(S.read_events(spark, sf_dir))).select("user_id", *_utc("session_start", "session_end"), "n")


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run(S.deduplicated(S.read_events(spark, sf_dir))).select("event_id", "user_id", "event_type")


@query()
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a bucket of two, refilled every half hour, lets through."""
    return S.run(S.rate_limited(S.read_events(spark, sf_dir), 1 / 1800, 2))


@query()
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name resembles a misspelt one."""
    return Z.search(table(spark, sf_dir, "part"), "p_partkey", "p_name", "smal rng", 0.8)


@query("SELECT c_custkey, levenshtein(lower(c_mktsegment),'machinry') AS distance FROM customer")
def fuzzy_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.levenshtein(F.lower("c_mktsegment"), F.lit("machinry")).cast("bigint").alias("distance"))


@query("""SELECT p_partkey, round(CASE WHEN p_retailprice<=900 OR p_retailprice>=1100 THEN 0.0 WHEN p_retailprice<1000 THEN (p_retailprice-900)/100 ELSE (1100-p_retailprice)/100 END,6) AS tri, round(CASE WHEN p_size<=5 OR p_size>=45 THEN 0.0 WHEN p_size<15 THEN (p_size-5)/10 WHEN p_size<=35 THEN 1.0 ELSE (45-p_size)/10 END,6) AS trap, round(exp(-0.5*pow((p_size-25)/10.0,2)),6) AS gauss, round(1/(1+exp(-0.2*(p_size-25))),6) AS sig FROM part""")
def fuzzy_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(
        "p_partkey", rnd(Z.triangular(price, 900, 1000, 1100), 6).alias("tri"), rnd(Z.trapezoidal(size, 5, 15, 35, 45), 6).alias("trap"),
        rnd(Z.gaussian(size, 25, 10), 6).alias("gauss"), rnd(Z.sigmoid(size, 0.2, 25), 6).alias("sig"))


@query()
def fuzzy_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grade of each part from two rules."""
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    cheap, small = Z.trapezoidal(price, 0, 1, 950, 1050), Z.trapezoidal(size, -2, -1, 10, 30)
    grade = Z.mamdani([(Z.fuzzy_and(cheap, small), (50.0, 80.0, 100.0)), (Z.fuzzy_or(1 - cheap, 1 - small), (0.0, 20.0, 50.0))], 0.0, 100.0)
    return table(spark, sf_dir, "part").select("p_partkey", rnd(grade, 6).alias("grade"))


@query()
def finance_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call and a put on every part's price, a year out, and the volatility
    that the call implies."""
    s, k, t, r, v = F.col("p_retailprice"), F.lit(1000.0), F.lit(1.0), F.lit(0.02), F.col("p_size") / 100.0 + 0.05
    p = table(spark, sf_dir, "part").withColumn("call", N.call(s, k, t, r, v))
    return p.select("p_partkey", rnd("call", 6).alias("call"), rnd(N.put(s, k, t, r, v), 6).alias("put"), rnd(N.greeks(s, k, t, r, v)["delta"], 6).alias("delta"), rnd(N.implied_volatility(F.col("call"), s, k, t, r), 5).alias("implied"))


@query("SELECT p_partkey, round(greatest(0.0,(2.0*p_size/100-(1-p_size/100))/2.0),6) AS kelly, round(0.03+1.5*(p_size/1000-0.02)+0.5*(p_retailprice/1000-1),6)+0.0 AS rate, round(CASE WHEN p_retailprice-1000>=0 THEN pow(p_retailprice-1000,0.88) ELSE -2.25*pow(1000-p_retailprice,0.88) END,4)+0.0 AS felt FROM part")
def finance_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kelly fraction, policy rate and felt value of numbers of each part."""
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey", rnd(N.kelly(size / 100, F.lit(2.0)), 6).alias("kelly"), (rnd(N.taylor_rate(size / 1000, price / 1000 - 1), 6) + 0.0).alias("rate"), (rnd(N.prospect_value(price - 1000), 4) + 0.0).alias("felt"))
