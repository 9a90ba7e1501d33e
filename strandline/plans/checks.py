"""Queries of the quality and anomaly operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import anomaly as A
from strandline.operators import quality as Q
from strandline.plans.registry import registry, rnd
from strandline.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registry(QUERIES, ORACLE)

_FIELDS = ("title", "lang", "source", "url", "text")


def _union(template: str, names) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in names)


@query(_union("SELECT '{c}' AS field, count(*) AS n_rows, count(*)-count({c}) AS n_null, count(*) FILTER (coalesce(trim(CAST({c} AS VARCHAR)),'')='') AS n_blank, round(1-count(*) FILTER (coalesce(trim(CAST({c} AS VARCHAR)),'')='')/count(*),6) AS filled FROM documents", _FIELDS))
def quality_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls and blanks of document fields."""
    return Q.completeness(table(spark, sf_dir, "documents"), _FIELDS)


@query(_union("SELECT '{c}' AS field, count(DISTINCT {c}) AS n_distinct, count({c}) AS n_filled FROM documents", ("lang", "source", "url", "title")))
def quality_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of document fields."""
    return Q.cardinality(table(spark, sf_dir, "documents"), ("lang", "source", "url", "title"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*)>1")
def quality_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once."""
    return Q.duplicates(table(spark, sf_dir, "documents"), ["text"])


@query("SELECT CAST(sum(k) AS BIGINT) AS n_rows, count(*) AS n_distinct, round(1-count(*)/sum(k),6) AS ratio FROM (SELECT count(*) AS k FROM extracted GROUP BY field_id, name, method)")
def quality_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated rows of extracted fields."""
    return Q.redundancy(table(spark, sf_dir, "extracted"), ["field_id", "name", "method"])


@query("SELECT 'url' AS field, count(*) FILTER (coalesce(trim(url),'')<>'') AS n_checked, count(*) FILTER (coalesce(trim(url),'')<>'' AND NOT regexp_matches(url,'^https?://[^\\s/]+\\S*$')) AS n_invalid FROM pages UNION ALL SELECT 'published_date', count(*) FILTER (coalesce(trim(published_time),'')<>''), count(*) FILTER (coalesce(trim(published_time),'')<>'' AND NOT regexp_matches(published_time,'^\\d{4}-\\d{2}-\\d{2}')) FROM pages")
def quality_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that break what their column's name implies."""
    return Q.validity(table(spark, sf_dir, "pages").withColumnRenamed("published_time", "published_date"), ["url", "published_date"])


@query("SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL AND lang NOT IN (SELECT lang FROM sites) GROUP BY 1")
def quality_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages that no site has."""
    return Q.reference_misses(table(spark, sf_dir, "documents"), "lang", table(spark, sf_dir, "sites"), "lang")


@query("SELECT round(a,4) AS age_days, round(exp(-ln(2.0)*a/30.0),6) AS score FROM (SELECT avg((epoch(TIMESTAMP '2001-01-01') - floor(epoch(o_orderdate)))/86400.0) AS a FROM orders)")
def quality_timeliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of orders."""
    return Q.timeliness(table(spark, sf_dir, "orders"), "o_orderdate", "2001-01-01")


@query("SELECT l_returnflag, round(ln(sum(k))-sum(k*ln(k))/sum(k),6) AS entropy FROM (SELECT l_returnflag, l_suppkey, count(*) AS k FROM lineitem GROUP BY 1,2) GROUP BY 1")
def quality_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of suppliers by return flag."""
    return Q.entropy(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_returnflag"])


@query("""WITH j AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS k FROM orders GROUP BY 1,2), a AS (SELECT ln(sum(k))-sum(k*ln(k))/sum(k) AS h FROM (SELECT sum(k) AS k FROM j GROUP BY x)), b AS (SELECT ln(sum(k))-sum(k*ln(k))/sum(k) AS h FROM (SELECT sum(k) AS k FROM j GROUP BY y)), c AS (SELECT ln(sum(k))-sum(k*ln(k))/sum(k) AS h FROM j)
 SELECT round(a.h,6) AS h_x, round(b.h,6) AS h_y, round(c.h-b.h,6) AS h_x_given_y, round(greatest(0.0,a.h+b.h-c.h),6) AS mutual_information FROM a, b, c""")
def quality_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What status and priority say of each other."""
    return Q.mutual_information(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("""WITH p AS (SELECT l_linenumber AS k, sum(l_quantity) AS w FROM lineitem WHERE l_returnflag='R' GROUP BY 1), q AS (SELECT l_linenumber AS k, sum(l_quantity) AS w FROM lineitem WHERE l_returnflag='A' GROUP BY 1), j AS (SELECT greatest(coalesce(p.w,0.0),1e-12) AS p, greatest(coalesce(q.w,0.0),1e-12) AS q FROM p FULL JOIN q USING(k))
 SELECT round(sum(p*ln(p/q))/sum(p)-ln(sum(p)/sum(q)),6) AS kl FROM j""")
def quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned against accepted quantities by line number."""
    l = table(spark, sf_dir, "lineitem")
    return Q.kl_divergence(l.where("l_returnflag = 'R'"), l.where("l_returnflag = 'A'"), "l_linenumber", "l_quantity")


@query("SELECT o_orderpriority, n, n_passed, round((n_passed+1.0)/(n+2.0),6) AS score, round(1-sqrt((n_passed+1.0)*(n-n_passed+1.0)/((n+2.0)*(n+2.0)*(n+3.0))),6) AS confidence FROM (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus='F') AS n_passed FROM orders GROUP BY 1)")
def quality_beta_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bayesian rate of finished orders."""
    return Q.beta_score(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F")


@query("""WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT event_type, CAST(coalesce(least(19, floor((value-lo)/nullif(hi-lo,0)*20)),0) AS INTEGER) AS bin, count(*) AS n FROM events JOIN b USING(event_type) WHERE value IS NOT NULL GROUP BY 1,2""")
def quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-width histograms of event values."""
    return Q.histogram(table(spark, sf_dir, "events"), "value", 20, ["event_type"])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")


@query("WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1) SELECT event_id, round((value-m)/sd,4) AS z FROM events JOIN s USING(event_type) WHERE sd>0 AND abs((value-m)/sd)>=3")
def anomaly_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.zscore(events(spark, sf_dir), ["event_type"], "value").select("event_id", rnd("z").alias("z"))


@query("WITH s AS (SELECT event_type, quantile_cont(value,0.25) AS a, quantile_cont(value,0.75) AS b FROM events GROUP BY 1) SELECT event_id, value FROM events JOIN s USING(event_type) WHERE b>a AND (value<a-1.5*(b-a) OR value>b+1.5*(b-a))")
def anomaly_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.iqr(events(spark, sf_dir), ["event_type"], "value").select("event_id", "value")


@query("WITH m AS (SELECT event_type, quantile_cont(value,0.5) AS med FROM events GROUP BY 1), d AS (SELECT e.event_type, quantile_cont(abs(value-med),0.5) AS mad FROM events e JOIN m USING(event_type) GROUP BY 1) SELECT event_id, round(0.6745*(value-med)/greatest(mad,1e-12),4) AS score FROM events JOIN m USING(event_type) JOIN d USING(event_type) WHERE abs(0.6745*(value-med)/greatest(mad,1e-12))>=3.5")
def anomaly_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mad(events(spark, sf_dir), ["event_type"], "value").select("event_id", rnd("score").alias("score"))


@query("WITH s AS (SELECT event_type, quantile_cont(value,0.05) AS a, quantile_cont(value,0.95) AS b FROM events GROUP BY 1) SELECT event_id FROM events JOIN s USING(event_type) WHERE value<a OR value>b")
def anomaly_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.percentile_band(events(spark, sf_dir), ["event_type"], "value").select("event_id")


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd, quantile_cont(value,0.25) AS a, quantile_cont(value,0.5) AS med, quantile_cont(value,0.75) AS b FROM events GROUP BY 1), d AS (SELECT e.event_type, quantile_cont(abs(value-med),0.5) AS mad FROM events e JOIN s USING(event_type) GROUP BY 1)
 SELECT event_id, CAST(coalesce(abs((value-m)/nullif(sd,0))>=3,false) AS INTEGER)+CAST(coalesce(b>a AND (value<a-1.5*(b-a) OR value>b+1.5*(b-a)),false) AS INTEGER)+CAST(coalesce(0.6745*abs(value-med)/greatest(mad,1e-12)>=3.5,false) AS INTEGER) AS votes, round((CAST(coalesce(abs((value-m)/nullif(sd,0))>=3,false) AS INTEGER)+CAST(coalesce(b>a AND (value<a-1.5*(b-a) OR value>b+1.5*(b-a)),false) AS INTEGER)+CAST(coalesce(0.6745*abs(value-med)/greatest(mad,1e-12)>=3.5,false) AS INTEGER))/3,4) AS confidence FROM events JOIN s USING(event_type) JOIN d USING(event_type)""")
def anomaly_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ensemble(events(spark, sf_dir), ["event_type"], "value").select("event_id", "votes", "confidence")


@query("SELECT event_id FROM (SELECT event_id, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd, count(value) OVER w AS k FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE k=10 AND sd>0 AND abs(value-m)/sd>=2")
def anomaly_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.moving_average(events(spark, sf_dir), ["event_type"], ["ts", "event_id"], "value").select("event_id")


@query()
def anomaly_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cusum(events(spark, sf_dir), ["event_type"], ["ts", "event_id"], "value").select("event_id", "event_type", "direction")


@query("""WITH c AS (SELECT event_type, value AS v, sum(CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN 1 ELSE 0 END) AS b FROM events WHERE value IS NOT NULL GROUP BY 1,2),
 d AS (SELECT event_type, sum(a) OVER g AS na, sum(b) OVER g AS nb, abs(sum(a) OVER w/sum(a) OVER g - sum(b) OVER w/sum(b) OVER g) AS d FROM c WINDOW g AS (PARTITION BY event_type), w AS (PARTITION BY event_type ORDER BY v ROWS UNBOUNDED PRECEDING))
 SELECT event_type, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b, round(max(d),6) AS ks FROM d GROUP BY 1""")
def anomaly_distribution_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    return A.ks_two_sample(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), ["event_type"], "value")


@query()
def anomaly_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    return A.drift_score(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), ["event_type"], "value")


@query("""WITH d AS (SELECT event_type, row_number() OVER w AS n, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER g AS nn, sum(value) OVER g AS ss, var_pop(value) OVER g*count(*) OVER g AS tot FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id), g AS (PARTITION BY event_type)),
 k AS (SELECT event_type, n, round(pow(s/n-(ss-s)/(nn-n),2)*n*(nn-n)/nn/tot,6) AS gain FROM d WHERE n<nn AND tot>0), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY gain DESC, n) AS rk FROM k) SELECT event_type, n AS at, gain FROM r WHERE rk=1""")
def anomaly_mean_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mean_breaks(events(spark, sf_dir), ["event_type"], ["ts", "event_id"], "value")
