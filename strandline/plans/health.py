"""Queries of the health and quality operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import health as H
from strandline.plans.registry import registry, rnd
from strandline.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registry(QUERIES, ORACLE)


@query("""WITH c AS (SELECT name, p_partkey, p_brand FROM (SELECT lower(p_name) AS name, p_partkey, p_brand FROM part)), k AS (SELECT p_partkey, ch, count(*) AS k FROM (SELECT p_partkey, unnest(string_split(name,'')) AS ch FROM c) WHERE ch<>'' GROUP BY 1,2), h AS (SELECT p_partkey, log2(sum(k))-sum(k*log2(k))/sum(k) AS e FROM k GROUP BY 1),
 w AS (SELECT p_brand, p_partkey, e, avg(e) OVER w AS m, count(*) OVER w AS n FROM h JOIN c USING(p_partkey) WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT p_brand, p_partkey, round(e,6) AS entropy, round(m,6) AS expected FROM w WHERE n=5 AND abs(e-m)>=0.3""")
def anomaly_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name has another entropy than those before it."""
    p = table(spark, sf_dir, "part").withColumn("name", F.lower("p_name"))
    return H.entropy_jumps(p, ["p_brand"], ["p_partkey"], "name").select("p_brand", "p_partkey", rnd("entropy", 6).alias("entropy"), rnd("expected", 6).alias("expected"))


@query("""WITH d AS (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, avg(value) AS v FROM events GROUP BY 1,2), w AS (SELECT event_type, day, v, count(*) OVER w AS n, avg(v) OVER w AS m, stddev_samp(v) OVER w AS sd FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT event_type, day, round(v,6) AS v, round((v-m)/sd,4) AS z FROM w WHERE n>=3 AND sd>0 AND abs((v-m)/sd)>=2""")
def anomaly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose mean is unlike all days before, by event type."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.avg("value").alias("v"))
    return H.profile_anomalies(d, ["event_type"], ["day"], "v").select("event_type", "day", rnd("v", 6).alias("v"), rnd("z").alias("z"))


_HEALTH = "p AS (SELECT site, url, coalesce(code<>200 AND code<>0, true) AS bad, tokens, length(html) AS size, coalesce(length(title),0) AS items FROM pages WHERE site IS NOT NULL)"


@query(f"""WITH {_HEALTH}, l AS (SELECT site, quantile_cont(tokens,0.25) AS q1, quantile_cont(tokens,0.75) AS q3, quantile_cont(size,0.25) AS s1, quantile_cont(size,0.75) AS s3 FROM p GROUP BY 1),
 g AS (SELECT site, count(*) AS n, avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END) AS errors, avg(CASE WHEN tokens<q1-1.5*(q3-q1) OR tokens>q3+1.5*(q3-q1) THEN 1.0 ELSE 0.0 END) AS slow, avg(CASE WHEN size<s1-1.5*(s3-s1) OR size>s3+1.5*(s3-s1) THEN 1.0 ELSE 0.0 END) AS odd_size, avg(CASE WHEN items=0 THEN 1.0 ELSE 0.0 END) AS empty, 1-count(DISTINCT url)/count(*) AS repeated FROM p JOIN l USING(site) GROUP BY 1)
 SELECT site, n, round(errors,6) AS errors, round(slow,6) AS slow, round(odd_size,6) AS odd_size, round(empty,6) AS empty, round(repeated,6)+0.0 AS repeated, round(1-((errors>0.1)::INT+(slow>0.05)::INT+(odd_size>0.05)::INT+(empty>0.2)::INT+(repeated>0.5)::INT)/5.0,4) AS score, 1-((errors>0.1)::INT+(slow>0.05)::INT+(odd_size>0.05)::INT+(empty>0.2)::INT+(repeated>0.5)::INT)/5.0>=0.6 AS healthy FROM g""")
def quality_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of each site's pages."""
    p = table(spark, sf_dir, "pages").where("site IS NOT NULL").withColumn("size", F.length("html")).withColumn("items", F.length("title"))
    h = H.collection_health(p, ["site"], (F.col("code") != 200) & (F.col("code") != 0), "tokens", "size", "items", "url")
    return h.select("site", "n", *(rnd(c, 6).alias(c) for c in ("errors", "slow", "odd_size", "empty")), (rnd("repeated", 6) + 0.0).alias("repeated"), "score", "healthy")


@query("""WITH f AS (SELECT 'lang' AS field, count(*) FILTER (coalesce(trim(lang),'')='') AS faults FROM documents UNION ALL SELECT 'source', count(*) FILTER (coalesce(trim(source),'')='') FROM documents UNION ALL SELECT 'title', count(*) FILTER (coalesce(trim(title),'')='') FROM documents UNION ALL SELECT 'url', count(*) FILTER (coalesce(trim(url),'')='') FROM documents), n AS (SELECT count(*) AS n FROM documents)
 SELECT field, faults, round(faults/n,6) AS ratio, CASE WHEN faults/n>=0.5 THEN 'critical' WHEN faults/n>=0.25 THEN 'high' WHEN faults/n>=0.1 THEN 'medium' ELSE 'low' END AS severity FROM f, n WHERE faults>0 ORDER BY faults DESC, field LIMIT 3""")
def quality_top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three document fields with most blanks."""
    from strandline.operators import quality as Q

    c = Q.completeness(table(spark, sf_dir, "documents"), ("lang", "source", "title", "url"))
    return H.top_issues(c.withColumn("faults", F.col("n_blank")), F.col("n_rows")).select("field", "faults", rnd("ratio", 6).alias("ratio"), "severity")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, round(e,6)+0.0 AS entropy, round(d,6) AS cardinality, round(f,6) AS density, round(0.4*e+0.35*d+0.25*f,6) AS score FROM (SELECT (ln(sum(k))-sum(k*ln(k))/sum(k))/ln(sum(k)) AS e, count(*)/sum(k) AS d, sum(k)/(SELECT count(*) FROM icons) AS f FROM (SELECT {c}, count(*) AS k FROM icons WHERE {c} IS NOT NULL GROUP BY 1))" for c in ("category", "icon_name", "style")))
def quality_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much icon fields tell."""
    return H.complexity(table(spark, sf_dir, "icons"), ("category", "icon_name", "style")).select("field", (rnd("entropy", 6) + 0.0).alias("entropy"), *(rnd(c, 6).alias(c) for c in ("cardinality", "density", "score")))


@query("""WITH s AS (SELECT 'completeness' AS dimension, 1-count(*) FILTER (title IS NULL)/count(*) AS score FROM pages UNION ALL SELECT 'uniqueness', count(DISTINCT page_id)/count(*) FROM pages UNION ALL SELECT 'validity', avg(CASE WHEN code=200 OR code=0 THEN 1.0 ELSE 0.0 END) FROM pages)
 SELECT dimension, round(score,6) AS score, CASE dimension WHEN 'completeness' THEN 'fill missing titles' WHEN 'uniqueness' THEN 'drop repeated pages' ELSE 'fetch failed pages again' END AS advice FROM s WHERE score<0.999""")
def quality_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about the pages' weakest dimensions."""
    s = table(spark, sf_dir, "pages").agg(
        (1 - F.avg(F.col("title").isNull().cast("double"))).alias("completeness"), (F.count_distinct("page_id") / F.count("*")).alias("uniqueness"),
        F.avg(F.coalesce(F.col("code").isin(200, 0), F.lit(False)).cast("double")).alias("validity")).unpivot([], ["completeness", "uniqueness", "validity"], "dimension", "score")
    return H.suggestions(s, {"completeness": (0.999, "fill missing titles"), "uniqueness": (0.999, "drop repeated pages"), "validity": (0.999, "fetch failed pages again")}).select("dimension", rnd("score", 6).alias("score"), "advice")


@query()
def quality_credible_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the share of fetched pages of each site."""
    g = table(spark, sf_dir, "pages").groupBy("site").agg(F.sum((F.col("code") == 200).cast("long")).alias("p"), F.sum((F.col("code") != 200).cast("long")).alias("f"))
    i = H.beta_interval(F.col("p"), F.col("f"))
    return g.select("site", rnd(i["low"], 6).alias("low"), rnd(i["high"], 6).alias("high"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(avg(CASE WHEN value IS NOT NULL AND value>=0 THEN 1.0 ELSE 0.0 END),6) AS score FROM events GROUP BY 1")
def quality_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of valid events by day."""
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), rnd(F.avg(F.coalesce(F.col("value") >= 0, F.lit(False)).cast("double")), 6).alias("score"))


_NOW = "2024-03-10 09:30:00"


@query(f"""WITH t AS (SELECT DISTINCT task_id, schedule_type AS k, interval_seconds AS s, CASE WHEN regexp_matches(specific_time,'^[0-2][0-9]:[0-5][0-9]$') THEN specific_time END AS c, day_of_week AS w, day_of_month AS d, TIMESTAMP '{_NOW}' AS now, TIMESTAMP '2024-01-01 00:00:00' AS made FROM tasks),
 a AS (SELECT *, CAST(c AS TIME) AS clock, CAST(now AS DATE) AS today FROM t), b AS (SELECT *, CAST((w-(isodow(today)-1)+7)%7 AS INT) AS ahead, date_trunc('month',today)::DATE AS m0, (date_trunc('month',today)+INTERVAL 1 MONTH)::DATE AS m1 FROM a),
 e AS (SELECT *, today+clock AS d0, today+1+clock AS d1, today+ahead+clock AS w0, today+ahead+7+clock AS w1, m0+CAST(least(d,day(last_day(m0)))-1 AS INT)+clock AS x0, m1+CAST(least(d,day(last_day(m1)))-1 AS INT)+clock AS x1 FROM b)
 SELECT task_id, CASE k WHEN 'interval' THEN made+to_seconds((greatest(floor((epoch(now)-epoch(made))/s),-1)+1)*s) WHEN 'daily' THEN CASE WHEN d0>now THEN d0 ELSE d1 END WHEN 'weekly' THEN CASE WHEN w0>now THEN w0 ELSE w1 END WHEN 'monthly' THEN CASE WHEN x0>now THEN x0 ELSE x1 END END AS next_run FROM e""")
def rel_next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each task runs next, seen from one moment."""
    t = table(spark, sf_dir, "tasks").select("task_id", "schedule_type", "interval_seconds", "specific_time", "day_of_week", "day_of_month").distinct()
    clock = F.when(F.col("specific_time").rlike("^[0-2][0-9]:[0-5][0-9]$"), F.col("specific_time"))
    n = H.next_run(F.col("schedule_type"), F.lit(_NOW).cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("interval_seconds"), clock, F.col("day_of_week"), F.col("day_of_month"))
    return t.select("task_id", n.cast("timestamp_ntz").alias("next_run"))


@query("SELECT p_partkey, round(greatest(0.5,least(60.0,1.0*pow(2.0,p_size%8))*pow(0.9,p_size%5)),6) AS delay FROM part")
def stream_back_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays after errors and successes in a row."""
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", rnd(H.back_off((s % 8).cast("double"), (s % 5).cast("double"), 1.0, 2.0, 0.9, 0.5, 60.0), 6).alias("delay"))
