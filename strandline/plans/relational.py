"""Queries of the relational operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import relational as R
from strandline.plans.registry import registry, rnd
from strandline.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registry(QUERIES, ORACLE)


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity),2) AS sum_qty, round(sum(l_extendedprice),2) AS sum_base_price,
 round(sum(l_extendedprice*(1-l_discount)),2) AS sum_disc_price, round(sum(l_extendedprice*(1-l_discount)*(1+l_tax)),2) AS sum_charge,
 round(avg(l_quantity),4) AS avg_qty, round(avg(l_extendedprice),4) AS avg_price, round(avg(l_discount),6) AS avg_disc, count(*) AS count_order
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1,2""")
def rel_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-by with many aggregates over a pushed-down filter."""
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus").agg(
            rnd(F.sum("l_quantity"), 2).alias("sum_qty"), rnd(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            rnd(F.sum(charge), 2).alias("sum_disc_price"), rnd(F.sum(charge * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            rnd(F.avg("l_quantity")).alias("avg_qty"), rnd(F.avg("l_extendedprice")).alias("avg_price"),
            rnd(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))
    )


@query("SELECT * FROM customer WHERE contains(lower(CAST(c_custkey AS VARCHAR)),'mach') OR contains(lower(c_name),'mach') OR contains(lower(CAST(c_nationkey AS VARCHAR)),'mach') OR contains(lower(CAST(c_acctbal AS VARCHAR)),'mach') OR contains(lower(c_mktsegment),'mach')")
def rel_search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive search over every column."""
    return R.search_rows(table(spark, sf_dir, "customer"), "MACH")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 300000")
def rel_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and projection that reach the scan."""
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice >= 300000").select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, rank_in_group FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank_in_group FROM lineitem) WHERE rank_in_group <= 10")
def rel_top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten dearest lines of each flag and status."""
    return R.top_k(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"],
        [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 10,
    ).select("l_orderkey", "l_linenumber", "l_extendedprice", "rank_in_group")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rel_sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global top-k."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT p_brand, p_type, count(*) AS n FROM part WHERE CAST(p_size AS VARCHAR) < '3' GROUP BY 1,2")
def rel_string_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison by the text of a number, as tables sort on screen."""
    return table(spark, sf_dir, "part").where(F.col("p_size").cast("string") < "3").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice),2) AS total, round(100.0*count(*) FILTER (o_orderstatus='F')/count(*),1) AS done_pct, round(avg(o_totalprice),1) AS mean FROM orders GROUP BY 1")
def rel_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums, averages and a success rate by key."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), rnd(F.sum("o_totalprice"), 2).alias("total"),
        rnd(100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 1).alias("done_pct"), rnd(F.avg("o_totalprice"), 1).alias("mean"))


@query("SELECT n_name, c_mktsegment, grouping(n_name) AS g_nation, grouping(c_mktsegment) AS g_segment, count(*) AS n, round(sum(c_acctbal),2) AS balance FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY CUBE(n_name,c_mktsegment)")
def rel_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All margins of two keys."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.cube("n_name", "c_mktsegment").agg(
        F.grouping("n_name").cast("long").alias("g_nation"), F.grouping("c_mktsegment").cast("long").alias("g_segment"),
        F.count("*").alias("n"), rnd(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice),2) AS total FROM lineitem GROUP BY ROLLUP(l_returnflag,l_linestatus)")
def rel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotals along a hierarchy."""
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), rnd(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT o_orderpriority, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus='F'),2),0.0) AS o_orderstatus_f, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus='O'),2),0.0) AS o_orderstatus_o, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus='P'),2),0.0) AS o_orderstatus_p FROM orders GROUP BY 1")
def rel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column spread over its values."""
    return R.pivot_sum(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, measure, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR measure IN (l_discount, l_tax))")
def rel_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide to long."""
    return table(spark, sf_dir, "lineitem").unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["l_discount", "l_tax"], "measure", "value")


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey")
def rel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left joins to small dimension tables."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice > 400000)")
def rel_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a match."""
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    c = table(spark, sf_dir, "customer")
    return c.join(big, c.c_custkey == big.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey)")
def rel_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a match."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("""WITH p AS (SELECT user_id, ts AS buy_ts, event_id AS buy_id FROM events WHERE event_type='purchase'), c AS (SELECT user_id, ts AS click_ts, value AS click_value, event_id FROM events WHERE event_type='click'),
 j AS (SELECT p.*, c.click_ts, c.click_value, row_number() OVER (PARTITION BY buy_id ORDER BY click_ts DESC, c.event_id DESC) AS rn FROM p LEFT JOIN c ON c.user_id=p.user_id AND c.click_ts<=p.buy_ts)
 SELECT user_id, buy_ts, buy_id, click_ts, click_value FROM j WHERE rn=1""")
def rel_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last click before it."""
    e = table(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("buy_ts"), F.col("event_id").alias("buy_id"))
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("value").alias("click_value"))
    return R.as_of(buys, clicks, ["user_id"], "buy_ts", "click_ts", ["click_value"])


@query("""WITH s AS (SELECT user_id, ts AS t0, ts + INTERVAL 1 HOUR AS t1, event_id AS span_id FROM events WHERE event_type='error')
 SELECT s.span_id, e.event_id FROM s JOIN events e ON e.user_id=s.user_id AND e.ts>=s.t0 AND e.ts<s.t1""")
def rel_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user did in the hour after each error."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = e.where("event_type = 'error'").select("user_id", F.col("at").alias("t0"), (F.col("at") + 3_600_000_000).alias("t1"), F.col("event_id").alias("span_id"))
    return R.range_join(e.select("user_id", "at", "event_id"), spans, ["user_id"], "at", "t0", "t1", 3.6e9).select("span_id", "event_id")


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderdate::VARCHAR || lpad(CAST(o_orderkey AS VARCHAR),12,'0')) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def rel_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first order."""
    return R.dedupe_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def rel_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def rel_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select("s_nationkey"))


@query("SELECT c_name AS name, c_acctbal AS balance, 'customer' AS kind FROM customer UNION ALL SELECT s_name, s_acctbal, 'supplier' FROM supplier")
def rel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"))
    return c.unionByName(s)


@query("""WITH a AS (SELECT p_partkey AS id, CASE WHEN p_size>25 THEN p_brand END AS brand, p_type AS type FROM part WHERE p_type <> 'ECONOMY'), b AS (SELECT p_partkey AS id, p_brand AS brand, CASE WHEN p_size<10 THEN p_type END AS type FROM part WHERE p_retailprice >= 950)
 SELECT coalesce(a.id,b.id) AS id, coalesce(a.brand,b.brand) AS brand, coalesce(a.type,b.type) AS type, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NOT NULL AND ((a.brand IS NULL AND b.brand IS NOT NULL) OR (a.type IS NULL AND b.type IS NOT NULL)) THEN 'filled' ELSE 'kept' END AS action FROM a FULL JOIN b ON a.id=b.id""")
def rel_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed merge that only fills what is missing."""
    p = table(spark, sf_dir, "part")
    a = p.where("p_type <> 'ECONOMY'").selectExpr("p_partkey AS id", "CASE WHEN p_size > 25 THEN p_brand END AS brand", "p_type AS type")
    b = p.where("p_retailprice >= 950").selectExpr("p_partkey AS id", "p_brand AS brand", "CASE WHEN p_size < 10 THEN p_type END AS type")
    return R.upsert(a, b, "id")


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, o_orderstatus, round(sum(o_totalprice),2) AS total FROM orders GROUP BY 1,2)
 SELECT month, o_orderstatus, total, round(total - lag(total) OVER w, 2) AS change, round((total - lag(total) OVER w)/nullif(lag(total) OVER w,0),6) AS pct_change FROM m WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month)""")
def rel_period_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month over month."""
    m = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month"), "o_orderstatus").agg(rnd(F.sum("o_totalprice"), 2).alias("total"))
    return R.period_change(m, ["o_orderstatus"], "month", "total").withColumn("change", rnd("change", 2)).withColumn("pct_change", rnd("pct_change", 6))


@query("""WITH t AS (SELECT p_brand, round(sum(l_extendedprice),2) AS revenue FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1)
 SELECT p_brand, revenue, round(sum(revenue) OVER (ORDER BY revenue DESC, p_brand ROWS UNBOUNDED PRECEDING)/sum(revenue) OVER (),6) AS cum_share FROM t""")
def rel_cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running share of brands, largest first."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    t = l.join(p, l.l_partkey == p.p_partkey).groupBy("p_brand").agg(rnd(F.sum("l_extendedprice"), 2).alias("revenue"))
    return R.cumulative_share(t, "revenue", ["p_brand"]).withColumn("cum_share", rnd("cum_share", 6))


@query("""WITH d AS (SELECT *, sum(l_quantity) OVER w AS d_hi, sum(l_quantity) OVER w - l_quantity AS d_lo FROM lineitem WHERE l_returnflag='R' WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate,l_orderkey,l_linenumber ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT *, sum(l_quantity) OVER w AS s_hi, sum(l_quantity) OVER w - l_quantity AS s_lo FROM lineitem WHERE l_returnflag='A' WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate,l_orderkey,l_linenumber ROWS UNBOUNDED PRECEDING))
 SELECT d.l_partkey AS part, d.l_orderkey AS d_order, d.l_linenumber AS d_line, s.l_orderkey AS s_order, s.l_linenumber AS s_line, least(d_hi,s_hi)-greatest(d_lo,s_lo) AS allocated FROM d JOIN s ON d.l_partkey=s.l_partkey AND d_lo<s_hi AND s_lo<d_hi""")
def rel_fifo_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines matched with accepted lines, first come first served."""
    def side(flag: str, name: str) -> DataFrame:
        f = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
        return f.selectExpr("l_partkey AS part", f"l_orderkey AS {name}_order", f"l_linenumber AS {name}_line", f"l_shipdate AS {name}_date", f"l_quantity AS {name}_q")
    out = R.allocate_fifo(side("R", "d"), side("A", "s"), ["part"], ["d_date", "d_order", "d_line"], ["s_date", "s_order", "s_line"], "d_q", "s_q")
    return out.select("part", "d_order", "d_line", "s_order", "s_line", "allocated")


@query("SELECT o_orderkey, o_custkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS quartile, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS dr FROM orders")
def rel_window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles and ranks."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS quartile",
        "CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS r", "CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS dr")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),6) AS prev10, round(max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),6) AS running_max FROM events")
def rel_window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the ten rows before, and the running maximum."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),6) AS prev10",
        "round(max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),6) AS running_max")


@query("SELECT event_type, CAST(json_extract(props,'$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1,2")
def rel_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member of a JSON text as a key."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
 g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM o)
 SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM g GROUP BY 1,2""")
def rel_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions ended by half an hour of silence."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "ts", "CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens")
    g = e.selectExpr("user_id", "ts", "sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session")
    return g.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT o_orderpriority, list_sort(list(o_orderkey)) AS keys FROM orders GROUP BY 1")
def rel_group_to_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups as sorted lists."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))


@query("SELECT lang, source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT url) AS urls FROM documents GROUP BY 1,2")
def rel_documents_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and source, nulls as groups of their own."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"), F.count_distinct("url").alias("urls"))


@query("SELECT quantile_cont(l_extendedprice,0.5) AS median, quantile_cont(l_extendedprice,0.95) AS p95, l_returnflag FROM lineitem GROUP BY l_returnflag")
def rel_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles by group."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", 0.5).alias("median"), F.percentile("l_extendedprice", 0.95).alias("p95"))


@query("SELECT n_name, o_year, round(sum(v),2) AS revenue FROM (SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS o_year, l_extendedprice*(1-l_discount) AS v FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey) GROUP BY 1,2")
def rel_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation and year over a star of four tables."""
    l, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", F.year("o_orderdate").alias("o_year")).agg(rnd(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
