"""Queries of the closed forms on statements, capital, games and fuzzy numbers.

Their numbers are taken from parts and orders: any columns do, as the forms are
evaluated row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import statements as N
from strandline.plans.registry import registry, rnd
from strandline.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registry(QUERIES, ORACLE)


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("v"))


_P = "p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, p_retailprice AS v FROM part)"


@query(f"""WITH {_P}, z AS (SELECT p_partkey, 6.56*(s/100)+3.26*(s/80)+6.72*(v/20000)+1.05*(v/1000)+3.25-6 AS z FROM p)
 SELECT p_partkey, round(z,6) AS z, CASE WHEN z>2.6 THEN 'safe' WHEN z>=1.1 THEN 'grey' ELSE 'distress' END AS zone, CASE WHEN z>2.99 THEN 'safe' WHEN z>=1.81 THEN 'grey' ELSE 'distress' END AS zone_making FROM z""")
def finance_distress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distress scores and their zones."""
    s, v = F.col("s"), F.col("v")
    z = _part(spark, sf_dir).withColumn("z", N.altman_general(s / 100, s / 80, v / 20000, v / 1000) - 6)
    return z.select("p_partkey", rnd("z", 6).alias("z"), N.altman_zone(F.col("z"), False).alias("zone"), N.altman_zone(F.col("z")).alias("zone_making"))


@query(f"""WITH {_P}, i AS (SELECT p_partkey, (s/v)/nullif((s-1)/(v-10),0) AS dsri, (0.3+s/200)/(0.2+s/100) AS gmi, (1-(v/3)/(v+s))/(1-(v/4)/v) AS aqi, (v+s)/v AS sgi,
 (s/(s+v))/((s+1)/(s+1+v)) AS depi, (s/v)/nullif((s-1)/(v-10),0) AS sgai, (s+2)/(s+1) AS lvgi, (s-v/100)/(v+s) AS tata FROM p),
 m AS (SELECT *, -4.84+0.92*coalesce(dsri,1)+0.528*gmi+0.404*aqi+0.892*sgi+0.115*depi-0.172*coalesce(sgai,1)+4.679*tata-0.327*lvgi AS m FROM i)
 SELECT p_partkey, round(dsri,6) AS dsri, round(gmi,6) AS gmi, round(aqi,6) AS aqi, round(sgi,6) AS sgi, round(depi,6) AS depi, round(lvgi,6) AS lvgi, round(tata,6)+0.0 AS tata, round(m,6)+0.0 AS m, m>-1.78 AS likely, round(least(1.0,greatest(0.0,1-exp(-7.89+2.53*m))),6) AS chance FROM m""")
def finance_manipulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of two periods and the score of manipulation."""
    s, v = F.col("s"), F.col("v")
    days = N.ratio_index(s / v, (s - 1) / (v - 10))
    i = _part(spark, sf_dir).select(
        "p_partkey", days.alias("dsri"), N.margin_index(0.2 + s / 100, 0.3 + s / 200).alias("gmi"), N.asset_quality_index(v + s, v / 3, v, v / 4).alias("aqi"),
        N.ratio_index(v + s, v).alias("sgi"), N.depreciation_index(s + 1, v, s, v).alias("depi"), days.alias("sgai"), N.ratio_index(s + 2, s + 1).alias("lvgi"), N.accruals(s, v / 100, v + s).alias("tata"))
    m = i.withColumn("m", N.beneish_score(*(F.col(c) for c in ("dsri", "gmi", "aqi", "sgi", "depi", "sgai", "lvgi", "tata"))))
    return m.select(
        "p_partkey", *(rnd(c, 6).alias(c) for c in ("dsri", "gmi", "aqi", "sgi", "depi", "lvgi")), (rnd("tata", 6) + 0.0).alias("tata"), (rnd("m", 6) + 0.0).alias("m"),
        (F.col("m") > -1.78).alias("likely"), rnd(N.manipulation_probability(F.col("m")), 6).alias("chance"))


@query(f"""WITH {_P}, l AS (SELECT *, v+0.25*10*s AS value, v+0.25*10*s-10*s AS equity FROM p), c AS (SELECT *, 0.1+(0.1-0.04)*0.75*(10*s/equity) AS cost FROM l), g AS (SELECT i FROM generate_series(0,199) t(i)),
 d AS (SELECT p_partkey, arg_max(i, w)*v/199.0 AS debt FROM (SELECT p_partkey, v, i, v*(0.25*i/199.0-0.3*pow(i/199.0,2)) AS w FROM p, g) GROUP BY p_partkey, v)
 SELECT c.p_partkey, round(value,4) AS value, round(cost,6) AS equity_cost, round((equity*cost+10*s*0.04*0.75)/value,6) AS wacc, round(debt,4) AS best_debt, round(least(v,20*s),4) AS internal, round(least(v-least(v,20*s),300),4) AS debt, round(v-least(v,20*s)-least(v-least(v,20*s),300),4) AS equity FROM c JOIN d USING(p_partkey)""")
def finance_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and cost of levered firms, the best debt, and the order of funds."""
    s, v = F.col("s"), F.col("v")
    m, o = N.levered(v, 10 * s, 0.1, 0.04, 0.25), N.pecking_order(v, 20 * s, F.lit(300.0))
    return _part(spark, sf_dir).select(
        "p_partkey", rnd(m["value"]).alias("value"), rnd(m["equity_cost"], 6).alias("equity_cost"), rnd(m["wacc"], 6).alias("wacc"), rnd(N.best_debt(v, 0.25, 0.3)).alias("best_debt"),
        *(rnd(o[c]).alias(c) for c in ("internal", "debt", "equity")))


@query(f"""WITH {_P} SELECT p_partkey, round(v*0.045,4) AS common, round(v*0.06,4) AS tier1, round(v*0.08,4) AS total, round(v*0.025,4) AS buffer, round(3*s-v*0.105,4)+0.0 AS surplus,
 round(v/(s*30),6) AS coverage, v/(s*30)>=1 AS covered, round(s/v,6) AS leverage, s/v>=0.03 AS enough FROM p WHERE s>0""")
def finance_regulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capital, liquidity and leverage that regulation asks for."""
    s, v = F.col("s"), F.col("v")
    need, cover, lever = N.capital_needs(v, 3 * s), N.coverage(v, s * 30), N.leverage(s, v)
    return _part(spark, sf_dir).where("s > 0").select(
        "p_partkey", *(rnd(need[c]).alias(c) for c in ("common", "tier1", "total", "buffer")), (rnd(need["surplus"]) + 0.0).alias("surplus"),
        rnd(cover["coverage"], 6).alias("coverage"), cover["covered"].alias("covered"), rnd(lever["leverage"], 6).alias("leverage"), lever["enough"].alias("enough"))


@query(f"""WITH {_P} SELECT p_partkey, round(s+(v-s)*pow(1.05,s/10),4) AS price, round(1000.0/5*(v-s)*(1/1.05+1/pow(1.05,2)+1/pow(1.05,3)+1/pow(1.05,4)+1/pow(1.05,5)),2) AS reserve, round(v*pow(2.0,s/2.0),2) AS doubled, round(2*log2(1e12/v),6) AS years,
 round(v*(0.1*0.2+0.02*0.7),4) AS hazard, round(s/100*v*0.5*2.25,6) AS carbon, round(0.25*s+0.25*s*2+0.5*v/20,4) AS composite,
 CASE WHEN 0.25*s+0.25*s*2+0.5*v/20>=80 THEN 'very low' WHEN 0.25*s+0.25*s*2+0.5*v/20>=70 THEN 'low' WHEN 0.25*s+0.25*s*2+0.5*v/20>=60 THEN 'moderate' WHEN 0.25*s+0.25*s*2+0.5*v/20>=50 THEN 'high' ELSE 'very high' END AS risk,
 round(s*greatest(s/50-0.5,0),6) AS confidence, round(s/(s+v)-10/(10+s),6)+0.0 AS disposition FROM p""")
def finance_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource prices, growth, hazards, country risk and investor bias."""
    s, v = F.col("s"), F.col("v")
    risk = N.composite_risk(s, s * 2, v / 20)
    return _part(spark, sf_dir).select(
        "p_partkey", rnd(N.hotelling_price(v, s, 0.05, s / 10)).alias("price"), rnd(N.reserve_value(F.lit(1000.0), v, s, 0.05, 5), 2).alias("reserve"), rnd(N.doublings(v, s), 2).alias("doubled"),
        rnd(N.years_to(v, 1e12), 6).alias("years"), rnd(N.physical_risk(v, (0.1, 0.02), (0.2, 0.7))).alias("hazard"), rnd(N.carbon_exposure(s / 100, v, 1.5), 6).alias("carbon"),
        rnd(risk["composite"]).alias("composite"), risk["risk"].alias("risk"), rnd(N.overconfidence(s, s / 50, F.lit(0.5)), 6).alias("confidence"),
        (rnd(N.disposition(s, F.lit(10.0), v, s), 6) + 0.0).alias("disposition"))


@query(f"""WITH {_P} SELECT p_partkey, round(greatest(v-950,0)-greatest(v-1050,0),4) AS spread, round(greatest(v-1000,0)+greatest(1000-v,0),4) AS straddle,
 round(greatest(900-v,0)-greatest(950-v,0)-greatest(v-1050,0)+greatest(v-1100,0),4)+0.0 AS condor, round(greatest(v-900,0)-2*greatest(v-1000,0)+greatest(v-1100,0),4)+0.0 AS butterfly FROM p""")
def finance_payoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payoffs of option strategies at each part's price."""
    v = F.col("v")
    return _part(spark, sf_dir).select(
        "p_partkey", rnd(N.payoff(v, N.bull_call_spread(950, 1050))).alias("spread"), rnd(N.payoff(v, N.straddle(1000))).alias("straddle"),
        (rnd(N.payoff(v, N.iron_condor(900, 950, 1050, 1100))) + 0.0).alias("condor"), (rnd(N.payoff(v, N.butterfly(900, 1000, 1100))) + 0.0).alias("butterfly"))


@query(f"""WITH {_P}, c AS (SELECT exp(0.2*sqrt(1/100.0)) AS u, (exp(0.02/100.0)-1/exp(0.2*sqrt(1/100.0)))/(exp(0.2*sqrt(1/100.0))-1/exp(0.2*sqrt(1/100.0))) AS q), g AS (SELECT i, exp(lgamma(101)-lgamma(i+1)-lgamma(101-i)+i*ln(q)+(100-i)*ln(1-q)) AS w, pow(u,2*i-100) AS m FROM generate_series(0,100) t(i), c)
 SELECT p_partkey, round(exp(-0.02)*sum(w*greatest(v*m-1000,0)),4) AS call FROM p, g GROUP BY 1""")
def finance_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call on every part's price on a binomial tree."""
    return _part(spark, sf_dir).select("p_partkey", rnd(N.binomial_call(F.col("v"), F.lit(1000.0), 1.0, 0.02, 0.2)).alias("call"))


@query(f"""WITH {_P}, a AS (SELECT *, s AS a0, 10.0 AS a1, 20.0 AS a2, v/100 AS a3, v/80 AS b0, s AS b1, 15.0 AS b2, 12.0 AS b3 FROM p), m AS (SELECT *, (b3-b2)/nullif(b0-b1-b2+b3,0) AS pr, (a3-a1)/nullif(a0-a1-a2+a3,0) AS qr FROM a)
 SELECT p_partkey, concat_ws(',', CASE WHEN a0>=a2 AND b0>=b1 THEN '00' END, CASE WHEN a1>=a3 AND b1>=b0 THEN '01' END, CASE WHEN a2>=a0 AND b2>=b3 THEN '10' END, CASE WHEN a3>=a1 AND b3>=b2 THEN '11' END) AS pure,
 round(CASE WHEN pr BETWEEN 0 AND 1 AND qr BETWEEN 0 AND 1 THEN pr END,6)+0.0 AS mixed_row, round(CASE WHEN pr BETWEEN 0 AND 1 AND qr BETWEEN 0 AND 1 THEN qr END,6)+0.0 AS mixed_column FROM m""")
def game_equilibria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pure and mixed equilibria of a game of each part."""
    s, v = F.col("s"), F.col("v")
    a, b = (s, F.lit(10.0), F.lit(20.0), v / 100), (v / 80, s, F.lit(15.0), F.lit(12.0))
    mixed = N.mixed_equilibrium(a, b)
    return _part(spark, sf_dir).select(
        "p_partkey", F.array_join(N.pure_equilibria(a, b), ",").alias("pure"), (rnd(mixed["row"], 6) + 0.0).alias("mixed_row"), (rnd(mixed["column"], 6) + 0.0).alias("mixed_column"))


@query(f"""WITH {_P}, q AS (SELECT p_partkey, v, s, greatest(0.0,(v-2*s*10+s*12)/(3*2.0)) AS q1, greatest(0.0,(v-2*s*12+s*10)/(3*2.0)) AS q2 FROM p)
 SELECT p_partkey, round(q1,4) AS q1, round(q2,4) AS q2, round(v-2*(q1+q2),4) AS price, round((v-2*(q1+q2)-s*10)*q1,6)+0.0 AS profit1, round((v-2*(q1+q2)-s*12)*q2,6)+0.0 AS profit2, round(pow(q1/(q1+q2),2)+pow(q2/(q1+q2),2),6) AS concentration FROM q""")
def game_duopoly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two producers of each part."""
    c = N.cournot(F.col("v"), F.lit(2.0), F.col("s") * 10, F.col("s") * 12)
    return _part(spark, sf_dir).select(
        "p_partkey", *(rnd(c[k]).alias(k) for k in ("q1", "q2", "price")), *((rnd(c[k], 6) + 0.0).alias(k) for k in ("profit1", "profit2")), rnd(c["concentration"], 6).alias("concentration"))


@query("""WITH r AS (SELECT l_partkey, l_suppkey, l_extendedprice AS bid, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_suppkey) AS k FROM lineitem)
 SELECT l_partkey, max(l_suppkey) FILTER (k=1) AS winner, greatest(coalesce(max(bid) FILTER (k=2),20000.0),20000.0) AS price FROM r WHERE k<=2 GROUP BY 1 HAVING max(bid)>=20000""")
def game_auction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers bid for each part; the second price is paid."""
    return N.second_price(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey", "l_extendedprice", 20000.0)


@query("SELECT l_suppkey, round(avg(l_extendedprice),4) AS value FROM lineitem GROUP BY 1")
def game_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of suppliers in an additive game."""
    return N.shares_of_worth(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice").select("l_suppkey", rnd("value").alias("value"))


@query(f"""WITH {_P} SELECT p_partkey, round(s+0.3*(v/50-s),6) AS low, round(v-0.3*(v-v/50),6) AS high, round(s-4,6)+0.0 AS sum_low, round(v/50+2,6) AS sum_peak, round(v+6,6) AS sum_high, round(s-6,6)+0.0 AS diff_low, round(v+5-0,6) AS diff_high,
 round(least(-4*s,6*s,-4*v,6*v),6)+0.0 AS product_low, round(v/50*2,6) AS product_peak, round(greatest(-4*s,6*s,-4*v,6*v),6) AS product_high, round((s+v/50+v)/3,6) AS centroid FROM p""")
def fuzzy_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, sums, differences, products and centroids of fuzzy numbers."""
    s, v = F.col("s"), F.col("v")
    x, y = (s, v / 50, v), (F.lit(-4.0), F.lit(2.0), F.lit(6.0))
    cut, total, product = N.fuzzy_cut(*x, 0.3), N.fuzzy_sum(x, y), N.fuzzy_product(x, y)
    less = N.fuzzy_difference(x, (F.lit(-5.0), F.lit(2.0), F.lit(6.0)))
    return _part(spark, sf_dir).select(
        "p_partkey", rnd(cut["low"], 6).alias("low"), rnd(cut["high"], 6).alias("high"), (rnd(total[0], 6) + 0.0).alias("sum_low"), rnd(total[1], 6).alias("sum_peak"), rnd(total[2], 6).alias("sum_high"),
        (rnd(less[0], 6) + 0.0).alias("diff_low"), rnd(less[2], 6).alias("diff_high"), (rnd(product[0], 6) + 0.0).alias("product_low"), rnd(product[1], 6).alias("product_peak"), rnd(product[2], 6).alias("product_high"),
        rnd(N.fuzzy_centroid(x), 6).alias("centroid"))


@query(f"""WITH {_P}, k AS (SELECT (1-exp(-0.3*5))/0.3 AS b) SELECT p_partkey, round(1000*exp(-5*exp(-0.1*s)),6) AS adopted, round(1.2*(s/100)+1.4*(s/80)+3.3*(v/20000)+0.6*(v/1000)+v/2000,6) AS z_making,
 round(exp((0.05-0.02*0.02/(2*0.3*0.3))*(b-5)-0.02*0.02*b*b/(4*0.3))*exp(-b*s/1000),6) AS bond FROM p, k""")
def finance_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adoption curve, distress score of makers and bond prices."""
    from strandline.functions import finance as C

    s, v = F.col("s"), F.col("v")
    return _part(spark, sf_dir).select(
        "p_partkey", rnd(C.gompertz(s, 1000.0, 5.0, 0.1), 6).alias("adopted"), rnd(C.altman_z(s / 100, s / 80, v / 20000, v / 1000, v / 2000), 6).alias("z_making"),
        rnd(C.zero_coupon(s / 1000, F.lit(5.0), 0.3, 0.05, 0.02), 6).alias("bond"))


@query()
def finance_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What option strategies cost at each part's price, a year out."""
    from strandline.functions import finance as C

    v, args = F.col("v"), (F.lit(1.0), F.lit(0.02), F.lit(0.2))
    cost = lambda legs: sum((n * (C.call if kind == "call" else C.put)(v, F.lit(float(k)), *args) for kind, k, n in legs), F.lit(0.0))
    named = {"spread": N.bull_call_spread(950, 1050), "straddle": N.straddle(1000), "condor": N.iron_condor(900, 950, 1050, 1100), "butterfly": N.butterfly(900, 1000, 1100)}
    return _part(spark, sf_dir).select("p_partkey", *(rnd(cost(legs), 6).alias(name) for name, legs in named.items()))
