"""Queries of matching, ranking of records, page hints and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import fuzzy as Z
from strandline.functions import match as M
from strandline.operators import extraction as X
from strandline.plans.registry import registry, rnd
from strandline.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registry(QUERIES, ORACLE)


@query("""WITH w AS (SELECT p_partkey, lower(p_name) AS h, unnest(generate_series(1, greatest(length(p_name)-4+1,1))) AS i FROM part) SELECT p_partkey, round(CASE WHEN contains(any_value(h),'rign') THEN 1.0 ELSE max(1-levenshtein(substr(h,i,4),'rign')/4.0) END,6) AS score FROM w GROUP BY 1""")
def fuzzy_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How nearly a misspelt word stands in each part's name."""
    return table(spark, sf_dir, "part").select("p_partkey", rnd(M.contains(F.col("p_name"), F.lit("rign")), 6).alias("score"))


_CLASSES = {"admissions": ("admission", "university", "score", "major"), "series": ("volatility", "closing", "hedge", "return"), "design": ("icon", "padding", "palette", "font"), "crawl": ("selector", "scheduler", "link", "page")}


@query("WITH s AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS class, ({'+'.join(f'CAST(coalesce(contains(lower(text),{chr(39)}{k}{chr(39)}),false) AS INT)' for k in ks)})/{len(ks)}.0 AS score FROM documents" for c, ks in _CLASSES.items()) + ") SELECT doc_id, class, round(score,6) AS score FROM s WHERE score>0")
def fuzzy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of documents by their keywords."""
    return M.classify(table(spark, sf_dir, "documents"), "doc_id", "text", _CLASSES).select("doc_id", "class", rnd("score", 6).alias("score"))


@query("""WITH s AS (SELECT page_id, row_number() OVER () AS k, (CAST(coalesce(trim(url),'')<>'' AS INT)+CAST(coalesce(trim(title),'')<>'' AS INT)+CAST(coalesce(trim(published_time),'')<>'' AS INT))/3.0 AS c, (CAST(coalesce(url LIKE 'http%',false) AS INT)+CAST(coalesce(code=200,false) AS INT))/2.0 AS r FROM pages) SELECT round(c,6) AS complete, r AS consistent, count(*) AS n FROM s GROUP BY 1,2""")
def fuzzy_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by completeness and kept rules."""
    p = table(spark, sf_dir, "pages").select(
        rnd(M.completeness(("url", "title", "published_time")), 6).alias("complete"), M.consistency([F.col("url").startswith("http"), F.col("code") == 200]).alias("consistent"))
    return p.groupBy("complete", "consistent").agg(F.count("*").alias("n"))


@query()
def fuzzy_overall_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grade of each page from both scores, by fuzzy rules."""
    p = table(spark, sf_dir, "pages").select(
        "page_id", (M.completeness(("url", "title", "published_time")) * 100).alias("c"), (M.consistency([F.col("url").startswith("http"), F.col("code") == 200]) * 100).alias("r"))
    c, r = F.col("c"), F.col("r")
    low, high = (lambda x: Z.trapezoidal(x, -2.0, -1.0, 40.0, 70.0)), (lambda x: Z.trapezoidal(x, 50.0, 80.0, 101.0, 102.0))
    grade = Z.mamdani([(Z.fuzzy_and(high(c), high(r)), (60.0, 90.0, 100.0)), (Z.fuzzy_or(low(c), low(r)), (0.0, 10.0, 50.0)), (Z.fuzzy_and(high(c), low(r)), (30.0, 50.0, 70.0))], 0.0, 100.0)
    graded = p.select("c", "r").distinct().withColumn("grade", rnd(grade))
    return p.join(graded, ["c", "r"]).select("page_id", "grade")


@query("SELECT p_partkey, round(1-CASE WHEN p_size<=5 OR p_size>=45 THEN 0.0 WHEN p_size<25 THEN (p_size-5)/20 ELSE (45-p_size)/20 END,6) AS outside, (CASE WHEN p_size<=5 OR p_size>=45 THEN 0.0 WHEN p_size<25 THEN (p_size-5)/20 ELSE (45-p_size)/20 END)>=0.5 AS in_cut FROM part")
def fuzzy_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complement of a fuzzy set and its cut at one half."""
    grade = Z.triangular(F.col("p_size").cast("double"), 5, 25, 45)
    return table(spark, sf_dir, "part").select("p_partkey", rnd(1 - grade, 6).alias("outside"), (grade >= 0.5).alias("in_cut"))


# ------------------------------------------------------------- small reports


@query("SELECT site, count(*) AS n, round(avg(CASE WHEN code=200 THEN 1.0 ELSE 0.0 END),6) AS rate, arg_min(page_id, struct_pack(a := tokens, b := page_id)) AS fastest FROM pages WHERE tokens IS NOT NULL GROUP BY 1")
def rel_pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, rate of success and cheapest page of each site."""
    return table(spark, sf_dir, "pages").where("tokens IS NOT NULL").groupBy("site").agg(
        F.count("*").alias("n"), rnd(F.avg(F.coalesce(F.col("code") == 200, F.lit(False)).cast("double")), 6).alias("rate"), F.min_by("page_id", F.struct("tokens", "page_id")).alias("fastest"))


@query("SELECT doc_id, epoch_us(crawled_at) AS crawled_us FROM (SELECT doc_id, crawled_at, row_number() OVER (ORDER BY crawled_at DESC, doc_id) AS k FROM documents WHERE crawled_at IS NOT NULL) WHERE k<=200")
def rel_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 entries, which a history keeps."""
    return table(spark, sf_dir, "documents").where("crawled_at IS NOT NULL").orderBy(F.desc("crawled_at"), "doc_id").limit(200).select("doc_id", F.unix_micros("crawled_at").alias("crawled_us"))


@query("WITH v AS (SELECT name, unnest(field_values) AS v FROM extracted) SELECT name, count(*) AS n, count(*) FILTER (regexp_matches(v,'#(REF|DIV/0|N/A|VALUE|NAME|NUM|NULL)')) AS errors, count(*) FILTER (trim(v) IN ('0','0.0')) AS zeros, count(*) FILTER (trim(v)='') AS blanks FROM v GROUP BY 1")
def quality_cell_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error marks, zeros and blanks in the values of each field."""
    v = table(spark, sf_dir, "extracted").select("name", F.explode("field_values").alias("v"))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return v.groupBy("name").agg(
        F.count("*").alias("n"), count(F.col("v").rlike("#(REF|DIV/0|N/A|VALUE|NAME|NUM|NULL)")).alias("errors"), count(F.trim("v").isin("0", "0.0")).alias("zeros"), count(F.trim("v") == "").alias("blanks"))


@query("WITH m AS (SELECT doc_id, regexp_extract_all(text,'(?:19|20)[0-9]{2}') AS ys FROM documents), u AS (SELECT doc_id, unnest(ys) AS year, generate_subscripts(ys,1)-1 AS pos FROM m) SELECT doc_id, CAST(pos AS INT) AS pos, year FROM u")
def text_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years named in documents, in order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?:19|20)[0-9]{2}"), F.lit(0))).alias("pos", "year"))


@query("WITH t AS (SELECT doc_id, source, trim(lower(split_part(title,':',1))) AS topic FROM documents WHERE title IS NOT NULL), d AS (SELECT source, topic, min(doc_id) AS first FROM t WHERE topic<>'' AND length(topic)<=80 GROUP BY 1,2) SELECT source, topic FROM (SELECT source, topic, row_number() OVER (PARTITION BY source ORDER BY first, topic) AS k FROM d) WHERE k<=5")
def text_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five topics of each source's titles."""
    from strandline.operators import relational as R

    d = table(spark, sf_dir, "documents").where("title IS NOT NULL").select("source", "doc_id", F.trim(F.lower(F.split_part("title", F.lit(":"), F.lit(1)))).alias("topic"))
    first = d.where((F.col("topic") != "") & (F.length("topic") <= 80)).groupBy("source", "topic").agg(F.min("doc_id").alias("first"))
    return R.top_k(first, ["source"], [F.col("first"), F.col("topic")], 5).select("source", "topic")


@query("SELECT lower(title) AS name, count(DISTINCT title) AS forms, min(title) AS one FROM documents WHERE title IS NOT NULL GROUP BY 1 HAVING count(DISTINCT title)>1")
def text_name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that differ only in case."""
    d = table(spark, sf_dir, "documents").where("title IS NOT NULL").select(F.lower("title").alias("name"), "title").distinct()
    return d.groupBy("name").agg(F.count("*").alias("forms"), F.min("title").alias("one")).where("forms > 1")


@query("SELECT doc_id, title FROM documents WHERE coalesce(trim(title),'')<>''")
def rel_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a title, two columns."""
    return table(spark, sf_dir, "documents").where("coalesce(trim(title), '') <> ''").select("doc_id", "title")


_DOMAINS = {"chart": ("chart", "graph", "data"), "arrow": ("arrow", "direction", "move"), "user": ("user", "account", "person")}


@query("WITH s AS (SELECT icon_no, " + ", ".join(f"({'+'.join(f'CAST(contains(t,{chr(39)}{k}{chr(39)}) AS INT)' for k in ks)}) AS {d}" for d, ks in _DOMAINS.items()) + " FROM (SELECT icon_no, lower(concat_ws(' ',icon_name,keywords,usage_text)) AS t FROM icons)) SELECT icon_no, CASE WHEN chart>0 AND chart>=arrow AND chart>=\"user\" THEN 'chart' WHEN arrow>0 AND arrow>=\"user\" THEN 'arrow' WHEN \"user\">0 THEN 'user' ELSE 'style' END AS domain FROM s")
def text_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of each icon by the keywords it holds."""
    t = F.lower(F.concat_ws(" ", "icon_name", "keywords", "usage_text"))
    hits = [F.struct(sum((F.contains(t, F.lit(k)).cast("int") for k in ks), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, (d, ks) in enumerate(_DOMAINS.items())]
    best = F.array_max(F.array(*hits))
    return table(spark, sf_dir, "icons").select("icon_no", F.when(best["n"] > 0, best["d"]).otherwise("style").alias("domain"))


@query()
def text_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document beside the last before it with the same title."""
    from strandline.operators import ordered

    d = table(spark, sf_dir, "documents").where("title IS NOT NULL AND text IS NOT NULL").select("doc_id", "title", "text", "lang")
    pairs = ordered.looking_back(d, ["title"], ["doc_id"], 1, {"other": lambda w: F.lag("text").over(w), "other_lang": lambda w: F.lag("lang").over(w), "other_id": lambda w: F.lag("doc_id").over(w)}).where("other_id IS NOT NULL")
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    both = F.size(F.array_intersect(words("text"), words("other")))
    return pairs.select(
        "doc_id", "other_id", rnd(both / F.greatest(F.size(F.array_union(words("text"), words("other"))), F.lit(1)), 6).alias("overlap"), F.equal_null("lang", "other_lang").alias("same_lang"),
        rnd(F.least(F.length("text"), F.length("other")) / F.greatest(F.length("text"), F.length("other"), F.lit(1)), 6).alias("length_ratio"))


@query()
def extract_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that would find something on each page, with a sample."""
    return X.suggest_rules(table(spark, sf_dir, "pages"))


