"""Queries of the extraction operators, over all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import extraction as X
from strandline.plans.registry import registry
from strandline.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registry(QUERIES, ORACLE)

RULES = [
    X.Rule("headline", "css", "h1"), X.Rule("menu", "xpath", "//nav//li", is_list=True), X.Rule("number", "regex", r"var n=(\d+)", default="0"),
    X.Rule("links", "links", is_list=True, max_items=5), X.Rule("charset", "css", "meta[charset]", attribute="charset"), X.Rule("title", "meta", "title"),
]


@query()
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rules on every page."""
    return X.extract(table(spark, sf_dir, "pages"), RULES)


@query("SELECT page_id, coalesce(nullif(regexp_extract(html,'var n=(\\d+)',1),''),'0') AS number FROM pages WHERE page_id IS NOT NULL")
def extract_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number in a script of every page, through the rule engine."""
    return X.extract(table(spark, sf_dir, "pages"), [X.Rule("number", "regex", r"var n=(\d+)", default="0")]).select("page_id", F.col("field_values")[0].alias("number"))


@query()
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page by category."""
    return X.page_links(table(spark, sf_dir, "pages")).groupBy("page_id", "category").agg(F.count("*").alias("n"))


@query()
def extract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.page_tables(table(spark, sf_dir, "pages"))


_RAW = "string_split(regexp_extract(html,'<title>(.*?)</title>',1),'&#')"
_CODE = "CASE WHEN p LIKE 'x%' THEN '0' || regexp_extract(p,'^(x[0-9a-fA-F]+);',1) ELSE regexp_extract(p,'^([0-9]+);',1) END"
_TITLE = f"array_to_string(list_transform({_RAW}, lambda p, i: CASE WHEN i=1 THEN p ELSE chr(CAST({_CODE} AS INTEGER)) || regexp_replace(p,'^x?[0-9a-fA-F]+;','') END),'')"
_NAMED = dict(zip(
    "quot lt gt nbsp eacute egrave ecirc agrave acirc ccedil icirc iuml ocirc ucirc ugrave auml ouml uuml Auml Ouml Uuml szlig aacute iacute oacute uacute ntilde Eacute Agrave mdash ndash hellip rsquo amp".split(),
    '"<>\u00a0éèêàâçîïôûùäöüÄÖÜßáíóúñÉÀ—–…’&', strict=True))
for _name, _char in _NAMED.items():
    _name = f"&{_name};"
    _TITLE = f"replace({_TITLE},'{_name}','{_char}')"


@query(f"SELECT page_id, 'title' AS name, trim({_TITLE}) AS content FROM pages WHERE page_id IS NOT NULL AND html LIKE '%<title>%'")
def extract_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metadata entry of every page."""
    return X.page_metadata(table(spark, sf_dir, "pages"))


@query("SELECT page_id, CASE WHEN lower(html) LIKE '%captcha%' THEN 'generic' ELSE 'none' END AS challenge FROM pages")
def extract_challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.detect_challenge(F.col("html")).alias("challenge"))


@query("SELECT page_id, url, CASE WHEN regexp_matches(lower(url),'^https?://(?:www\\.)?' || site || '(?:[/?#]|$)') THEN 'internal' ELSE 'external' END AS category FROM pages WHERE url IS NOT NULL AND site IS NOT NULL")
def extract_url_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's address is on its own site."""
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL AND site IS NOT NULL")
    return p.select("page_id", "url", X.category(F.col("url"), F.concat(F.lit("https://"), "site")).alias("category"))
