"""Queries of the text operators, over all documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import textstats as S
from strandline.plans.registry import registry
from strandline.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registry(QUERIES, ORACLE)

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_STOP = ",".join(f"'{w}'" for w in T.STOP_WORDS)
_CONTENT = f"list_filter({_TOK}, lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t))"
_QUERY = ["rolling", "beta", "spread", "admissions"]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_CONTENT})  AS term FROM documents) GROUP BY 1")
def text_word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content words and the documents that hold them."""
    counts = S.term_counts(docs(spark, sf_dir), "doc_id", "text", T.content_tokens(F.col("text")))
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


@query(f"""WITH c AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_CONTENT}) AS term FROM documents) GROUP BY 1,2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), z AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY 1), k AS (SELECT count(*) AS n_docs FROM documents),
 s AS (SELECT doc_id, term, round(n/total*(ln((n_docs+1)/(df+1))+1),6) AS tfidf FROM c JOIN d USING(term) JOIN z USING(doc_id) CROSS JOIN k)
 SELECT doc_id, term, tfidf, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS rank FROM s) WHERE rank<=10""")
def text_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten terms of most weight in each document."""
    return S.tf_idf(docs(spark, sf_dir), "doc_id", "text", 10)


@query(f"""WITH z AS (SELECT doc_id, {_TOK} AS w FROM documents), s AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM z), t AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM z) WHERE term IN ('rolling','beta','spread','admissions') GROUP BY 1,2,3), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1)
 SELECT doc_id, round(sum(ln((n_docs-df+0.5)/(df+0.5)+1)*tf*2.5/(tf+1.5*(1-0.75+0.75*len/avg_len))),6) AS score FROM t JOIN d USING(term) CROSS JOIN s GROUP BY 1 HAVING round(sum(ln((n_docs-df+0.5)/(df+0.5)+1)*tf*2.5/(tf+1.5*(1-0.75+0.75*len/avg_len))),6) > 0""")
def text_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by relevance to a query."""
    return S.bm25(docs(spark, sf_dir), "doc_id", "text", _QUERY)


@query("""WITH c AS (SELECT doc_id, c, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text,'')) AS c FROM documents WHERE length(text)>0) GROUP BY 1,2), t AS (SELECT doc_id, sum(k) AS n FROM c GROUP BY 1)
 SELECT doc_id, round(log2(max(n)) - sum(k*log2(k))/max(n),4) AS entropy FROM c JOIN t USING(doc_id) GROUP BY 1""")
def text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character entropy of each document."""
    return S.char_entropy(docs(spark, sf_dir), "doc_id", "text")


@query(f"""WITH z AS (SELECT doc_id, length(text) AS chars, {_TOK} AS w, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\\s*|\\n'), lambda s: trim(s)), lambda s: length(s)>2) AS s FROM documents),
 y AS (SELECT *, list_sum(list_transform(w, lambda x: CASE WHEN length(x)<=3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(x,'(?:es|ed|e)$',''),'[aeiouy]{{1,2}}'))) END)) AS syl FROM z)
 SELECT doc_id, chars, CAST(len(w) AS BIGINT) AS words, CAST(len(s) AS BIGINT) AS n_sentences, round(len(list_distinct(w))/greatest(len(w),1),4) AS diversity, round(0.39*greatest(len(w),1)/greatest(len(s),1)+11.8*coalesce(syl,0)/greatest(len(w),1)-15.59,8) AS grade FROM y""")
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, diversity and reading grade."""
    return S.profile(docs(spark, sf_dir), "doc_id", "text")


def _language_sql() -> str:
    hits = ", ".join(
        f"struct_pack(n := len(list_intersect(w, [{','.join(repr(x) for x in m)}])), o := {-i}, name := '{k}')" for i, (k, m) in enumerate(S.MARKERS.items()))
    return f"""WITH z AS (SELECT doc_id, text, list_distinct({_TOK}) AS w FROM documents), h AS (SELECT doc_id, text, list_max([{hits}]) AS best FROM z)
 SELECT doc_id, CASE WHEN length(regexp_replace(text,'[^\\x{{4e00}}-\\x{{9fff}}]','','g'))*3 >= length(text) THEN 'zh' WHEN best.n>=3 THEN best.name ELSE 'unknown' END AS detected FROM h"""


@query(_language_sql())
def text_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by marker words."""
    return S.detect_language(docs(spark, sf_dir), "doc_id", "text")


def _sentiment_sql() -> str:
    lex = ",".join(f"('{k}',{v})" for k, v in sorted(S.LEXICON.items()))
    neg = ",".join(f"'{x}'" for x in S.NEGATIONS)
    return f"""WITH l AS (SELECT * FROM (VALUES {lex}) t(term,v)), z AS (SELECT doc_id, {_TOK} AS w FROM documents), e AS (SELECT doc_id, len(w) AS n, unnest(w) AS term, unnest(range(len(w))) AS i, w FROM z),
 h AS (SELECT doc_id, sum(CAST(v AS DOUBLE)*CASE WHEN list_has_any(w[greatest(i-2,1):i], [{neg}]) THEN -0.75 ELSE 1.0 END) AS s, count(*) AS hits FROM e JOIN l USING(term) GROUP BY 1),
 r AS (SELECT doc_id, round(greatest(-1.0,least(1.0,coalesce(s,0.0)/greatest(len(w),1))),4)+0.0 AS polarity, round(least(1.0,3*coalesce(hits,0)/greatest(len(w),1)),4) AS subjectivity FROM z LEFT JOIN h USING(doc_id))
 SELECT *, CASE WHEN polarity>0.05 THEN 'positive' WHEN polarity<-0.05 THEN 'negative' ELSE 'neutral' END AS label FROM r"""


@query(_sentiment_sql())
def text_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon sentiment with negation."""
    return S.sentiment(docs(spark, sf_dir), "doc_id", "text")


@query()
def text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sentences of each document."""
    return S.summarise(docs(spark, sf_dir), "doc_id", "text")


@query()
def text_rake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten key phrases of each document."""
    return S.rake(docs(spark, sf_dir), "doc_id", "text")


def _entity_sql() -> str:
    rest, parts = "text", []
    for kind, p in S.ENTITIES.items():
        q = p.replace("'", "''")
        parts.append(f"SELECT doc_id, '{kind}' AS kind, CAST(len(regexp_extract_all({rest}, '{q}')) AS BIGINT) AS n FROM documents")
        rest = f"regexp_replace({rest}, '{q}', ' ', 'g')"
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


@query(_entity_sql())
def text_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by pattern."""
    return S.entities(docs(spark, sf_dir), "doc_id", "text")


@query()
def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of each document."""
    return S.fingerprints(docs(spark, sf_dir), "doc_id", "text")


@query("SELECT doc_id, lower(trim(regexp_replace(regexp_replace(title,'\\d+','','g'),'\\s+',' ','g'))) || ' !' AS shown FROM documents WHERE title IS NOT NULL AND title <> ''")
def text_transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of transforms in one projection."""
    shown = T.transform_chain(F.col("title"), [("remove_numbers",), ("normalize_spaces",), ("lowercase",), ("suffix", "", " !")])
    return docs(spark, sf_dir).where("title IS NOT NULL AND title <> ''").select("doc_id", shown.alias("shown"))
