"""Text statistics, ranking and lexicon analysis over tables of documents.

Tables have a key and a text. Tokens are counted per document map-side before
any shuffle, so what moves is one row for each distinct token of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text as T

# Words of feeling and their weight.
LEXICON = {
    "good": 1.0, "better": 1.0, "best": 1.5, "great": 1.5, "calm": 0.8, "calmer": 0.8, "clean": 0.6, "cleaner": 0.6, "clear": 0.6,
    "clearer": 0.6, "reliable": 1.0, "steady": 0.6, "trusted": 0.8, "worth": 0.5, "promise": 0.4, "familiar": 0.3, "fixed": 0.4,
    "fail": -1.0, "failed": -1.0, "noisy": -0.8, "patchy": -0.8, "thin": -0.3, "uneven": -0.6, "disagree": -0.7, "worthless": -1.5,
    "miserable": -1.5, "cautious": -0.2, "late": -0.4, "slowly": -0.3, "empty": -0.4,
}
# Words that turn a feeling round.
NEGATIONS = ("not", "no", "never", "nothing", "hardly", "without")
# Frequent words that mark a language.
MARKERS = {
    "en": ("the", "and", "of", "to", "that", "is", "for", "which"), "de": ("der", "die", "das", "und", "nicht", "für", "mit", "ist"),
    "fr": ("le", "la", "les", "des", "une", "est", "été", "pour"), "es": ("el", "los", "las", "una", "por", "que", "del", "para"),
    "ru": ("и", "в", "не", "на", "что", "как", "это", "по"),
}


def term_counts(docs: DataFrame, key: str, text: str, terms: Column | None = None) -> DataFrame:
    """How often each term is in each document: ``key, term, n``."""
    return docs.select(key, F.explode(T.tokens(F.col(text)) if terms is None else terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def tf_idf(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """The ``k`` terms of most weight in each document: tf * (ln((N + 1) / (df + 1)) + 1)."""
    counts = term_counts(docs, key, text, T.content_tokens(F.col(text)))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    size = counts.groupBy(key).agg(F.sum("n").alias("total"))
    n_docs = docs.agg(F.count("*").alias("n_docs")).withColumn("one", F.lit(1))
    scored = (
        counts.join(df, "term").join(size, key).withColumn("one", F.lit(1)).join(n_docs, "one")
        .withColumn("tfidf", F.round(F.col("n") / F.col("total") * (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1), 6))
    )
    w = Window.partitionBy(key).orderBy(F.desc("tfidf"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "term", "tfidf", "rank")


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Documents by their relevance to the query: ``key, score``, above 0.

    Only terms of the query leave the scan; lengths are kept beside them.
    """
    words = T.tokens(F.col(text))
    sized = docs.select(key, words.alias("w")).select(key, F.size("w").alias("len"), F.filter("w", lambda t: t.isin(*query)).alias("hits"))
    stats = sized.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")).withColumn("one", F.lit(1))
    tf = sized.where(F.size("hits") > 0).select(key, "len", F.explode("hits").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    times = F.create_map(*(x for t in sorted(set(query)) for x in (F.lit(t), F.lit(query.count(t)))))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = times[F.col("term")] * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return tf.join(df, "term").withColumn("one", F.lit(1)).join(stats, "one").groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def char_entropy(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Shannon entropy of each text's characters, in bits: ``key, entropy``."""
    counts = docs.where(F.length(text) > 0).select(key, F.explode(F.split(text, "")).alias("c")).groupBy(key, "c").agg(F.count("*").alias("k"))
    sums = counts.groupBy(key).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log2("k")).alias("s"))
    return sums.select(key, F.round(F.log2("n") - F.col("s") / F.col("n"), 4).alias("entropy"))


def profile(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Counts, diversity and reading grade of each text, in one projection."""
    w, s = F.col("__w"), F.greatest(F.size("__s"), F.lit(1))
    n = F.greatest(F.size("__w"), F.lit(1))
    syl = F.aggregate(F.transform(w, T.syllables), F.lit(0), lambda a, x: a + x)
    return (
        docs.withColumn("__w", T.tokens(F.col(text))).withColumn("__s", T.sentences(F.col(text)))
        .select(
            key, F.length(text).cast("bigint").alias("chars"), F.size("__w").cast("bigint").alias("words"), F.size("__s").cast("bigint").alias("n_sentences"),
            F.round(F.size(F.array_distinct("__w")) / n, 4).alias("diversity"),
            F.round(0.39 * n / s + 11.8 * syl / n - 15.59, 8).alias("grade"))
    )


def detect_language(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The language with most marker words in the text, ``unknown`` below 3;
    Han letters in a third of the text mean zh."""
    words = F.array_distinct(T.tokens(F.col(text)))
    hits = F.array(*(F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, m)))).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, m) in enumerate(MARKERS.items())))
    han = F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", ""))
    best = F.array_max("__h")
    return docs.withColumn("__h", hits).select(key, F.when(han * 3 >= F.length(text), "zh").when(best["n"] >= 3, best["name"]).otherwise("unknown").alias("detected"))


def sentiment(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Polarity and subjectivity by lexicon; a negation within the three words
    before turns a word round by -0.75: ``key, polarity, subjectivity, label``."""
    lexicon = F.create_map(*(x for k, v in sorted(LEXICON.items()) for x in (F.lit(k), F.lit(v))))
    w = F.col("__w")
    weight = F.aggregate(
        F.transform(w, lambda t, i: F.struct(lexicon[t].alias("v"), F.arrays_overlap(
            F.slice(w, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), F.array(*map(F.lit, NEGATIONS))).alias("neg"))),
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            (a["s"] + F.coalesce(x["v"], F.lit(0.0)) * F.when(x["neg"], -0.75).otherwise(1.0)).alias("s"),
            (a["n"] + x["v"].isNotNull().cast("int")).alias("n")))
    n = F.greatest(F.size("__w"), F.lit(1))
    scored = docs.withColumn("__w", T.tokens(F.col(text))).withColumn("__a", weight)
    pol = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("__a.s") / n)), 4)
    return scored.select(
        key, pol.alias("polarity"), F.round(F.least(F.lit(1.0), 3 * F.col("__a.n") / n), 4).alias("subjectivity"),
        F.when(pol > 0.05, "positive").when(pol < -0.05, "negative").otherwise("neutral").alias("label"))


def _best_sentences(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For ``key, s, w`` (sentences and the words of each): ``key, summary``."""
    for batch in batches:
        key, held, words = batch.columns
        if not len(key):
            continue
        per_doc = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(key)), per_doc)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        by_sentence = words.flatten()
        n = pc.list_value_length(by_sentence).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = by_sentence.flatten().dictionary_encode()
        pair = np.repeat(doc, n) * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False)
        _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        upto = np.concatenate([[0], np.cumsum(count[which])])
        end = np.cumsum(n)
        some = np.flatnonzero(n)  # sentences without such words have no score
        score = (upto[end] - upto[end - n])[some] / n[some]
        ranked = some[np.lexsort((place[some], -score, doc[some]))]
        of = doc[ranked]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        best = np.sort(ranked[rank < k])
        docs, chosen = np.unique(doc[best], return_counts=True)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(chosen)]), pa.int32()), held.flatten().take(pa.array(best, pa.int64())))
        yield pa.RecordBatch.from_arrays([key.take(pa.array(docs, pa.int64())), pc.binary_join(lists, ". ")], ["key", "summary"])


def summarise(docs: DataFrame, key: str, text: str, k: int = 3) -> DataFrame:
    """The ``k`` sentences that hold most of the text's frequent words, in
    their order: ``key, summary``. Each row is one text and nothing is shuffled:
    words are counted by text in the worker that reads it."""
    split = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), T.sentences(F.col(text)).alias("s"))
    worded = split.select("key", "s", F.transform("s", T.content_tokens).alias("w"))
    return worded.mapInArrow(lambda batches: _best_sentences(batches, k), f"key {dict(split.dtypes)['key']}, summary string").withColumnRenamed("key", key)


def rake(docs: DataFrame, key: str, text: str, k: int = 10) -> DataFrame:
    """Phrases between stop words, by the sum of their words' degree over
    frequency: ``key, phrase, score``, the ``k`` best of each text."""
    stops = "|".join(T.STOP_WORDS)
    cut = F.split(F.lower(F.col(text)), rf"(?:[^\p{{L}}\p{{N}}_\s'-]|\s+(?:{stops})(?=\s|$)|^(?:{stops})(?=\s)|\n)+")
    phrases = docs.select(key, F.explode(cut).alias("p")).select(key, F.regexp_extract_all("p", F.lit(T.TOKEN), F.lit(0)).alias("w"))
    phrases = phrases.withColumn("w", F.filter("w", lambda t: ~t.isin(*T.STOP_WORDS) & (F.length(t) > 1))).where(F.size("w").between(1, 5))
    words = phrases.select(key, F.size("w").alias("n"), F.explode("w").alias("t")).groupBy(key, "t").agg((F.sum("n") / F.count("*")).alias("ws"))
    named = phrases.withColumn("phrase", F.array_join("w", " ")).dropDuplicates([key, "phrase"])
    scored = named.select(key, "phrase", F.explode("w").alias("t")).join(words, [key, "t"]).groupBy(key, "phrase").agg(F.round(F.sum("ws"), 4).alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "phrase")
    return scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


# Entity patterns in order of priority.
ENTITIES = {
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+", "url": r"https?://\S+", "date": r"\d{4}-\d{2}-\d{2}",
    "percent": r"\d+(?:[.,]\d+)?\s?(?:%|percent|Prozent)", "number": r"\d+(?:[.,]\d+)?",
}


def entities(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Entities by pattern; what a pattern took is gone for the later ones:
    ``key, kind, n``."""
    rest, columns = F.col(text), []
    for kind, pattern in ENTITIES.items():
        columns.append(F.struct(F.lit(kind).alias("kind"), F.regexp_count(rest, F.lit(pattern)).cast("bigint").alias("n")))
        rest = F.regexp_replace(rest, pattern, " ")
    return docs.select(key, F.explode(F.array(*columns)).alias("e")).select(key, "e.kind", "e.n").where("n > 0")


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    cache: dict[str, int] = {}
    shifts = np.arange(64, dtype=np.uint64)
    for pdf in batches:
        out = []
        for t in pdf["text"]:
            t = " ".join(t.lower().split())
            grams = [t[i:i + 3] for i in range(len(t) - 2)]
            if not grams:
                out.append(0)
                continue
            if len(cache) > 300_000:
                cache.clear()
            for g in grams:
                if g not in cache:
                    cache[g] = int.from_bytes(hashlib.md5(g.encode("utf-8", "surrogatepass")).digest()[:8], "little")
            h = np.fromiter((cache[g] for g in grams), np.uint64, len(grams))
            u, n = np.unique(h, return_counts=True)
            votes = (((u[:, None] >> shifts) & np.uint64(1)).astype(np.int64) * 2 - 1).T @ n
            bits = int(((votes >= 0).astype(np.uint64) << shifts).sum())
            out.append(bits - (1 << 64) if bits >= 1 << 63 else bits)
        yield pd.DataFrame({"key": pdf["key"], "simhash": np.array(out, np.int64)})


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """64-bit SimHash over character trigrams: ``key, simhash``."""
    return docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(
        _fingerprints, "key long, simhash long").withColumnRenamed("key", key)


def similarity(a: Column, b: Column) -> Column:
    """1 minus the share of differing bits of two fingerprints."""
    return F.round(1 - F.bit_count(a.bitwiseXOR(b)) / 64, 4)
