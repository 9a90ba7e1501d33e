"""Several values packed in one field, split into one row per item.

A field is cut into tokens: every delimiter, quote mark and blank is a token of
its own, every other stretch of characters is one token. Masking the ordinary
tokens gives the field's *skeleton*. Which tokens form an item depends on the
skeleton alone, so the rule is resolved once for each distinct skeleton and
then joined back; the items are cut out by position, inside the JVM. Fields
without any such character need no rule and skip the join. The rule table is
small beside the data; whether it is broadcast is left to the optimiser, which
knows its size at run time and splits a skewed skeleton otherwise.

Rules:

* delimiters are comma, semicolon, vertical bar, slash (ordinary and
  full-width), the enumeration comma, tab and line ends;
* a quote mark opens at the start of an item only and closes before a
  delimiter, a blank or the end; nothing inside it divides;
* plain blanks divide only where no delimiter stands outside the quotes; other
  kinds of space are trimmed but never divide;
* a JSON array of strings holds its elements;
* outer blanks and enclosing quotes are removed, empty pieces take no position,
  repeated items stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters with a part in splitting.
DELIMITERS = ",，、;；|｜/／\t\n\r"
BLANKS = " \u00a0\u2002\u2003\u2007\u2009\u202f\u3000"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』", "«": "»", "＂": "＂"}

SPECIAL = DELIMITERS + BLANKS + "".join(dict.fromkeys("".join(k + v for k, v in QUOTES.items())))
_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in SPECIAL)
TOKEN = f"[{_CLASS}]|[^{_CLASS}]+"
ORDINARY = f"[^{_CLASS}]+"
MASK = "w"


def resolve(skeleton: str) -> list[tuple[int, int]]:
    """First token and number of tokens of each item of a skeleton.

    A skeleton has one character for each token. An empty one has no items.
    """
    n = len(skeleton)
    edge = lambda i: i >= n or skeleton[i] in DELIMITERS or skeleton[i] in BLANKS
    quoted: dict[int, int] = {}
    strong, i, fresh = False, 0, True
    while i < n:
        c = skeleton[i]
        if fresh and c in QUOTES:
            close = next((j for j in range(i + 1, n) if skeleton[j] == QUOTES[c] and edge(j + 1)), None)
            if close is not None:
                quoted[i] = close
                i, fresh = close + 1, False
                continue
        strong |= c in DELIMITERS
        fresh = c in DELIMITERS or c in BLANKS
        i += 1
    divides = DELIMITERS if strong else " "
    pieces, start, i = [], 0, 0
    while i <= n:
        if i in quoted:
            i = quoted[i] + 1
            continue
        if i == n or skeleton[i] in divides:
            pieces.append((start, i))
            start = i + 1
        i += 1
    items = []
    for a, b in pieces:
        a, b = _trim(skeleton, a, b)
        if a < b and quoted.get(a) == b - 1:
            a, b = _trim(skeleton, a + 1, b - 1)
        if a < b:
            items.append((a, b - a))
    return items


def _trim(skeleton: str, a: int, b: int) -> tuple[int, int]:
    while a < b and skeleton[a] in BLANKS:
        a += 1
    while a < b and skeleton[b - 1] in BLANKS:
        b -= 1
    return a, b


def _resolve_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        spans = [resolve(s) for s in pdf["skeleton"]]
        yield pd.DataFrame({
            "skeleton": pdf["skeleton"],
            "spans": [[{"at": a + 1, "n": k} for a, k in s] for s in spans],
        })


def skeleton(value: Column) -> Column:
    """One character for each token of a field."""
    return F.regexp_replace(value, ORDINARY, MASK)


def rules(skeletons: DataFrame) -> DataFrame:
    """The splitting rule of each distinct ``skeleton``."""
    return skeletons.select("skeleton").distinct().mapInPandas(
        _resolve_all, "skeleton string, spans array<struct<at:int,n:int>>"
    )


def split_packed(df: DataFrame, origin: str, id_col: str, value_col: str) -> DataFrame:
    """One row per item of ``value_col``: ``origin, row_key, pos, item``.

    Null keys and null, empty or blank fields give no rows; repeated records
    give their rows once; other columns of ``df`` are ignored.
    """
    fields = (
        df.select(F.col(id_col).cast("long").alias("row_key"), F.col(value_col).alias("value"))
        .where(F.col("row_key").isNotNull() & F.col("value").isNotNull())
        .withColumn("listed", F.when(F.col("value").rlike(r"^\s*\[(?s:.*)\]\s*$"), F.from_json("value", "array<string>")))
        .withColumn("skeleton", F.when(F.col("listed").isNull(), skeleton(F.col("value"))))
    )
    plain = fields.where(F.col("skeleton") == MASK).select(
        "row_key", F.array(F.col("value")).alias("items"))
    listed = fields.where(F.col("listed").isNotNull()).select(
        "row_key", F.transform("listed", lambda x: F.trim(x)).alias("items"))
    ruled = fields.where(F.col("skeleton") != MASK)
    spans = rules(ruled)
    cut = (
        ruled.join(spans, "skeleton")
        .withColumn("tokens", F.regexp_extract_all("value", F.lit(TOKEN), F.lit(0)))
        .select("row_key", F.transform(
            "spans", lambda s: F.array_join(F.slice(F.col("tokens"), s["at"], s["n"]), "")).alias("items"))
    )
    kept = F.filter("items", lambda x: x.isNotNull() & (x != ""))
    return (
        plain.unionByName(listed).unionByName(cut)
        .select("row_key", F.posexplode(kept).alias("pos", "item"))
        .select(F.lit(origin).alias("origin"), "row_key", F.col("pos").cast("int").alias("pos"), "item")
        .distinct()
    )
