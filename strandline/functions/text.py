"""Column expressions on strings: the transform chain and tokenisation.

Everything here stays in the JVM. Empty or null input passes through the chain
unchanged, as a transform of nothing is nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"

# Words without content of their own.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can did do does doing down during each few for from further had has have having he her here hers him his how i if in "
    "into is it its itself just me more most my no nor not now of off on once only or other our out over own same she so "
    "some such than that the their them then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with you your"
).split()


def transform(value: Column, operation: str, pattern: str = "", replacement: str = "") -> Column:
    """One step of the chain by name; an unknown name changes nothing."""
    first_int = F.regexp_extract(value, r"-?\d+", 0)
    first_num = F.regexp_extract(value, r"-?\d+(?:\.\d+)?", 0)
    steps = {
        "trim": lambda: F.regexp_replace(value, r"^\s+|\s+$", ""),
        "uppercase": lambda: F.upper(value),
        "lowercase": lambda: F.lower(value),
        "title_case": lambda: F.initcap(value),
        "strip_html": lambda: F.regexp_replace(value, r"<[^>]+>", ""),
        "normalize_spaces": lambda: F.trim(F.regexp_replace(value, r"\s+", " ")),
        "remove_numbers": lambda: F.regexp_replace(value, r"\d+", ""),
        "remove_urls": lambda: F.regexp_replace(value, r"https?://\S+", ""),
        "remove_emails": lambda: F.regexp_replace(value, r"\S+@\S+\.\S+", ""),
        "replace": lambda: F.regexp_replace(value, pattern, replacement),
        "prefix": lambda: F.concat(F.lit(replacement or pattern), value),
        "suffix": lambda: F.concat(value, F.lit(replacement or pattern)),
        "to_int": lambda: F.when(first_int == "", value).otherwise(first_int),
        "to_float": lambda: F.when(first_num == "", value).otherwise(first_num),
        "extract": lambda: F.coalesce(F.nullif(F.regexp_extract(value, pattern, 0), F.lit("")), value),
    }
    step = steps.get(operation)
    return value if step is None else F.when(F.coalesce(value, F.lit("")) == "", value).otherwise(step())


def transform_chain(value: Column, steps: Sequence[tuple]) -> Column:
    """Transforms applied left to right in one projection."""
    return reduce(lambda v, s: transform(v, *s), steps, value)


def tokens(text: Column) -> Column:
    """Lower-case word tokens; accented letters belong to words."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Tokens longer than one character that are no stop words."""
    return F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+\s*|\n"), lambda s: F.trim(s)), lambda s: F.length(s) > 2)


def syllables(word: Column) -> Column:
    """Heuristic syllables: short words one; endings es, ed, e dropped; then
    groups of one or two vowels."""
    stem = F.regexp_replace(word, r"(?:es|ed|e)$", "")
    return F.when(F.length(word) <= 3, F.lit(1)).otherwise(F.greatest(F.lit(1), F.regexp_count(stem, F.lit(r"[aeiouy]{1,2}"))))
