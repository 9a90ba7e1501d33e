"""Text that looks like other text but is made of other characters.

Two kinds of repair lead to one form:

* forms of a character: invisible characters go, unusual spaces become a
  space, accents join their letter, full- and half-width letters and digits,
  ligatures, radicals and other compatibility forms become the ordinary
  character. Superscripts, subscripts, circled digits, full-width punctuation,
  emoji sequences and accents that have no joined form stay;
* letters of another alphabet, by script-aware repair: a token's dominant
  script is that of its letters which look like no letter of the token's other
  scripts or, without such letters, of most of its letters. Its other letters
  are replaced by their look-alikes in that script, in tokens of mixed script
  only, and only where the result is a word of the corpus; of two words the one
  that comes more often, then the one of the dominant script. A token made wholly
  of look-alikes is read as Latin on the same condition, but only in a value
  with no other letter of its script.

Every substitution needs a witness, however long the token. The witnesses are
counted over the whole corpus for the candidate tokens only, by a join, so no
vocabulary has to fit anywhere. Values read under a wrong encoding are left
out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.mojibake import PairModel, corpus_counts, repaired
from strandline.session import settle

INVISIBLE = r"\u00ad\u200b\u200c\u200e\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff\u180e\u034f"
SPACES = r"\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_SPACES = re.compile(f"[{SPACES}]")
_JOINER = re.compile("(?<![\u2600-\u27bf\u2b00-\u2bff\ufe0f\U0001f000-\U0001faff])\u200d|\u200d(?![\u2600-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff])")

# Letters of other alphabets and the Latin letters they look like.
ALIKE = {
    "CYRILLIC": dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјкорсухһԁԛԝѵ", "ABESIJKMHOPCTYXaesijkopcyxhdqwv", strict=True)),
    "GREEK": dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχϲϳ", "ABEZHIKMNOPTYXaikvopuxcj", strict=True)),
    "ARMENIAN": dict(zip("օսհոցզյԼՕՏ", "ouhngqjLOS", strict=True)),
    "CHEROKEE": dict(zip("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ", strict=True)),
    "PHONETIC": dict(zip("ɑɡɩᴄᴏᴠᴡᴢꜱ", "agicovwzs", strict=True)),
}
LOOKALIKES = {c: latin for letters in ALIKE.values() for c, latin in letters.items()}

_RANGES = {
    "LATIN": "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff", "CYRILLIC": "\u0400-\u052f", "GREEK": "\u0370-\u03ff",
    "ARMENIAN": "\u0530-\u058f", "CHEROKEE": "\u13a0-\u13ff", "PHONETIC": "\u0250-\u02af\u1d00-\u1d7f\ua731",
}
_LETTERS = {script: re.compile(f"[{r}]") for script, r in _RANGES.items()}
_FOREIGN = re.compile("[" + "".join(r for script, r in _RANGES.items() if script != "LATIN") + "]")
_TOKEN = re.compile(r"[^\W_]+")
#: Occurrences that make a word a witness, for tokens of mixed script and for tokens wholly of look-alikes.
WITNESSES, WITNESSES_WHOLE = 1, 2
KEPT_TAGS = ("<super>", "<sub>", "<circle>", "<vertical>", "<fraction>", "<square>", "<small>")


def _form(char: str) -> str:
    """The ordinary form of one character."""
    if char.isascii():
        return char
    tag = unicodedata.decomposition(char)
    if not tag or tag.startswith(KEPT_TAGS):
        return char
    if not tag.startswith("<"):
        return unicodedata.normalize("NFC", char)
    plain = unicodedata.normalize("NFKC", char)
    # Full-width punctuation, spacing accents and the ellipsis are themselves.
    return plain if plain[:1] != " " and all(unicodedata.category(c)[0] in "LN" for c in plain) else char


def plain_form(text: str) -> str:
    """The text with ordinary forms of its characters."""
    if text.isascii():
        return text
    out = _JOINER.sub("", _INVISIBLE.sub("", text))
    out = _SPACES.sub(" ", out)
    if not unicodedata.is_normalized("NFKC", out):
        out = unicodedata.normalize("NFC", "".join(map(_form, out)))
    return out


def _script(char: str) -> str | None:
    return next((script for script, letters in _LETTERS.items() if letters.match(char)), None)


#: Letters of one script as letters of another, by way of the Latin letter.
_TURN: dict[tuple[str, str], dict[str, str]] = {}
for _one, _own in ALIKE.items():
    _TURN[_one, "LATIN"] = _own
    _TURN["LATIN", _one] = {latin: c for c, latin in reversed(_own.items())}
for _one in ALIKE:
    for _other in ALIKE:
        if _one != _other:
            _TURN[_one, _other] = {c: _TURN["LATIN", _other][latin] for c, latin in ALIKE[_one].items() if latin in _TURN["LATIN", _other]}


def readings(token: str) -> list[str]:
    """What a token with letters of several scripts may be, its dominant
    script first: all its letters in one of them."""
    scripts = [_script(c) for c in token]
    held = Counter(s for s in scripts if s)
    if len(held) < 2:
        return []
    out = []
    # A letter that no other script of the token has decides by itself: without it there is no reading.
    for script in sorted(held, key=lambda s: (-held[s], s != "LATIN", s)):
        meant = [c if s in (None, script) else _TURN[s, script].get(c) for c, s in zip(token, scripts, strict=True)]
        if None not in meant and script != "PHONETIC":
            out.append("".join(meant))
    return out


def candidates(text: str) -> list[tuple[str, str, int]]:
    """Tokens with look-alikes: the token, what it would be, the likeliest
    reading first, and how many witnesses that needs in the corpus."""
    if not _FOREIGN.search(text):
        return []
    out = []
    strange = {_script(c) for c in _FOREIGN.findall(text) if c not in LOOKALIKES}
    for token in _TOKEN.findall(text):
        foreign = _FOREIGN.findall(token)
        if not foreign:
            continue
        mixed = readings(token)
        out += [(token, meant, WITNESSES) for meant in mixed]
        if not mixed and all(c in LOOKALIKES for c in foreign) and not strange & {_script(c) for c in foreign}:
            out.append((token, "".join(LOOKALIKES.get(c, c) for c in token), WITNESSES_WHOLE))
    return out


def substitute(text: str, pairs: dict[str, str]) -> str:
    return _TOKEN.sub(lambda m: pairs.get(m.group(), m.group()), text)


_SEEN = "row_key long, pos int, value string, form string, differs boolean, asked array<struct<k:int,t:string,m:string,need:int>>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, pos, value in zip(pdf["row_key"], pdf["pos"], pdf["value"], strict=True):
            form = plain_form(value)
            found = candidates(form)
            if form != value or found:
                rows.append((key, pos, value, form, form != value, [{"k": k, "t": t, "m": m, "need": need} for k, (t, m, need) in enumerate(found)]))
        if rows:
            yield pd.DataFrame(rows, columns=["row_key", "pos", "value", "form", "differs", "asked"])


def _values(extracted: DataFrame) -> DataFrame:
    return (
        extracted.where(F.col("field_id").isNotNull())
        .select(F.col("field_id").cast("long").alias("row_key"), F.posexplode("field_values").alias("pos", "value"))
        .where(F.col("value").isNotNull())
    )


def _tags(volunteers: DataFrame) -> DataFrame:
    return volunteers.where(F.col("response_id").isNotNull() & F.col("tags").isNotNull()).select(
        F.col("response_id").cast("long").alias("row_key"), F.lit(0).alias("pos"), F.col("tags").alias("value"))


def normalised(extracted: DataFrame, volunteers: DataFrame) -> DataFrame:
    """Values that deviate, in one form: ``origin, row_key, pos, normal``.

    Null keys and values give no rows; repeated records give theirs once.
    """
    fields, tags = _values(extracted), _tags(volunteers)
    model, words = PairModel.fit(corpus_counts(fields).unionByName(corpus_counts(tags)))
    all_values = fields.withColumn("origin", F.lit("extracted")).unionByName(tags.withColumn("origin", F.lit("volunteers")))
    read = None
    for origin, df in (("extracted", fields), ("volunteers", tags)):
        part = df.where(F.col("value").rlike(r"[^\x00-\x7f]")).mapInPandas(_read, _SEEN).withColumn("origin", F.lit(origin))
        read = part if read is None else read.unionByName(part)
    read = settle(read.distinct())
    garbled = repaired(read.where("origin = 'extracted'"), model, words).select(F.lit("extracted").alias("origin"), "row_key", "pos").distinct()
    read = read.join(garbled, ["origin", "row_key", "pos"], "left_anti")
    asked = read.select("origin", "row_key", "pos", F.explode("asked").alias("a")).select("origin", "row_key", "pos", "a.*").withColumn("word", F.lower("m"))
    witnesses = (
        all_values.select(F.explode(F.regexp_extract_all("value", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
        .select(F.lower("word").alias("word")).join(asked.select("word").distinct(), "word").groupBy("word").agg(F.count("*").alias("n"))
    )
    confirmed = (
        asked.join(witnesses, "word").where("n >= need")
        .groupBy("origin", "row_key", "pos").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "k", "t", "m"))).alias("seen"))
    )
    joined = read.join(confirmed, ["origin", "row_key", "pos"], "left").withColumn(
        "pairs", F.coalesce("seen", F.array().cast("array<struct<n:long,k:int,t:string,m:string>>")))
    return (
        joined.where(F.col("differs") | (F.size("pairs") > 0)).select("origin", "row_key", "pos", "form", "pairs")
        .mapInPandas(_substitute_all, "origin string, row_key long, pos int, normal string").distinct()
    )


def _substitute_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        done = [substitute(f, {p["t"]: p["m"] for p in reversed(ps)}) if len(ps) else f for f, ps in zip(pdf["form"], pdf["pairs"], strict=True)]
        if done:
            yield pdf[["origin", "row_key", "pos"]].assign(normal=done)


def deviating(extracted: DataFrame, volunteers: DataFrame) -> DataFrame:
    """Places of values that deviate: ``origin, row_key, pos``."""
    return normalised(extracted, volunteers).select("origin", "row_key", "pos").distinct()
