"""Timestamps written in many ways, brought to one instant in UTC.

Each value is read under every format whose pattern it fits and whose fields
form a real date; most fit one, an all-numeric date may fit two. Which reading
a *source* means is learned by expectation-maximisation over a mixture of
formats: a value spreads its weight over its valid readings in proportion to
the source's current format shares, the shares are the sums of those weights.
The values enter only as counts per (source, set of valid readings), a table
bounded by sources times reading sets, so the iterations never touch the data.
A value takes its most probable reading if the posterior reaches
``certainty``; otherwise it is reported as ambiguous and left without instant.

Format tests depend on a value's shape only and are kept by shape; the calendar
and the zones are the runtime's (``try_make_timestamp`` with the zone as a
column). Local times that occur twice mean the first; skipped ones are read with the
offset valid before the change.
"""

from __future__ import annotations

import re
import zoneinfo
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names by language, each list from January on.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en3": "jan feb mar apr may jun jul aug sep oct nov dec",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
# Other spellings of a month.
MONTH_VARIANTS = {"sept": 9, "setiembre": 9, "maerz": 3, "jänner": 1, "fevrier": 2, "aout": 8, "decembre": 12}

# Zone abbreviations and the offsets, in minutes, they may stand for.
ABBREVIATIONS = {
    "UTC": [0], "GMT": [0], "Z": [0], "WET": [0], "WEST": [60], "BST": [60, 360], "CET": [60], "CEST": [120],
    "EET": [120], "EEST": [180], "MSK": [180], "IST": [330, 120, 60], "SGT": [480], "HKT": [480], "JST": [540],
    "KST": [540], "AWST": [480], "ACST": [570], "ACDT": [630], "AEST": [600], "AEDT": [660], "NZST": [720],
    "NZDT": [780], "BRT": [-180], "BRST": [-120], "ART": [-180], "EST": [-300], "EDT": [-240],
    "CST": [-360, 480], "CDT": [-300], "MST": [-420], "MDT": [-360], "PST": [-480], "PDT": [-420],
    "AKST": [-540], "AKDT": [-480], "HST": [-600],
}

_LETTER = r"[^\W\d_]"
_TIME = r"(?:[T ,]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)"
_DAY = rf"(?:{_LETTER}{{2,12}}\.?,?\s+)?"
_WORD = rf"{_LETTER}{{3,12}}\.?"


@dataclass(frozen=True)
class Format:
    """A way of writing an instant. ``order`` names what the numbers of the
    value are, in turn: y, m, d, h, i (minute), s, f (fraction)."""

    name: str
    pattern: str
    order: str


# Patterns are matched against the value without its zone and am/pm mark.
FORMATS = (
    Format("ymd", rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}{_TIME}?$", "ymdhisf"),
    Format("ymd_slash", rf"^\d{{4}}[/.]\d{{1,2}}[/.]\d{{1,2}}{_TIME}?$", "ymdhisf"),
    Format("ymd_han", r"^\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日\s*(?:\d{1,2}[:：时]\d{2}分?(?:[:：]?\d{2}秒?)?)?$", "ymdhis"),
    Format("day_month", rf"^{_DAY}\d{{1,2}}\.?\s+(?:de\s+)?{_WORD}\s+(?:de\s+|del\s+)?\d{{4}}(?:\s*(?:,|à|um|at|a las|T)?\s*\d{{1,2}}[:h]\d{{2}}(?::\d{{2}}(?:\.\d{{1,9}})?)?(?:\s*Uhr)?)?$", "dyhisf"),
    Format("month_day", rf"^{_DAY}{_WORD}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}(?:\s*(?:,|at)?\s*\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,9}})?)?)?$", "dyhisf"),
    Format("mdy", rf"^\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{4}}{_TIME}?$", "mdyhisf"),
    Format("dmy", rf"^\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{4}}{_TIME}?$", "dmyhisf"),
    Format("basic", r"^\d{8}(?:T\d{4}(?:\d{2})?)?$", "*"),
    Format("epoch_s", r"^-?\d{9,10}$", "*"),
    Format("epoch_ms", r"^-?\d{12,13}$", "*"),
    Format("epoch_us", r"^-?\d{15,16}$", "*"),
    Format("epoch_ns", r"^-?\d{18,19}$", "*"),
)
EPOCH = {"epoch_s": 1_000_000, "epoch_ms": 1000, "epoch_us": 1, "epoch_ns": None}

_ZONE = re.compile(
    r"\s*(Z|[+-]\d{2}:?\d{2}|(?<=:\d{2})[+-]\d{2}|(?<=\d)\s*(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?|(?<=[\d ])(?:"
    + "|".join(k for k in ABBREVIATIONS if k != "Z") + r"))$")
_PLAIN_DAY = re.compile(r"^\d{4}-\d{1,2}-\d{1,2}$")
_HALF = re.compile(r"\s*([ap])\.?m\.?$", re.I)
_MONTH_NUMBERS = {name: i + 1 for names in MONTHS.values() for i, name in enumerate(names.split())} | MONTH_VARIANTS
_MONTH = re.compile(rf"(?<!{_LETTER})(" + "|".join(sorted(_MONTH_NUMBERS, key=len, reverse=True)) + rf")(?!{_LETTER})", re.I)
_OFFSET = re.compile(r"([+-])(\d{1,2}):?(\d{2})?$")
_SPACE = re.compile(r"[\s\u00a0\u202f\u3000]+")
_DIGIT, _DIGITS = re.compile(r"\d"), re.compile(r"\d+")

#: A reading of a value before its clock is applied.
WRITTEN = "array<struct<format:string,us:long,y:int,m:int,d:int,h:int,i:int,s:int,f:int,zone:string,offsets:array<int>>>"


class Reader:
    """Readings of values under every format they fit. What depends on the
    shape of a value only (its digits masked) is worked out once for each."""

    #: Shapes remembered at a time.
    KEPT = 50_000

    def __init__(self):
        self.compiled = [(f, re.compile(f.pattern)) for f in FORMATS]
        self.shapes: dict[str, tuple] = {}
        self.zones = {z for z in zoneinfo.available_timezones() if "/" in z} | {"UTC", "GMT"}

    def clock(self, zone: str | None) -> str:
        """The zone, or UTC if it is not known."""
        return zone if zone in self.zones else "UTC"

    def _shape(self, shape: str) -> tuple:
        zone = None if _PLAIN_DAY.match(shape) else _ZONE.search(shape)
        end = zone.start() if zone else len(shape)
        half = _HALF.search(shape[:end])
        end = half.start() if half else end
        body = shape[:end]
        month = _MONTH.search(body)
        fits = tuple(f for f, p in self.compiled if p.match(body))
        return end, half.group(1).lower() if half else "", _MONTH_NUMBERS[month.group(1).lower()] if month else None, zone.start(1) if zone else -1, fits

    def read(self, value: str) -> list[dict]:
        value = _SPACE.sub(" ", value).strip(" ")
        if len(value) > 80:  # longer than any way of writing an instant
            return []
        shape = _DIGIT.sub("9", value)
        if "9999" not in shape:
            return []
        held = self.shapes.get(shape)
        if held is None:
            if len(self.shapes) >= self.KEPT:
                self.shapes.clear()
            held = self.shapes[shape] = self._shape(shape)
        end, half, month, zone_at, fits = held
        if not fits:
            return []
        body = value[:end]
        zone, offsets = _zone(value[zone_at:] if zone_at >= 0 else "")
        if zone is None and offsets is None:
            return []
        out = []
        for f in fits:
            w = {"format": f.name, "us": None, "zone": zone, "offsets": offsets, **dict.fromkeys("ymdhisf")}
            if f.name in EPOCH:
                if half or zone_at >= 0:
                    continue
                w["us"] = int(body) // 1000 if EPOCH[f.name] is None else int(body) * EPOCH[f.name]
            else:
                parts = (body[:4], body[4:6], body[6:8], body[9:11], body[11:13], body[13:15]) if f.name == "basic" else _DIGITS.findall(body)
                for name, digits in zip("ymdhis" if f.name == "basic" else f.order, parts, strict=False):
                    if digits:
                        w[name] = int(digits[:6].ljust(6, "0")) if name == "f" else int(digits[:4])
                if "m" not in f.order and f.name != "basic":
                    w["m"] = month
                hour = w["h"] or 0
                if half:
                    if w["h"] is None or not 1 <= hour <= 12:
                        continue
                    hour = hour % 12 + 12 * (half == "p")
                if w["m"] is None or hour > 23 or (w["s"] or 0) > 59:
                    continue
                w["h"] = hour
            out.append(w)
        return out


def _zone(text: str) -> tuple[str | None, list[int] | None]:
    """A fixed offset, or the offsets an abbreviation may stand for; the empty
    text leaves the clock of the source, an impossible offset nothing."""
    if not text:
        return "", None
    m = _OFFSET.search(text)
    if m:
        hours, minutes = int(m[2]), int(m[3] or 0)
        return (f"{m[1]}{hours:02d}:{minutes:02d}", None) if hours < 18 and minutes < 60 else (None, None)
    return "UTC", ABBREVIATIONS[text.strip().upper()]


def _read_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reader = Reader()
    for pdf in batches:
        if len(pdf):
            clocks = [reader.clock(z) for z in pdf["clock"]]
            yield pdf.assign(clock=clocks, written=[reader.read(v) if isinstance(v, str) else [] for v in pdf["value"]])


def _instant(w: Column, zone: Column) -> Column:
    """Microseconds since 1970 UTC of written fields on the clock of ``zone``;
    null if there is no such date or time."""
    fine = (F.coalesce(w["s"], F.lit(0)) + F.coalesce(w["f"], F.lit(0)) / F.lit(1_000_000)).cast("decimal(16,6)")
    made = F.try_make_timestamp(w["y"], w["m"], w["d"], F.coalesce(w["h"], F.lit(0)), F.coalesce(w["i"], F.lit(0)), fine, zone)
    return F.when(w["y"] >= 1, F.unix_micros(made))


def readings(values: DataFrame) -> DataFrame:
    """Add ``readings``, every valid (format, instant), to a table with
    ``value`` and ``clock``. A zone that is not known counts as UTC.

    Fields are told apart in Arrow batches; dates, clocks and their changes are
    the runtime's, in one expression over the readings.
    """
    kept = ", ".join(f"`{c}` {t}" for c, t in values.dtypes)
    read = values.mapInPandas(_read_all, f"{kept}, written {WRITTEN}")

    def instant(w: Column) -> Column:
        own = _instant(w, F.when(w["zone"] == "", F.col("clock")).otherwise(w["zone"]))
        # An abbreviation may name several offsets: the one nearest to the clock is meant.
        nearest = F.array_min(F.transform(w["offsets"], lambda m: F.struct(
            F.abs(own - m.cast("long") * 60_000_000 - _instant(w, F.col("clock"))).alias("far"), (own - m.cast("long") * 60_000_000).alias("us"))))["us"]
        return F.coalesce(w["us"], F.when(w["offsets"].isNull(), own).otherwise(nearest))

    held = F.transform("written", lambda w: F.struct(w["format"].alias("format"), instant(w).alias("epoch_us")))
    return read.withColumn("readings", F.filter(held, lambda r: r["epoch_us"].isNotNull())).drop("written")


def _shares(counts: pd.DataFrame, rounds: int, strength: float) -> dict[str, float]:
    """Format shares of one source by expectation-maximisation."""
    sets = [s.split("|") for s in counts["formats"]]
    names = sorted({f for s in sets for f in s})
    at = {f: i for i, f in enumerate(names)}
    fits = np.zeros((len(sets), len(names)))
    for i, s in enumerate(sets):
        fits[i, [at[f] for f in s]] = 1
    weight = counts["n"].to_numpy(float)
    declared = set(counts["declared"].dropna())
    prior = np.array([1.0 + strength * (f in declared) for f in names]) / len(names)
    share = prior / prior.sum()
    for _ in range(rounds):
        post = fits * share
        post /= post.sum(axis=1, keepdims=True)
        share = weight @ post + prior
        share /= share.sum()
    return dict(zip(names, share.tolist(), strict=True))


def format_shares(read: DataFrame, source: str = "source", rounds: int = 30, strength: float = 1e6) -> DataFrame:
    """Shares of the formats in each source: ``source, shares``.

    ``declared`` names the format a source is known to use, as a prior worth
    ``strength`` values.
    """
    counted = (
        read.where(F.size("readings") > 0)
        .groupBy(F.col(source).alias("source"), F.array_join(F.col("readings.format"), "|").alias("formats"))
        .agg(F.count("*").alias("n"), F.max("declared").alias("declared"))
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"source": pdf["source"].iloc[:1], "shares": [_shares(pdf, rounds, strength)]})

    return counted.groupBy("source").applyInPandas(fit, "source string, shares map<string,double>")


def normalise(
    df: DataFrame, id_col: str, value_col: str, source: Column, clock: Column,
    declared: Column | None = None, certainty: float = 0.9, keep: Sequence[str] = (),
) -> DataFrame:
    """The instant of each value: ``row_key, source, value, format, epoch_us, posterior, status``.

    ``status`` is ``resolved``, ``ambiguous`` (no reading reaches
    ``certainty``) or ``unreadable`` (relative, impossible, blank or null).
    One row per row of ``df`` with a key; of its other columns those named by
    ``keep`` stay.
    """
    base = df.select(
        *keep, F.col(id_col).cast("long").alias("row_key"), F.coalesce(source, F.lit("")).alias("source"),
        F.coalesce(clock, F.lit("UTC")).alias("clock"), (F.lit(None).cast("string") if declared is None else declared).alias("declared"),
        F.col(value_col).cast("string").alias("value"),
    ).where(F.col("row_key").isNotNull())
    read = readings(base)
    weighed = read.join(format_shares(read), "source", "left").withColumn(
        "scored", F.array_sort(F.transform("readings", lambda r: F.struct(
            (-F.coalesce(F.element_at("shares", r["format"]), F.lit(0.0))).alias("w"), r["format"].alias("format"), r["epoch_us"].alias("epoch_us")))))
    # Readings of one instant support each other.
    best = F.get("scored", F.lit(0))
    total = F.aggregate("scored", F.lit(0.0), lambda a, r: a - r["w"])
    backing = F.aggregate(F.filter("scored", lambda r: r["epoch_us"] == best["epoch_us"]), F.lit(0.0), lambda a, r: a - r["w"])
    posterior = F.when(F.size("readings") > 0, backing / F.greatest(total, F.lit(1e-300)))
    sure = posterior >= certainty
    return weighed.select(
        *keep, "row_key", "source", "value", F.when(sure, best["format"]).alias("format"),
        F.when(sure, best["epoch_us"]).alias("epoch_us"), posterior.alias("posterior"),
        F.when(posterior.isNull(), "unreadable").when(sure, "resolved").otherwise("ambiguous").alias("status"),
    )


def page_values(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """``published_time`` of pages, on the clock and date order of their site:
    ``origin, id, value, source, clock, declared``."""
    known = sites.groupBy("site").agg(F.max("tz_name").alias("tz_name"), F.max("date_order").alias("date_order"))
    return pages.select("page_id", "site", "published_time").join(known, "site", "left").select(
        F.lit("pages.published_time").alias("origin"), F.col("page_id").cast("long").alias("id"), F.col("published_time").alias("value"),
        F.concat(F.lit("pages.published_time "), F.coalesce("site", F.lit(""))).alias("source"), F.col("tz_name").alias("clock"), F.col("date_order").alias("declared"))


def task_values(tasks: DataFrame, columns: Sequence[str] = ("last_run", "created_at")) -> DataFrame:
    """Time columns of tasks, on the clock of the host that wrote the row; the
    same columns as ``page_values``."""
    each = F.array(*(F.struct(F.lit(f"tasks.{c}").alias("origin"), F.col(c).alias("value")) for c in columns))
    return tasks.select(F.col("task_id").cast("long").alias("id"), "tz_name", F.explode(each).alias("x")).select(
        "x.origin", "id", "x.value", F.concat(F.col("x.origin"), F.lit(" "), F.coalesce("tz_name", F.lit(""))).alias("source"),
        F.col("tz_name").alias("clock"), F.lit(None).cast("string").alias("declared"))


def instants(values: DataFrame) -> DataFrame:
    """The resolved instants of such values, each row once: ``origin, row_key, epoch_us``."""
    out = normalise(values, "id", "value", F.col("source"), F.col("clock"), F.col("declared"), keep=["origin"])
    return out.where(F.col("status") == "resolved").select("origin", "row_key", "epoch_us").distinct()
