"""Text decoded under a wrong encoding: found, and restored where possible.

1. Adjacent character pairs with a character beyond ASCII are counted over all
   text, in numpy, combined per task before the shuffle; so are words with an
   accented letter. A pair's score is its share of the corpus' mutual
   information, p(ab) * log2(p(ab) / (p(a) p(b))), in bits. Pairs below a share
   of ``FLOOR`` are not kept, so the model has at most 1 / FLOOR entries
   whatever the corpus, and is broadcast. Words stay a table.
2. A text is looked at piece by piece (between tags and line ends), and only
   where it has an improbable pair, which numpy finds for a batch at a time. In
   such a piece the maximum-scoring segments of improbable pairs are isolated,
   each widened to whole stretches of characters beyond ASCII: the *runs*.
3. Only inside the runs inverse mappings are tried: back to bytes under the
   encoding that was wrongly used, forward under the one that was meant. Runs
   that a mapping does not fit stay. A strict reading as UTF-8 holds if the runs
   it changes become more probable by ``GAIN`` bits a pair, and is repeated
   while it gains, to undo further wrong readings. A reading under another
   encoding must fit all runs; it holds if it gives Chinese text more probable by
   ``GAIN_LOOSE`` bits a pair, or known words. Whether words are known is asked
   by a join of the candidates' words with the counts of all corpus words.

U+FFFD marks lost characters: such text is reported, and restored only outside
the lost places. The rest of a text is never changed.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import settle

FLOOR = 2.0**-19
#: Pairs with a smaller share than this are improbable.
PROBABLE = 2.0**-8
#: Least score of a segment worth testing, in bits; a segment ends where the
#: score has fallen by ``FALL``. A pair within ASCII costs ``PLAIN``.
SEGMENT, FALL, PLAIN = 2.0, 4.0, 0.05
#: Least gain of a mapping, in bits a pair: of strict multi-byte readings, and
#: of readings under another single-byte or double-byte encoding.
GAIN, GAIN_LOOSE = 0.1, 4.0
#: Occurrences that make a word known.
SAID = 3
LOST = "�"

_BEYOND = re.compile(r"[^\x00-\x7f]+")
_CONTROL = re.compile(r"[\x80-\x9f]")
_WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]*[À-ÖØ-öø-ɏ][A-Za-zÀ-ÖØ-öø-ɏ]*")
#: An accented word from its first accent on.
_ACCENTED = re.compile(r"[À-ÖØ-öø-ɏ][A-Za-zÀ-ÖØ-öø-ɏ]*")
#: Line end and angle brackets part the pieces.
_PARTING = np.array([10, 60, 62], np.uint32)
_PLAIN = "".join(map(chr, range(33, 127)))
_HAN = re.compile(r"[\x00-\x7f\u3000-\u303f\u3400-\u9fff\uff00-\uff5e\u2018-\u201d\u2014\u2026\u00b7]+")

# Encodings under which UTF-8 is read by mistake.
READ_AS = ("cp1252+", "gb18030", "mac_roman", "cp1251", "cp1250", "cp850", "cp437", "cp1253", "cp1254", "koi8-r", "big5", "shift_jis", "euc_kr")
# Wrong and meant encoding of text that is not UTF-8.
MISREAD = tuple((a, "gb18030") for a in ("cp1252+", "mac_roman", "cp1251", "cp850", "cp437")) + tuple(
    (a, "cp1252") for a in ("cp850", "cp437", "mac_roman", "cp1251", "cp1250", "gb18030")) + (("utf-8", "gb18030"),)

_CP1252 = {bytes([b]).decode("cp1252"): b for b in range(128, 256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_CP1252 |= {chr(b): b for b in range(128, 256) if chr(b) not in _CP1252}


def to_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that read as ``text``; ``cp1252+`` is the web's reading, with
    control characters where the code page is empty."""
    if encoding != "cp1252+":
        try:
            return text.encode(encoding)
        except UnicodeEncodeError:
            return None
    try:
        return bytes(ord(c) if ord(c) < 128 else _CP1252[c] for c in text)
    except KeyError:
        return None


# ---------------------------------------------------------------- pair model


def _pairs(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with a character beyond ASCII, as keys, and their counts."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(codes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = codes[:-1], codes[1:]
    held = ((a > 127) | (b > 127)) & (a != 10) & (b != 10)
    return np.unique((a[held].astype(np.int64) << 21) | b[held], return_counts=True)


def _accented_words(text: str) -> Iterator[str]:
    """The words that ``_WORD`` finds, looking from their accents backwards."""
    for m in _ACCENTED.finditer(text):
        a = b = m.start()
        while a and text[a - 1].isascii() and text[a - 1].isalpha():
            a -= 1
        yield text[a:b] + m.group()


def _count(unescape: bool):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, words = np.zeros(0, np.int64), np.zeros(0, np.int64), Counter()
        for pdf in batches:
            texts = [html.unescape(t) if unescape and "&" in t else t for t in pdf["value"]]
            k, c = _pairs(texts)
            keys, at = np.unique(np.concatenate((keys, k)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, c)), len(keys)).astype(np.int64)
            for t in texts:
                if not t.isascii():
                    words.update(_accented_words(t))
            if len(words) > 200_000:
                yield pd.DataFrame({"pair": None, "word": list(words), "n": list(words.values())})
                words.clear()
        if len(keys):
            yield pd.DataFrame({"pair": pd.array(keys, "Int64"), "word": None, "n": counts})
        if words:
            yield pd.DataFrame({"pair": None, "word": list(words), "n": list(words.values())})

    return count


def corpus_counts(texts: DataFrame, unescape: bool = False) -> DataFrame:
    """Pairs and accented words of the column ``value``: ``pair, word, n``."""
    return texts.where(F.col("value").isNotNull()).select("value").mapInPandas(_count(unescape), "pair long, word string, n long")


class PairModel:
    """Scores of character pairs in bits, negative where improbable; ``keys``
    are sorted."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray, base: float):
        self.keys, self.bits, self.base = keys, bits, base
        self._table: dict[str, float] | None = None

    @classmethod
    def fit(cls, counts: DataFrame) -> tuple[PairModel, DataFrame]:
        """The model, of which at most 1 / FLOOR rows are collected, and the
        counts of all words: ``word, n``."""
        summed = settle(counts.groupBy("pair", "word").agg(F.sum("n").alias("n")))
        pairs, words = summed.where("pair IS NOT NULL").drop("word"), summed.where("word IS NOT NULL").drop("pair")
        total = pairs.agg(F.sum("n")).first()[0] or 1
        left, right = F.shiftright("pair", 21), F.col("pair").bitwiseAND(F.lit((1 << 21) - 1))
        ones = pairs.select(F.explode(F.array(left, right)).alias("c"), "n").groupBy("c").agg((F.sum("n") / 2.0).alias("m"))
        kept = (
            pairs.where(F.col("n") >= total * FLOOR)
            .withColumn("a", left).withColumn("b", right)
            .join(ones.select(F.col("c").alias("a"), F.col("m").alias("ma")), "a")
            .join(ones.select(F.col("c").alias("b"), F.col("m").alias("mb")), "b")
            .select("pair", "n", "ma", "mb").toPandas().sort_values("pair")
        )
        share = kept["n"].to_numpy(float) / total
        lift = np.log2(np.maximum(share * total * total / np.maximum(kept["ma"] * kept["mb"], 1).to_numpy(float), 2.0))
        return cls(kept["pair"].to_numpy(np.int64), np.log2(share * lift), float(np.log2(FLOOR / 4))), words

    @property
    def table(self) -> dict[str, float]:
        if self._table is None:
            a, b = (self.keys >> 21).tolist(), (self.keys & ((1 << 21) - 1)).tolist()
            self._table = {chr(x) + chr(y): s for x, y, s in zip(a, b, self.bits.tolist(), strict=True)}
        return self._table

    def suspect(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text the pieces that have an improbable pair, in order."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not texts:
            return out
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        parting = np.isin(codes, _PARTING)
        a, b = codes[:-1], codes[1:]
        at = np.flatnonzero(((a > 127) | (b > 127)) & ~parting[:-1] & ~parting[1:])
        key = (a[at].astype(np.int64) << 21) | b[at]
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            at = at[~((self.keys[place] == key) & (self.bits[place] >= np.log2(PROBABLE)))]
        if len(at):
            ends = np.flatnonzero(parting)
            k = np.unique(np.searchsorted(ends, at))
            first = np.where(k > 0, ends[np.maximum(k - 1, 0)] + 1, 0)
            owner = np.searchsorted(starts, first, side="right") - 1
            for i, x, y in zip(owner.tolist(), (first - starts[owner]).tolist(), (ends[k] - starts[owner]).tolist(), strict=True):
                out[i].append((x, y))
        return out

    def runs(self, piece: str) -> list[tuple[int, int]]:
        """The maximum-scoring segments of improbable pairs, widened to whole
        stretches beyond ASCII; where one segment reaches ``SEGMENT``, the
        weaker ones of the piece are runs as well."""
        get, base, limit = self.table.get, self.base, float(np.log2(PROBABLE))
        found: list[tuple[int, int]] = []
        here = best = 0.0
        first = last = 0
        end, top = None, 0.0

        def close() -> None:
            if best > 0:
                found.append((first, last + 2))

        for m in _BEYOND.finditer(piece):
            if end is not None:
                here -= PLAIN * (m.start() - end)
            end = m.end()
            for i in range(max(m.start() - 1, 0), min(m.end(), len(piece) - 1)):
                here += limit - get(piece[i:i + 2], base)
                if here <= 0 or here < best - FALL:
                    top = max(top, best)
                    close()
                    here = best = 0.0
                elif here > best:
                    if best == 0.0:
                        first = i
                    best, last = here, i
        close()
        if max(top, best) < SEGMENT:
            return []
        out: list[tuple[int, int]] = []
        for m in _BEYOND.finditer(piece):
            if any(a < m.end() and m.start() < b for a, b in found):
                held = next(((a, b) for a, b in found if a < m.end() and m.start() < b))
                if out and held[0] < out[-1][1]:  # one segment over several stretches is one run
                    out[-1] = (out[-1][0], m.end())
                else:
                    out.append((m.start(), m.end()))
        return out

    def bits_of(self, text: str) -> tuple[float, int]:
        """Sum and number of the scores of pairs with a character beyond ASCII."""
        get, base = self.table.get, self.base
        s = [get(text[i:i + 2], base) for i in range(len(text) - 1) if text[i] > "\x7f" or text[i + 1] > "\x7f"]
        return sum(s), len(s)


# ------------------------------------------------------------------- repair


def _change(run: str, change) -> str | None:
    """The run under a mapping, or None where it does not fit. A run with lost
    characters is cut there, and its parts fit or stay each for itself."""
    if LOST not in run:
        return change(run)
    parts = re.split(f"({LOST})", run)
    meant = [change(p) if p and p != LOST else None for p in parts]
    return "".join(p if o is None else o for p, o in zip(parts, meant, strict=True)) if any(o is not None for o in meant) else None


def _mapping(wrong: str, right: str):
    def change(run: str) -> str | None:
        raw = to_bytes(run, wrong)
        try:
            meant = None if raw is None else raw.decode(right)
        except UnicodeDecodeError:
            return None
        return None if meant is None or _CONTROL.search(meant) and right != "utf-8" else meant

    return change


_STRICT = tuple((w, _mapping(w, "utf-8")) for w in READ_AS)
_LOOSE = tuple((w, r, _mapping(w, r)) for w, r in MISREAD)
_HEAD = re.compile(f"(?<![^\x00-\x7f{LOST}])[^\x00-\x7f{LOST}].?", re.S)
#: Answers of ``_held``, at most one for each character there is.
_SEEN_HEADS: dict[str, frozenset[str]] = {}


def _held(char: str) -> frozenset[str]:
    """The encodings that have the character."""
    if char not in _SEEN_HEADS:
        _SEEN_HEADS[char] = frozenset(w for w in (*READ_AS, "utf-8") if to_bytes(char, w))
    return _SEEN_HEADS[char]


def _opens(head: str, wrong: str) -> bool:
    """Whether the bytes of the first characters can open UTF-8 text."""
    raw = to_bytes(head, wrong) or to_bytes(head[0], wrong) or b""
    size = 2 if 0xC2 <= raw[0] <= 0xDF else 3 if 0xE0 <= raw[0] <= 0xEF else 4 if 0xF0 <= raw[0] <= 0xF4 else 0
    return size > 0 and all(0x80 <= x <= 0xBF for x in raw[1:size])


def _worth(runs: list[str], strict: bool) -> set[str]:
    """The encodings that some stretch of the runs may have been read under."""
    heads = {h for run in runs for h in _HEAD.findall(run)}
    if not strict:
        return {w for h in heads for w in _held(h[0])}
    return {w for w in READ_AS if any(w in _held(h[0]) and _opens(h, w) for h in heads)}


def _known(before: str, after: str, words: dict[str, int]) -> tuple[bool, set[str]]:
    """Whether all words that a reading changed are known, and known better;
    and the words that this depends on."""
    old, new = before.split(), after.split()
    if len(old) != len(new):
        return False, set()
    changed = [(a, b) for a, b in zip(old, new, strict=True) if a != b]
    asked: set[str] = set()
    for a, b in changed:
        meant, stood = _WORD.findall(b), _WORD.findall(a)
        if not meant or re.sub(_WORD, "", b).strip(_PLAIN):
            return False, set()
        asked.update(meant, stood)
    if not any(len(w) > 2 for _, b in changed for w in _WORD.findall(b)):
        return False, set()
    good = all(
        min(words.get(w, 0) for w in _WORD.findall(b)) > max([SAID - 1, *(words.get(w, 0) for w in _WORD.findall(a))])
        for a, b in changed)
    return good, asked


class _Piece:
    """A piece as its runs and what stands between them."""

    def __init__(self, piece: str, runs: list[tuple[int, int]], model: PairModel):
        self.model = model
        cuts = [0, *(x for run in runs for x in run), len(piece)]
        parts = [piece[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.fixed, self.runs = parts[::2], parts[1::2]
        self.known: dict[tuple[int, str], tuple[float, int]] = {}

    def text(self, runs: list[str]) -> str:
        return "".join(x for pair in zip(self.fixed, [*runs, ""], strict=True) for x in pair)

    def mean(self, runs: list[str], at: list[int]) -> float:
        total = n = 0
        for i in at:
            key = (i, runs[i])
            if key not in self.known:
                self.known[key] = self.model.bits_of(self.fixed[i][-1:] + runs[i] + self.fixed[i + 1][:1])
            s, k = self.known[key]
            total, n = total + s, n + k
        return total / n if n else 0.0

    def mapped(self, runs: list[str], change, every: bool) -> tuple[list[str], list[int], bool] | None:
        """The runs under a mapping, which of them changed, and whether it fits
        all of them."""
        answers = [_change(r, change) for r in runs]
        if every and None in answers:
            return None
        out = [r if o is None else o for r, o in zip(runs, answers, strict=True)]
        at = [i for i, (r, o) in enumerate(zip(runs, out, strict=True)) if r != o]
        return (out, at, None not in answers) if at else None

    def gain(self, before: list[str], after: list[str], at: list[int]) -> float:
        return self.mean(after, at) - self.mean(before, at)


def restore_piece(piece: str, model: PairModel, words: dict[str, int], asked: set[str]) -> str | None:
    """What a piece was meant to be, or None where it stands as it is. Words
    whose counts decide are added to ``asked``."""
    spans = model.runs(piece)
    if not spans:
        return None
    # Readings as UTF-8 leave ASCII as it is, so that each stretch is read for itself.
    split = _Piece(piece, [m.span() for a, b in spans for m in _BEYOND.finditer(piece, a, b)], model)
    now, held = split.runs, None
    while True:
        best: tuple[int, float, list[str]] | None = None
        hidden = []

        def offer(found: tuple[list[str], list[int], bool] | None) -> None:
            nonlocal best
            if found is None or any(_CONTROL.search(found[0][i]) for i in found[1]):
                return
            at = [i for i, (r, o) in enumerate(zip(now, found[0], strict=True)) if r != o]  # noqa: B023
            gain = split.gain(now, found[0], at)  # noqa: B023
            if gain >= GAIN and (best is None or (len(at), gain) > (best[0], best[1])):
                best = (len(at), gain, found[0])

        worth = _worth(now, True)
        for wrong, change in _STRICT:
            found = split.mapped(now, change, False) if wrong in worth else None
            offer(found)
            if found is not None and found[2]:
                hidden.append(found[0])
        if best is None:  # a second wrong reading may hide behind one that fits all runs but gains nothing
            for first in hidden:
                for _, change in _STRICT:
                    offer(split.mapped(first, change, True))
        if best is None:
            break
        now = held = best[2]
    if held is not None:
        return split.text(held)
    best, split = None, _Piece(piece, spans, model)
    worth = _worth(split.runs, False)
    for wrong, right, change in _LOOSE:
        found = split.mapped(split.runs, change, True) if wrong in worth else None
        if found is None:
            continue
        runs, at, _ = found
        if right == "cp1252":
            good, of = _known(piece, split.text(runs), words)
            asked |= of
        else:
            good = all(_HAN.fullmatch(runs[i]) for i in at)
        gain = split.gain(split.runs, runs, at) if good else 0.0
        if good and (right == "cp1252" or gain >= GAIN_LOOSE) and (best is None or gain > best[0]):
            best = (gain, split.text(runs))
    return None if best is None else best[1]


def restore_all(
    texts: list[str], model: PairModel, known: list[dict[str, int]] | None = None, seen: dict[str, tuple[str | None, frozenset[str]]] | None = None,
) -> list[tuple[bool, str, set[str]]]:
    """For each text whether it is garbled, the text with what could be
    restored, and the words whose counts could have restored more. ``known``
    has the counts of words for each text; without them ``seen`` keeps the
    answers for pieces that come again."""
    seen = {} if seen is None else seen
    out = []
    for k, (text, pieces) in enumerate(zip(texts, model.suspect(texts), strict=True)):
        garbled, parts, last, asked = LOST in text, [], 0, set()
        for a, b in pieces:
            piece = text[a:b]
            if known is not None:
                meant = restore_piece(piece, model, known[k], asked)
            elif piece in seen:
                meant, of = seen[piece]
                asked |= of
            else:
                of = set()
                meant = restore_piece(piece, model, {}, of)
                asked |= of
                if len(piece) <= 300:  # what comes again is short
                    if len(seen) > 50_000:
                        seen.clear()
                    seen[piece] = (meant, frozenset(of))
            if meant is not None:
                garbled = True
                parts += [text[last:a], meant]
                last = b
        out.append((garbled, "".join(parts) + text[last:], asked))
    return out


_KEYS = ("row_key", "pos")


def _first(shared, unescape: bool):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, seen = PairModel(*shared.value), {}
        for pdf in batches:
            texts = [html.unescape(t) if unescape and "&" in t else t for t in pdf["value"]]
            rows = [
                (key, pos, text if asked else None, meant if garbled else None, sorted(asked))
                for key, pos, text, (garbled, meant, asked) in zip(pdf["row_key"], pdf["pos"], texts, restore_all(texts, model, None, seen), strict=True)
                if garbled or asked]
            if rows:
                yield pd.DataFrame(rows, columns=["row_key", "pos", "value", "restored", "asked"])

    return work


def _second(shared):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = PairModel(*shared.value)
        for pdf in batches:
            counts = [{w["word"]: w["n"] for w in ws} for ws in pdf["counts"]]
            rows = [
                (key, pos, meant)
                for key, pos, (garbled, meant, _) in zip(pdf["row_key"], pdf["pos"], restore_all(list(pdf["value"]), model, counts), strict=True) if garbled]
            if rows:
                yield pd.DataFrame(rows, columns=["row_key", "pos", "restored"])

    return work


def repaired(values: DataFrame, model: PairModel, words: DataFrame, unescape: bool = False) -> DataFrame:
    """Garbled values of ``row_key, pos, value``: ``row_key, pos, restored``.
    ``words`` has the counts of the corpus' accented words."""
    shared = values.sparkSession.sparkContext.broadcast((model.keys, model.bits, model.base))
    first = settle(
        values.where(F.col("value").rlike(r"[^\x00-\x7f]|&" if unescape else r"[^\x00-\x7f]")).select(*_KEYS, "value")
        .mapInPandas(_first(shared, unescape), "row_key long, pos int, value string, restored string, asked array<string>"))
    open_rows = first.where("value IS NOT NULL").select(*_KEYS, "value", "asked").distinct().withColumn("row", F.xxhash64(*_KEYS, "value"))
    counts = (
        open_rows.select("row", F.explode("asked").alias("word")).distinct().join(words, "word")
        .groupBy("row").agg(F.collect_list(F.struct("word", "n")).alias("counts"))
    )
    second = (
        open_rows.join(counts, "row", "left")
        .select(*_KEYS, "value", F.coalesce("counts", F.array().cast("array<struct<word:string,n:bigint>>")).alias("counts"))
        .mapInPandas(_second(shared), "row_key long, pos int, restored string")
    )
    return first.where("value IS NULL").select(*_KEYS, "restored").unionByName(second).distinct()


def _values(extracted: DataFrame) -> DataFrame:
    return (
        extracted.where(F.col("field_id").isNotNull())
        .select(F.col("field_id").cast("long").alias("row_key"), F.posexplode("field_values").alias("pos", "value"))
        .where(F.col("value").isNotNull())
    )


def _pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("page_id").isNotNull() & F.col("html").isNotNull()).select(
        F.col("page_id").cast("long").alias("row_key"), F.lit(0).alias("pos"), F.col("html").alias("value"))


def restored(pages: DataFrame, extracted: DataFrame) -> DataFrame:
    """Garbled values: ``origin, row_key, pos, restored``, each once.

    ``restored`` has the HTML with its entities decoded, or the value at
    ``pos``; places that are lost stay marked. Nulls give no rows.
    """
    html_pages, values = _pages(pages), _values(extracted)
    model, words = PairModel.fit(corpus_counts(html_pages, unescape=True).unionByName(corpus_counts(values)))
    found = [
        repaired(df, model, words, unescape).select(F.lit(origin).alias("origin"), "*")
        for origin, df, unescape in (("pages", html_pages, True), ("extracted", values, False))
    ]
    return found[0].unionByName(found[1])


def garbled(pages: DataFrame, extracted: DataFrame) -> DataFrame:
    """Records that hold garbled text: ``origin, row_key``."""
    return restored(pages, extracted).select("origin", "row_key").distinct()
