"""Abusive, hateful and sexual content: a character n-gram linear classifier.

A sentence is brought to a form that undoes disguise (look-alike letters, leet
digits, spelled-out and stretched words, marks inside words), cut into
character n-grams, and hashed into ``BUCKETS`` features. Features are scaled by
naive Bayes log-count ratios of each category against the rest, and a logistic
model is fitted on the scaled features, one for each category.

The labelled samples hold few wordings. Before the model is fitted they are
widened by mutual bootstrapping over all documents: sentences of a category
that differ in one place give *frames* and *fillers*; a frame of the documents
that takes two known fillers is new, a filler seen in two known frames is new,
and so on until nothing new is found. Sentences with a known filler in no frame, that
come again and again with this one filler, are learned as harmless. All learned
frames and fillers are kept and matched exactly: a sentence that is a known frame
around any known filler of its category has that category. They grow with the
distinct wordings of the documents, not with their number.

Ordinary text is every sentence of every document that is in no known frame:
its features are counted in one distributed aggregation, whose result has at
most ``BUCKETS`` rows, and a second one finds how high ordinary sentences reach.

Bounds, all parameters: the rows the model is fitted on are the samples and up
to ``LEARNED`` bootstrapped sentences of each kind. The search for frames and
fillers, the counts and the scoring cover every sentence of every document.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.lookalike import LOOKALIKES
from strandline.session import settle

CATEGORIES = ("abusive", "hateful", "sexual")
BUCKETS = 1 << 18
ORDERS = (2, 3, 4, 5)
LEARNED = 3_000
#: Characters of a frame on either side of its slot.
AROUND = 200
#: Distinct fillers that make a frame, and frames that make a filler.
FILLERS, FRAMES = 2, 2
#: Occurrences in known frames that make a filler of one frame.
OFTEN = 3
#: Occurrences with one filler only that make a sentence harmless.
HARMLESS = 4
#: Probability at which a sentence counts.
CUT = 0.5
#: Share of ordinary sentences below the foot of the logistic curve, and how finely it is found.
ORDINARY, GRAIN = 0.999, 100
#: Share of plain naive Bayes in the weights; the rest is fitted.
BAYES = 0.3

_END = re.compile(r"[.!?…](?=\s)|[。！？]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_HAN_GAP = re.compile(r"(?<=[一-鿿])[ ·*_#.\-\u200b]+(?=[一-鿿])")
_SPELLED = re.compile(r"(?<!\w)\w(?:([ .·_*-])\w)(?:\1\w)+(?!\w)")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
#: Signs that may stand for letters, beside a letter or by themselves.
_SIGN = re.compile(r"[a-z][0134579$@*#_]|[0134579*#_][a-z]|[$@]|\w[*#_]\w")
_PARTS_WORDS = frozenset(" \t\n\r\f\v,;:!?()\"、。，\u3000")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_MARKED = re.compile(r"(?<=\w)[*#_](?=\w)")
_INSIDE = re.compile(r"[a-z][$@0134579]+[a-z]|[$@]")
# Signs that stand for letters in disguised words.
LEET = str.maketrans("0134579$@", "oieastgsa")
_LIKE = re.compile("[" + "".join(LOOKALIKES) + "]")


def _combining(codes: range) -> re.Pattern:
    return re.compile("[" + "".join(c for c in map(chr, codes) if unicodedata.combining(c)) + "]")


_ACCENTS, _ACCENTS_BEYOND = _combining(range(0x80, 0x10000)), _combining(range(0x10000, 0x110000))


def undisguise(text: str, lexicon: dict[int, set[str]] | None = None) -> str:
    """The form in which wordings are compared, of a sentence or of sentences
    at a line each; numbers are alike. Words with masked letters or with signs
    for letters are read as the words of ``lexicon`` (by length) that they fit."""
    lexicon = lexicon or {}
    s = text
    if not s.isascii():
        s = _HAN_GAP.sub("", _INVISIBLE.sub("", unicodedata.normalize("NFKC", s)))
        s = _LIKE.sub(lambda m: LOOKALIKES[m.group()], s)
        s = _ACCENTS.sub("", unicodedata.normalize("NFD", s))
        if max(s, default="") > "\uffff":
            s = _ACCENTS_BEYOND.sub("", s)
    s = _SPELLED.sub(lambda m: re.sub(r"[ .·_*-]", "", m.group()), s.lower())
    if _repeats(s):
        s = _STRETCH.sub(lambda m: m.group() if m.group() == "xxx" else m.group(1), s)
    return _NUMBER.sub("0", _read_words(s, lexicon))


def _repeats(text: str) -> bool:
    """Whether some character comes three times in a row."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    same = codes[1:] == codes[:-1]
    return bool((same[1:] & same[:-1] & (codes[2:] > 64)).any())


def _read_words(text: str, lexicon: dict[int, set[str]]) -> str:
    """The text with each word that holds a sign read by ``_read_word``."""
    out, last = [], 0
    for m in _SIGN.finditer(text):
        if m.start() < last:
            continue
        a, b = m.start(), m.end()
        while a > last and text[a - 1] not in _PARTS_WORDS:
            a -= 1
        while b < len(text) and text[b] not in _PARTS_WORDS:
            b += 1
        out += [text[last:a], _read_word(text[a:b], lexicon)]
        last = b
    return "".join(out) + text[last:] if out else text


def _read_word(word: str, lexicon: dict[int, set[str]]) -> str:
    core = word.strip(".-'")
    if _MARKED.search(core):
        fits = re.compile(".".join(map(re.escape, _MARKED.split(core))))
        known = sorted(w for w in lexicon.get(len(core), ()) if fits.fullmatch(w))
        return word.replace(core, known[0]) if known else word
    read = core.translate(LEET)
    if not read.replace("-", "").isalpha():
        return word
    if read in lexicon.get(len(read), ()) or _INSIDE.search(core):
        return word.replace(core, read)
    return word


def words_of(texts: Iterable[str]) -> dict[int, set[str]]:
    """The words of undisguised texts, by length."""
    out: dict[int, set[str]] = {}
    for t in texts:
        for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", t):
            if len(w) > 2:
                out.setdefault(len(w), set()).add(w)
    return out


def sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in _END.sub(r"\g<0>\n", text).split("\n")) if s]


def grams(texts: list[str]) -> tuple[Iterator[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed n-grams: for each order an array with the bucket of every place
    of all texts (``BUCKETS`` where no n-gram begins), where each text begins,
    and how many n-grams it has."""
    codes = np.frombuffer("".join(f" {t} \x00" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(texts) else np.zeros(0, np.int64)
    size = sum(np.maximum(lengths - n, 0) for n in ORDERS)
    closes = np.flatnonzero(codes == 0)

    def each() -> Iterator[np.ndarray]:
        roll = codes
        for n in range(2, max(ORDERS) + 1):
            roll = roll[:-1] * np.uint32(0x9E3779B1) + codes[n - 1:]
            if n in ORDERS:
                mixed = roll ^ (roll >> np.uint32(15))
                mixed *= np.uint32(0x85EBCA6B)
                mixed >>= np.uint32(14)
                key = np.full(len(codes), BUCKETS, np.uint32)
                key[:len(mixed)] = mixed
                for k in range(n):
                    key[closes - k] = BUCKETS
                yield key

    return each(), starts, size


def occurrences(texts: list[str]) -> np.ndarray:
    """How often each feature comes in all texts together."""
    count = np.zeros(BUCKETS, np.int64)
    for key in grams(texts)[0] if texts else ():
        count += np.bincount(key, minlength=BUCKETS + 1)[:BUCKETS]
    return count


def sums(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """For each text and row of ``weights`` the sum over its features, over the
    root of their number."""
    out = np.zeros((len(texts), len(weights)))
    if not texts:
        return out
    padded = np.concatenate((weights, np.zeros((len(weights), 1))), axis=1).astype(np.float64)
    each, starts, size = grams(texts)
    for key in each:
        for c, w in enumerate(padded):
            out[:, c] += np.add.reduceat(w.take(key), starts)
    return out / np.sqrt(np.maximum(size, 1))[:, None]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, and the index of the text of each."""
    each, starts, _ = grams(texts)
    found, whose = [], []
    for key in each:
        at = np.flatnonzero(key < BUCKETS)
        found.append(key[at].astype(np.int64))
        whose.append(np.searchsorted(starts, at, side="right") - 1)
    return np.concatenate(found), np.concatenate(whose)


class Model:
    """Weights of the hashed features, one row for each category."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Probability of each category for each undisguised sentence."""
        z = sums(texts, self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(
        cls, texts: list[str], labels: np.ndarray, weight: np.ndarray, count: np.ndarray, n: int, mass: float,
        reach: Callable[[np.ndarray], np.ndarray], steps: int = 60, decay: float = 1e-3, alpha: float = 1.0,
    ) -> Model:
        """``labels`` has a row for each category, ``weight`` says how much
        each text counts. ``count`` says how often each feature comes in
        ``n`` ordinary sentences; together these weigh ``mass``. ``reach``
        gives for ratios of the features, a row for each category, the value
        that few ordinary sentences exceed. Features of no labelled text have
        no weight; a feature without evidence has the ratio zero. Logistic
        regression by gradient descent with momentum on the scaled features,
        blended with plain naive Bayes."""
        key, whose = features(texts)
        size = np.sqrt(np.maximum(np.bincount(whose, minlength=len(texts)), 1))
        keep = named_features(texts, labels)[key]
        whose, key = whose[keep], key[keep]
        used, at = np.unique(key, return_inverse=True)
        weights, bias = np.zeros((len(CATEGORIES), BUCKETS), np.float32), np.zeros(len(CATEGORIES))
        for c, y in enumerate(labels.astype(float)):
            with_c, without = np.bincount(at, (y * weight)[whose], len(used)), np.bincount(at, ((1 - y) * weight)[whose], len(used))
            without += mass * count[used] / max(n, 1)
            with_c, without = with_c / max((weight * y).sum(), 1e-9), without / max((weight * (1 - y)).sum() + mass * (n > 0), 1e-9)
            floor = alpha / max(y.sum(), 1)
            weights[c, used] = np.log((with_c + floor) / (without + floor))
        top = reach(weights)
        for c, y in enumerate(labels.astype(float)):
            v = np.where(y > 0, weight / max((weight * y).sum(), 1e-9), weight / max((weight * (1 - y)).sum(), 1e-9))
            ratio = weights[c, used].astype(float)
            value = ratio[at] / size[whose]
            w, b, vw, vb = np.ones(len(used)), 0.0, np.zeros(len(used)), 0.0
            z = np.bincount(whose, value, len(texts))
            low, high = max(np.quantile(z[y == 0], ORDINARY) if (y == 0).any() else 0.0, top[c]), np.quantile(z[y > 0], 0.05) if y.any() else 1.0
            steep = 8.0 / max(high - low, 0.5)
            plain_w, plain_b = steep, -steep * (low + high) / 2
            w[:] = plain_w
            b = plain_b
            for _ in range(steps):
                z = np.bincount(whose, w[at] * value, len(texts)) + b
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * v / 2
                gw = np.bincount(at, g[whose] * value, len(used)) + decay * (w - plain_w)
                vw, vb = 0.9 * vw - 2.0 * gw, 0.9 * vb - 2.0 * g.sum()
                w, b = w + vw, b + vb
            weights[c, used] = (BAYES * plain_w + (1 - BAYES) * w) * ratio
            bias[c] = BAYES * plain_b + (1 - BAYES) * b
        return cls(weights, bias)


def named_features(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """Which features a labelled text has."""
    named = np.zeros(BUCKETS, bool)
    named[features([t for t, y in zip(texts, labels.any(axis=0), strict=True) if y] or [""])[0]] = True
    return named


# ------------------------------------------------------------ bootstrapping

SLOT = "\u25a2"
_BULLET = re.compile(r"^[\s>*#\u2022-]+")
_HAN = re.compile("[\u4e00-\u9fff]")


_BULLETS = frozenset(" \t>*#\u2022-")


def bare(form: str) -> str:
    return _BULLET.sub("", form) if form[:1] in _BULLETS else form


def _is_filler(middle: str) -> bool:
    if _HAN.search(middle):
        return len(middle) <= 4 and all(_HAN.match(c) for c in middle)
    return 2 < len(middle) <= 24 and middle.count(" ") <= 1 and middle.replace("-", "").replace(" ", "").replace("'", "").isalpha()


def frame_of(a: str, b: str) -> tuple[str, str, str] | None:
    """The frame two sentences share, and what each has in its slot."""
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    j = next((k for k in range(n - i) if a[-1 - k] != b[-1 - k]), n - i)
    if not _HAN.search(a):
        while i > 0 and a[i - 1].isalpha():
            i -= 1
        while j > 0 and a[len(a) - j].isalpha():
            j -= 1
    x, y = a[i:len(a) - j], b[i:len(b) - j]
    if i + j < 0.6 * n or not _is_filler(x) or not _is_filler(y):
        return None
    return a[:i] + SLOT + a[len(a) - j:], x, y


class Wordings:
    """Known frames and fillers, each with its category."""

    def __init__(self):
        self.frames: dict[str, str] = {}
        self.fillers: dict[str, str] = {}

    @classmethod
    def of_samples(cls, forms: list[str], categories: list[str]) -> Wordings:
        out = cls()
        for c in CATEGORIES:
            own = sorted({bare(f) for f, k in zip(forms, categories, strict=True) if k == c})
            for i, a in enumerate(own):
                for b in own[i + 1:]:
                    found = frame_of(a, b)
                    if found:
                        out.frames.setdefault(found[0], c)
                        for x in found[1:]:
                            out.fillers.setdefault(x, c)
        return out

    def finder(self) -> Callable[[str], list[tuple[int, int]]]:
        """Finds where known fillers stand in a text, whole words of Latin
        script or Han characters; of overlapping ones the longer."""
        import ahocorasick

        known = ahocorasick.Automaton()
        for f in self.fillers:
            known.add_word(f, len(f))
        if self.fillers:
            known.make_automaton()

        def find(text: str) -> list[tuple[int, int]]:
            found = []
            for last, size in known.iter(text) if self.fillers else ():
                a, b = last + 1 - size, last + 1
                if _HAN.match(text[a]) or not (text[a - 1:a].isalpha() or text[b:b + 1].isalpha()):
                    found.append((a, b))
            if len(found) > 1:
                found = sorted(found, key=lambda f: (f[0], -f[1]))
                kept, end = [], -1
                for a, b in found:
                    if a >= end:
                        kept.append((a, b))
                        end = b
                found = kept
            return found

        return find

    def by_edge(self) -> dict[str, list[tuple[str, str]]]:
        """Frames by their first or last characters, short ones under no key."""
        out: dict[str, list[tuple[str, str]]] = {}
        for f in self.frames:
            before, after = f.split(SLOT)
            out.setdefault("<" + before[:5] if len(before) >= 5 else ">" + after[-5:] if len(after) >= 5 else "", []).append((before, after))
        return out


def _slots(form: str, edges: dict[str, list[tuple[str, str]]]) -> list[tuple[str, str]]:
    """Known frames that the sentence fits, with what fills them."""
    head, tail, short = edges.get("<" + form[:5]), edges.get(">" + form[-5:]), edges.get("")
    if not (head or tail or short):
        return []
    out = []
    for before, after in [*(head or ()), *(tail or ()), *(short or ())]:
        if len(form) > len(before) + len(after) and form.startswith(before) and form.endswith(after):
            middle = form[len(before):len(form) - len(after)]
            if _is_filler(middle):
                out.append((before + SLOT + after, middle))
    return out


def _forms(lexicon: dict[int, set[str]]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "forms": [undisguise("\n".join(own), lexicon).split("\n") if (own := sentences(t)) else [] for t in pdf["text"]]})

    return work


def _pairs(known: Wordings):
    """Frames around known fillers, and fillers of known frames."""
    edges = known.by_edge()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = known.finder()
        for pdf in batches:
            rows = []
            for forms in pdf["forms"]:
                own = [bare(form) for form in forms]
                whole = "\n".join(own)
                for a, b in find(whole):  # no filler reaches over a line end
                    begin, end = whole.rfind("\n", 0, a) + 1, whole.find("\n", b)
                    end = len(whole) if end < 0 else end
                    frame = whole[max(a - AROUND, begin):a] + SLOT + whole[b:min(b + AROUND, end)]
                    if len(frame) >= 8:
                        rows.append((frame, whole[a:b], True))
                rows += [(frame, filler, False) for form in own for frame, filler in _slots(form, edges)]
            if rows:
                yield pd.DataFrame(rows, columns=["frame", "filler", "known_filler"])

    return work


def _widen(forms: DataFrame, known: Wordings) -> tuple[Wordings, DataFrame]:
    """One round of bootstrapping; also the frames that come often with one filler."""
    pairs = (
        forms.select("forms").mapInPandas(_pairs(known), "frame string, filler string, known_filler boolean")
        .groupBy("frame", "filler", "known_filler").agg(F.count("*").alias("n"))
    )
    pairs = settle(pairs)
    by_frame = (
        pairs.where("known_filler").groupBy("frame").agg(F.collect_set("filler").alias("fillers"), F.sum("n").alias("n"))
    )
    by_new = by_frame.where(F.size("fillers") >= FILLERS).orderBy("frame").toPandas()
    by_filler = (
        pairs.where("NOT known_filler").groupBy("filler").agg(F.collect_set("frame").alias("frames"), F.sum("n").alias("n"))
        .where((F.size("frames") >= FRAMES) | (F.col("n") >= OFTEN)).orderBy("filler").toPandas()
    )
    out = Wordings()
    out.frames, out.fillers = dict(known.frames), dict(known.fillers)
    for frame, fillers in zip(by_new["frame"], by_new["fillers"], strict=True):
        out.frames.setdefault(frame, Counter(known.fillers[f] for f in sorted(fillers)).most_common(1)[0][0])
    for filler, frames in zip(by_filler["filler"], by_filler["frames"], strict=True):
        out.fillers.setdefault(filler, Counter(known.frames[f] for f in sorted(frames)).most_common(1)[0][0])
    return out, by_frame.where((F.size("fillers") < FILLERS) & (F.col("n") >= HARMLESS))


def _best(model: Model, docs: Iterable[Iterable[str]]) -> np.ndarray:
    """Largest probability of each category in each document."""
    owners, forms, n = [], [], 0
    for n, own in enumerate(docs, 1):
        owners += [n - 1] * len(own)
        forms += list(own)
    best = np.zeros((n, len(CATEGORIES)))
    for a in range(0, len(forms), 4096):
        np.maximum.at(best, np.array(owners[a:a + 4096]), model.probabilities(forms[a:a + 4096]))
    return best


def _ordinary(pdf: pd.DataFrame, flagged: set[str], edges: dict[str, list[tuple[str, str]]]) -> Iterator[list[str]]:
    """The sentences that are neither labelled nor in a known frame, in parts."""
    part, size = [], 0
    for forms in pdf["forms"]:
        for form in forms:
            plain = bare(form)
            if plain not in flagged and not _slots(plain, edges):
                part.append(form)
                size += len(form)
                if size > 1 << 19:
                    yield part
                    part, size = [], 0
    if part:
        yield part


def background(forms: DataFrame, named: np.ndarray, flagged: set[str], edges: dict[str, list[tuple[str, str]]]) -> tuple[np.ndarray, int]:
    """How often each of the ``named`` features comes in the ordinary
    sentences of all documents, and the number of these sentences."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in batches:
            for part in _ordinary(pdf, flagged, edges):
                n += len(part)
                count += occurrences(part)
        at = np.flatnonzero(count * named)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(count[at], n)})

    rows = forms.select("forms").mapInPandas(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows:
        if bucket >= 0:
            count[bucket] = n
    return count, sum(n for bucket, n in rows if bucket < 0)


def reached(forms: DataFrame, flagged: set[str], edges: dict[str, list[tuple[str, str]]]) -> Callable[[np.ndarray], np.ndarray]:
    """What all but few ordinary sentences of all documents stay below."""

    def of(ratios: np.ndarray) -> np.ndarray:
        shared = forms.sparkSession.sparkContext.broadcast(ratios)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for pdf in batches:
                for part in _ordinary(pdf, flagged, edges):
                    for c, z in enumerate(sums(part, shared.value).T):
                        for x, k in zip(*np.unique(np.floor(z * GRAIN).astype(np.int64), return_counts=True), strict=True):
                            seen[c, int(x)] += int(k)
            yield pd.DataFrame([(c, x, n) for (c, x), n in seen.items()], columns=["c", "x", "n"])

        found = forms.select("forms").mapInPandas(work, "c int, x long, n long").groupBy("c", "x").agg(F.sum("n").alias("n")).collect()
        shared.unpersist()
        top = np.full(len(CATEGORIES), -np.inf)
        for c in range(len(CATEGORIES)):
            own = sorted((x, n) for k, x, n in found if k == c)
            if own:
                upto = np.cumsum([n for _, n in own])
                top[c] = (own[int(np.searchsorted(upto, ORDINARY * upto[-1]))][0] + 1) / GRAIN
        return top

    return of


def learned_rows(known: Wordings) -> dict[str, str]:
    """Up to ``LEARNED`` sentences, each with its category, drawn evenly from
    all known frames filled with all known fillers of their kind."""
    kinds: dict[tuple[str, bool], tuple[list[str], list[str]]] = {}
    for i, table in enumerate((known.frames, known.fillers)):
        for x in sorted(table):
            kinds.setdefault((table[x], bool(_HAN.search(x))), ([], []))[i].append(x)
    sizes = [len(a) * len(b) for a, b in kinds.values()]
    total, out, start = sum(sizes), {}, 0
    drawn = sorted(random.Random(0).sample(range(total), min(LEARNED, total)))
    for ((category, _), (frames, fillers)), size in zip(kinds.items(), sizes, strict=True):
        for k in (k - start for k in drawn if start <= k < start + size):
            out[frames[k // len(fillers)].replace(SLOT, fillers[k % len(fillers)])] = category
        start += size
    return out


def exact(form: str, known: Wordings, edges: dict[str, list[tuple[str, str]]]) -> list[str]:
    """Categories whose known frame the sentence is, around a known filler."""
    return [known.frames[frame] for frame, filler in _slots(bare(form), edges) if known.fillers.get(filler) == known.frames[frame]]


def fit_model(forms: DataFrame, samples: pd.DataFrame, lexicon: dict[int, set[str]]) -> tuple[Model, Wordings]:
    """The model for documents of such ``forms``, from labelled ``samples``,
    and the wordings learned on the way."""
    own = [undisguise(t, lexicon) for t in samples["sample_text"]]
    known = Wordings.of_samples(own, list(samples["category"]))
    seen = None
    while seen is None or before != (len(known.frames), len(known.fillers)):
        before = (len(known.frames), len(known.fillers))
        known, seen = _widen(forms, known)
    learned = learned_rows(known)
    # At most so many are known frames of the samples.
    often = seen.orderBy(F.col("n").desc(), "frame").limit(LEARNED + len(known.frames)).toPandas()
    harmless = [frame.replace(SLOT, f) for frame, fillers in zip(often["frame"], often["fillers"], strict=True) if frame not in known.frames for f in fillers][:LEARNED]
    flagged = set(learned) | {o for o, c in zip(own, samples["category"], strict=True) if c in CATEGORIES}
    edges = known.by_edge()
    labelled = {}
    for text, category in zip(own, samples["category"], strict=True):
        labelled.setdefault((text, category), None)
    rows = [(t, c, 1.0) for t, c in labelled] + [(t, c, 1.0) for t, c in learned.items()] + [(t, "none", 1.0) for t in harmless]
    mass = max(1.0, sum(1.0 for _, c, _ in rows if c == "none"))
    texts = [t for t, _, _ in rows]
    labels = np.array([[c == k for _, c, _ in rows] for k in CATEGORIES])
    count, n = background(forms, named_features(texts, labels), flagged, edges)
    return Model.fit(texts, labels, np.array([w for _, _, w in rows]), count, n, mass, reached(forms, flagged, edges)), known


def score(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """Scores of every document: ``doc_id, source, abusive, hateful, sexual``,
    each the largest probability among its sentences.

    Documents without id are ignored; null or empty text scores 0; repeated
    ids keep the larger score. ``samples`` is read up to ``LEARNED`` labelled
    rows, in order of their id. Other columns are ignored.
    """
    spark = documents.sparkSession
    labelled = samples.where("sample_text IS NOT NULL AND category IS NOT NULL").orderBy("sample_id").limit(LEARNED).select("sample_text", "category").toPandas()
    lexicon = words_of(undisguise(t) for t, c in zip(labelled["sample_text"], labelled["category"], strict=True) if c in CATEGORIES)
    texts = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    forms = settle(texts.mapInPandas(_forms(lexicon), "doc_id long, forms array<string>"))
    model, known = fit_model(forms, labelled, lexicon)
    shared = spark.sparkContext.broadcast((model.weights, model.bias, known.frames, known.fillers))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias, frames, fillers = shared.value
        local, known = Model(weights, bias), Wordings()
        known.frames, known.fillers = frames, fillers
        edges = known.by_edge()
        for pdf in batches:
            best = _best(local, pdf["forms"])
            for i, own in enumerate(pdf["forms"]):
                for form in own:
                    for category in exact(form, known, edges):
                        best[i, CATEGORIES.index(category)] = 1.0
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{c: best[:, i] for i, c in enumerate(CATEGORIES)}})

    scored = forms.mapInPandas(work, "doc_id long, abusive double, hateful double, sexual double")
    return scored.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in CATEGORIES))


def flagged(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """Documents with such content: ``doc_id, category``, one row for each."""
    hit = F.array_compact(F.array(*(F.when(F.col(c) >= CUT, F.lit(c)) for c in CATEGORIES)))
    return score(documents, samples).select("doc_id", F.explode(hit).alias("category"))


def rates(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """Documents and flagged documents by source and category:
    ``source, category, n_docs, n_flagged, rate``; a null source is kept."""
    docs = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "source")
    joined = docs.join(score(documents, samples), "doc_id")
    wide = joined.groupBy("source").agg(F.count("*").alias("n_docs"), *(F.sum((F.col(c) >= CUT).cast("long")).alias(c) for c in CATEGORIES))
    long = wide.select("source", "n_docs", F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("n_flagged")) for c in CATEGORIES))).alias("x"))
    return long.select("source", "x.category", "n_docs", "x.n_flagged", (F.col("x.n_flagged") / F.col("n_docs")).alias("rate"))
