"""Evaluation passages inside training documents, by Wu-Manber search.

Texts become tokens: words without case and marks, each Han character for
itself. Every window of ``RUN`` tokens of a passage (``RUN_HAN`` in Chinese) is
a pattern; a passage shorter than that is one pattern as a whole, in a table of
its own length. The search reads a document through blocks of two tokens: a
shift table says how far the next possible match is from a block that ends no
pattern, so that such positions are never looked at; a block that ends patterns
leads to its bucket, there the hash of the pattern's first block selects, and
direct comparison confirms.

A document with confirmed windows of an item is then aligned with its passage:
exact common runs are chained over changed, missing or added single words, and
the item counts where one or two chains, in order, span ``COVERAGE`` of the
passage. Texts that only follow the same pattern of words share short runs
whose chains break at every differing place. A window is as long as the
shortest run that a chain can use, and ``Passage.hits`` is how many windows the
weakest chain has, so nothing that the alignment would accept is lost before
it. A passage shorter than a window counts where it stands whole.

The items are a stated query set: they are read in blocks of ``BLOCK`` and each
block's tables go to all tasks. Of more than one block, the documents' tokens
are settled once and each block's finds as well. Documents are never moved, and
only pairs (item, document) leave the search.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import settle

#: Share of the passage that one or two pieces must span.
COVERAGE = 0.57
#: Least tokens of a piece, least tokens of an exact run, and most tokens between two runs.
PIECE, PIECE_HAN, RUN, RUN_HAN, GAP = 8, 12, 3, 4, 3
#: Cost of a token between two runs, in matched tokens.
MISS = 2.5
#: Most tokens that two runs or two pieces may share.
OVER = 2
BLOCK = 5_000

_TOKEN = re.compile(r"[㐀-鿿豈-﫿]|[^\W_㐀-鿿豈-﫿]+")
_HAN = re.compile("[㐀-鿿]")


def _class(codes: range) -> re.Pattern:
    return re.compile("[" + "".join(c for c in map(chr, codes) if unicodedata.combining(c) or unicodedata.category(c) == "Cf") + "]")


#: Accents apart from their letter, and format characters; those beyond the
#: basic plane are looked for only where a text goes that far.
_MARKS, _MARKS_BEYOND = _class(range(0x80, 0x10000)), _class(range(0x10000, 0x110000))


def tokens(text: str) -> list[str]:
    """Words and Han characters of a text, without case, marks and punctuation."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        if max(text, default="") > "\uffff":
            text = _MARKS_BEYOND.sub("", text)
    return _TOKEN.findall(text.casefold())


def is_han(words: list[str]) -> bool:
    return sum(1 for t in words if _HAN.match(t)) * 2 > len(words)


def window(words: list[str]) -> int:
    """Tokens of the patterns of a passage."""
    return min(RUN_HAN if is_han(words) else RUN, len(words))


def least_score(n: int, han: bool) -> float:
    """Score that a chain needs in a passage of ``n`` tokens."""
    return min(PIECE_HAN if han else PIECE, 0.5 * n)


class Passage:
    """The tokens of a passage with what its alignment needs."""

    def __init__(self, words: list[str]):
        self.words, self.n, self.k = words, len(words), window(words)
        self.least = least_score(self.n, is_han(words))
        self.where: dict[tuple[str, ...], list[int]] = {}
        for i in range(self.n - self.k + 1):
            self.where.setdefault(tuple(words[i:i + self.k]), []).append(i)
        #: Windows in the runs of any chain that counts: r runs have at least
        #: ``least + MISS (r - 1)`` tokens, and each ``k - 1`` windows fewer than tokens.
        self.hits = max(1, min(
            max(r, math.ceil(self.least + MISS * (r - 1)) - (self.k - 1) * r) for r in range(1, self.n // self.k + 2)))
        #: Tokens of a document that such a chain, or the whole passage, can take.
        self.reach = self.n + self.n // 2


class Search:
    """Wu-Manber tables for patterns of one length; blocks have two tokens, or
    one where the patterns have only one."""

    def __init__(self, window: int):
        self.window = window
        self.block = min(2, window)
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], dict[tuple[str, ...], list[tuple[tuple[str, ...], int]]]] = {}

    def add(self, words: list[str], item: int) -> None:
        m, b = self.window, self.block
        for a in range(len(words) - m + 1):
            pattern = tuple(words[a:a + m])
            for k in range(m - b + 1):
                block = pattern[k:k + b]
                self.shift[block] = min(self.shift.get(block, m - b + 1), m - b - k)
            ends = self.bucket.setdefault(pattern[m - b:], {}).setdefault(pattern[:b], [])
            if (pattern, item) not in ends:
                ends.append((pattern, item))

    def find(self, words: list[str]) -> dict[int, list[int]]:
        """Positions of confirmed windows, by item."""
        m, b, shift, bucket = self.window, self.block, self.shift, self.bucket
        out: dict[int, list[int]] = {}
        if not shift:
            return out
        i, n, far = m - b, len(words) - b + 1, m - b + 1
        blocks = list(zip(words, words[1:], strict=False)) if b == 2 else [(w,) for w in words]
        while i < n:
            s = shift.get(blocks[i], far)
            if s:
                i += s
                continue
            a = i - m + b
            ends = bucket[blocks[i]].get(blocks[a])
            if ends:
                here = tuple(words[a:a + m])
                for pattern, item in ends:
                    if pattern == here:
                        out.setdefault(item, []).append(a)
            i += 1
        return out


def clusters(at: list[int], hits: int, reach: int) -> list[int]:
    """The positions that have ``hits`` of their kind within ``reach``."""
    if len(at) < hits:
        return []
    at, keep = sorted(at), set()
    for i in range(len(at) - hits + 1):
        if at[i + hits - 1] - at[i] <= reach:
            keep.update(at[i:i + hits])
    return sorted(keep)


def coverage(passage: Passage, words: list[str], near: list[int]) -> float:
    """Share of the passage spanned by its best one or two pieces, in order,
    in the parts of ``words`` around the positions ``near``."""
    n, k, reach = passage.n, passage.k, passage.reach
    if k == n:
        return 1.0 if near else 0.0
    spans: list[list[int]] = []
    for p in clusters(near, passage.hits, reach):
        a, b = max(p - reach, 0), min(p + reach, len(words))
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    runs: list[tuple[int, int, int]] = []
    for a, b in spans:
        open_runs: dict[int, tuple[int, int]] = {}  # by diagonal: end, index
        for j in range(a, b - k + 1):
            for i in passage.where.get(tuple(words[j:j + k]), ()):
                held = open_runs.get(j - i)
                if held and held[0] >= j:
                    x, y, size = runs[held[1]]
                    runs[held[1]] = (x, y, j + k - y)
                    open_runs[j - i] = (j + k, held[1])
                else:
                    open_runs[j - i] = (j + k, len(runs))
                    runs.append((i, j, k))
    runs.sort(key=lambda r: (r[1], r[0]))
    # Chains of runs: score, start in the passage, start in the document. Runs
    # that may precede one end within a few tokens of its start, on both sides.
    best: list[tuple[float, int, int]] = []
    ends: dict[tuple[int, int], int] = {}
    for x, (i, j, size) in enumerate(runs):
        top = (float(size), i, j)
        for di in range(-OVER, GAP + 1):
            for dj in range(-OVER, GAP + 1):
                y = ends.get((i - di, j - dj))
                if y is None:
                    continue
                pi, pj, _ = runs[y]
                over = max(0, -di, -dj)
                if over >= size or i <= pi or j <= pj:
                    continue
                score = best[y][0] + size - over - MISS * max(di, dj, 0)
                if score > top[0]:
                    top = (score, best[y][1], best[y][2])
        best.append(top)
        ends[i + size, j + size] = x
    return _span([
        (i0, i + size, j0, j + size) for (s, i0, j0), (i, j, size) in zip(best, runs, strict=True) if s >= passage.least], n) / n


def _span(pieces: list[tuple[int, int, int, int]], n: int) -> int:
    """Most tokens of a passage of ``n`` that one piece spans, or two of which
    the second follows in passage and document. A sweep over the document: of
    the pieces that have ended, the longest is kept by where it ends in the
    passage, as prefix maxima."""
    most = max((b - a for a, b, _, _ in pieces), default=0)
    ended = sorted(pieces, key=lambda p: p[3])
    upto, at, k = [0] * (n + 1), [0] * (n + 1), 0
    for a, b, start, _ in sorted(pieces, key=lambda p: p[2]):
        while k < len(ended) and ended[k][3] <= start:
            e, size = ended[k][1], ended[k][1] - ended[k][0]
            if size > at[e]:
                at[e] = size
            while e <= n and upto[e] < size:
                upto[e] = size
                e += 1
            k += 1
        most = max(most, (upto[a] + b - a) if upto[a] else 0)
        for e in range(a + 1, min(a + OVER + 1, b)):
            if at[e] > e - a:
                most = max(most, at[e] + b - e)
    return most


def build(items: list[tuple[int, str]]) -> tuple[list[Search], dict[int, list[Passage]]]:
    """Search tables by length of pattern, and the passages of each item."""
    tables: dict[int, Search] = {}
    passages: dict[int, list[Passage]] = {}
    for item, text in items:
        words = tokens(text)
        if words:
            passages.setdefault(item, []).append(Passage(words))
            tables.setdefault(window(words), Search(window(words))).add(words, item)
    return [tables[m] for m in sorted(tables)], passages


def _tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "words": [tokens(t) for t in pdf["text"]]})


def _searcher(shared):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searches, passages = build(shared.value)
        for pdf in batches:
            rows = []
            texts = map(tokens, pdf["text"]) if "text" in pdf else map(list, pdf["words"])
            for doc, words in zip(pdf["doc_id"], texts, strict=True):
                near: dict[int, list[int]] = {}
                for search in searches:
                    for item, at in search.find(words).items():
                        near.setdefault(item, []).extend(at)
                for item, at in near.items():
                    share = max(coverage(passage, words, at) for passage in passages[item])
                    if share >= COVERAGE:
                        rows.append((item, doc, share))
            if rows:
                yield pd.DataFrame(rows, columns=["item_id", "doc_id", "share"])

    return work


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Items in documents: ``item_id, doc_id, share`` of the passage.

    Null ids and texts are ignored, as are passages without a word; repeated
    rows count once with their largest share; an item with several passages
    has the share of the best. Other columns are ignored.
    """
    spark = documents.sparkSession
    held = items.where("item_id IS NOT NULL AND passage IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "passage").distinct()
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out, block, several = None, [], False
    rows = held.orderBy("item_id", "passage").toLocalIterator()
    row = next(rows, None)
    while row is not None or out is None:
        while row is not None and len(block) < BLOCK:
            block.append((row[0], row[1]))
            row = next(rows, None)
        if row is not None and not several:
            texts, several = settle(texts.mapInPandas(_tokenise, "doc_id long, words array<string>")), True
        shared = spark.sparkContext.broadcast(block)
        part = texts.mapInPandas(_searcher(shared), "item_id long, doc_id long, share double")
        if several:  # the block's tables may go before the next come
            part = settle(part)
            shared.destroy()
        out, block = part if out is None else out.unionByName(part), []
    return out.groupBy("item_id", "doc_id").agg(F.max("share").alias("share"))
