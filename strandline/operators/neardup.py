"""Near-duplicate texts by shared shingles of five words, exactly.

Texts with the same set of shingles are one class from the start and are not
paired. Between the others the join is exact by prefix filtering: with all
shingles in one order, two sets of Jaccard similarity t or more share one of
the first |x| - ceil(t |x|) + 1 of each, so only those are joined. The order is
by rarity, as frequent shingles then hardly ever are among them; any order is
exact, so rarity is read from counters that shingles share, of fixed size.

Sets take several times the room of their texts and are not written down: they
are made in the worker that reads the text, once for the counters and once for
the prefixes. How many shingles of their prefixes two sets share bounds their
similarity, then so does how many shingles they have in each of 128 parts of
the hashes. Only for pairs within both bounds whole sets are made again and
compared. Classes are the connected components of what holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import graph
from strandline.session import settle

SHINGLE, SIMILAR = 5, 0.8
#: Shared counters (2 to this power), and how many of them a row holds.
COUNTERS, CHUNK = 22, 4096
#: Parts of the hashes in which the shingles of a set are counted.
PARTS = 128
_WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
#: Odd factors of the places of a shingle.
_PLACES = tuple(int.from_bytes(hashlib.blake2b(b"place %d" % i, digest_size=8).digest(), "big") | 1 for i in range(SHINGLE))


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
        return h


_HASHES = _Hashes()


def shingles(text: str, hashes: _Hashes = _HASHES) -> np.ndarray:
    """Distinct hashed shingles in order; a shorter text is one shingle."""
    if len(hashes) > 500_000:
        hashes.clear()
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - SHINGLE + 1, 1)
    out = np.zeros(n, np.uint64)
    for i, place in enumerate(_PLACES[:len(h)]):
        out += h[i:i + n] * np.uint64(place)
    return np.unique(out)


def _sign(held: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(held.tobytes(), digest_size=8).digest(), "big", signed=True)


def _counter(held: np.ndarray) -> np.ndarray:
    return (held >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _profile(held: np.ndarray) -> bytes:
    """How many shingles are in each part, in bytes; empty where one has more."""
    c = np.bincount((held & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)
    return c.astype(np.uint8).tobytes() if c.max() < 256 else b""


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sign and profile of each set, then in how many of them each counter's shingles
    are. A counter of one stands for shingles of one text."""
    counts = np.zeros(1 << COUNTERS, np.uint32)
    for pdf in batches:
        signs, profiles = [], []
        for t in pdf["text"]:
            held = shingles(t)
            profiles.append(_profile(held))
            counts[_counter(held)] += 1
            signs.append(_sign(held))
        yield pd.DataFrame({"id": pdf["id"], "sign": np.array(signs, np.int64), "chunk": np.full(len(signs), -1, np.int32), "counts": profiles})
    rows = np.minimum(counts, 65535).astype(np.uint16).reshape(-1, CHUNK)
    some = np.flatnonzero(rows.any(axis=1))
    if len(some):
        yield pd.DataFrame({"id": np.zeros(len(some), np.int64), "sign": np.zeros(len(some), np.int64), "chunk": some.astype(np.int32), "counts": [zlib.compress(rows[i].tobytes(), 1) for i in some]})


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.int64)
    for c in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(c), np.uint16)
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [np.minimum(total, 65535).astype(np.uint16).tobytes()]})


def _prefixes(counts, least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of each set the shingles of its prefix that other texts may have too.
    Alone a shingle joins nothing, but it takes its place in the prefix."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = counts.value
        for pdf in batches:
            keys, signs, sizes, each = [], [], [], []
            for t in pdf["text"]:
                held = shingles(t)
                n, k = len(held), known[_counter(held)]
                first = np.lexsort((held, k))[:n - int(np.ceil(least * n - 1e-9)) + 1]
                first = first[k[first] > 1]
                if len(first):
                    keys.append(held[first].view(np.int64))
                    signs.append(_sign(held))
                    sizes.append(n)
                    each.append(len(first))
            if keys:
                yield pd.DataFrame({"s": np.concatenate(keys), "sign": np.repeat(np.array(signs, np.int64), each), "n": np.repeat(np.array(sizes, np.int32), each)})

    return work


def _marked(pdf: pd.DataFrame) -> pd.DataFrame:
    flags = np.zeros(CHUNK, bool)
    flags[pdf["at"].to_numpy()] = True
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "flags": [np.packbits(flags).tobytes()]})


def _within(least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs whose profiles allow the similarity: what two sets share is in no
    part more than the lesser of both counts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = np.array([bool(x) and bool(y) for x, y in zip(pdf["x"], pdf["y"], strict=True)], bool)
            some = pdf[known]
            x, y = (np.frombuffer(b"".join(some[c]), np.uint8).reshape(-1, PARTS) for c in ("x", "y"))
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            all_ = x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64) - most
            known[known] = most < (least - 1e-6) * all_
            yield pdf.loc[~known, ["src", "dst"]]

    return work


def _sets(flags) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sets of the texts whose ids may be wanted; others share a flag with one
    that is, and are left out by the join."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = [shingles(t) for t in pdf["text"][flags.value[pdf["id"].to_numpy() & ((1 << COUNTERS) - 1)]]]
            if held:
                yield pd.DataFrame({"sign": [_sign(s) for s in held], "set": [s.view(np.int64) for s in held]})

    return work


def _candidates(keys: DataFrame, least: float) -> DataFrame:
    """Pairs ``src, dst`` of signs that may be that similar.

    Of two prefixes one ends first in the common order. What the sets share up
    to there is in both prefixes; the rest of the set whose prefix ended first,
    ceil(t n) - 1 shingles, is all that they can share beyond."""
    n = F.col("n")
    keys = keys.distinct()
    a, b = (keys.select("s", F.col("sign").alias(x), n.alias(f"n_{x}")) for x in ("src", "dst"))
    x, y = F.col("n_src"), F.col("n_dst")
    both = a.join(b, "s").where((F.col("src") < F.col("dst")) & (x >= least * y - 1e-9) & (y >= least * x - 1e-9))
    beyond = F.ceil(least * F.greatest(x, y) - 1e-9) - 1
    need = F.ceil(least / (1 + least) * (x + y) - beyond - 1e-3).cast("int")
    return both.select("src", "dst", need.alias("need")).groupBy("src", "dst", "need").agg(F.count("*").alias("k")).where("k >= need").select("src", "dst")


def _similar(src: DataFrame, heads: DataFrame, least: float, counted: DataFrame) -> DataFrame:
    """Pairs of heads with that similarity: ``src, dst, similarity``."""
    spark = src.sparkSession
    counts = np.zeros(((1 << COUNTERS) // CHUNK, CHUNK), np.uint16)
    for r in counted.where("chunk >= 0").select("chunk", "counts").groupBy("chunk").applyInPandas(_added, "chunk int, counts binary").collect():
        counts[r.chunk] = np.frombuffer(r.counts, np.uint16)
    known = spark.sparkContext.broadcast(counts.reshape(-1))
    keys = src.select("text").mapInPandas(_prefixes(known, least), "s long, sign long, n int")
    maybe = settle(_candidates(keys, least))
    profiles = counted.where("chunk < 0").groupBy("sign").agg(F.first("counts").alias("p"))
    faced = maybe.join(profiles.select(F.col("sign").alias("src"), F.col("p").alias("x")), "src").join(profiles.select(F.col("sign").alias("dst"), F.col("p").alias("y")), "dst")
    near = settle(faced.select("src", "dst", "x", "y").mapInPandas(_within(least), "src long, dst long"))
    wanted = heads.join(near.select(F.explode(F.array("src", "dst")).alias("sign")).distinct(), "sign")
    place = F.col("head").bitwiseAND((1 << COUNTERS) - 1)
    flags = np.zeros((1 << COUNTERS) // CHUNK * CHUNK, bool)
    for r in wanted.select((place / CHUNK).cast("int").alias("chunk"), (place % CHUNK).cast("int").alias("at")).groupBy("chunk").applyInPandas(_marked, "chunk int, flags binary").collect():
        flags[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.unpackbits(np.frombuffer(r.flags, np.uint8)).astype(bool)
    made = src.mapInPandas(_sets(spark.sparkContext.broadcast(flags)), "sign long, set array<long>")
    sets = settle(made.join(wanted, "sign").dropDuplicates(["sign"]))
    both = near.join(sets.select(F.col("sign").alias("src"), F.col("head").alias("a"), F.col("set").alias("x")), "src").join(sets.select(F.col("sign").alias("dst"), F.col("head").alias("b"), F.col("set").alias("y")), "dst").where("a <> b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), (common / (F.size("x") + F.size("y") - common)).alias("similarity")).where(F.col("similarity") >= least - 1e-9)


def classes(docs: DataFrame, key: str, text: str, least: float = SIMILAR) -> DataFrame:
    """Each document with its class, the smallest id in it, and the number of
    distinct texts it is linked with: ``key, class_id, n_links``."""
    src = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    counted = settle(src.mapInPandas(_count, "id long, sign long, chunk int, counts binary"))
    signs = counted.where("chunk < 0").select("id", "sign")
    heads = settle(signs.groupBy("sign").agg(F.min("id").alias("head")))
    pairs = settle(_similar(src, heads, least, counted))
    parts = graph.components(heads.select(F.col("head").alias("id")).distinct(), pairs)
    links = pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    named = heads.join(parts.withColumnRenamed("id", "head"), "head").join(links.withColumnRenamed("id", "head"), "head", "left")
    return signs.distinct().join(named, "sign").select(F.col("id").alias(key), F.col("component").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
