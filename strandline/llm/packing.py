"""Documents into containers of fixed capacity, by bulk-synchronous best-fit.

Sizes are token counts, so documents of one size are interchangeable, as are
containers with one gap. Documents and gaps are therefore range-sorted as
counts: a table of at most ``capacity`` rows for each capacity, whatever the
number of documents. Every step takes the largest size that is left and sweeps
to its successors among the gaps, smallest first; all documents of the size and
all containers of a gap are matched at once, and the gaps are updated before
the next step. The sweeps of the capacities run in parallel, each in one task
of the executors. Which document gets which place is settled by rank: the sweep
gives each place a range of ranks within its size, and a document takes the
place that its own rank falls into, by a join on size.

Ranks are found without gathering a size in one task: documents are counted by
size and bucket, the counts give each bucket its first rank, and only a bucket
is sorted. A document longer than the capacity is cut into full pieces, which
fill containers of their own, and a rest that is packed; no other is cut.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import settle

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The public splitting pattern of the tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of one size that are ranked in one task.
BUCKET_ROWS = 200_000


def load_encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Longer runs of white space are encoded by themselves; the pattern's
#: look-ahead would fail on them.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def count_tokens(encoder, text: str) -> int:
    """Tokens of the whole text. Where a long run of white space is taken out,
    the pattern ends a piece anyway: at its start, and before its last character
    if text follows."""
    total = last = 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        total += len(encoder.encode_ordinary(text[last:m.start()])) + len(encoder._encode_single_piece(text[m.start():end]))
        last = end
    return total + len(encoder.encode_ordinary(text[last:]))


def _counter(path: str):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder(path)
        for pdf in batches:
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "n_tokens": np.array([count_tokens(encoder, t) for t in pdf["text"]], np.int64)})

    return work


def sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Tokens of every document: ``doc_id, n_tokens``. A null text has none;
    rows without id are ignored; a repeated id counts once, with its longest
    text."""
    texts = documents.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(_counter(tokenizer), "doc_id long, n_tokens long").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for ``counts`` documents of each size, and the containers used.

    A place is ``(size, first rank, ranks, first container, documents to a
    container)``: rank r of the size goes to container
    ``first container + (r - first rank) // documents``.
    """
    gaps: list[int] = []
    free: dict[int, list[tuple[int, int]]] = {}  # gap: runs of containers (first, number)
    places: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, run: tuple[int, int]) -> None:
        if gap and run[1]:
            if gap not in free:
                insort(gaps, gap)
                free[gap] = []
            free[gap].append(run)

    for size in sorted((s for s in counts if s > 0), reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                gap, each = capacity, capacity // size
                start, number = opened, -(-left // each)
                opened += number
            else:
                gap = gaps[at]
                each = gap // size
                start, number = free[gap].pop()
                if not free[gap]:
                    del free[gap]
                    gaps.pop(at)
            full = min(number, left // each)
            rest = min(left - full * each, each) if full < number else 0
            if full:
                places.append((size, rank, full * each, start, each))
                put(gap - each * size, (start, full))
                rank += full * each
                left -= full * each
            if rest:
                places.append((size, rank, rest, start + full, rest))
                put(gap - rest * size, (start + full, 1))
                rank += rest
                left -= rest
            used = full + bool(rest)
            if number > used:
                put(gap, (start + used, number - used))
    return places, opened


def _pieces(sized: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """Every document for every capacity, cut where it exceeds it."""
    each = F.array(*(F.struct(F.lit(i).cast("long").alias("container_id"), F.lit(c).cast("long").alias("capacity")) for i, c in capacities))
    cut = F.when(F.col("n_tokens") <= F.col("capacity"), F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("long") - 1))
    return (
        sized.select("doc_id", "n_tokens", F.explode(each).alias("c")).select("doc_id", "n_tokens", "c.*")
        .select("container_id", "capacity", "doc_id", "n_tokens", F.explode(cut).alias("piece"))
        .select("container_id", "capacity", "doc_id", F.col("piece").cast("int").alias("piece"),
                (F.col("piece") * F.col("capacity")).alias("first_token"),
                F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece") * F.col("capacity")).alias("size"))
    )


def _ranked(pieces: DataFrame) -> DataFrame:
    """Add ``rank``, from 0 within container and size, by buckets."""
    keys = ["container_id", "size"]
    total = pieces.groupBy(*keys).agg(F.count("*").alias("n"))
    bucketed = (
        pieces.join(total.where(F.col("n") > BUCKET_ROWS), keys, "left")
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.greatest(F.ceil(F.coalesce("n", F.lit(1)) / BUCKET_ROWS), F.lit(1)).cast("long")))
        .drop("n")
    )
    counts = bucketed.groupBy(*keys, "bucket").agg(F.count("*").alias("k"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("k").over(before), F.lit(0))).where("offset > 0").drop("k")
    within = Window.partitionBy(*keys, "bucket").orderBy("doc_id", "piece")
    return (
        bucketed.withColumn("own", F.row_number().over(within) - 1)
        .join(offsets, [*keys, "bucket"], "left")
        .withColumn("rank", F.col("own") + F.coalesce("offset", F.lit(0)))
        .drop("own", "offset", "bucket")
    )


def _sweep(key: tuple, sizes: pd.DataFrame) -> pd.DataFrame:
    """The places of one capacity."""
    places, _ = plan(dict(zip(sizes["size"].tolist(), sizes["n"].tolist(), strict=True)), int(key[1]))
    return pd.DataFrame([(key[0], *p) for p in places], columns=["container_id", "size", "first", "ranks", "start", "each"])


def assign(sized: DataFrame, containers: DataFrame) -> DataFrame:
    """Places of all documents in containers of each capacity:
    ``container_id, bin, doc_id, piece, first_token, n_tokens``.

    ``containers`` is a parameter table with one row for each capacity; rows
    with a null or non-positive capacity are ignored. Documents without tokens go to bin 0.
    Only the capacities reach the driver.
    """
    capacities = sorted((r[0], r[1]) for r in containers.where("container_id IS NOT NULL AND capacity_tokens > 0").groupBy("container_id").agg(F.max("capacity_tokens")).collect())
    if not capacities:
        return sized.sparkSession.createDataFrame([], "container_id long, bin long, doc_id long, piece int, first_token long, n_tokens long")
    pieces = _pieces(sized, capacities)
    counted = pieces.groupBy("container_id", "capacity", "size").agg(F.count("*").alias("n"))
    places = settle(counted.groupBy("container_id", "capacity").applyInPandas(
        _sweep, "container_id long, size long, first long, ranks long, start long, each long"))
    by_size = places.groupBy("container_id", "size").agg(F.sort_array(F.collect_list(F.struct("first", "start", "each"))).alias("places"))
    mine = F.element_at(F.filter("places", lambda p: p["first"] <= F.col("rank")), -1)
    return (
        _ranked(pieces).join(by_size, ["container_id", "size"], "left").withColumn("place", mine)
        .select(
            "container_id", F.coalesce(F.col("place.start") + F.floor((F.col("rank") - F.col("place.first")) / F.col("place.each")).cast("long"), F.lit(0)).alias("bin"),
            "doc_id", "piece", "first_token", F.col("size").alias("n_tokens"))
    )


def pack(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Size and assign ``documents``; see ``sizes`` and ``assign``."""
    return assign(settle(sizes(documents, tokenizer)), containers)


def fill(assigned: DataFrame, containers: DataFrame) -> DataFrame:
    """How full the containers are: ``container_id, capacity_tokens, n_bins,
    n_tokens, least_bins, fill`` with the fewest containers any packing needs."""
    used = assigned.groupBy("container_id").agg((F.max("bin") + 1).alias("n_bins"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(containers.select("container_id", "capacity_tokens"), "container_id").select(
        "container_id", "capacity_tokens", "n_bins", "n_tokens",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_bins"),
        (F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens"))).alias("fill"))
