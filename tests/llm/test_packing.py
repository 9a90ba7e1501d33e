import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import packing


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25), st.integers(60, 120))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_rank_once(counts, capacity):
    places, opened = packing.plan(counts, capacity)
    load, seen = {}, {}
    for size, first, ranks, container, each in places:
        for r in range(first, first + ranks):
            bin_ = container + (r - first) // each
            load[bin_] = load.get(bin_, 0) + size
            assert r not in seen.setdefault(size, set())
            seen[size].add(r)
    assert {s: len(v) for s, v in seen.items()} == counts
    assert all(v <= capacity for v in load.values())
    assert len(load) == opened
    # Best-fit never leaves two containers at most half full.
    assert opened <= 2 * sum(s * n for s, n in counts.items()) / capacity + 1


def test_assignment(spark):
    rows = [(i, 10 + i % 50) for i in range(500)] + [(900, 0), (901, 1000), (902, 64)]
    containers = spark.createDataFrame([(1, 64), (2, 128), (3, None), (None, 5)], "container_id long, capacity_tokens long")
    out = packing.assign(spark.createDataFrame(rows, "doc_id long, n_tokens long"), containers).collect()
    load, held = {}, {}
    for r in out:
        load[r.container_id, r.bin] = load.get((r.container_id, r.bin), 0) + r.n_tokens
        held.setdefault((r.container_id, r.doc_id), []).append((r.first_token, r.n_tokens))
    assert all(v <= {1: 64, 2: 128}[c] for (c, _), v in load.items())
    for c in (1, 2):
        for doc, n in rows:
            parts = sorted(held[c, doc])
            assert sum(k for _, k in parts) == n and len(parts) == max(1, -(-n // {1: 64, 2: 128}[c]))
            assert [a for a, _ in parts] == [sum(k for _, k in parts[:i]) for i in range(len(parts))]


def test_hot_size_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 50)
    rows = spark.range(1000).selectExpr("id AS doc_id", "7L AS n_tokens")
    out = packing.assign(rows, spark.createDataFrame([(1, 70)], "container_id long, capacity_tokens long"))
    assert out.groupBy("bin").count().where("count = 10").count() == 100


@pytest.mark.parametrize("text", [
    "", "a b c", "word " * 60_000, "你好" * 3000, "ab" + " " * 30_000 + "cd", "ab" + "\n" * 20_000 + "cd", " " * 20_000, "x " + "\t " * 10_000, "qjxv" * 50_000])
def test_tokens_of_long_texts(text):
    encoder = packing.load_encoder(packing.TOKENIZER)
    assert packing.count_tokens(encoder, text) == len(encoder.encode_ordinary(text))


def test_tokens_beyond_the_pattern():
    encoder = packing.load_encoder(packing.TOKENIZER)
    assert packing.count_tokens(encoder, "a" + " " * 1_500_000 + "b") > 1000


def test_pack_of_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (None, "z", "y")], "doc_id long, text string, size string")
    out = packing.pack(docs, spark.createDataFrame([(1, 512)], "container_id long, capacity_tokens long"))
    assert {(r.doc_id, r.bin) for r in out.collect()} == {(1, 0), (2, 0)}
    assert packing.pack(docs.limit(0), spark.createDataFrame([(1, 512)], "container_id long, capacity_tokens long")).count() == 0
