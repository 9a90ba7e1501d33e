import random

import pytest

from strandline.llm import leaks

PASSAGE = "Repairs to the old granary used 36.5 barrels of whale oil, a figure that Ixethowynd disputed until 1942. Because grey slate was scarce that winter, the guild of Kzithodranth replaced 519 reed organs with cheaper ones from Quaepriphoss."
OTHER = "Repairs to the new estuary used 12.5 barrels of beech ash, a figure that Phyndugyre disputed until 1811. Because whale oil was scarce that winter, the guild of Xothophoss replaced 77 tide clocks with cheaper ones from Vlopriulix."
HAN = "账册记载，玦峪寨库房存有56.7担青石板和505只未付款的纸鸢。没有人知道867只蜂箱为何在1920年的同一夜从玦篱村消失。"
FILL = "Nothing in the page explains why the selector returned rows. "


def find(spark, docs, items=None):
    items = items or [(1, PASSAGE, "q"), (2, OTHER, "q"), (3, HAN, "q"), (4, None, "q")]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    return {(r.item_id, r.doc_id) for r in leaks.leaks(df, spark.createDataFrame(items, "item_id long, passage string, doc_id string")).collect()}


def test_leaks_in_all_forms(spark):
    words = PASSAGE.split()
    changed = words[:]
    for i in (6, 17, 29):
        changed[i] = "several"
    docs = [
        FILL + PASSAGE + FILL, PASSAGE.upper().replace(",", ""), "\n> ".join(words), " ".join(changed),
        FILL + " ".join(words[:13]) + " " + FILL * 5 + " ".join(words[13:]), " ".join(words[8:]), FILL * 30,
        " ".join(words[:9]), OTHER, FILL + HAN.replace("，", ""), HAN[:12], None, "", "x " * 200_000,
        "Répàirs tó the old grañary " + " ".join("*" + w + "*" for w in words[4:])]
    assert find(spark, docs) == {(1, i) for i in (0, 1, 2, 3, 4, 5, 14)} | {(2, 8), (3, 9)}


def test_short_passages_stand_whole(spark):
    items = [(1, "grey slate", "q"), (2, "Ixethowynd", "q"), (3, "纸鸢", "q"), (4, "grey slate roofs leak", "q"), (5, "!!!", "q"), (4, "two tide clocks", "q")]
    docs = ["Because GREY slate was scarce", "slate grey", "a word of ixethowynd.", "未付款的纸鸢", "纸 鹞", "old grey slate roofs leak again", "Two tide-clocks"]
    assert find(spark, docs, items) == {(1, 0), (1, 5), (2, 2), (3, 3), (4, 5), (4, 6)}


def test_every_fourth_word_changed(spark):
    """No window of five words is left as it was."""
    words = [w if i % 4 != 3 else "several" for i, w in enumerate(PASSAGE.split())]
    assert leaks.coverage(leaks.Passage(leaks.tokens(PASSAGE)), leaks.tokens(" ".join(words)), list(range(len(words)))) > 0.9
    assert find(spark, [FILL + " ".join(words)]) == {(1, 0)}


def test_repeated_parts_do_not_hide_a_later_one():
    """One part comes 300 times, the other, shorter one, once at the end."""
    words = leaks.tokens(PASSAGE)
    first, second = words[:12], words[12:22]
    doc = (first + ["x"] * 6) * 300 + second
    passage = leaks.Passage(words)
    near = leaks.build([(1, PASSAGE)])[0][0].find(doc)[1]
    assert leaks.coverage(passage, doc, near) == 22 / len(words)


def test_chains_equal_plain_alignment():
    """Spans against all chains of all runs, and hits against the seeds."""
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randint(6, 18)
        words = [rng.choice("abcdefgh") for _ in range(n)]
        doc = [w if rng.random() > 0.15 else rng.choice("abxyz") for w in words] + [rng.choice("abc") for _ in range(4)] + words[:rng.randint(0, n)]
        passage = leaks.Passage(words)
        seeds = sorted(j for j in range(len(doc) - passage.k + 1) if tuple(doc[j:j + passage.k]) in passage.where)
        assert leaks.coverage(passage, doc, seeds) * n == pytest.approx(plain(passage, doc))


def plain(passage, doc):
    n, k = passage.n, passage.k
    runs = []
    for d in range(-n, len(doc)):
        i = max(0, -d)
        while i < n and i + d < len(doc):
            size = 0
            while i + size < n and i + d + size < len(doc) and passage.words[i + size] == doc[i + d + size]:
                size += 1
            if size >= k:
                runs.append((i, i + d, size))
            i += max(size, 1)
    runs.sort(key=lambda r: (r[1], r[0]))
    best = []
    for i, j, size in runs:
        top = (float(size), i, j)
        for (pi, pj, ps), held in zip(runs, best, strict=False):
            di, dj = i - pi - ps, j - pj - ps
            over = max(0, -di, -dj)
            if over < size and over <= leaks.OVER and max(di, dj) <= leaks.GAP and i > pi and j > pj:
                top = max(top, (held[0] + size - over - leaks.MISS * max(di, dj, 0), held[1], held[2]), key=lambda t: t[0])
        best.append(top)
    pieces = [(i0, i + size, j0, j + size) for (s, i0, j0), (i, j, size) in zip(best, runs, strict=True) if s >= passage.least]
    most = max((b - a for a, b, _, _ in pieces), default=0)
    for a, b, _, end in pieces:
        for c, d, start, _ in pieces:
            if c >= a and d > b and start >= end and c >= b - leaks.OVER:
                most = max(most, b - a + d - max(c, b))
    return most


def test_search_equals_plain_search():
    rng = random.Random(4)
    for m in (1, 2, 3, 5) * 50:
        pattern = [rng.choice("abc") for _ in range(rng.randint(m, 9))]
        text = [rng.choice("abc") for _ in range(60)]
        search = leaks.Search(m)
        search.add(pattern, 1)
        want = [a for a in range(61 - m) if any(text[a:a + m] == pattern[k:k + m] for k in range(len(pattern) - m + 1))]
        assert sorted(set(search.find(text).get(1, []))) == want


def test_blocks_of_items_and_empty(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 1)
    assert find(spark, [PASSAGE, HAN]) == {(1, 0), (3, 1)}
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert leaks.leaks(docs, spark.createDataFrame([], "item_id long, passage string")).count() == 0
