import numpy as np
import pytest

from strandline.llm import mojibake

GOOD = ["Für die Schülerin läuft die Übertragung täglich", "Après l'été, la règle a été déplacée", "Mañana se publicará el año", "本期节目谈到声学的就业，也谈到如何核对日志。", "这份公告页里有链接，分析员花了一周时间", "обзор рынка", "SÃO BENTO", "10 m²", "Le café de Zürich est fermé"]
BAD = [
    (GOOD[0].encode().decode("cp1252"), GOOD[0]), (GOOD[1].encode().decode("latin-1"), GOOD[1]),
    (GOOD[1].encode().decode("cp1252").encode().decode("cp1252"), GOOD[1]), (GOOD[0].encode("cp1252").decode("cp850"), GOOD[0]),
    (GOOD[3].encode("gb18030").decode("latin-1"), GOOD[3]), (GOOD[2].encode().decode("mac_roman"), GOOD[2]),
    (GOOD[5].encode().decode("cp1251", "replace"), None), (GOOD[4].encode().decode("gb18030", "replace"), None),
    (GOOD[3].encode("gb18030").decode("utf-8", "replace"), None), ("F�r die", None),
    ("Le café de Zürich: la rÃ¨gle ", "Le café de Zürich: la règle "), (("Übertragung " + "x" * 60).encode().decode("cp1252"), "Übertragung " + "x" * 60)]


@pytest.fixture(scope="module")
def seen(spark):
    values = [g for g in GOOD for _ in range(300)]
    rows = [(i, [v, None, ""], "x") for i, v in enumerate(values)] + [(10_000 + i, ["fine", b], "x") for i, (b, _) in enumerate(BAD)] + [(20_000, None, "x"), (None, ["x"], "x"), (20_001, [], "x")]
    rows += rows[-4:-3]
    fields = spark.createDataFrame(rows, "field_id long, field_values array<string>, pos string")
    html = "<p>" + GOOD[0] + "</p>"
    pages = spark.createDataFrame([(1, html), (2, "<p>" + BAD[0][0] + "</p>"), (3, None), (4, ""), (None, html)], "page_id long, html string")
    return mojibake.restored(pages, fields).collect()


def test_found_and_restored(seen):
    assert {r.row_key for r in seen if r.origin == "extracted"} == {10_000 + i for i in range(len(BAD))}
    assert {r.row_key for r in seen if r.origin == "pages"} == {2}
    by = {r.row_key: r for r in seen if r.origin == "extracted"}
    for i, (_, meant) in enumerate(BAD):
        if meant:
            assert by[10_000 + i].restored == meant and by[10_000 + i].pos == 1


def test_runs_are_spans_of_the_piece():
    good = [g for g in GOOD for _ in range(60)]
    keys, counts = mojibake._pairs(good)
    total = counts.sum()
    model = mojibake.PairModel(keys, np.log2(counts / total * 4), float(np.log2(mojibake.FLOOR / 4)))
    text = "Le café de Zürich: crÃ¨me brulÃ©e, café"
    assert [text[a:b] for a, b in model.runs(text)] == ["Ã¨me brulÃ©"]
    assert mojibake.restore_piece(text, model, {}, set()) == "Le café de Zürich: crème brulée, café"
    assert model.suspect(["fine", "<p>café</p>\n<b>crÃ¨me</b>", ""]) == [[], [(15, 21)], []]


def test_words_are_asked_whatever_their_share(spark):
    """A word said three times in a corpus of many others is a witness still."""
    model = mojibake.PairModel(np.zeros(0, np.int64), np.zeros(0), float(np.log2(mojibake.FLOOR / 4)))
    words = spark.createDataFrame([("Brühwürfel", 3), ("täglich", 10**9), ("Gartentür", 2)], "word string, n long")
    bad = [w.encode("cp1252").decode("cp850") for w in ("Brühwürfel", "Gartentür")]
    rows = spark.createDataFrame([(i, 0, b) for i, b in enumerate(bad)], "row_key long, pos int, value string")
    assert [(r.row_key, r.restored) for r in mojibake.repaired(rows, model, words).collect()] == [(0, "Brühwürfel")]


def test_empty(spark):
    fields = spark.createDataFrame([], "field_id long, field_values array<string>")
    pages = spark.createDataFrame([], "page_id long, html string")
    assert mojibake.garbled(pages, fields).count() == 0
