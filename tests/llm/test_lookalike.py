import unicodedata

import pytest

from strandline.llm import lookalike

CASES = {
    "сopy the file": "copy the file", "Tоp 50": "Top 50", "Ｔop": "Top", "café bar": "café bar", "a​b": "ab",
    "a b": "a b", "oﬃce": "office", "⼤学": "大学", "1２": "12", "А类": "A类", "so­ft": "soft", "Саре": "Cape",
    "мoсква": "москва", "привeт": "привет", "сору": "copy", "сopу": "copy",
}
FINE = ["обзор рынка", "H₂O", "10 m²", "①②", "👩‍💻 desk", "x̄ = 4.2", "全角，标点！", "Ж-модель", "5 Ω", "copy Cape Top A类", "copy Cape Top A类", "", "plain", "москва привет", "qzхw", "αqzхw", "λόγoxs", "oрз"]


@pytest.fixture(scope="module")
def seen(spark):
    rows = [(i, [v], "x") for i, v in enumerate([*CASES, *FINE])] + [(100, None, "x"), (101, [None, ""], "x"), (None, ["x"], "x"), (102, ["café"] * 2, "x"), (103, ["F�r a b"], "x")]
    tags = [(1, "А类;x", 1), (1, "А类;x", 1), (2, None, 1), (3, "A类", 1), (None, "x", 1)]
    return lookalike.normalised(spark.createDataFrame(rows, "field_id long, field_values array<string>, normal string"), spark.createDataFrame(tags, "response_id long, tags string, pos int")).collect()


def test_forms(seen):
    got = {(r.origin, r.row_key, r.pos): r.normal for r in seen}
    want = {("extracted", i, 0): n for i, n in enumerate(CASES.values())}
    want |= {("extracted", 102, 0): "café", ("extracted", 102, 1): "café", ("volunteers", 1, 0): "A类;x"}
    assert got == {k: unicodedata.normalize("NFC", v) for k, v in want.items()}


@pytest.mark.parametrize(("token", "want"), [
    ("мoсква", ["москва"]), ("Tоp", ["Top", "ТоР"][:1]), ("сope", ["cope", "соре"]), ("qzхw", ["qzxw"]), ("word", []), ("слово", []), ("αрe", ["ape"]), ("шzо", [])])
def test_dominant_script_comes_first(token, want):
    assert lookalike.readings(token)[:len(want)] == want and bool(lookalike.readings(token)) == bool(want)


def test_empty(spark):
    assert lookalike.deviating(spark.createDataFrame([], "field_id long, field_values array<string>"), spark.createDataFrame([], "response_id long, tags string")).count() == 0
