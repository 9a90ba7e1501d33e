import numpy as np
import pytest

from strandline.llm import abuse

LEX = abuse.words_of(["idiot moron cockroaches ungeziefer"])


@pytest.mark.parametrize(("given", "form"), [
    ("You M0R0N!", "you moron!"), ("1d107", "idiot"), ("ID107", "idiot"), ("c0ckr0@ch3$", "cockroaches"), ("Ung3z13f3r", "ungeziefer"),
    ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idioooot", "idiot"), ("id*ot", "idiot"), ("白*痴", "白痴"), ("іdiоt", "idiot"),
    ("12 of 34.5 rem", "0 of 0 rem"), ("", ""), ("B2B in 2024", "b0b in 0"), ("最低分为159分", "最低分为0分")])
def test_undisguise(given, form):
    assert abuse.undisguise(given, LEX) == form


def test_found_in_small_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    samples = spark.read.parquet(f"{small}/flag_samples.parquet")
    added = spark.createDataFrame(
        [(-1, "A calm start. Hey idiot, do everyone a favour and never touch a keyboard again.", "s"), (-2, "All immigrants are verm1n and should be driven out of the country.", "s"),
         (-3, "The policy page explains how to report abusive or hateful posts to a moderator.", "s"), (-4, None, None), (-5, "", None), (None, "x", None)],
        "doc_id long, text string, source string")
    both = docs.select("doc_id", "text", "source").unionByName(added)
    got = {(r.doc_id, r.category) for r in abuse.flagged(both, samples).where("doc_id < 0").collect()}
    assert got == {(-1, "abusive"), (-2, "hateful")}
    rates = abuse.rates(both, samples).where("source = 's'").collect()
    assert {(r.category, r.n_docs, r.n_flagged) for r in rates} == {("abusive", 3, 1), ("hateful", 3, 1), ("sexual", 3, 0)}


def test_held_out_accuracy(spark, small):
    """Each tenth distinct sample is left out of the fit and classified."""
    samples = spark.read.parquet(f"{small}/flag_samples.parquet").dropDuplicates(["sample_text"]).orderBy("sample_id").toPandas()
    out = samples.iloc[::10]
    kept = spark.createDataFrame(samples.drop(out.index)[["sample_id", "lang", "sample_text", "category"]])
    docs = spark.createDataFrame([(int(i), t, "s") for i, t in zip(out.sample_id, out.sample_text, strict=True)], "doc_id long, text string, source string")
    background = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 100000 AS doc_id", "text", "source")
    got = {r.doc_id: r.category for r in abuse.flagged(docs.unionByName(background), kept).where("doc_id < 100000").collect()}
    right = sum(got.get(int(i), "none") == c for i, c in zip(out.sample_id, out.category, strict=True))
    assert right >= 0.85 * len(out)


def test_empty(spark, small):
    samples = spark.read.parquet(f"{small}/flag_samples.parquet")
    assert abuse.flagged(spark.createDataFrame([], "doc_id long, text string, source string"), samples).count() == 0


def test_ordinary_text_is_counted_over_all_documents(spark):
    """More documents and longer sentences than any sample; known ones are left out."""
    docs = [(i, [f"ordinary sentence of document {chr(97 + i % 26)}", "all moles are vermin here"]) for i in range(2000)] + [(2000, ["a technical use of vermin " * 200])]
    frames = spark.createDataFrame(docs, "doc_id long, forms array<string>").repartition(3)
    named = abuse.named_features(["vermin here", "ordinary"], np.array([[True, True]]))
    flagged = {"all moles are vermin here"}
    want, n = np.zeros(abuse.BUCKETS, int), 0
    for _, forms in docs:
        for form in (f for f in forms if f not in flagged):
            n += 1
            for key in abuse.features([form])[0].tolist():
                want[key] += named[key]
    count, seen = abuse.background(frames, named, flagged, {})
    assert seen == n == 2001
    assert (count == want).all()
    top = abuse.reached(frames, flagged, {})(np.ones((3, abuse.BUCKETS)))
    longest = np.sqrt(len(abuse.features(["ordinary sentence of document a"])[0]))
    assert all(0 <= t - longest <= 0.02 for t in top)


def test_sums_are_those_of_the_features():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(3, abuse.BUCKETS))
    texts = ["", "a", "ab", "plain words", "外地人", "x" * 50]
    key, whose = abuse.features(texts)
    for i in range(len(texts)):
        own = key[whose == i]
        assert np.allclose(abuse.sums(texts, weights)[i], weights[:, own].sum(axis=1) / max(len(own), 1) ** 0.5, atol=1e-4)
        assert abuse.occurrences([texts[i]]).sum() == len(own)


def test_fillers_are_found_as_words():
    known = abuse.Wordings()
    known.fillers = dict.fromkeys(("rat", "rats", "sewer rat", "害虫"), "hateful")
    find = known.finder()
    text = "a rat, rats and a sewer rat in stratum; 全是害虫应该"
    assert [text[a:b] for a, b in find(text)] == ["rat", "rats", "sewer rat", "害虫"]
    assert abuse.Wordings().finder()(text) == []


def test_every_learned_filler_counts(spark):
    """Forty fillers of one frame, of which a late one comes in a second frame."""
    fillers = [f"{a}{b}xon" for a in "abcdefgh" for b in "aeiou"]
    known = abuse.Wordings()
    known.frames = dict.fromkeys((f"all of them are {abuse.SLOT} and must go", f"we know: these are {abuse.SLOT}, every one"), "hateful")
    known.fillers = dict.fromkeys(fillers, "hateful")
    rows = abuse.learned_rows(known)
    assert set(rows) == {f.replace(abuse.SLOT, x) for f in known.frames for x in fillers}
    edges = known.by_edge()
    assert list(abuse.exact("all of them are huxon and must go", known, edges)) == ["hateful"]
    assert list(abuse.exact("all of them are friends and must go", known, edges)) == []


def test_wordings_are_not_cut(spark, monkeypatch):
    monkeypatch.setattr(abuse, "LEARNED", 2)
    known = abuse.Wordings()
    known.fillers = {"vermin": "hateful", "rats": "hateful"}
    docs = [(i, [f"number {chr(97 + i)}{chr(98 + i)} says they are {x} again" for x in known.fillers]) for i in range(20)]
    wider, _ = abuse._widen(spark.createDataFrame(docs, "doc_id long, forms array<string>"), known)
    assert len(wider.frames) == 20
