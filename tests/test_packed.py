import pytest

from strandline.operators import packed


@pytest.mark.parametrize(("value", "items"), [
    ("a,b", ["a", "b"]), ("a, b c ,d", ["a", "b c", "d"]), ("a b  c", ["a", "b", "c"]),
    ('"x, y";z', ["x, y", "z"]), ("'user's guide' pen", ["user's guide", "pen"]), ("user's guide|pen", ["user's guide", "pen"]),
    ("「甲、乙」、丙", ["甲、乙", "丙"]), ("，a，，b，", ["a", "b"]), ('["p", "q r"]', ["p", "q r"]),
    ("a\tb\nc", ["a", "b", "c"]), ("  lone ", ["lone"]), ("x,x", ["x", "x"]), ("A类 | “文/史类”", ["A类", "文/史类"]),
    ("Top 50;b", ["Top 50", "b"]), ("", []), ("   ", []), (",;", []), (None, []),
])
def test_items(spark, value, items):
    df = spark.createDataFrame([(1, value, 7)], "id long, v string, pos int")
    got = sorted((r.pos, r.item) for r in packed.split_packed(df, "t.v", "id", "v").collect())
    assert got == list(enumerate(items))


def test_repeats_null_keys_and_long_fields(spark):
    long = ",".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([(1, "a,b"), (1, "a,b"), (None, "a"), (2, long)], "id long, v string")
    out = packed.split_packed(df, "t.v", "id", "v")
    assert out.where("row_key = 1").count() == 2
    assert out.where("row_key = 2").count() == 3000
    assert packed.split_packed(df.limit(0), "t.v", "id", "v").count() == 0
