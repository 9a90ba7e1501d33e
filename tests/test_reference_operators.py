"""Operators without an SQL form, and edge cases, against plain Python."""

import math
import random
import re
import time
from collections import Counter
from datetime import datetime, timedelta
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from strandline.functions import finance, fuzzy, text
from strandline.functions import html as H
from strandline.operators import anomaly, extraction, graph, quality, relational, series, textstats
from strandline.sources import readers, writers
from strandline.streaming import streams


# ------------------------------------------------------------------- relational


def test_as_of_takes_the_last_before(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), (None, 4, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z")], "k string, rt int, v string")
    got = {r.id: (r.rt, r.v) for r in relational.as_of(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert got == {1: (5, "y"), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_range_join_equals_all_pairs(spark):
    rng = random.Random(2)
    points = [(rng.randint(0, 3), rng.uniform(0, 50), i) for i in range(200)]
    spans = [(rng.randint(0, 3), a, a + rng.uniform(0, 20), i) for i, a in enumerate(rng.uniform(0, 50) for _ in range(60))]
    p, s = spark.createDataFrame(points, "k int, x double, i int"), spark.createDataFrame(spans, "k int, a double, b double, j int")
    got = {(r.i, r.j) for r in relational.range_join(p, s, ["k"], "x", "a", "b", 7.0).collect()}
    assert got == {(i, j) for k, x, i in points for q, a, b, j in spans if k == q and a <= x < b}


def test_fifo_allocation_keeps_amounts(spark):
    d = spark.createDataFrame([("p", 1, 5.0), ("p", 2, 4.0)], "part string, d int, dq double")
    s = spark.createDataFrame([("p", 1, 3.0), ("p", 2, 10.0)], "part string, s int, sq double")
    got = {(r.d, r.s): r.allocated for r in relational.allocate_fifo(d, s, ["part"], ["d"], ["s"], "dq", "sq").collect()}
    assert got == {(1, 1): 3.0, (1, 2): 2.0, (2, 2): 4.0}


def test_running_share_over_buckets(spark):
    rng = random.Random(9)
    rows = [(i, float(rng.randint(0, 300))) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, v double")
    got = {r.i: r.cum_share for r in relational.cumulative_share(df, "v", ["i"]).collect()}
    total, run = sum(v for _, v in rows), 0.0
    for i, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        run += v
        assert got[i] == pytest.approx(run / total)
    assert relational.cumulative_share(df.limit(0), "v", ["i"]).count() == 0


def test_search_and_internal_columns(spark):
    df = spark.createDataFrame([(1, "Alpha", None), (2, "beta", "x")], "id int, name string, _hidden string")
    assert [r.id for r in relational.search_rows(df, "ALP").collect()] == [1]
    assert relational.drop_internal(df).columns == ["id", "name"]
    assert relational.search_rows(df.limit(0), "a").count() == 0


# ------------------------------------------------------------------------- text


def test_transform_chain(spark):
    df = spark.createDataFrame([("  <b>Hi</b>  42 you@x.org ",), ("",), (None,)], "v string")
    chain = [("strip_html",), ("remove_emails",), ("normalize_spaces",), ("uppercase",), ("prefix", "", "> "), ("no such step",)]
    assert [r.o for r in df.select(text.transform_chain(F.col("v"), chain).alias("o")).collect()] == ["> HI 42", "", None]
    assert df.select(text.transform(F.col("v"), "to_int").alias("o")).first().o == "42"


def test_summary_rake_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "Red apples grow. Red apples fall from trees! Nothing else matters here. Apples are red."), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.summary for r in textstats.summarise(df, "doc_id", "text", 2).collect()}
    assert set(got) == {1} and "apples" in got[1].lower()
    phrases = {r.phrase for r in textstats.rake(df, "doc_id", "text").collect()}
    assert "red apples grow" in phrases
    assert {r.doc_id for r in textstats.profile(df, "doc_id", "text").collect()} == {1, 2, 3}


def test_summaries_equal_plain_python_without_a_shuffle(spark):
    rng = random.Random(4)
    words = ["apples", "trees", "the", "of", "rain", "x", "Rain", "straße", "国语", "7", "data_1", "was"]
    texts = ["".join(" ".join(rng.choices(words, k=rng.randint(1, 7))) + rng.choice([". ", "! ", "?! ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += ["the of was. of the.", "no. ", "Rain. Rain. Rain. Rain.", "...", ""]
    df = spark.createDataFrame([*((f"d{i}", t) for i, t in enumerate(texts)), ("null", None), (None, "Rain fell.")], "name string, text string").repartition(3)
    want = {}
    for i, t in enumerate(texts):
        held = [s.strip(" ") for s in re.split(r"[.!?]+\s*|\n", t)]
        held = [s for s in held if len(s) > 2]
        content = [[w for w in re.findall(r"\w+", s.lower()) if len(w) > 1 and w not in text.STOP_WORDS] for s in held]
        f = Counter(w for c in content for w in c)
        best = sorted((-sum(f[w] for w in c) / len(c), j) for j, c in enumerate(content) if c)[:3]
        if best:
            want[f"d{i}"] = ". ".join(held[j] for j in sorted(j for _, j in best))
    out = textstats.summarise(df, "name", "text")
    assert {r.name: r.summary for r in out.collect()} == want and out.count() == len(want) > 50
    plan = textstats.summarise(spark.createDataFrame([("a", "b")], "name string, text string"), "name", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_fingerprints_of_near_and_far_texts(spark):
    base = "the maintainer noted that the spread looked noisy after many observations " * 3
    df = spark.createDataFrame([(1, base), (2, base), (3, base + "x"), (4, "completely different words about cooking rice and beans"), (5, ""), (6, None)], "doc_id long, text string")
    h = {r.doc_id: r.simhash for r in textstats.fingerprints(df, "doc_id", "text").collect()}
    assert h[1] == h[2] and h[5] == 0 and 6 not in h
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert bits(h[1], h[3]) <= 9 < bits(h[1], h[4])
    pair = spark.createDataFrame([(h[1], h[4])], "a long, b long").select(textstats.similarity(F.col("a"), F.col("b")).alias("s")).first().s
    assert pair == pytest.approx(1 - bits(h[1], h[4]) / 64, abs=1e-4)


# ---------------------------------------------------------------------- quality


def test_quality_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, url string")
    assert {r.field: r.n_rows for r in quality.completeness(df).collect()} == {"a": 0, "url": 0}
    assert quality.validity(df, ["url"]).first().n_checked == 0


def test_planted_faults(spark):
    rows = [("p", "5", "https://a.example/x"), ("", "x", "not a url"), (None, "", None), ("p", "-3", "https://a.example/x")]
    df = spark.createDataFrame(rows, "name string, price string, url string")
    got = {r.field: (r.n_null, r.n_blank) for r in quality.completeness(df).collect()}
    assert got == {"name": (1, 2), "price": (0, 1), "url": (1, 1)}
    assert {r.field: r.n_invalid for r in quality.validity(df, ["price", "url"]).collect()} == {"price": 1, "url": 1}


# ---------------------------------------------------------------------- anomaly


def test_cusum_against_a_loop(spark):
    rng = random.Random(1)
    v = [rng.gauss(0, 1) + (3 if i > 60 else 0) for i in range(120)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "g string, i int, value double")
    got = {(r.i, r.direction) for r in anomaly.cusum(df, ["g"], ["i"], "value").collect()}
    m = sum(v) / len(v)
    sd = math.sqrt(sum((x - m) ** 2 for x in v) / len(v))
    up = down = 0.0
    want = set()
    for i, x in enumerate(v):
        z = (x - m) / sd
        up, down = max(0.0, up + z), max(0.0, down - z)
        if up > 4 or down > 4:
            want.add((i, 1 if up > 4 else -1))
            up = down = 0.0
    assert got == want and want


def test_drift_is_zero_for_the_same_and_large_for_other_data(spark):
    a = spark.createDataFrame([("g", float(i % 50)) for i in range(500)], "g string, value double")
    b = a.withColumn("value", F.col("value") / 10)
    assert anomaly.drift_score(a, a, ["g"], "value").first().drift == 0
    assert anomaly.drift_score(a, b, ["g"], "value").first().drift > 0.3


def test_constant_groups_have_no_outliers(spark):
    df = spark.createDataFrame([("g", 1.0)] * 10, "g string, value double")
    for f in (anomaly.zscore, anomaly.iqr):
        assert f(df, ["g"], "value").count() == 0


# ------------------------------------------------------------------------ graph


def test_graph_against_loops(spark):
    rng = random.Random(3)
    edges = {(f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 14)}") for _ in range(18)}
    edges = {(a, b) for a, b in edges if a != b}
    names = [f"n{i}" for i in range(18)]
    e, n = spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame([(x,) for x in names], "id string")
    group = {x: x for x in names}
    for _ in names:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert {r.id: r.component for r in graph.components(n, e).collect()} == group
    seen, front, depth = {"n0": 0}, {"n0"}, 0
    while front:
        depth += 1
        front = {b for a, b in edges if a in front} - set(seen)
        seen |= dict.fromkeys(front, depth)
    assert {r.id: r.depth for r in graph.depths(e, spark.createDataFrame([("n0",)], "id string")).collect()} == seen
    failed, r = {"n0": 0}, 0
    while True:
        r += 1
        new = {x for x in names if x not in failed and (k := [a for a, b in edges if b == x]) and sum(a in failed for a in k) / len(k) >= 0.3}
        if not new:
            break
        failed |= dict.fromkeys(new, r)
    got = graph.cascade(n, e, spark.createDataFrame([("n0",)], "id string"), 0.3).collect()
    assert {x.id: x["round"] for x in got} == failed


def test_topological_levels_leave_cycles_out(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "c")], "src string, dst string")
    got = {r.id: r.level for r in graph.topological_levels(graph.nodes_of(e), e).collect()}
    assert got == {"a": 0, "b": 1}


def test_graph_without_edges(spark):
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([], "src string, dst string")
    assert {r.id: r.component for r in graph.components(n, e).collect()} == {"a": "a", "b": "b"}
    assert sum(r["rank"] for r in graph.pagerank(n, e, rounds=3).collect()) == pytest.approx(1)


# ----------------------------------------------------------------------- series


def test_windows_over_stretch_borders(spark, monkeypatch):
    monkeypatch.setattr(series, "STRETCH", 16)
    monkeypatch.setattr(series.stretched, "__defaults__", (16,))
    rng = random.Random(5)
    v = [100 + rng.uniform(-5, 5) for _ in range(100)]
    df = spark.createDataFrame([("a", i, datetime(2024, 1, 1) + timedelta(days=i), x) for i, x in enumerate(v)], "name string, t long, ts timestamp, value double")
    r = {x.t: x.r for x in series.log_returns(df).collect()}
    assert set(r) == set(range(1, 100)) and all(math.isclose(r[i], math.log(v[i] / v[i - 1]), abs_tol=1e-12) for i in r)
    top = {x.t: x.peak for x in series.running_max(df, "value", "peak").collect()}
    assert all(top[i] == max(v[:i + 1]) for i in range(100))
    total = {x.t: x.s for x in series.running_sum(df, "value", "s").collect()}
    assert all(math.isclose(total[i], sum(v[:i + 1])) for i in range(100))


def test_forecast_of_a_line_and_of_an_oscillation(spark):
    rows = [("line", i, 10.0 + 2 * i) for i in range(80)] + [("wave", i, 50 + 10 * math.sin(i / 3)) for i in range(400)] + [("short", 0, 1.0)]
    df = spark.createDataFrame([(n, t, datetime(2024, 1, 1) + timedelta(days=t), v) for n, t, v in rows], "name string, t long, ts timestamp, value double")
    got = {(r.name, r.step): r.forecast for r in series.autoregression(df, 3, 4).collect()}
    assert got["line", 1] == pytest.approx(170, abs=1)
    assert got["wave", 1] == pytest.approx(50 + 10 * math.sin(400 / 3), abs=1)
    assert ("short", 1) not in got


def test_least_squares_recovers_coefficients(spark):
    rng = random.Random(6)
    rows = [(x, y, 3 + 2 * x - y) for x, y in ((rng.random(), rng.random()) for _ in range(100))]
    fit = series.least_squares(spark.createDataFrame(rows, "x double, y double, z double"), "z", ["x", "y"])
    assert [round(fit[k], 6) for k in ("intercept", "x", "y", "r2")] == [3, 2, -1, 1]


# ---------------------------------------------------------- extraction and files


PAGE = """<html><head><title>A &amp; B</title><meta name="author" content="Me"><link rel="canonical" href="/c"><script type="application/json">{"a":{"b":[1,2]}}</script></head>
<body><div id="main" class="box big"><p>One <b>two</b><p>Three</div><ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td><table><tr><td>in</table></table>
<a href="/p#f">Go</a><a href="mailto:a@b.example">m</a><a href="https://www.youtube.com/v">v</a><a href="f.pdf">d</a><img data-src="i.png" alt="pic"><a href="#x">no</a></body>"""


def test_selectors_and_parts():
    root = H.parse(PAGE)
    assert [n.text() for n in H.css(root, "#main > p")] == ["Onetwo", "Three"]
    assert [n.text() for n in H.css(root, "div.box p:first-child, li:nth-child(2)")] == ["Onetwo", "y"]
    assert H.css(root, "a[href^=mailto]")[0].text() == "m"
    assert H.xpath(root, "//ul/li[2]") == ["y"] and H.xpath(root, "//meta[@name='author']/@content") == ["Me"]
    assert H.xpath(root, "//p[contains(text(),'Thr')]") == ["Three"] and H.xpath(root, "//nothing") == []
    assert H.tables(root)[0][0] == ["1", "2"] and H.tables(root)[1] == [["in"]]
    assert H.meta(root) == {"title": "A & B", "author": "Me", "canonical_url": "/c"}
    assert H.json_path(H.script_json(root)[0], "a.b[1]") == 2 and H.json_path({}, "a[0]") is None
    H.parse("<div>" * 5000)
    assert list(H.parse(None).walk()) == []


def test_rules_links_and_defaults(spark):
    pages = spark.createDataFrame([(1, "https://a.example/d/", PAGE), (2, None, None), (3, "x", ""), (None, "x", PAGE)], "page_id long, url string, html string")
    rules = [extraction.Rule("t", "meta", "title"), extraction.Rule("n", "json", "a.b", is_list=True), extraction.Rule("p", "css", "p", default="none", prefix="<", suffix=">")]
    got = {(r.page_id, r.name): (r.field_values, r.used_default) for r in extraction.extract(pages, rules).collect()}
    assert got[1, "t"] == (["A & B"], False) and got[1, "n"] == (["1", "2"], False) and got[1, "p"] == (["<Onetwo>"], False)
    assert got[2, "p"] == (["none"], True) and got[3, "t"] == ([""], True) and len(got) == 9
    links = {(r.address, r.category) for r in extraction.page_links(pages).collect()}
    assert links == {
        ("https://a.example/c", "internal"), ("https://a.example/p", "internal"), ("mailto:a@b.example", "email"), ("https://www.youtube.com/v", "social"),
        ("https://a.example/d/f.pdf", "document"), ("https://a.example/d/i.png", "image")}


def test_round_trip_of_every_format(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd', ["x", "y"], "h"), (2, None, [], "h"), (3, "ü", None, "h")], "id long, name string, tags array<string>, _hidden string")
    for kind in ("csv", "json", "xml", "parquet", "orc"):
        path = str(tmp_path / f"out.{kind}" / f"x.{kind}")
        writers.export(df, path, kind)
        back = readers.read_table(spark, path, "id long, name string, tags string" if kind in ("csv", "xml") else None, **({"rowTag": "item"} if kind == "xml" else {"multiLine": "false"} if kind == "json" else {}))
        if kind == "json":
            back = spark.read.json(path)
        assert {r.id: r.name for r in back.collect()} == {1: 'a "b", c\nd', 2: None, 3: "ü"}, kind
        assert kind in ("parquet", "orc") or "_hidden" not in back.columns
    writers.export(df, str(tmp_path / "x.sqlite"), "sqlite")
    import sqlite3

    with sqlite3.connect(tmp_path / "x.sqlite") as db:
        assert db.execute("SELECT count(*), count(name) FROM data").fetchone() == (3, 2)
    writers.export(df, str(tmp_path / "x.html"), "html")
    assert "&quot;b&quot;" in (tmp_path / "x.html").read_text()
    with pytest.raises(ValueError, match="no such format"):
        writers.export(df, "x", "docx")
    assert writers.preview(df.select("id", "name"), 2, 5).splitlines()[0].split() == ["id", "name"]


def test_series_from_any_table(spark):
    df = spark.createDataFrame([("2024-01-02", "3.5", "z"), ("2024/01/01", "2", "z"), ("bad", "1", "z"), ("2024-01-03", "n/a", "z")], "day_date string, close string, note string")
    assert readers.infer_series_columns(df) == ("day_date", "close")
    assert [(r.t, r.value) for r in readers.as_series(df, "close", "day_date").orderBy("t").collect()] == [(0, 2.0), (1, 3.5)]


# ------------------------------------------------------------- fuzzy and finance


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.961), ("dixon", "dicksonx", 0.813), ("", "x", 0.0), ("x", "x", 1.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, want):
    assert fuzzy.jaro_winkler(a, b) == pytest.approx(want, abs=1e-3)


def test_fuzzy_search_misses_nothing(spark):
    names = ["small ring", "small rings", "smal ring", "big widget", "", None, "SMALL RING"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {r.id for r in fuzzy.search(df, "id", "name", "small ring", 0.8).collect()}

    def score(v):
        n, m = len(v), len("small ring")
        row = list(range(m + 1))
        for i in range(1, n + 1):
            last, row[0] = row[0], i
            for j in range(1, m + 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (v[i - 1] != "small ring"[j - 1]))
        return 0.6 * fuzzy.jaro_winkler(v, "small ring") + 0.4 * (1 - row[m] / max(n, m))

    assert got == {i for i, v in enumerate(names) if v is not None and score(v.lower()) >= 0.8}


def test_normal_distribution_and_options(spark):
    xs = [-40.0, -8.0, -3.3, -1.0, 0.0, 0.5, 2.2, 7.5, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", finance.norm_cdf(F.col("x")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(NormalDist().cdf(r.x), abs=1e-14)
    o = spark.createDataFrame([(100.0, 105.0, 1.0, 0.02, 0.2)], "s double, k double, t double, r double, v double")
    c = [F.col(x) for x in "sktrv"]
    row = o.select(finance.call(*c).alias("c"), finance.put(*c).alias("p"), finance.greeks(*c).alias("g"), finance.implied_volatility(finance.call(*c), *c[:4]).alias("iv")).first()
    assert row.c - row.p == pytest.approx(100 - 105 * math.exp(-0.02), abs=1e-9)
    assert row.iv == pytest.approx(0.2, abs=1e-8) and 0 < row.g.delta < 1
    expired = o.withColumn("t", F.lit(0.0)).select(finance.call(*c).alias("c"), finance.put(*c).alias("p")).first()
    assert (expired.c, expired.p) == (0.0, 5.0)


def test_implied_volatility_of_many_and_of_missing_prices(spark):
    c = [F.col(x) for x in "sktr"]
    many = spark.range(200_000).select((F.col("id") % 1999 + 900.0).alias("s"), F.lit(1000.0).alias("k"), F.lit(1.0).alias("t"), F.lit(0.02).alias("r"), (F.col("id") % 50 / 100 + 0.2).alias("v"))
    began = time.monotonic()
    found = many.select("v", finance.implied_volatility(finance.call(*c, F.col("v")), *c).alias("iv"))
    assert found.agg(F.max(F.abs(F.col("iv") - F.col("v")))).first()[0] < 1e-3
    assert time.monotonic() - began < 60  # a fold over the closed form takes minutes
    odd = spark.createDataFrame([(None, 100.0, 1.0), (5.0, None, 1.0), (5.0, 100.0, None), (7.0, 100.0, 1.0), (5.0, 100.0, 0.0), (-1.0, 100.0, 1.0)], "p double, s double, t double")
    got = [r.iv for r in odd.select(finance.implied_volatility(F.col("p"), F.col("s"), F.lit(105.0), F.col("t"), F.lit(0.02)).alias("iv")).collect()]
    assert got[:3] == [None] * 3 and 0.1 < got[3] < 0.3
    assert got[4] == pytest.approx(5.0) and got[5] == pytest.approx(1e-4)  # the bounds, where no volatility gives the price


# -------------------------------------------------------------------- streaming


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=7 * i), i % 3, "k", 1.0, None) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    for part in range(3):
        df.where(f"event_id >= {part * 30} AND event_id < {part * 30 + 30}").coalesce(1).write.parquet(str(tmp_path / f"events{part}.parquet"))
    (tmp_path / "events.parquet").symlink_to(tmp_path / "events0.parquet")
    batch = {(r.event_id, r.allowed) for r in streams.rate_limited(df, 0.02, 2).collect()}
    schema = spark.read.parquet(str(tmp_path / "events.parquet")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events[0-2].parquet"))
    got = {(r.event_id, r.allowed) for r in streams.run(streams.rate_limited(stream, 0.02, 2)).collect()}
    assert {i for i, _ in got} == set(range(90)) and 0 < sum(a for _, a in batch) < 90
    assert got == batch


def test_token_bucket():
    ok, level, last = streams.consume([0.0, 0.0, 0.0, 10.0, 5.0], 2.0, None, 0.1, 2.0)
    assert ok == [True, True, False, True, False] and last == 10.0


# ------------------------------------------------------------------------- entry


def test_every_query_runs_and_names_match(spark, small):
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert entry.entry(spark).count() > 0
    for name in ("rel_pivot", "text_bm25", "quality_entropy", "series_summary", "p7_found"):
        assert queries[name](spark, small).count() >= 0


# ---------------------------------------------------------- whole-table queries


def test_metadata_of_all_pages(spark, tmp_path):
    from strandline.plans import extraction as plans

    pages = [(1, "<head><title>Cats &amp; dogs</title><meta name='author' content='A &lt; B'></head>"), (2, "<title> Blank before</title>"), (3, "<p>none</p>"), (None, "<title>x</title>"), (4, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.name, r.content.strip()) for r in plans.extract_metadata(spark, str(tmp_path)).collect()}
    assert got >= {(1, "title", "Cats & dogs"), (1, "author", "A < B"), (2, "title", "Blank before")}
    assert {k for k, _, _ in got} == {1, 2}


def test_whole_graph_and_all_orders(spark, tmp_path):
    from strandline.plans import graphs, relational as lists

    lines = [(1, 1, "N", 10.0), (1, 2, "R", 90000.0), (2, 2, "A", 5.0), (3, 3, "N", 1.0)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_returnflag string, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(5, "HIGH", 1.0), (2, "HIGH", 500000.0), (9, "LOW", 7.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.id for r in graphs.graph_orphans_all(spark, str(tmp_path)).collect()} == {"p1", "p2", "p3"}
    assert {r.id for r in graphs.graph_dead_ends_all(spark, str(tmp_path)).collect()} == {"s1", "s2", "s3"}
    assert {r.id: r.depth for r in graphs.graph_depths_all(spark, str(tmp_path)).collect()} == {"p1": 0, "s1": 1, "s2": 1, "p2": 2}
    assert {r.o_orderpriority: r["keys"] for r in lists.rel_group_to_lists(spark, str(tmp_path)).collect()} == {"HIGH": [2, 5], "LOW": [9]}
