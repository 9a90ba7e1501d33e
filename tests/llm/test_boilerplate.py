import hashlib
import json

from strandline.llm import boilerplate


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def page(i, article, shut=True):
    menu = "".join(f'<li><a href="/{m}">{m}</a></li>' for m in ("Home", "Jobs", "Help", "Tools"))
    side = "".join(f'<div><a href="#">Teaser {i} number {k} of the day</a></div>' for k in range(3))
    body = "".join(f"<p>{a}" + ("</p>" if shut else "") for a in article)
    return (
        f"<!DOCTYPE html><html><head><title>T {i}</title><script>var q='</p><p>x';</script></head><body><nav><ul>{menu}</ul></nav>"
        f"<article><h1>Title {i} &amp; more</h1>{body}<div class=s>Share this page</div></article><aside>{side}</aside>"
        "<footer><div>All rights reserved</div><div>Imprint</div></footer></body></html>")


def frames(spark, n=60):
    pages, parsed, want = [], [], set()
    for i in range(n):
        article = [f"Paragraph {i} {k} says &uuml; <b>bold</b>\n  words" for k in range(3)]
        shown = [f"Title {i} & more", *(f"Paragraph {i} {k} says ü bold words" for k in range(3))]
        bare = i % 20 == 7
        pages.append((i, f"https://a.example/{i}", "a.example", f"Title {i} & more", None if bare else page(i, article, i % 2 == 0), "x"))
        lines = ["Home", "Jobs", "Help", *shown, "Share this page", f"Teaser {i} number 1 of the day", "All rights reserved"]
        parsed.append((i, f"https://a.example/{i}", json.dumps({"full_text": "\n".join(lines)})))
        want |= {(i, md5(t)) for t in shown}
    pages.append(pages[0])
    pages += [(900, None, None, None, None, None), (None, None, "a.example", None, "<p>x</p>", None)]
    parsed += [(None, None, "{}"), (901, None, "broken"), (902, "https://b.example/", None)]
    return (
        spark.createDataFrame(pages, "page_id long, url string, site string, title string, html string, path string"),
        spark.createDataFrame(parsed, "page_id long, url string, raw_data string"), want)


def test_articles_come_out(spark):
    pages, parsed, want = frames(spark)
    got = {(r.page_id, r.block_md5) for r in boilerplate.main_blocks(pages, parsed).collect()}
    assert got == want


def test_empty_tables(spark):
    pages, parsed, _ = frames(spark, 2)
    assert boilerplate.main_blocks(pages.limit(0), parsed.limit(0)).count() == 0


def test_blocks_of_broken_markup():
    got = [t for _, t, _ in boilerplate.page_blocks("<td>one<br><br>two<br>still two<p>three<p>four<ul><li>a<li>b</ul><!-- gone --><table><tr><td>x<td>y")]
    assert got == ["one", "twostill two", "three", "four", "a", "b", "x", "y"]
    assert boilerplate.page_blocks("") == []
    assert len(boilerplate.page_blocks("<p>a</p>" * 20000)) == 20000


def test_one_article_on_a_third_of_the_pages(spark):
    """Copies under other ids, with other teasers, count once."""
    pages, want = [], set()
    for i in range(150):
        k = 0 if i % 3 == 0 else i
        words = f"Story {chr(97 + k % 26)}{chr(97 + k // 26)}"
        html = page(i, [f"{words} part {p}" for p in ("one", "two", "three")]).replace(f"Title {i} &amp; more", words)
        pages.append((i, f"https://a.example/{i}", "a.example", words, html))
        want |= {(i, md5(t)) for t in (words, *(f"{words} part {p}" for p in ("one", "two", "three")))}
    frame = spark.createDataFrame(pages, "page_id long, url string, site string, title string, html string")
    parsed = spark.createDataFrame([], "page_id long, url string, raw_data string")
    assert {(r.page_id, r.block_md5) for r in boilerplate.main_blocks(frame, parsed).collect()} == want


def test_rare_leaves_go_with_their_branch(spark):
    """A note that stands in few footers has no evidence of its own."""
    pages, want = [], set()
    for i in range(60):
        html = page(i, [f"Paragraph {i} {k} of its own" for k in range(3)])
        if i % 12 == 5:
            html = html.replace("<footer>", f"<footer><p class=note>Notice {chr(97 + i)} of the week</p>").replace("</article>", f"<blockquote>Quoted {i} by hand</blockquote></article>")
            want.add((i, md5(f"Quoted {i} by hand")))
        pages.append((i, f"https://a.example/{i}", "a.example", f"Title {i} & more", html))
        want |= {(i, md5(t)) for t in (f"Title {i} & more", *(f"Paragraph {i} {k} of its own" for k in range(3)))}
    frame = spark.createDataFrame(pages, "page_id long, url string, site string, title string, html string")
    parsed = spark.createDataFrame([], "page_id long, url string, raw_data string")
    assert {(r.page_id, r.block_md5) for r in boilerplate.main_blocks(frame, parsed).collect()} == want


def test_branches_above_a_path():
    assert boilerplate.above("div.a/ul/li") == ["div.a/ul", "div.a"] and boilerplate.above("p") == []
