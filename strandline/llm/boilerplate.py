"""Main content of web pages, by a style tree for each site.

Each page is read once into blocks: a run of text between block-level tags,
with its *style path* (the open tags and classes above it). Merging the pages
of a host gives its style tree, of which every leaf is a style path with the
texts seen there:

* content importance is the second-order Rényi entropy of the leaf's texts,
  from an unbiased estimate of the chance that two blocks there agree. Menus,
  notices and footers repeat a few texts (low), articles do not (high). The
  measure does not drift with the number of pages;
* presentation importance falls with the share of blocks that are one link.

A leaf is removed if either is low. The importance of a branch is the mean of
its leaves', by blocks. A leaf with too few blocks to judge goes with the lowest
branch above it that has enough: if nearly all of that branch is removed, so is
the leaf. Else it is judged by how many of its texts are *phrases*: texts that
make up a fair part of some removed leaf on any site. Pages known only as lines of text keep what
stands between the headline and the first text that closes articles on that
site, without phrases.

Text leaves the parser as digests only; what is shuffled is of fixed width and
counted map-side before it moves. The tables of leaves, phrases and closings
grow with the number of sites, not of pages.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import settle

#: Leaves where two blocks agree more often than this are boilerplate.
AGREEMENT = 1 / 50
#: Leaves with at least this share of pure links are boilerplate.
LINKED = 0.2
#: Leaves with fewer blocks are judged by the branch above them and by their phrases.
EVIDENCE = 30
#: A branch of less importance takes leaves of few blocks with it.
BRANCH = 0.1
#: A phrase makes up this share of a removed leaf, and so many blocks; a leaf of few blocks is
#: removed if this share of its blocks are phrases.
PHRASE, PHRASE_LEAST, PHRASES = 0.02, 5, 0.3
#: A closing ends this share of a site's articles, or of all.
CLOSING, CLOSING_ANYWHERE = 0.2, 0.005

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![a-zA-Z][^>]*>|<\?[^>]*>|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|([^<]+|<)", re.S | re.I)
_CLASS = re.compile(r"class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[ \t\r\n]+")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
INLINE = frozenset("a span strong em b i u s small big font abbr acronym sup sub code mark time cite q label tt wbr img bdi bdo ins del kbd var samp".split())
CLEAR = frozenset("html body tbody thead tfoot center form".split())
VOID = frozenset("br hr meta link input col area base embed source track param".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 blockquote figure article section aside footer header main nav pre hr li dd dt td th tr".split())
#: Start tags that end an open element of their kind.
SIBLINGS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}


def page_blocks(document: str) -> list[tuple[str, str, bool]]:
    """Style path, text and whether it is one link, of each block in order."""
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    out: list[tuple[str, str, bool]] = []
    inside = linked = size = 0
    head = broken = False

    def flush() -> None:
        nonlocal linked, size
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip(" ")
            if whole:
                out.append(("/".join(s for _, s in stack), whole, 0 < size <= linked))
            text.clear()
        linked = size = 0

    for m in _TOKEN.finditer(document):
        tag = m.group(3)
        if tag is None:
            piece = m.group(5)
            if piece and not head:
                text.append(piece)
                n = len(piece.strip())
                broken = broken and not n
                size += n
                linked += n * (inside > 0)
            continue
        tag, close = tag.lower(), m.group(2) == "/"
        if tag == "head":
            head = not close
            continue
        if tag == "body":
            head = False
        if head:
            continue
        if tag in INLINE:
            if tag == "a":
                inside = 0 if close else 1
            continue
        if tag == "br":  # one is a line end in its block, two part blocks
            if broken:
                flush()
            broken = True
            continue
        broken = False
        flush()
        if tag in CLEAR or tag in VOID:
            continue
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in ENDS_P and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in SIBLINGS and stack and stack[-1][0] in SIBLINGS[tag]:
            while stack and stack[-1][0] in SIBLINGS[tag]:
                stack.pop()
        inside = 0
        found = _CLASS.search(m.group(4)) if m.group(4) else None
        label = f"{tag}.{next(g for g in found.groups() if g is not None)}" if found else tag
        stack.append((tag, label))
    flush()
    return out


def host(url: str | None) -> str:
    return re.sub(r"^[a-z]+://(?:[^/@]*@)?|[:/?#].*$", "", url or "", flags=re.I).lower()


def masked(text: str, site: str) -> str:
    """The text with its numbers and the name of its site made alike; a text
    without letters stays as it is."""
    out = _NUMBER.sub("0", text)
    if out.strip(" 0%.,") == "":
        return text
    name = site.split(".")[-2] if site.count(".") else site
    return re.sub(re.escape(name), "\0", out, flags=re.I) if name else out


def _key(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)


_BLOCK = "array<struct<path:long,raw:long,like:long,next:long,linked:boolean,md5:binary>>"
_LINE = "array<struct<like:long,headline:boolean,md5:binary>>"


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def body_key(blocks: list[dict]) -> int | None:
    """The same for pages of a site that agree in every block but links."""
    own = [(b["path"], b["raw"]) for b in blocks if not b["linked"]]
    return _key(repr(own)) if own else None


_PATH = "array<struct<path:long,above:array<long>>>"


def above(path: str) -> list[str]:
    """The branches above a style path, the lowest first."""
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(len(parts) - 1, 0, -1)]


def _read_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    paths: dict[str, int] = {}
    for pdf in batches:
        rows, seen = [], []
        for site, document in zip(pdf["site"], pdf["html"], strict=True):
            found, fresh = [], []
            for path, text, linked in page_blocks(document):
                if path not in paths:
                    if len(paths) > 100_000:
                        paths.clear()
                    paths[path] = _key(path)
                    fresh.append({"path": paths[path], "above": [_key(p) for p in above(path)]})
                digest = _digest(text)
                raw = int.from_bytes(digest[:8], "big", signed=True)
                alike = masked(text, site)
                found.append({"path": paths[path], "raw": raw, "like": raw if alike == text else _key(alike), "next": None, "linked": linked, "md5": digest})
            for a, b in zip(found, found[1:], strict=False):
                a["next"] = b["like"]
            rows.append(found)
            seen.append(fresh)
        yield pd.DataFrame({"page_id": pdf["page_id"], "site": pdf["site"], "paths": seen, "body": pd.array([body_key(r) for r in rows], dtype="Int64"), "blocks": rows})


def text_lines(raw: str) -> tuple[str | None, list[str]]:
    """Title and lines of parsed page text in any of its shapes: the longest
    list of strings or text with line ends that the JSON holds."""
    try:
        held = json.loads(raw)
    except ValueError:
        return None, []
    title, best = None, []
    todo = [held]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            if isinstance(node.get("title"), str):
                title = node["title"]
            todo.extend(v for k, v in node.items() if k != "title")
        elif isinstance(node, list):
            lines = [x for x in node if isinstance(x, str)]
            best = max(best, lines, key=lambda x: sum(map(len, x)))
            todo.extend(x for x in node if not isinstance(x, str))
        elif isinstance(node, str):
            best = max(best, node.split("\n"), key=lambda x: sum(map(len, x)))
    return title, [y for x in best if (y := _SPACE.sub(" ", x).strip(" "))]


def _read_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows, sites = [], []
        for url, known, raw in zip(pdf["url"], pdf["title"], pdf["raw_data"], strict=True):
            site = host(url)
            title, lines = text_lines(raw)
            titles = {_SPACE.sub(" ", t).strip(" ") for t in (title, known) if isinstance(t, str)} - {""}
            sites.append(site)
            rows.append([{"like": _key(masked(x, site)), "headline": x in titles, "md5": _digest(x)} for x in lines])
        yield pd.DataFrame({"page_id": pdf["page_id"], "site": sites, "lines": rows})


def leaf_importance(blocks: DataFrame) -> DataFrame:
    """Leaves of the style trees: ``site, path, n, agreement, linked, content, presentation``.

    ``blocks`` has ``site, path, raw, linked, weight``.

    ``content`` is the leaf's Rényi entropy over the entropy at which two
    blocks agree as often as ``AGREEMENT``, 1 at most.
    """
    texts = blocks.groupBy("site", "path", "raw").agg(
        F.sum("weight").alias("k"), F.sum(F.col("linked").cast("long") * F.col("weight")).alias("l"))
    n = F.sum("k")
    agreement = F.sum(F.col("k") * (F.col("k") - 1)) / F.greatest(n * (n - 1), F.lit(1.0))
    return texts.groupBy("site", "path").agg(
        n.alias("n"), agreement.alias("agreement"), (F.sum("l") / n).alias("linked"),
        F.least(F.lit(1.0), -F.log(F.greatest(agreement, F.lit(1e-12))) / -math.log(AGREEMENT)).alias("content"),
        (1 - F.least(F.lit(1.0), F.sum("l") / n / LINKED)).alias("presentation"),
    )


def branch_importance(leaves: DataFrame, paths: DataFrame) -> DataFrame:
    """Branches of the style trees, for each leaf below and by its distance:
    ``site, path, up, n, importance``. A branch has the mean importance of its
    leaves with evidence, by blocks. ``paths`` has the branches ``above`` a path."""
    place = leaves.join(paths, "path").select("site", "path", "n", "content", "presentation", F.posexplode("above").alias("up", "branch"))
    kept = ((F.col("content") >= 1) & (F.col("presentation") > 0)).cast("double")
    held = place.where(f"n >= {EVIDENCE}").groupBy("site", "branch").agg(F.sum("n").alias("n"), (F.sum(kept * F.col("n")) / F.sum("n")).alias("importance"))
    return place.select("site", "path", "up", "branch").join(held, ["site", "branch"]).drop("branch")


def _judge(blocks: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept leaves (``site, path``) and phrases (``like``)."""
    leaves = settle(leaf_importance(blocks))
    lowest = branch_importance(leaves, paths).groupBy("site", "path").agg(F.min_by("importance", "up").alias("importance"))
    taken = lowest.where(F.col("importance") < BRANCH).select("site", "path")
    low = (F.col("agreement") > AGREEMENT) | (F.col("linked") >= LINKED)
    alike = blocks.groupBy("site", "path", "like").agg(F.sum("weight").alias("k")).join(
        leaves.select("site", "path", "n", low.alias("low"), "linked"), ["site", "path"])
    alike = settle(alike)
    phrases = alike.where(f"low AND n >= {EVIDENCE} AND k >= {PHRASE} * n AND k >= {PHRASE_LEAST}").select("like").distinct()
    few = (
        alike.where(f"n < {EVIDENCE}").join(phrases.withColumn("phrase", F.lit(1)), "like", "left")
        .groupBy("site", "path").agg(
            F.max("linked").alias("linked"), (F.sum(F.coalesce("phrase", F.lit(0)) * F.col("k")) / F.sum("k")).alias("share"))
        .where(f"linked < {LINKED} AND share < {PHRASES}").select("site", "path").join(taken, ["site", "path"], "left_anti")
    )
    many = leaves.where(~low & (F.col("n") >= EVIDENCE)).select("site", "path")
    return many.unionByName(few), phrases


def _hex(md5: Column) -> Column:
    return F.lower(F.hex(md5))


def _closings(kept: DataFrame) -> DataFrame:
    """Texts that follow the last kept block of a page: ``site, like``."""
    ends = (
        kept.groupBy("page_id", "site").agg(F.max_by("next", "pos").alias("like"))
        .where(F.col("like").isNotNull()).groupBy("site", "like").agg(F.count("*").alias("k"))
    )
    here = ends.groupBy("site").agg(F.sum("k").alias("n"))
    anywhere = (
        ends.groupBy("like").agg(F.sum("k").alias("k_all")).withColumn("one", F.lit(1))
        .join(ends.agg(F.sum("k").alias("n_all")).withColumn("one", F.lit(1)), "one")
    )
    own = ends.join(here, "site").where(F.col("k") >= CLOSING * F.col("n")).select("site", "like")
    any_site = anywhere.where(F.col("k_all") >= CLOSING_ANYWHERE * F.col("n_all")).select(F.lit("").alias("site"), "like")
    return own.unionByName(any_site)


def main_blocks(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """Article blocks of every page: ``page_id, block_md5``, each once.

    Pages with HTML are judged by their style tree; pages without use the
    lines of ``parsed``. Rows without id, HTML and lines give nothing; repeated
    rows count once in the result. Other columns are ignored.
    """
    html_pages = pages.where(F.col("page_id").isNotNull() & F.col("html").isNotNull()).select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("site", F.lit("")).alias("site"), "html")
    read = settle(html_pages.mapInPandas(_read_pages, f"page_id long, site string, paths {_PATH}, body long, blocks {_BLOCK}"))
    # Rows of one page share its weight, and so do pages of a site with one body, so that repeats do not count as agreement.
    repeats = read.groupBy("page_id").agg(F.count("*").alias("rows")).where("rows > 1")
    copies = read.where("body IS NOT NULL").groupBy("site", "body").agg(F.count("*").alias("copies")).where("copies > 1")
    blocks = (
        read.join(repeats, "page_id", "left").join(copies, ["site", "body"], "left")
        .select("page_id", "site", (1.0 / F.greatest(F.coalesce("rows", F.lit(1)), F.coalesce("copies", F.lit(1)))).alias("weight"), F.posexplode("blocks").alias("pos", "b"))
        .select("page_id", "site", "weight", "pos", "b.*")
    )
    paths = settle(read.select(F.explode("paths").alias("p")).select("p.path", "p.above").distinct())
    leaves, phrases = _judge(blocks, paths)
    leaves = settle(leaves)
    kept = blocks.join(leaves, ["site", "path"], "left_semi")
    from_html = kept.select("page_id", "md5")

    ids = parsed.where(F.col("page_id").isNotNull() & F.col("raw_data").isNotNull()).select(F.col("page_id").cast("long").alias("page_id")).distinct()
    missing = settle(ids.join(read.select("page_id"), "page_id", "left_anti"))
    titles = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), "title").join(missing, "page_id", "left_semi")
        .groupBy("page_id").agg(F.max("title").alias("title"))
    )
    lines = (
        parsed.where(F.col("raw_data").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), "url", "raw_data")
        .join(missing, "page_id", "left_semi").join(titles, "page_id", "left")
        .mapInPandas(_read_lines, f"page_id long, site string, lines {_LINE}").distinct()
        .select("page_id", "site", F.posexplode("lines").alias("pos", "b")).select("page_id", "site", "pos", "b.*")
    )
    closings = _closings(kept).withColumn("closes", F.lit(True))
    own, general = closings.where("site <> ''"), closings.where("site = ''").select("like", F.col("closes").alias("closes_any"))
    marked = (
        lines.join(phrases.withColumn("phrase", F.lit(True)), "like", "left")
        .join(own, ["site", "like"], "left").join(general, "like", "left")
        .select("page_id", "pos", "md5", "headline", F.coalesce("phrase", F.lit(False)).alias("phrase"),
                F.coalesce("closes", "closes_any", F.lit(False)).alias("closes"))
    )
    bounded = marked.groupBy("page_id").agg(
        F.coalesce(F.min(F.when(F.col("headline"), F.col("pos"))), F.min(F.when(~F.col("phrase") & ~F.col("closes"), F.col("pos")))).alias("first"),
        F.collect_list(F.struct("pos", "md5", "phrase", "closes")).alias("all"),
    )
    last = F.array_min(F.transform(
        F.filter("all", lambda x: x["closes"] & (x["pos"] > F.col("first"))), lambda x: x["pos"]))
    from_lines = (
        bounded.withColumn("last", F.coalesce(last, F.lit(2**31 - 1)))
        .select("page_id", F.explode(F.filter("all", lambda x: (x["pos"] >= F.col("first")) & (x["pos"] < F.col("last")) & ~x["phrase"])).alias("x"))
        .select("page_id", "x.md5")
    )
    return from_html.unionByName(from_lines).distinct().select("page_id", _hex(F.col("md5")).alias("block_md5"))
