"""Rule-driven extraction from pages: fields, links, tables, metadata.

Pages pass once through Arrow batches, all rules in one pass; addresses are
classified and chains applied afterwards, in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import html as H


@dataclass(frozen=True)
class Rule:
    """What to take from a page. ``method``: css, xpath, regex, json, text,
    attr, meta, table, links or images."""

    name: str
    method: str
    selector: str = ""
    attribute: str = ""
    default: str = ""
    prefix: str = ""
    suffix: str = ""
    is_list: bool = False
    max_items: int = 0


def apply_rule(rule: Rule, root: H.Node, document: str, url: str) -> list[str]:
    """The raw values of one rule on one page."""
    if rule.method == "css":
        found = H.css(root, rule.selector)
        return [n.attrs.get(rule.attribute, "") for n in found] if rule.attribute else [n.text() for n in found]
    if rule.method == "xpath":
        return H.xpath(root, rule.selector)
    if rule.method == "regex":
        return [" ".join(x for x in m if x) if isinstance(m, tuple) else m for m in re.findall(rule.selector, document, re.S)]
    if rule.method == "json":
        held = [H.json_path(d, rule.selector) for d in H.script_json(root)]
        return [str(x) for v in held if v is not None for x in (v if isinstance(v, list) else [v])]
    if rule.method == "text":
        return [n.text("\n") for n in (H.css(root, rule.selector) if rule.selector else [root])]
    if rule.method == "attr":
        return [n.attrs[rule.attribute or "href"] for n in H.css(root, rule.selector) if n.attrs.get(rule.attribute or "href")]
    if rule.method == "meta":
        held = H.meta(root)
        return [held[rule.selector]] if rule.selector in held else [] if rule.selector else [f"{k}: {v}" for k, v in held.items()]
    if rule.method == "table":
        return ["\n".join(" | ".join(r) for r in t) for t in H.tables(root)]
    if rule.method in ("links", "images"):
        tags = ("a",) if rule.method == "links" else ("img",)
        return [text if rule.attribute in ("text", "alt") else address for tag, address, text in H.links(root, url) if tag in tags]
    return []


def extract(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", document: str = "html") -> DataFrame:
    """Values of every rule on every page: ``key, name, method, selector,
    field_values, used_default``. A null page gives defaults."""
    told = [asdict(r) for r in rules]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [Rule(**t) for t in told]
        for pdf in batches:
            rows = []
            for k, u, doc in zip(pdf["k"], pdf["u"], pdf["d"], strict=True):
                doc = doc if isinstance(doc, str) else ""
                root = H.parse(doc)
                for r in made:
                    values = [f"{r.prefix}{v.strip()}{r.suffix}" for v in apply_rule(r, root, doc, u if isinstance(u, str) else "") if v and v.strip()]
                    values = values[:r.max_items] if r.max_items else values if r.is_list else values[:1]
                    rows.append((k, r.name, r.method, r.selector, values or [r.default], not values))
            if rows:
                yield pd.DataFrame(rows, columns=["k", "name", "method", "selector", "field_values", "used_default"])

    src = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), F.col(document).alias("d"))
    return src.mapInPandas(work, "k long, name string, method string, selector string, field_values array<string>, used_default boolean").withColumnRenamed("k", key)


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", document: str = "html") -> DataFrame:
    """Links of every page: ``key, source_url, kind, address, text, category``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, u, *x) for k, u, d in zip(pdf["k"], pdf["u"], pdf["d"], strict=True) for x in H.links(H.parse(d), u if isinstance(u, str) else "")]
            if rows:
                yield pd.DataFrame(rows, columns=["k", "source_url", "kind", "address", "text"])

    src = pages.where(F.col(key).isNotNull() & F.col(document).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), F.col(document).alias("d"))
    found = src.mapInPandas(work, "k long, source_url string, kind string, address string, text string")
    return found.withColumn("category", category(F.col("address"), F.col("source_url"))).withColumnRenamed("k", key)


# File endings and hosts that tell a link's category.
ENDINGS = {
    "document": "pdf doc docx xls xlsx ppt pptx csv txt zip", "video": "mp4 avi mov mkv webm", "audio": "mp3 wav ogg flac",
    "image": "jpg jpeg png gif svg webp ico", "feed": "rss atom xml",
}
SOCIAL = "facebook.com twitter.com x.com instagram.com linkedin.com youtube.com t.me weibo.com".split()


def category(address: Column, source: Column) -> Column:
    """Kind of a link: by ending, mail, social host, own host, or external."""
    host = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")
    path = F.lower(F.regexp_extract(address, r"^[a-z]+://[^/?#]+([^?#]*)", 1))
    out = None
    for name, endings in ENDINGS.items():
        test = path.rlike(rf"\.(?:{endings.replace(' ', '|')})$")
        out = F.when(test, name) if out is None else out.when(test, name)
    social = "|".join(re.escape(s) for s in SOCIAL)
    return out.when(address.startswith("mailto:"), "email").when(host(address).rlike(rf"(?:^|\.)(?:{social})$"), "social").when(host(address) == host(source), "internal").otherwise("external")


def page_tables(pages: DataFrame, key: str = "page_id", document: str = "html") -> DataFrame:
    """Rows of every table: ``key, table_no, row_no, cells``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, j, cells) for k, d in zip(pdf["k"], pdf["d"], strict=True) for i, t in enumerate(H.tables(H.parse(d))) for j, cells in enumerate(t)]
            if rows:
                yield pd.DataFrame(rows, columns=["k", "table_no", "row_no", "cells"])

    src = pages.where(F.col(key).isNotNull() & F.col(document).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(document).alias("d"))
    return src.mapInPandas(work, "k long, table_no int, row_no int, cells array<string>").withColumnRenamed("k", key)


def page_metadata(pages: DataFrame, key: str = "page_id", document: str = "html") -> DataFrame:
    """Named metadata of every page: ``key, name, content``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, c) for k, d in zip(pdf["k"], pdf["d"], strict=True) for n, c in H.meta(H.parse(d)).items()]
            if rows:
                yield pd.DataFrame(rows, columns=["k", "name", "content"])

    src = pages.where(F.col(key).isNotNull() & F.col(document).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(document).alias("d"))
    return src.mapInPandas(work, "k long, name string, content string").withColumnRenamed("k", key)


#: Rules that are tried on a page of unknown make.
SUGGESTED = (
    Rule("title", "css", "title"), Rule("description", "meta", "description"), Rule("heading", "css", "h1"), Rule("article", "css", "article"),
    Rule("main", "css", "main"), Rule("links", "links", is_list=True), Rule("images", "images", is_list=True), Rule("tables", "table", is_list=True))
#: Characters of a sample.
SAMPLE = 100


def suggest_rules(pages: DataFrame, key: str = "page_id", url: str = "url", document: str = "html") -> DataFrame:
    """The rules of ``SUGGESTED`` that find something on a page: ``key, name,
    method, selector, found, sample``, where ``sample`` is the beginning of the
    first find."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, u, d in zip(pdf["k"], pdf["u"], pdf["d"], strict=True):
                root = H.parse(d)
                for rule in SUGGESTED:
                    got = [str(v).strip() for v in apply_rule(rule, root, d, u or "")]
                    got = [v for v in got if v]
                    if got:
                        rows.append((k, rule.name, rule.method, rule.selector, len(got), got[0][:SAMPLE]))
            if rows:
                yield pd.DataFrame(rows, columns=["k", "name", "method", "selector", "found", "sample"])

    src = pages.where(F.col(key).isNotNull() & F.col(document).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), F.col(document).alias("d"))
    return src.mapInPandas(work, "k long, name string, method string, selector string, found int, sample string").withColumnRenamed("k", key)


# Marks of challenge pages, by kind and weight.
CHALLENGES = (
    ("recaptcha", 3, r"g-recaptcha|recaptcha/api\.js"), ("hcaptcha", 3, r"h-captcha|hcaptcha\.com"), ("turnstile", 3, r"cf-turnstile|challenges\.cloudflare\.com"),
    ("cloudflare", 2, r"checking your browser|cf-browser-verification"), ("generic", 1, r"captcha|are you a robot|unusual traffic"),
)


def detect_challenge(document: Column) -> Column:
    """Kind of challenge a page shows, the surest mark first, or none."""
    low = F.lower(document)
    out = None
    for kind, _, pattern in sorted(CHALLENGES, key=lambda c: -c[1]):
        out = F.when(low.rlike(pattern), kind) if out is None else out.when(low.rlike(pattern), kind)
    return F.coalesce(out.otherwise("none"), F.lit("none"))
