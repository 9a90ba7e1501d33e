"""A lenient HTML tree with selectors, on the standard library alone.

The tree is built once for each page inside an Arrow batch; selectors are
compiled once for each task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "p": {"p"}, "div": {"p"}, "ul": {"p"}, "ol": {"p"}, "table": {"p"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}, "section": {"p"}, "article": {"p"},
}
HIDDEN = frozenset(("script", "style", "noscript"))


class Node:
    """An element: its tag, attributes and children (nodes and strings)."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def strings(self, hidden: bool = False) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif hidden or c.tag not in HIDDEN:
                yield from c.strings(hidden)

    def text(self, separator: str = "") -> str:
        parts = (s.strip() for s in self.strings())
        return separator.join(p for p in parts if p)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag, ())
        while self.at.tag in ends:
            self.at, self.depth = self.at.parent, self.depth - 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID and self.depth < 400:  # deeper nesting stays flat
            self.at, self.depth = node, self.depth + 1

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node, up = self.at, 0
        while node.parent is not None and node.tag != tag:
            node, up = node.parent, up + 1
        if node.parent is not None:
            self.at, self.depth = node.parent, self.depth - up - 1

    def handle_data(self, data):
        self.at.children.append(data)


def parse(document: str | None) -> Node:
    builder = _Builder()
    if document:
        builder.feed(document)
        builder.close()
    return builder.root


# ------------------------------------------------------------------ selectors

_SIMPLE = re.compile(r"(?P<tag>^[a-zA-Z][\w-]*|^\*)|#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<op>[~^$*|]?=)[\"']?(?P<value>[^\"'\]]*)[\"']?)?\]|:(?P<pseudo>first-child|last-child)|:nth-child\((?P<nth>\d+)\)")


def _matches(node: Node, simple: str) -> bool:
    for m in _SIMPLE.finditer(simple):
        g = m.groupdict()
        if g["tag"] and g["tag"] != "*" and node.tag != g["tag"].lower():
            return False
        if g["id"] and node.attrs.get("id") != g["id"]:
            return False
        if g["class"] and g["class"] not in node.attrs.get("class", "").split():
            return False
        if g["attr"]:
            held = node.attrs.get(g["attr"])
            if held is None or g["op"] and not {
                "=": held == g["value"], "~=": g["value"] in held.split(), "^=": held.startswith(g["value"]),
                "$=": held.endswith(g["value"]), "*=": g["value"] in held, "|=": held == g["value"] or held.startswith(g["value"] + "-"),
            }[g["op"]]:
                return False
        if g["pseudo"] or g["nth"]:
            kin = [c for c in node.parent.children if isinstance(c, Node)]
            at = {"first-child": 0, "last-child": len(kin) - 1}.get(g["pseudo"], int(g["nth"] or 1) - 1)
            if not 0 <= at < len(kin) or kin[at] is not node:
                return False
    return True


def _fits(node: Node, steps: list[str]) -> bool:
    if not _matches(node, steps[-1]):
        return False
    if len(steps) == 1:
        return True
    if steps[-2] == ">":
        return node.parent is not None and node.parent.tag != "" and _fits(node.parent, steps[:-2])
    up = node.parent
    while up is not None and up.tag != "":
        if _fits(up, steps[:-1]):
            return True
        up = up.parent
    return False


def css(root: Node, selector: str) -> list[Node]:
    """Elements for a selector of tags, ids, classes, attributes, child and
    descendant steps, and groups."""
    groups = [re.sub(r"\s*>\s*", " > ", g.strip()).split() for g in selector.split(",") if g.strip()]
    return [n for n in root.walk() if any(_fits(n, g) for g in groups)]


_STEP = re.compile(r"(//|/)?(@?[\w*-]+|text\(\))((?:\[[^\]]+\])*)")


def xpath(root: Node, path: str) -> list[str]:
    """Texts or attributes for a path of child and descendant steps with
    position, attribute and contains() conditions. A bad path gives nothing."""
    nodes, out = [root], None
    for axis, name, conditions in _STEP.findall(path):
        if name.startswith("@"):
            out = [n.attrs[name[1:]] for n in nodes if name[1:] in n.attrs]
            break
        if name == "text()":
            out = [s.strip() for n in nodes for s in n.children if isinstance(s, str) and s.strip()]
            break
        found = []
        for n in nodes:
            pool = list(n.walk()) if axis == "//" else [c for c in n.children if isinstance(c, Node)]
            if axis == "/" and n is root and name == "html":
                pool = [c for c in n.walk() if c.tag == "html"]
            hits = [c for c in pool if name in ("*", c.tag)]
            for cond in re.findall(r"\[([^\]]+)\]", conditions):
                hits = _condition(hits, cond)
            found += [h for h in hits if not any(h is f for f in found)] if axis == "//" and len(nodes) > 1 else hits
        nodes = found
    return out if out is not None else [n.text(" ") for n in nodes]


def _condition(nodes: list[Node], cond: str) -> list[Node]:
    if cond.isdigit():
        seen: dict[int, int] = {}
        out = []
        for n in nodes:
            seen[id(n.parent)] = seen.get(id(n.parent), 0) + 1
            if seen[id(n.parent)] == int(cond):
                out.append(n)
        return out
    m = re.fullmatch(r"@([\w:-]+)(?:\s*=\s*[\"'](.*)[\"'])?", cond.strip())
    if m:
        return [n for n in nodes if m[1] in n.attrs and (m[2] is None or n.attrs[m[1]] == m[2])]
    m = re.fullmatch(r"contains\((?:@([\w:-]+)|text\(\)|\.),\s*[\"'](.*)[\"']\)", cond.strip())
    if m:
        return [n for n in nodes if m[2] in (n.attrs.get(m[1], "") if m[1] else n.text(" "))]
    return []


# ------------------------------------------------------------------- parts


def tables(root: Node) -> list[list[list[str]]]:
    """Cells of the rows of each table; rows of inner tables stay inside."""
    def rows(t: Node) -> list[list[str]]:
        found, todo = [], [c for c in t.children if isinstance(c, Node)]
        while todo:
            n = todo.pop(0)
            if n.tag == "tr":
                found.append([c.text(" ") for c in n.children if isinstance(c, Node) and c.tag in ("td", "th")])
            elif n.tag != "table":
                todo = [c for c in n.children if isinstance(c, Node)] + todo
        return found

    return [rows(t) for t in root.walk() if t.tag == "table"]


def meta(root: Node) -> dict[str, str]:
    """Title, canonical link and every named meta tag; the last one holds."""
    out = {}
    for n in root.walk():
        if n.tag == "title":
            out["title"] = n.text()
        elif n.tag == "meta":
            name = n.attrs.get("name") or n.attrs.get("property")
            if name and n.attrs.get("content"):
                out[name] = n.attrs["content"]
        elif n.tag == "link" and n.attrs.get("rel") == "canonical":
            out["canonical_url"] = n.attrs.get("href", "")
    return out


def absolute(url: str, base: str) -> str | None:
    """The http address without fragment, or None."""
    try:
        full = urldefrag(urljoin(base, url.strip()))[0]
        return full if urlparse(full).scheme in ("http", "https") and urlparse(full).netloc else None
    except ValueError:
        return None


SKIPPED = ("#", "javascript:", "data:", "void", "tel:")


def links(root: Node, base: str) -> list[tuple[str, str, str]]:
    """Kind, address and text of what a page points to, each address once."""
    seen, out = set(), []
    for n in root.walk():
        where = {"a": "href", "img": "src", "source": "src", "video": "src", "audio": "src", "embed": "src", "iframe": "src", "link": "href"}.get(n.tag)
        raw = n.attrs.get(where or "", "") or (n.attrs.get("data-src", "") if n.tag == "img" else "")
        if not raw or raw.strip().lower().startswith(SKIPPED) or n.tag == "link" and n.attrs.get("rel", "") in ("stylesheet", "icon"):
            continue
        full = raw if raw.startswith("mailto:") else absolute(raw, base)
        if full and full not in seen:
            seen.add(full)
            out.append((n.tag, full, n.text(" ") if n.tag == "a" else n.attrs.get("alt", "")))
    return out


def json_path(data, path: str):
    """``key.inner[0]`` in decoded JSON; None where it leads nowhere."""
    for part in re.findall(r"[^.\[\]]+|\[\d+\]", path):
        if part.startswith("["):
            i = int(part[1:-1])
            data = data[i] if isinstance(data, list) and i < len(data) else None
        else:
            data = data.get(part) if isinstance(data, dict) else None
        if data is None:
            return None
    return data


def script_json(root: Node) -> list:
    """Documents in JSON scripts, else in any script that holds one."""
    scripts = [n for n in root.walk() if n.tag == "script"]
    typed = [n for n in scripts if "json" in n.attrs.get("type", "")]
    out = []
    for n in typed or scripts:
        try:
            out.append(json.loads("".join(n.strings(True))))
        except ValueError:
            pass
    return out
