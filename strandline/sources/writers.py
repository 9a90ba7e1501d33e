"""Sinks: one call for every format, and texts for small results."""

from __future__ import annotations

import html
import re
import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shown(df: DataFrame) -> DataFrame:
    """Without internal columns (leading underscore); lists joined by "; "."""
    out = []
    for c, t in df.dtypes:
        if c.startswith("_"):
            continue
        col = F.col(f"`{c}`")
        out.append((F.array_join(col.cast("array<string>"), "; ") if t.startswith("array") else F.to_json(col) if t.startswith(("struct", "map")) else col).alias(c))
    return df.select(*out)


def export(df: DataFrame, path: str, kind: str, mode: str = "overwrite") -> None:
    """Write in parallel as csv, json, xml, parquet or orc; as html or sqlite
    row by row through the driver, without collecting."""
    if kind == "csv":
        shown(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        df.select(*(f"`{c}`" for c in df.columns if not c.startswith("_"))).write.mode(mode).json(path)
    elif kind == "xml":
        safe = shown(df).toDF(*(xml_name(c) for c in shown(df).columns))
        safe.write.mode(mode).option("rootTag", "data").option("rowTag", "item").xml(path)
    elif kind in ("parquet", "orc"):
        df.write.mode(mode).format(kind).save(path)
    elif kind == "html":
        _html(shown(df), path)
    elif kind == "sqlite":
        _sqlite(shown(df), path)
    else:
        raise ValueError(f"no such format: {kind}")


def xml_name(name: str) -> str:
    clean = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return f"f_{clean}" if not clean or clean[0].isdigit() else clean


def _html(df: DataFrame, path: str) -> None:
    with Path(path).open("w", encoding="utf-8") as f:
        f.write("<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>\n")
        for row in df.toLocalIterator():
            f.write("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in row) + "</tr>\n")
        f.write("</table>\n")


def _sqlite(df: DataFrame, path: str) -> None:
    Path(path).unlink(missing_ok=True)
    quoted = ", ".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE data ({', '.join(q + ' TEXT' for q in quoted.split(', '))})")
        marks = ", ".join("?" * len(df.columns))
        rows = (tuple(None if v is None else str(v) for v in r) for r in df.toLocalIterator())
        db.executemany(f"INSERT INTO data VALUES ({marks})", rows)
        db.execute("CREATE TABLE _metadata (key TEXT, value TEXT)")
        db.execute("INSERT INTO _metadata VALUES ('columns', ?)", (str(len(df.columns)),))


def preview(df: DataFrame, rows: int = 10, width: int = 40) -> str:
    """The first rows as text of fixed width."""
    head = [list(df.columns), *([("" if v is None else str(v))[:width] for v in r] for r in df.limit(rows).collect())]
    sizes = [max(len(str(r[i])) for r in head) for i in range(len(df.columns))]
    return "\n".join("  ".join(str(v).ljust(n) for v, n in zip(r, sizes, strict=True)).rstrip() for r in head)
