"""Nested JSON records to flat, linked tables.

The whole unnesting is one projection per record: nested ``transform`` calls
carry the ancestors' keys and positions down to each child, ``flatten`` joins
the per-parent arrays, and a single ``inline`` emits the rows. There is no
explode-then-join and no Python; the only shuffle is the final ``distinct``
over the children, which combines map-side first.

Shapes that vary are read as they come, by the text of a node:

* a node beginning with ``[`` is a list;
* an object whose keys are all integers is a list in the order of those keys;
* any other object or scalar is a list of one;
* a string holding JSON counts as what it holds;
* null, a missing key and the empty string are an empty list;
* text that is no complete JSON document yields no rows.

A list whose elements are all objects, the usual shape, is parsed once: its
elements' key and the list below come out of one typed reading. Anything else
is read element by element.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = (
    "array<struct<child_kind:string,parent_pos:int,pos:int,item_key:string>>"
)
OUT = ("origin", "root_id", "child_kind", "parent_pos", "pos", "item_key")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def as_map(node: Column) -> Column:
    """Members of an object as raw text; null for anything else."""
    return F.from_json(node, "map<string,string>")


def member(node: Column, *keys: str) -> Column:
    """The member reached over ``keys``; JSON inside a string is entered."""
    for key in keys:
        node = F.element_at(as_map(node), F.lit(key))
    return node


def as_list(node: Column) -> Column:
    """The elements of a node as raw text, by the rules of the module."""
    text = F.trim(node)
    members = as_map(text)
    keys = F.map_keys(members)
    indexed = (F.size(keys) > 0) & F.forall(keys, lambda k: k.rlike("^[0-9]{1,9}$"))
    by_index = F.transform(
        F.array_sort(F.transform(
            F.map_entries(members),
            lambda e: F.struct(e["key"].try_cast("int").alias("i"), e["value"].alias("v")),
        )),
        lambda s: s["v"],
    )
    return F.coalesce(
        F.when(text.isNull() | text.isin("", "null"), F.array().cast("array<string>"))
        .when(text.startswith("["), F.from_json(text, "array<string>"))
        .when(text.startswith("{") & indexed, by_index)
        .otherwise(F.array(text)),
        F.array().cast("array<string>"),
    )


def readable(text: Column) -> Column:
    """Whether the text is one complete JSON document."""
    return F.try_parse_json(text).isNotNull()


@dataclass(frozen=True)
class Child:
    """One child table: where its list hangs and which member is its key.

    ``paths`` are tried in order from the root (or from the parent's element);
    ``bare`` says that a string element is itself the key.
    """

    kind: str
    paths: tuple[tuple[str, ...], ...]
    key: str
    keyed_object: bool = False
    positioned: bool = True
    bare: bool = False
    below: Child | None = None


def _find(node: Column, paths: tuple[tuple[str, ...], ...]) -> Column:
    """The first path that leads somewhere; the node itself is parsed once."""
    return let(as_map(node), lambda m: F.coalesce(*(member(F.element_at(m, F.lit(p[0])), *p[1:]) for p in paths)))


def _row(kind: str, parent: Column, pos: Column, key: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("child_kind"), parent.cast("int").alias("parent_pos"),
        pos.cast("int").alias("pos"), F.coalesce(key, F.lit("")).alias("item_key"),
    )


def _key(element: Column, spec: Child) -> Column:
    held = F.get(F.from_json(F.concat(F.lit("["), element, F.lit("]")), f"array<struct<`{spec.key}`:string>>"), F.lit(0))[spec.key]
    is_object = F.trim(element).startswith("{")
    return F.when(is_object, held).otherwise(element if spec.bare else F.lit(None).cast("string"))


def _rows(node: Column, spec: Child, parent: Column) -> Column:
    none = F.lit(-1)
    if spec.keyed_object:
        text = F.trim(node)
        listed = F.transform(
            F.filter(F.from_json(text, "array<string>"), lambda e: e.isNotNull()),
            lambda e: _row(spec.kind, none, none, _key(e, spec)),
        )
        mapped = F.transform(F.map_keys(as_map(text)), lambda k: _row(spec.kind, none, none, k))
        return F.coalesce(
            F.when(text.startswith("["), listed).when(text.startswith("{"), mapped),
            F.array().cast(ROW),
        )
    return let(F.trim(node), lambda text: let(
        _typed(text, spec),
        lambda typed: F.when(
            typed.isNotNull() & F.forall(typed, lambda e: e.isNotNull()),
            _linked(F.transform(typed, lambda e, i: F.struct(i.alias("i"), e["k"].alias("k"), e["b"].alias("b"))), spec, parent),
        ).otherwise(_linked(_by_element(text, spec), spec, parent))))


_ELEMENT = "struct<k:string,b:string>"


def _typed(text: Column, spec: Child) -> Column:
    """Key and lower list of all elements, null or with nulls if one is no object."""
    below = spec.below.paths[0][0] if spec.below and all(len(p) == 1 for p in spec.below.paths) and len(spec.below.paths) == 1 else None
    if spec.below is not None and below is None:
        return F.lit(None).cast(f"array<{_ELEMENT}>")
    fields = f"`{spec.key}`:string" + (f",`{below}`:string" if below else "")
    read = F.when(text.startswith("["), F.from_json(text, f"array<struct<{fields}>>"))
    return F.transform(read, lambda e: F.when(e.isNotNull(), F.struct(
        e[spec.key].alias("k"), (e[below] if below else F.lit(None).cast("string")).alias("b"))))


def _by_element(text: Column, spec: Child) -> Column:
    """Place, key and lower list of the elements of a node of any shape."""
    pairs = F.filter(F.transform(as_list(text), lambda e, i: F.struct(i.alias("i"), e.alias("e"))), lambda s: s["e"].isNotNull())
    return F.transform(pairs, lambda s: F.struct(
        s["i"].alias("i"), _key(s["e"], spec).alias("k"),
        (_find(s["e"], spec.below.paths) if spec.below else F.lit(None).cast("string")).alias("b")))


def _linked(elements: Column, spec: Child, parent: Column) -> Column:
    own = F.transform(elements, lambda s: _row(spec.kind, parent, s["i"] if spec.positioned else F.lit(-1), s["k"]))
    if spec.below is None:
        return own
    return F.concat(own, F.flatten(F.transform(elements, lambda s: _rows(s["b"], spec.below, s["i"]))))


def unnest(df: DataFrame, origin: str, id_col: str, json_col: str, specs: list[Child]) -> DataFrame:
    """Children of every record, linked to their parent.

    Columns: ``origin``, ``root_id``, ``child_kind``, ``parent_pos`` (-1: the
    root), ``pos``, ``item_key``. Records without an id or with unreadable or
    missing JSON have no rows; repeated records give their rows once; other
    columns of ``df``, whatever their names, are ignored.
    """
    read = (
        df.select(F.col(id_col).cast("long").alias("root_id"), F.col(json_col).alias("__doc"))
        .where(F.col("root_id").isNotNull() & readable(F.col("__doc")))
    )
    doc = F.col("__doc")
    rows = F.flatten(F.array(*(_rows(_find(doc, s.paths), s, F.lit(-1)) for s in specs)))
    return (
        read.select("root_id", F.inline(rows))
        .select(F.lit(origin).alias("origin"), "root_id", "child_kind", "parent_pos", "pos", "item_key")
        .distinct()
    )


SCORE = Child("score", (("student", "subject_scores"), ("data", "student", "subject_scores")), "subject", keyed_object=True)
DIRECTION = Child("direction", (("analysis", "major_directions"), ("data", "analysis", "major_directions")), "title", bare=True)
MAJOR = Child("major", (("majorList",),), "majorCode")
SCHOOL = Child(
    "school",
    (("schoolList",), ("body", "schoolList"), ("result", "schoolList"), ("data", "schoolList")),
    "universityCode", below=MAJOR,
)


def report_children(reports: DataFrame) -> DataFrame:
    """Subject scores and major directions of every report."""
    return unnest(reports, "reports", "report_id", "payload", [SCORE, DIRECTION])


def volunteer_children(volunteers: DataFrame) -> DataFrame:
    """Schools and their majors of every answer."""
    return unnest(volunteers, "volunteers", "response_id", "body", [SCHOOL])
