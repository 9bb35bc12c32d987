"""Deeply nested semi-structured records to related flat tables.

The operator opens JSON level by level with every member as text, so one member may be an object in
one record, a list in the next and a JSON text in a third. ``merged_schema`` infers which types every path takes over all
records. ``inferred`` makes a tree of ``Level`` from it in which every list and object at any path
is a child table and every other member a column; a tree written by hand only gives names, says
which members are the same thing and which are maps. ``flatten`` explodes each level
recursively, every child row carrying the surrogate key of its parent and its own ordinal.

Defined cases: a payload that is null, empty or broken gives no rows in any table; a single member
outside a list has ordinal 0; null elements of a list keep their ordinal but give no row; a member
absent or null gives no child rows; repeated records give their rows once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import spread


@dataclass(frozen=True)
class Level:
    """One child table. ``members`` are alternative names of the list below the parent, the first
    present and non-null one holds; ``""`` is the parent's value itself where that is a list."""

    name: str
    members: tuple[str, ...]
    children: tuple["Level", ...] = ()
    keyed: bool = False  # a map (object) or a list of {key, value}: one row per entry
    fields: dict[str, tuple[str, ...]] = field(default_factory=dict)


#: The merged schema is collected to make the levels; a larger one is refused.
MOST_PATHS = 10_000
Path = tuple[str | None, ...]  # names of members, None for the elements of a list


def _paths(value: object, out: set[tuple[Path, str]], texts: bool = False, closed: frozenset[Path] = frozenset()) -> None:
    """``texts``: also within members that are JSON texts. ``closed``: paths of maps (without the
    lists on the way), whose keys are data."""
    todo: list[tuple[object, Path]] = [(value, ())]
    while todo:
        v, p = todo.pop()
        if isinstance(v, str):
            out.add((p, "str"))
            if not texts or v.lstrip()[:1] not in ("[", "{"):
                continue
            try:
                v = json.loads(v)
            except (ValueError, RecursionError):
                continue
        inside = not closed or tuple(x for x in p if x is not None) not in closed
        if isinstance(v, dict):
            out.add((p, "object"))
            todo += [(x, (*p, k)) for k, x in v.items() if inside]
        elif isinstance(v, list):
            out.add((p, "array"))
            todo += [(x, (*p, None)) for x in v if inside]
        else:
            out.add((p, "null" if v is None else type(v).__name__))


def _shown(p: Path) -> str:
    return "$" + "".join("[]" if x is None else f".{x}" for x in p)


def _typed_paths(df: DataFrame, payload: str, shown: Callable[[Path], str], **how: object) -> DataFrame:
    """(path, type): distinct within each Arrow stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[Path, str]] = set()
        for b in batches:
            new: set[tuple[Path, str]] = set()
            for text in b["_p"]:
                if not text:
                    continue
                try:
                    _paths(json.loads(text), new, **how)
                except (ValueError, RecursionError):
                    continue
            new -= seen
            seen |= new
            yield pd.DataFrame(sorted((shown(p), t) for p, t in new), columns=["path", "type"])

    return df.select(F.col(payload).alias("_p")).mapInPandas(run, "path string, type string")


def merged_schema(df: DataFrame, payload: str) -> DataFrame:
    """(path, types): every path of all readable payloads with the sorted types it takes.

    One pass; each Arrow batch emits only its distinct (path, type) pairs.
    """
    return _typed_paths(df, payload, _shown).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"))


@dataclass
class _Node:
    """What stands at one path of the merged schema."""

    types: set[str] = field(default_factory=set)
    kids: dict[str, "_Node"] = field(default_factory=dict)
    elem: "_Node | None" = None

    def at(self, p: Path) -> "_Node":
        n = self
        for x in p:
            if x is None:
                n.elem = n.elem or _Node()
                n = n.elem
            else:
                n = n.kids.setdefault(x, _Node())
        return n


def _closed(names: tuple[Level, ...], at: tuple[Path, ...] = ((),)) -> Iterator[Path]:
    for lv in names:
        here = tuple((*p, m) if m else p for p in at for m in lv.members)
        if lv.keyed:
            yield from here
        yield from _closed(lv.children, here)


def inferred(df: DataFrame, payload: str, names: tuple[Level, ...] = (), key: str = "rec_id") -> tuple[Level, ...]:
    """The levels of the merged schema. ``names`` are aliases: a path they do not name has a level (or
    column) called as its member, with the parent's name before it where that is taken; a level they
    name is there even if no record has it."""
    found = _typed_paths(df, payload, lambda p: json.dumps(p), texts=True, closed=frozenset(_closed(names))).distinct()
    rows = found.limit(MOST_PATHS + 1).collect()
    if len(rows) > MOST_PATHS:
        raise ValueError(f"the merged schema has more than {MOST_PATHS} paths")
    root = _Node()
    for r in sorted(rows):
        root.at(tuple(json.loads(r["path"]))).types.add(r["type"])

    taken: set[str] = set()

    def reserve(levels: tuple[Level, ...]) -> None:
        for lv in levels:
            taken.add(lv.name.lower())
            reserve(lv.children)

    def unique(name: str, used: set[str], parent: str) -> str:
        name = re.sub("[.`]", "_", name)  # no column name needs quoting
        name = f"{parent}_{name}" if name.lower() in used and parent else name
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        return name

    def below(at: list[_Node], parent: str, names: tuple[Level, ...], keys: set[str]) -> tuple[Level, ...]:
        """Levels below rows that look like the nodes ``at``."""
        kids: dict[str, list[_Node]] = {}
        for n in at:
            for k, x in n.kids.items():
                kids.setdefault(k, []).append(x)
        lists = [_Node({"array"}, {}, n.elem) for n in at if n.elem]
        named = {m for lv in names for m in lv.members}
        new = [Level(unique(k, taken, parent), (k,)) for k, ns in sorted(kids.items()) if k not in named and any(n.types & {"array", "object"} for n in ns)]
        if lists and "" not in named:
            new.append(Level(unique(f"{parent}_item" if parent else "item", taken, ""), ("",)))
        out = []
        for lv in (*names, *new):
            if lv.keyed:
                out.append(lv)
                continue
            held = [n for m in lv.members for n in (kids.get(m, []) if m else lists)]
            rows = [_Node(n.types, n.kids) for n in held] + [n.elem for n in held if n.elem]
            inner = keys | {f"{lv.name}_no".lower()}
            deeper = below(rows, lv.name, lv.children, inner)
            used = inner | {"value", *(f.lower() for f in lv.fields)}
            said = {m for ms in lv.fields.values() for m in ms} | {m for x in lv.children for m in x.members}
            plain = sorted({k for n in rows for k, x in n.kids.items() if k not in said and x.types - {"array", "object", "null"} or k not in said and x.types == {"null"}})
            fields = lv.fields | {unique(k, used, ""): (k,) for k in plain}
            out.append(Level(lv.name, lv.members, deeper, fields=fields))
        return tuple(out)

    reserve(names)
    return below([root], "", names, {key.lower()})


#: An object with its members as text: objects and lists come out as JSON text, strings bare. A member
#: that is a JSON object in one record and a JSON text holding an object in the next thus looks the
#: same in both. Names of members are data here and may hold anything.
OPENED = "map<string,string>"


def _member(names: tuple[str, ...]) -> Column:
    """The first present and non-null of alternative members of the opened value."""
    return F.coalesce(*[F.try_element_at("_o", F.lit(m)) for m in names], F.lit(None).cast("string"))


def as_list(c: Column) -> Column:
    """The elements of a JSON list, or a list of the single value; null for null."""
    return F.when(c.rlike(r"^\s*\["), F.coalesce(F.from_json(c, "array<string>"), F.array(c))).otherwise(F.when(c.isNotNull(), F.array(c)))


def _entries(c: Column) -> Column:
    """(no, item, value) of a map, or of a list of {key, value}: the position of an entry in the list
    (null in a map, which has no order), its key and its value as text. Entries without key are none."""
    of_list = F.transform(F.from_json(c, "array<struct<key: string, value: string>>"), lambda x, i: F.struct(i.alias("no"), x.key.alias("item"), x.value.alias("value")))
    of_map = F.transform(F.map_entries(F.from_json(c, OPENED)), lambda x: F.struct(F.lit(None).cast("int").alias("no"), x.key.alias("item"), x.value.alias("value")))
    return F.when(c.rlike(r"^\s*\["), F.filter(of_list, lambda x: x["item"].isNotNull())).otherwise(of_map)


def flatten(df: DataFrame, key: str, payload: str, levels: tuple[Level, ...]) -> dict[str, DataFrame]:
    """Child tables by level name.

    Columns of each: the record ``key``, ``<ancestor>_no`` for every enclosing level, ``<name>_no``
    (own ordinal), the level's ``fields`` as strings, and ``value`` (JSON text). Keyed levels have
    ``item`` (the key) and ``value`` (null stays null); their ordinal is null for a map.
    """
    root = spread(df.select(F.col(key), F.col(payload).alias("value")))
    root = root.where("value rlike '^\\\\s*[\\\\{\\\\[]' and try_parse_json(value) is not null")
    out: dict[str, DataFrame] = {}

    def expand(parent: DataFrame, keys: list[str], levels: tuple[Level, ...]) -> None:
        opened = parent.withColumn("_o", F.from_json("value", OPENED))
        for lv in levels:
            held = _member(tuple(m for m in lv.members if m))
            if lv.keyed:
                entries = opened.select(*keys, held.alias("_h")).where("_h is not null").select(*keys, F.explode(_entries(F.col("_h"))).alias("_e"))
                out[lv.name] = entries.select(*keys, F.col("_e.no").alias(f"{lv.name}_no"), "_e.item", "_e.value")
                continue
            if "" in lv.members:
                held = F.when(F.col("value").rlike(r"^\s*\["), F.col("value")).otherwise(held)
            no = f"{lv.name}_no"
            child = opened.select(*keys, held.alias("_h")).where("_h is not null").select(*keys, F.posexplode(as_list(F.col("_h"))).alias(no, "value")).where("value is not null")
            full = child.withColumn("_o", F.from_json("value", OPENED)) if lv.fields else child
            out[lv.name] = full.select(*keys, no, *[_member(ms).alias(f) for f, ms in lv.fields.items()], "value")
            expand(child, [*keys, no], lv.children)

    expand(root, [key], levels)
    return out


#: Names of the levels and columns of annotation records, with the members that mean the same.
SOURCE = Level("source", ("sources",))
SEMANTIC_TYPE = Level("semantic_type", ("semantic_types", "semantictypes"))
CONCEPT = Level("concept", ("concept", "conceptinfo"), (SOURCE, SEMANTIC_TYPE), fields={"cui": ("cui",), "preferred_name": ("preferred_name", "preferredname")})
EV = Level("ev", ("evs", "evlist"), (CONCEPT,), fields={"ev_id": ("id",), "score": ("score",)})
ENTITY = Level("entity", ("entities", ""), (EV,), fields={"entity_id": ("id",), "matched_text": ("text", "matchedtext")})
PASSAGE = Level("passage", ("passages",), (Level("infon", ("infons",), keyed=True),), fields={"offset": ("offset",), "text": ("text",)})
ANNOTATION_RECORD = (PASSAGE, ENTITY)


def annotation_tables(df: DataFrame, key: str = "rec_id", payload: str = "payload") -> dict[str, DataFrame]:
    """passage, infon, entity, ev, concept, source and semantic_type tables of annotation records, and one
    more for every other list or object their merged schema has."""
    return flatten(df, key, payload, inferred(df, payload, ANNOTATION_RECORD, key))


def children(df: DataFrame, key: str = "rec_id", payload: str = "payload") -> DataFrame:
    """(child, key, parent_no, ev_no, item): every readable child of the records, each once."""
    t = annotation_tables(df, key, payload)
    none = F.lit(-1)
    concept = _member(("concept", "conceptinfo"))
    ev = t["ev"].withColumn("_o", F.from_json("value", OPENED)).withColumn("_l", as_list(concept))
    cuis = F.transform("_l", lambda v: F.from_json(v, "struct<cui: string>").cui)
    ev = ev.withColumn("cui", F.coalesce(F.get(F.filter(cuis, lambda c: c.isNotNull()), F.lit(0)), F.lit("")))

    def row(d: DataFrame, child: str, parent: str, ev: Column, item: Column) -> DataFrame:
        return d.select(F.lit(child).alias("child"), F.col(key), F.col(parent).cast("int").alias("parent_no"), ev.cast("int").alias("ev_no"), item.alias("item"))

    parts = [
        row(t["entity"], "entity", "entity_no", none, F.lit("")),
        row(ev, "ev", "entity_no", F.col("ev_no"), F.col("cui")),
        row(t["source"], "source", "entity_no", F.col("ev_no"), F.col("value")),
        row(t["infon"], "infon", "passage_no", none, F.col("item")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
