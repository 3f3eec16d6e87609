"""Deeply nested JSON records to related flat tables, by Dewey labels.

Each node gets the ordinals on its way from the root as its label (``[2, 0, 5]``) besides the names on that way
(its schema path, ``sections.block.fields``). The parent's label is the label with its last ordinal cut off, so parents need no
join; a printed path is made from a schema path and a label. Nodes of one schema path are one table.

A payload is parsed once, inside an Arrow batch; nothing is shuffled. One record is one unit of work whatever its size and depth.

Defined results: a null, empty or incomplete payload gives no nodes; a null element keeps its ordinal and gives no node; an
object where a list belongs is a list of one; repeated records give repeated rows (``p1_found`` makes them distinct); other
columns of the input are left out, so clashing names cannot occur. Envelopes and JSON within strings may be nested to any depth, with blanks around.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shape of a ParsedDocument: name -> (kind, children). Kind None: an object on the way, of which nodes hang from the
#: element above; a child named "" is a list directly in the list (the cells of a row).
BLOCK = {"fields": ("field", {}), "paragraphs": ("paragraph", {}), "items": ("item", {})}
TABLES = {"tables": ("table", {"rows": ("row", {"": ("cell", {})})})}
PARSED_DOCUMENT = {"preface": (None, BLOCK), "sections": ("section", {"block": (None, BLOCK), **TABLES}), **TABLES}

#: The attributes of each kind's table.
COLUMNS = {
    "section": "number string, title string, inline_value string",
    "field": "label string, value string",
    "paragraph": "text string, page string",
    "item": "text string, page string",
    "table": "page string, strategy string, bbox string",
    "row": "cells int",
    "cell": "text string, page string",
}

_KEYS = frozenset(PARSED_DOCUMENT) | {"signature_columns", "page_footers"}
_JSON_BLANK = " \t\n\r﻿"


# ---- JSON of any depth --------------------------------------------------------------------------------------------------
_TOKEN = re.compile(r'[ \t\n\r]*([\[\]{},:]|"(?:[^"\\\x00-\x1f]|\\.)*"|[^\s\[\]{},:"]+)')


def parsed(text: str) -> Any:
    """A JSON text's value. ValueError where it is none; texts nested too deeply for the library's parser are read with a stack."""
    try:
        return json.loads(text.strip(_JSON_BLANK))
    except RecursionError:
        return _parsed_deep(text.strip(_JSON_BLANK))


def _parsed_deep(text: str) -> Any:
    root: list = []
    open_: list[tuple[Any, str]] = [(root, "value")]  # container and what it waits for
    at, key = 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError("no JSON")
        at, t = m.end(), m[1]
        box, wants = open_[-1]
        if t in "]}":
            if len(open_) == 1 or (t == "]") != isinstance(box, list) or wants not in ("first", "next"):
                raise ValueError("no JSON")
            open_.pop()
        elif t == "," and wants == "next" and len(open_) > 1:
            open_[-1] = (box, "value" if isinstance(box, list) else "key")
        elif t == ":" and wants == "colon":
            open_[-1] = (box, "value")
        elif isinstance(box, dict) and wants in ("first", "key") and t[0] == '"':
            key.append(json.loads(t))
            open_[-1] = (box, "colon")
        elif wants == "value" or wants == "first" and isinstance(box, list):
            x = [] if t == "[" else {} if t == "{" else json.loads(t)
            if isinstance(box, list):
                box.append(x)
            else:
                box[key.pop()] = x
            open_[-1] = (box, "next")
            if t in "[{":
                open_.append((x, "first"))
        else:
            raise ValueError("no JSON")
    if len(open_) > 1 or len(root) != 1:
        raise ValueError("no JSON")
    return root[0]


def _documents(payload: str) -> Iterator[dict]:
    """The ParsedDocuments in a payload, out of strings of JSON, lists and envelopes around them, in their order."""
    todo: list[Any] = [payload]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            try:
                todo.append(parsed(x))
            except ValueError:
                continue
        elif isinstance(x, dict) and not _KEYS.isdisjoint(x):
            yield x
        elif isinstance(x, (list, dict)):
            inner = x if isinstance(x, list) else list(x.values())
            todo += [y for y in reversed(inner) if isinstance(y, (dict, list)) or isinstance(y, str) and y.lstrip(_JSON_BLANK)[:1] in ("{", "[", '"')]


# ---- schema paths -------------------------------------------------------------------------------------------------------


def schema_paths(shape: dict, names: str = "", path: str = "", parent: str | None = None) -> dict[str, tuple[str, str, str | None]]:
    """Each schema path's kind, its printed form with "#" for each ordinal, and its parent's schema path."""
    out = {}
    for name, (kind, children) in shape.items():
        schema = f"{names}[]" if name == "" else f"{names}.{name}" if names else name
        here = path if name == "" else f"{path}.{name}" if path else name
        if kind is None:
            # What hangs from an object at the top has that object's own name for a parent.
            out |= schema_paths(children, schema, here, parent if parent else f"={here}")
        else:
            out |= {schema: (kind, f"{here}[#]", parent)} | schema_paths(children, schema, f"{here}[#]", schema)
    return out


def printed(pattern: str, dewey: Column) -> Column:
    """A printed path: the label's ordinals in the places of "#"."""
    literal = pattern.split("#")
    parts = [F.lit(literal[0])]
    for i, text in enumerate(literal[1:], 1):
        parts += [F.element_at(dewey, i).cast("string"), F.lit(text)]
    return F.concat(*parts)


def with_paths(nodes: DataFrame, shape: dict = PARSED_DOCUMENT) -> DataFrame:
    """Adds node_kind, node_path and parent_path to nodes (schema_path, dewey). The parent's label is the label without its last ordinal."""
    paths = schema_paths(shape)
    up = F.slice("dewey", 1, F.size("dewey") - 1)

    def by_path(one) -> Column:
        out = None
        for s, what in paths.items():
            out = F.when(F.col("schema_path") == s, one(*what)) if out is None else out.when(F.col("schema_path") == s, one(*what))
        return out

    def parent(_kind: str, _pattern: str, of: str | None) -> Column:
        return F.lit("") if of is None else F.lit(of[1:]) if of[0] == "=" else printed(paths[of][1], F.col("_up"))

    return (
        nodes.withColumn("_up", up)
        .withColumn("node_kind", by_path(lambda kind, *_: F.lit(kind)))
        .withColumn("node_path", by_path(lambda _, pattern, __: printed(pattern, F.col("dewey"))))
        .withColumn("parent_path", by_path(parent))
        .drop("_up")
    )


# ---- nodes --------------------------------------------------------------------------------------------------------------


def _plain(x: Any) -> Any:
    """The value of a SourcedValue, or the thing itself."""
    return x.get("value") if isinstance(x, dict) and "value" in x and not isinstance(x["value"], (dict, list)) else x


def _body(kind: str, x: Any) -> str:
    """The node's own attributes as JSON, without what its child nodes hold."""
    if kind == "section" and isinstance(x, dict):
        out = {k: _plain(x.get(k)) for k in ("number", "title", "inline_value")}
    elif kind == "field" and isinstance(x, dict):
        out = {k: _plain(x.get(k)) for k in ("label", "value")}
    elif kind == "table" and isinstance(x, dict):
        out = {k: x.get(k) for k in ("page", "strategy", "bbox")}
    elif kind == "row":
        out = {"cells": len(x) if isinstance(x, list) else 1}
    else:
        out = {"text": _plain(x)}
        if isinstance(x, dict):
            out["page"] = x.get("page")
    return json.dumps(out, ensure_ascii=False)


class _Nodes:
    """The nodes of a batch as columns: numbers of schema paths, labels laid end to end, bodies."""

    def __init__(self, shape: dict, bodies: bool):
        self.number = {s: i for i, s in enumerate(schema_paths(shape))}
        self.bodies = bodies
        self.schema: list[int] = []
        self.ordinals: list[int] = []
        self.size: list[int] = []
        self.body: list[str] = []

    def walk(self, x: Any, shape: dict, names: str, dewey: list[int]) -> None:
        """Adds the nodes below an object (or, for the child "", a list). As deep as the shape, not as the record."""
        for name, (kind, children) in shape.items():
            y = x if name == "" else x.get(name) if isinstance(x, dict) else None
            if y is None:
                continue
            schema = f"{names}[]" if name == "" else f"{names}.{name}" if names else name
            if kind is None:
                self.walk(y[0] if isinstance(y, list) and len(y) == 1 else y, children, schema, dewey)
                continue
            if not isinstance(y, list):
                if not isinstance(y, dict) and kind in ("section", "field", "table", "row"):
                    continue
                y = [y]
            number, n = self.number[schema], len(dewey) + 1
            for i, e in enumerate(y):
                if e is None:
                    continue
                label = [*dewey, i]
                self.schema.append(number)
                self.ordinals += label
                self.size.append(n)
                if self.bodies:
                    self.body.append(_body(kind, e))
                if children:
                    self.walk(e, children, schema, label)


def dewey_nodes(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload", shape: dict = PARSED_DOCUMENT, bodies: bool = True) -> DataFrame:
    """One row per node of every record: ``id_col``, schema_path, dewey, and with ``bodies`` the node's own attributes as JSON (body)."""
    kind = records.schema[id_col].dataType.simpleString()
    names = [id_col, "schema_path", "dewey", *(["body"] if bodies else [])]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, row = _Nodes(shape, bodies), []
            for i, p in enumerate(b.column(1).to_pylist()):
                if p is None:
                    continue
                before = len(nodes.schema)
                for d in _documents(p):
                    nodes.walk(d, shape, "", [])
                row += [i] * (len(nodes.schema) - before)
            schema = pa.DictionaryArray.from_arrays(pa.array(nodes.schema, pa.int32()), pa.array(list(nodes.number), pa.string())).cast(pa.string())
            dewey = pa.ListArray.from_arrays(pa.array([0, *accumulate(nodes.size)], pa.int32()), pa.array(nodes.ordinals, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), schema, dewey, *([pa.array(nodes.body, pa.string())] if bodies else [])], names)

    return records.select(id_col, payload_col).mapInArrow(parse, f"`{id_col}` {kind}, schema_path string, dewey array<int>" + (", body string" if bodies else ""))


def flat_tables(nodes: DataFrame, id_col: str = "record_id", shape: dict = PARSED_DOCUMENT) -> dict[str, DataFrame]:
    """The related tables, one for each schema path; ``parent_path`` with the record's id is the key of the parent.

    ``nodes`` with bodies. A node that is an object of another type than its table expects has null attributes.
    """
    out = {}
    for s, (kind, _, _) in schema_paths(shape).items():
        own = with_paths(nodes.filter(F.col("schema_path") == s), shape)
        out[s] = own.select(id_col, "node_path", "parent_path", "schema_path", "dewey", F.from_json("body", COLUMNS[kind]).alias("b")).select(id_col, "node_path", "parent_path", "schema_path", "dewey", "b.*")
    return out


def tables_of(nodes: DataFrame, kind: str, id_col: str = "record_id", shape: dict = PARSED_DOCUMENT) -> DataFrame:
    """The tables of every schema path of one kind together."""
    own = with_paths(nodes.filter(F.col("schema_path").isin(*[s for s, (k, _, _) in schema_paths(shape).items() if k == kind])), shape)
    return own.select(id_col, "node_path", "parent_path", "schema_path", "dewey", F.from_json("body", COLUMNS[kind]).alias("b")).select(id_col, "node_path", "parent_path", "schema_path", "dewey", "b.*")
