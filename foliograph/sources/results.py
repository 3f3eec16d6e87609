"""Sinks: one JSON and one Markdown text a document, from the long relation of values.

values: doc_id, ord, path, label, value, page, bbox, location, verbatim. A path such as ``sections.II.fields.tax_id`` or
``page_footers[0]`` says where the value stands; the tree is built here and nowhere before.

Defined results: a box or location that is null is left out, other nulls are kept; of two values of one path the later counts, at the
first one's place; keys with dots or brackets are written in the path as they are between quotation marks.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

_STEP = re.compile(r'"((?:[^"\\]|\\.)*)"|\[(\d+)\]|([^.\[\]"]+)')


def steps(path: str) -> list[str | int]:
    """The keys and indexes of a path."""
    return [int(i) if i else key or json.loads(f'"{quoted}"') for quoted, i, key in _STEP.findall(path)]


def key_step(key: Column) -> Column:
    """A key as it stands in a path."""
    safe = key.rlike(r'^[^.\[\]"\\]+$')
    return F.when(safe, key).otherwise(F.to_json(F.struct(key.alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(key.alias("k")))) - 6))


def node(row: dict) -> Any:
    """A value as it appears in the output."""
    if row.get("plain"):
        return int(row["value"]) if row["path"].endswith(".index") else row["value"]
    out: dict[str, Any] = {"label": row["label"]} if row.get("label") is not None else {}
    out["value"] = row["value"]
    if row["value"] is None:
        return out
    out |= {"page": row["page"], "verbatim": bool(row["verbatim"])}
    if row.get("bbox"):
        out["bbox"] = [round(row["bbox"][k], 2) for k in ("x0", "top", "x1", "bottom")]
    if row.get("location"):
        out["location"] = row["location"]
    return out


def tree(values: list[dict]) -> dict:
    """The nested form of a document's values, in their order."""
    root: dict = {}
    for row in values:
        *way, last = steps(row["path"])
        at: Any = root
        for step, after in zip(way, [*way[1:], last], strict=True):
            empty: Any = [] if isinstance(after, int) else {}
            if isinstance(step, int):
                while len(at) <= step:
                    at.append(None)
                if at[step] is None:
                    at[step] = empty
                at = at[step]
            else:
                at = at.setdefault(step, empty)
        if isinstance(last, int):
            while len(at) <= last:
                at.append(None)
        at[last] = node(row)
    return _completed(root)


def _completed(root: dict) -> dict:
    """The parts that every result has, empty where the document has none, in their fixed order."""
    for block in (root.setdefault("preface", {}), *root.setdefault("sections", {}).values()):
        parts = {"fields": {}, "unmapped_fields": {}, "paragraphs": [], "items": []}
        own = {k: block.pop(k, empty) for k, empty in parts.items()}
        head = {k: block.pop(k) for k in ("name", "title") if k in block}
        tail = dict(block)
        block.clear()
        block |= head | own | tail
    order = {"preface": {}, "sections": {}, "signatures": [], "page_footers": [], "form_fields": {}, "hyperlinks": []}
    return {k: root.get(k, empty) for k, empty in order.items()} | {k: v for k, v in root.items() if k not in order}


@arrow_udf(StringType())
def _tree_json(rows: pa.Array) -> pa.Array:
    return pa.array([None if r is None else json.dumps(tree(r), ensure_ascii=False) for r in rows.to_pylist()], pa.string())


def data_json(values: DataFrame) -> DataFrame:
    """doc_id, data: each document's values as nested JSON."""
    rest = ("label", "value", "page", "bbox", "location", "verbatim", "plain")
    by = values.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "path", *rest))).alias("_v"))
    return by.select("doc_id", _tree_json("_v").alias("data"))


def envelopes(docs: DataFrame, reports: DataFrame, data: DataFrame) -> DataFrame:
    """doc_id, file, status, json: source, template, status, verification, data, errors. Nulls are kept."""
    r = docs.select("doc_id", "file", "bytes").join(reports, "doc_id", "left").join(data, "doc_id", "left")
    head = F.to_json(F.struct(F.struct("file", F.col("doc_id").alias("sha256"), "bytes").alias("source"), F.col("template_id").alias("template"), "status", "verification"), {"ignoreNullFields": "false"})
    tail = F.to_json(F.struct(F.coalesce("errors", F.array().cast("array<string>")).alias("errors")), {"ignoreNullFields": "false"})
    body = F.concat(F.expr("substring(_h, 1, length(_h) - 1)"), F.lit(', "data": '), F.coalesce("data", F.lit("{}")), F.lit(", "), F.expr("substring(_t, 2)"))
    return r.withColumn("_h", head).withColumn("_t", tail).select("doc_id", "file", "status", body.alias("json"))


# ---- Markdown ---------------------------------------------------------------------------------------------------------
# The texts of the printed form.
VERIFIED_LINE = "_Đã đọc và xác minh đủ nội dung — {}/{} giá trị chứng minh được là nguyên văn._"
STATUS_LINE = "⚠️ **Trạng thái: {}** — xem lỗi bên dưới trước khi dùng nội dung."
FORM_TITLE, LINK_TITLE = "## Ô điền thông tin (form field)", "## Đường dẫn (hyperlink)"
# end of fixed values


def _say(x: Any) -> str:
    return str((x.get("value") if isinstance(x, dict) else x) or "").strip()


def _bar(cells: list[str]) -> str:
    return f"| {' | '.join(cells)} |"


def _grid(header: list[str], rows: list[list[str]]) -> list[str]:
    return [_bar(header), "|" + "---|" * len(header), *map(_bar, rows)]


def _block(b: dict) -> list[str]:
    paragraphs, items = b.get("paragraphs") or [], b.get("items") or []
    fields = {**(b.get("fields") or {}), **(b.get("unmapped_fields") or {})}
    out = [x for p in paragraphs if _say(p) for x in ("", _say(p))]
    for key, f in fields.items():
        if f:
            name = f.get("label", key)
            out.append(f"**{name}:**" if f.get("value") is None else f"- **{name}:** {f['value']}")
    out += [f"- {_say(i)}" for i in items if _say(i)]
    if not (fields or paragraphs or items) and _say(b.get("value")):
        out += ["", _say(b["value"])]
    if t := b.get("table"):
        out.append("")
        rows = [[_say(c) if isinstance(c, dict) else str(c) for c in r.values()] for r in t.get("rows") or []]
        columns = [_say(c) for c in t.get("columns") or []]
        out += _grid(columns, rows) if columns else [_bar(r) for r in rows]
        if totals := [x for x in (t.get("totals") or {}).values() if x]:
            out += ["", *[f"**{x.get('label')}:** {x.get('value')}" for x in totals]]
    return out


def markdown(name: str, result: dict) -> str:
    """A result as a readable text."""
    data, proof = result.get("data") or {}, (result.get("verification") or {}).get("provenance") or {}
    out = [f"# {name}", ""]
    if result["status"] == "verified":
        out.append(VERIFIED_LINE.format(proof.get("verbatim_values", 0), proof.get("total_values", 0)))
    else:
        out += [STATUS_LINE.format(result["status"]), *[f"- {e}" for e in result.get("errors") or []]]
    out += ["", "---", "", *_block(data.get("preface") or {})]
    for number, s in (data.get("sections") or {}).items():
        out += ["", f"## {number}. {_say(s.get('title'))}" if _say(s.get("title")) else f"## {number}", *_block(s)]
    if people := [[_say(x) for x in p.get("lines") or []] for p in data.get("signatures") or []]:
        height = max(map(len, people))
        rows = [[p[i] if i < len(p) else "" for p in people] for i in range(height)]
        out += ["", "---", "", *(_grid(rows[0], rows[1:]) if rows else [])]
    if forms := [f"- **{k}:** {_say(v)}" for k, v in (data.get("form_fields") or {}).items() if _say(v)]:
        out += ["", FORM_TITLE, "", *forms]
    if links := [f"- {_say(x)}" for x in data.get("hyperlinks") or [] if _say(x)]:
        out += ["", LINK_TITLE, "", *links]
    if feet := [_say(x) for x in data.get("page_footers") or [] if _say(x)]:
        out += ["", " · ".join(feet)]
    return "\n".join(out).rstrip() + "\n"


@arrow_udf(StringType())
def markdown_of(names: pa.Array, results: pa.Array) -> pa.Array:
    return pa.array([None if j is None else markdown(n, json.loads(j)) for n, j in zip(names.to_pylist(), results.to_pylist(), strict=True)], pa.string())


def write(results: DataFrame, path: str) -> None:
    """JSON and Markdown texts as tables, by status. A row names its file, so ``a.pdf`` and ``a.docx`` don't collide."""
    results.withColumn("markdown", markdown_of("file", "json")).write.mode("overwrite").partitionBy("status").parquet(path)
