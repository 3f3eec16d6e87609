"""Structure of documents: footers, preface, sections, their fields, paragraphs and items, and signature columns.

Whether a line opens a section, stands in the signature block or follows its neighbour are windows over a document's lines.
What a line is to the entry before it (a new field, a continuation of its label or of its value, …) depends on what that entry
has become, so one small state machine runs over the lines of a block and only names roles; the values are put together
afterwards by an aggregate over lines of the same entry.

Defined results: a blank line has no role; a document without headings is all preface; lines tie by page, then line_no.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions.text import BULLETS, HEADING, WS, fragment_text, heading_inline, heading_number, heading_title, is_bare_bullet, looks_like_label, looks_like_docx_label, sourced_text, squeezed, starts_with_bullet
from foliograph.operators import lines as lines_
from foliograph.operators.lines import box_around, box_of, left_of, segments, text_of

# ---- Fixed values -----------------------------------------------------------------------------------------------------
FOOTER, DATA_COLUMNS, SIGNATURE_INDENT = "trang", 3, 2.0
CONTINUATION_REACH, ADJACENT_GAP = 3.0, 1.0
# ---- end of fixed values ----------------------------------------------------------------------------------------------
_ORDER = ["page", "line_no"]
BOX = "struct<x0:double,top:double,x1:double,bottom:double>"


def footers(lines: DataFrame) -> Column:
    return F.startswith(F.lower(F.trim(F.col("text"))), F.lit(FOOTER))


def without_tables(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines outside the regions (doc_id, page, x0, top, x1, bottom) of data tables."""
    l, r = lines.alias("l"), regions.alias("r")
    middle = (F.col("l.top") + F.col("l.bottom")) / 2
    inside = (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col("l.page") == F.col("r.page")) & middle.between(F.col("r.top"), F.col("r.bottom")) & (F.col("l.x1") >= F.col("r.x0")) & (F.col("l.x0") <= F.col("r.x1"))
    return l.join(r, inside, "left_anti")


def sectioned(lines: DataFrame) -> DataFrame:
    """Adds ``section_no`` (0 for the preface), ``number`` of heading lines, and ``part``: preface, heading, body or signature.

    The signature block is the run of indented lines of two segments or more at the end.
    """
    kept = lines.filter(~is_bare_bullet("text") & ~footers(lines))
    w = Window.partitionBy("doc_id").orderBy(*_ORDER)
    rows = kept.withColumn("number", heading_number("text")).withColumn("section_no", F.sum(F.col("number").isNotNull().cast("int")).over(w))
    margin = kept.withColumn("_n", heading_number("text")).groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("_n").isNotNull(), F.col("x0"))), F.min("x0")).alias("_margin"))
    rows = rows.join(margin, "doc_id")
    fits = (F.col("x0") - F.col("_margin") >= F.col("font_size") * SIGNATURE_INDENT) & (F.size(segments()) >= 2) & (F.col("section_no") > 0)
    rows = rows.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    rows = rows.withColumn("_tail", F.min("_fits").over(Window.partitionBy("doc_id").orderBy(F.desc("page"), F.desc("line_no"))))
    part = F.when(F.col("section_no") == 0, "preface").when(F.col("_tail"), "signature").when(F.col("number").isNotNull(), "heading").otherwise("body")
    return rows.withColumn("part", part).drop("_margin", "_fits", "_tail")


def sections(parts: DataFrame) -> DataFrame:
    """doc_id, section_no, number, title, inline_value, page, bbox."""
    return parts.filter("part = 'heading'").select("doc_id", "section_no", "number", heading_title("text").alias("title"), heading_inline("text").alias("inline_value"), "page", box_of(F.col("chars")).alias("bbox"))


def label_split(chars: Column) -> tuple[Column, Column]:
    """Glyphs before and after the first colon; null if there is none."""
    at = F.array_position(F.transform(chars, lambda c: c["ch"]), ":")
    return F.when(at > 0, F.slice(chars, 1, (at - 1).cast("int"))), F.when(at > 0, F.slice(chars, (at + 1).cast("int"), F.size(chars)))


def with_fields(df: DataFrame, chars: Column, name: str = "_f") -> DataFrame:
    """Adds the fields of one line: array of (label, value), each an array of glyph arrays; null without a colon. Later columns of
    the value that hold a label of their own are fields; the others stay in the first one's value."""
    label, value = label_split(chars)
    df = lines_.with_columns(df.withColumn("_label", label).withColumn("_value", value), "_value", "_cols")
    at = F.transform("_cols", lambda c: F.struct(c.alias("c"), F.array_position(F.transform(c, lambda x: x["ch"]), ":").alias("at")))
    df = df.withColumn("_rest", F.when(F.size("_cols") > 1, F.slice(at, 2, F.size("_cols") - 1)))
    own = F.transform(F.filter("_rest", lambda r: r["at"] <= 1), lambda r: r["c"])
    main = F.when(F.size("_cols") > 1, F.concat(F.slice("_cols", 1, 1), own)).otherwise(F.array("_value"))
    more = F.transform(F.filter("_rest", lambda r: r["at"] > 1), lambda r: F.struct(F.array(F.slice(r["c"], 1, (r["at"] - 1).cast("int"))).alias("label"), F.array(F.slice(r["c"], (r["at"] + 1).cast("int"), F.size(r["c"]))).alias("value")))
    first = F.array(F.struct(F.array("_label").alias("label"), main.alias("value")))
    fields = F.when(F.col("_label").isNotNull(), F.when(F.size("_cols") > 1, F.concat(first, more)).otherwise(first))
    return df.withColumn(name, fields).drop("_label", "_value", "_cols", "_rest")


def _joined(groups: Column) -> Column:
    return F.array_join(F.transform(groups, text_of), " ")


def _value(groups: Column, prefixes: tuple[str, ...]) -> Column:
    text = sourced_text(_joined(groups), prefixes)
    return F.when(text.isNotNull(), F.struct(text.alias("value"), box_of(F.flatten(groups)).alias("bbox"), F.transform(groups, lambda g: fragment_text(text_of(g))).alias("source_lines")))


_ROLES = "doc_id string, section_no int, page int, line_no int, role string, entry_page int, entry_line int"


def _roles(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Names each line's role and the line that opened its entry."""
    out, state, before = [], None, None
    inline = bool(rows["inline"].iloc[0]) if len(rows) else False
    if inline:
        state = ("text", 0, -1)  # the value on the heading's own line goes on
    for r in rows.sort_values(_ORDER).itertuples(index=False):
        if before is not None and (before[0] != r.page or r.top - before[1] > ADJACENT_GAP * r.font_size):
            state = None
        before = (r.page, r.bottom)
        here = (r.page, r.line_no)
        starts = r.bullet or r.split and (r.short_label or r.long_label and state is None)
        if starts and r.split and r.labelled:
            role, entry = "field", here
            state = ("field", *here, r.label_x, r.value_x)
        elif starts:
            role, entry = ("item", here) if not r.blank else (None, here)
            state = ("text", *here) if not r.blank else None
        elif state is not None and state[0] == "field":
            to_label, to_value = abs(r.x0 - state[3]), abs(r.x0 - state[4])
            entry = state[1:3]
            if min(to_label, to_value) > CONTINUATION_REACH * r.font_size:
                role, entry, state = "paragraph", here, None
            else:
                role = "label" if to_label <= to_value else "value"
        elif state is not None:
            role, entry = "more", state[1:3]
        else:
            role, entry = "paragraph", here
            state = ("text", *here) if not r.blank else None
        if role and not (r.blank and role in ("paragraph", "label", "more")):
            out.append((*key, *here, role, *entry))
    return pd.DataFrame(out, columns=["doc_id", "section_no", "page", "line_no", "role", "entry_page", "entry_line"])


def line_roles(lines: DataFrame, inline: DataFrame | None = None) -> DataFrame:
    """doc_id, section_no, page, line_no, role (field, item, paragraph; label, value, more: goes on the entry), entry_page, entry_line.

    lines: of blocks keyed by (doc_id, section_no). inline: blocks whose heading line already holds the start of a value.
    """
    label, value = label_split(F.col("chars"))
    f = lines.select(
        "doc_id", "section_no", "page", "line_no", "x0", "top", "bottom", "font_size",
        F.coalesce(starts_with_bullet("text"), F.lit(False)).alias("bullet"), label.isNotNull().alias("split"),
        F.coalesce(looks_like_label(text_of(label)), F.lit(False)).alias("short_label"),
        F.coalesce(looks_like_label(text_of(label), allow_long=True), F.lit(False)).alias("long_label"),
        sourced_text(text_of(label), BULLETS).isNotNull().alias("labelled"),
        F.coalesce(left_of(label), F.lit(0.0)).alias("label_x"), F.coalesce(left_of(value), F.lit(0.0)).alias("value_x"),
        sourced_text("text", BULLETS).isNull().alias("blank"),
    )
    if inline is None:
        f = f.withColumn("inline", F.lit(False))
    else:
        f = f.join(inline.select("doc_id", "section_no", F.lit(True).alias("inline")).distinct(), ["doc_id", "section_no"], "left").withColumn("inline", F.coalesce("inline", F.lit(False)))
    return f.groupBy("doc_id", "section_no").applyInPandas(_roles, _ROLES)


def _union_box(boxes: Column) -> Column:
    return box_around(F.filter(boxes, lambda b: b.isNotNull()))


def entries(lines: DataFrame, roles: DataFrame) -> DataFrame:
    """doc_id, section_no, kind (field, item, paragraph, inline), page, line_no, k, label, label_bbox, value, bbox, source_lines of every entry.

    A continuation of a line with several fields goes to its last field.
    """
    keys = ["doc_id", "section_no", "page", "line_no"]
    rows = roles.join(lines.select(*keys, "text", "chars"), keys)
    fields = with_fields(rows.filter("role = 'field'"), F.col("chars"))
    fields = fields.select("doc_id", "section_no", F.col("page").alias("entry_page"), F.col("line_no").alias("entry_line"), F.size("_f").alias("_n"), F.posexplode("_f").alias("k", "_one"))
    fields = fields.select("doc_id", "section_no", "entry_page", "entry_line", "k", "_n", _value(F.col("_one.label"), BULLETS).alias("l"), _value(F.col("_one.value"), (":",)).alias("v")).filter("l IS NOT NULL")
    heads = rows.filter("role IN ('item', 'paragraph')").select("doc_id", "section_no", "entry_page", "entry_line", "role", F.struct(sourced_text("text", BULLETS).alias("value"), box_of(F.col("chars")).alias("bbox")).alias("v"))
    more = rows.filter("role IN ('label', 'value', 'more')").groupBy("doc_id", "section_no", "entry_page", "entry_line").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("page", "line_no", squeezed("text").alias("t"), sourced_text("text", BULLETS).alias("bare"), box_of(F.col("chars")).alias("b"))))).alias(f"_{r}") for r in ("label", "value", "more")]
    )
    at = ["doc_id", "section_no", "entry_page", "entry_line"]
    none = F.array().cast(f"array<struct<page:int,line_no:int,t:string,bare:string,b:{BOX}>>")

    def grown(first: Column, first_lines: Column, box: Column, tail: Column) -> tuple[Column, Column, Column]:
        # Where nothing came before, the first continuation opens the value, without its bullet.
        empty = first.isNull() & (F.size(tail) > 0)
        texts = F.concat(F.when(first.isNotNull(), F.array(first)).otherwise(F.array().cast("array<string>")), F.transform(tail, lambda x, i: F.when(empty & (i == 0), x["bare"]).otherwise(x["t"])))
        parts = F.concat(F.coalesce(first_lines, F.array().cast("array<string>")), F.transform(tail, lambda x, i: F.when(empty & (i == 0), x["bare"]).otherwise(x["t"])))
        return F.nullif(F.array_join(texts, " "), F.lit("")), parts, _union_box(F.concat(F.array(box), F.transform(tail, lambda x: x["b"])))

    f = fields.join(more, at, "left")
    last = F.col("k") == F.col("_n") - 1
    tails = {r: F.when(last, F.coalesce(f"_{r}", none)).otherwise(none) for r in ("label", "value")}
    lt, ll, lb = grown(F.col("l.value"), F.col("l.source_lines"), F.col("l.bbox"), tails["label"])
    vt, vl, vb = grown(F.col("v.value"), F.col("v.source_lines"), F.col("v.bbox"), tails["value"])
    out_f = f.select(*at, F.lit("field").alias("kind"), "k", lt.alias("label"), lb.alias("label_bbox"), ll.alias("label_lines"), vt.alias("value"), vb.alias("bbox"), vl.alias("source_lines"))
    t = heads.join(more, at, "left")
    tt, _, tb = grown(F.col("v.value"), F.lit(None).cast("array<string>"), F.col("v.bbox"), F.coalesce("_more", none))
    null = F.lit(None)
    out_t = t.select(*at, F.col("role").alias("kind"), F.lit(0).alias("k"), null.cast("string").alias("label"), null.cast(BOX).alias("label_bbox"), null.cast("array<string>").alias("label_lines"), tt.alias("value"), tb.alias("bbox"), null.cast("array<string>").alias("source_lines"))
    inline = more.filter("entry_line = -1").select(*at, F.lit("inline").alias("kind"), F.lit(0).alias("k"), null.cast("string").alias("label"), null.cast(BOX).alias("label_bbox"), null.cast("array<string>").alias("label_lines"), F.array_join(F.transform("_more", lambda x: x["t"]), " ").alias("value"), _union_box(F.transform("_more", lambda x: x["b"])).alias("bbox"), null.cast("array<string>").alias("source_lines"))
    return out_f.unionByName(out_t).unionByName(inline).withColumnsRenamed({"entry_page": "page", "entry_line": "line_no"})


def preface_columns(lines: DataFrame) -> DataFrame:
    """doc_id, page, line_no, k, kind, label, value, bbox of preface lines with several segments: each is a field if its label looks like one, else a paragraph."""
    s = lines.withColumn("_s", segments()).filter(F.size("_s") > 1).select("doc_id", "page", "line_no", F.posexplode("_s").alias("k", "_one"))
    label, _ = label_split(F.col("_one"))
    s = s.withColumn("_is", F.coalesce(looks_like_label(text_of(label)), F.lit(False)))
    fields = with_fields(s.filter("_is"), F.col("_one")).select("doc_id", "page", "line_no", "k", F.explode("_f").alias("_e")).select("doc_id", "page", "line_no", "k", F.lit("field").alias("kind"), _value(F.col("_e.label"), BULLETS)["value"].alias("label"), _value(F.col("_e.value"), (":",))["value"].alias("value"), box_of(F.flatten(F.col("_e.value"))).alias("bbox")).filter("label IS NOT NULL")
    rest = s.filter("NOT _is").select("doc_id", "page", "line_no", "k", F.lit("paragraph").alias("kind"), F.lit(None).cast("string").alias("label"), sourced_text(text_of(F.col("_one"))).alias("value"), box_of(F.col("_one")).alias("bbox")).filter("value IS NOT NULL")
    return fields.unionByName(rest)


def signature_columns(parts: DataFrame) -> DataFrame:
    """doc_id, person, page, line_no, value: column i of every line of the signature block is person i's."""
    s = parts.filter("part = 'signature'").withColumn("_s", F.filter(F.transform(segments(), lambda g: sourced_text(text_of(g))), lambda t: t.isNotNull()))
    return s.select("doc_id", "page", "line_no", F.posexplode("_s").alias("person", "value"))


def transposed(rows: DataFrame, keys: list[str], order: list[str], cells_col: str) -> DataFrame:
    """keys, person, lines: the columns of rows of cells (array<string>), as each person's lines in order."""
    one = rows.select(*keys, *order, F.posexplode(cells_col).alias("person", "value"))
    return one.groupBy(*keys, "person").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda x: x["value"]).alias("lines"))


# ---- paragraphs of word-processor files -------------------------------------------------------------------------------


def docx_entries(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, section_no, number, kind (heading, field, item, paragraph), label, value, location from paragraph nodes
    (doc_id, ord, text, location, list_level). No state: a paragraph is whole."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    text = F.trim(F.regexp_replace("text", f"^{WS}+|{WS}+$", ""))
    rows = nodes.filter("kind = 'p'").withColumn("_t", text).withColumn("number", heading_number("_t"))
    rows = rows.withColumn("section_no", F.sum(F.col("number").isNotNull().cast("int")).over(w))
    marker = F.col("_t").substr(1, 1).isin(*BULLETS)
    body = F.when(marker, F.trim(F.substr("_t", F.lit(2)))).otherwise(F.col("_t"))
    rows = rows.withColumn("_m", marker).withColumn("_b", body)
    label = F.split_part("_b", F.lit(":"), F.lit(1))
    value = F.when(F.contains("_b", F.lit(":")), F.substr("_b", F.locate(":", F.col("_b")) + 1))
    has_value = F.coalesce(squeezed(value) != "", F.lit(False))
    is_field = value.isNotNull() & looks_like_docx_label(label, has_value)
    kind = F.when(F.col("number").isNotNull(), "heading").when(is_field, "field").when(F.col("_m") | F.col("list_level").isNotNull(), "item").otherwise("paragraph")
    rows = rows.withColumn("kind", kind)
    return rows.select(
        "doc_id", "ord", "section_no", "number", "kind",
        F.when(F.col("kind") == "heading", heading_title("_t")).when(F.col("kind") == "field", F.trim(label)).alias("label"),
        F.when(F.col("kind") == "heading", heading_inline("_t")).when(F.col("kind") == "field", F.nullif(squeezed(value), F.lit(""))).otherwise(F.col("_b")).alias("value"),
        "location",
    )


def docx_signature_table(nodes: DataFrame) -> DataFrame:
    """doc_id, person, line, value, location: the last table with two columns or more and no number in its first column; its first row's cells by lines."""
    c = nodes.filter("kind = 'cell'")
    by = c.groupBy("doc_id", "tbl").agg(F.max("cell").alias("_w"), F.bool_or((F.col("cell") == 1) & F.trim("text").rlike(r"^\p{Nd}+$")).alias("_digits"))
    last = by.filter("_w >= 2 AND NOT _digits").groupBy("doc_id").agg(F.max("tbl").alias("tbl"))
    first = c.join(last, ["doc_id", "tbl"]).filter("row = 1").withColumn("_lines", F.filter(F.split("text", "\n"), lambda t: F.trim(t) != ""))
    e = first.select("doc_id", "tbl", (F.col("cell") - 1).alias("person"), F.posexplode("_lines").alias("line", "value"))
    return e.select("doc_id", "person", "line", F.trim("value").alias("value"), F.format_string("body/tbl[%d]/tr[1]/tc[%d]/p[%d]", "tbl", F.col("person") + 1, F.col("line") + 1).alias("location"))
