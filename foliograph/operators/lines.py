"""Lines, segments and columns from glyphs.

A page is the unit: its glyphs go through one kernel, since whether a glyph joins a line depends on the largest glyph that
line has so far. Everything after that is expressions over a line's array of glyphs.

Defined results: exact repeats count once; glyphs with null geometry lie nowhere and are left out; ties are settled by seq; an
empty table gives no lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.text import is_blank, squeezed
from foliograph.operators.glyphs import FALLBACK_SIZE, reading_position

# ---- Fixed values -----------------------------------------------------------------------------------------------------
CENTRE_SHARE, OVERLAP_SHARE, GAP_SHARE, BLANKS_OF_A_BREAK = 0.3, 0.35, 0.7, 3
# ---- end of fixed values ----------------------------------------------------------------------------------------------
CHAR = "struct<seq:bigint,ch:string,x0:double,x1:double,top:double,bottom:double,size:double>"
LINE = f"doc_id string, page int, line_no int, text string, x0 double, x1 double, top double, bottom double, font_size double, chars array<{CHAR}>"
_GEOMETRY = ("x0", "x1", "top", "bottom", "size")


def _median(size: np.ndarray) -> float:
    known = size[size > 0]
    return float(np.median(known)) if len(known) else FALLBACK_SIZE


def upright_groups(x0: np.ndarray, top: np.ndarray, bottom: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The line number of each glyph. Glyphs come from the top down; each joins the first line whose anchor is level with it
    (centres close, or extents overlapping), else opens one. A larger glyph takes over as its line's anchor."""
    line = np.empty(len(x0), int)
    near = CENTRE_SHARE * _median(size)
    anchors = np.empty((4, len(x0)))  # centre, top, bottom and size of each line's anchor
    n = 0
    for i in np.lexsort((x0, top)):
        t, b, s = top[i], bottom[i], size[i]
        centre, at, ab, asize = anchors[:, :n]
        over = np.minimum(ab, b) - np.maximum(at, t)
        shorter = np.minimum(ab - at, b - t)
        level = np.abs(centre - (t + b) / 2) <= near
        level |= (over > 0) & (shorter > 0) & (over >= OVERLAP_SHARE * shorter)
        k = int(np.argmax(level)) if level.any() else n
        if k == n or s > anchors[3, k]:
            anchors[:, k] = (t + b) / 2, t, b, s
        n = max(n, k + 1)
        line[i] = k
    return line


def rotated_groups(x0: np.ndarray, x1: np.ndarray, top: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The column number of each rotated glyph: from the left, as long as centres lie near the column's first."""
    column = np.empty(len(x0), int)
    near = CENTRE_SHARE * _median(size)
    centre, n, first = (x0 + x1) / 2, -1, np.inf
    for i in np.lexsort((top, centre)):
        if not abs(centre[i] - first) <= near:
            n, first = n + 1, centre[i]
        column[i] = n
    return column


def _page_lines(t: pa.Table) -> pa.Table:
    t = t.sort_by("seq")
    seq = t.column("seq").to_numpy()
    keep = np.ones(len(seq), bool)
    keep[1:] = seq[1:] != seq[:-1]
    t = t.filter(pa.array(keep))
    v = {k: np.nan_to_num(t.column(k).to_numpy().astype(float), nan=0.0) for k in _GEOMETRY}
    dx, dy = (np.where(np.isnan(d), u, d) for d, u in ((t.column("dx").to_numpy().astype(float), 1.0), (t.column("dy").to_numpy().astype(float), 0.0)))
    up = np.abs(dy) <= np.abs(dx)
    ch = t.column("ch").to_pylist()
    groups: list[np.ndarray] = []
    for of, rotated in ((np.flatnonzero(~up), True), (np.flatnonzero(up), False)):
        if not len(of):
            continue
        w = {k: x[of] for k, x in v.items()}
        number = rotated_groups(w["x0"], w["x1"], w["top"], w["size"]) if rotated else upright_groups(w["x0"], w["top"], w["bottom"], w["size"])
        for k in range(number.max() + 1):
            own = of[number == k]
            if rotated:
                lead = own[np.lexsort((v["top"][own], (v["x0"][own] + v["x1"][own]) / 2))[0]]
                own = own[np.argsort(-v["top"][own] if dy[lead] > 0 else v["top"][own], kind="stable")]
            else:
                own = own[np.lexsort((v["top"][own], v["x0"][own]))]
            groups.append(own)
    groups.sort(key=lambda g: (v["top"][g].min(), v["x0"][g].min()))
    flat = np.concatenate(groups) if groups else np.empty(0, int)
    sizes = [len(g) for g in groups]
    take = pa.array(flat)
    chars = pa.StructArray.from_arrays([_whole(t.column("seq").take(take)), _whole(t.column("ch").take(take)), *[pa.array(v[k][flat]) for k in _GEOMETRY]], ["seq", "ch", *_GEOMETRY])
    one = [t.column(k)[0].as_py() for k in ("doc_id", "page")]
    return pa.table(
        {
            "doc_id": pa.array([one[0]] * len(groups), pa.string()),
            "page": pa.array([one[1]] * len(groups), pa.int32()),
            "line_no": pa.array(range(len(groups)), pa.int32()),
            "text": pa.array(["".join(ch[i] or "" for i in g) for g in groups], pa.string()),
            **{k: pa.array([float(f(v[k][g])) for g in groups], pa.float64()) for k, f in (("x0", np.min), ("x1", np.max), ("top", np.min), ("bottom", np.max))},
            "font_size": pa.array([_median(v["size"][g]) for g in groups], pa.float64()),
            "chars": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), chars),
        }
    )


def _whole(a: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)


def group_lines(glyphs: DataFrame) -> DataFrame:
    """The lines of every page, numbered from the top: doc_id, page, line_no, text, x0, x1, top, bottom, font_size, chars."""
    placed = glyphs.select("doc_id", "page", "seq", "ch", "x0", "x1", "top", "bottom", "size", "dx", "dy").filter("x0 IS NOT NULL AND x1 IS NOT NULL AND top IS NOT NULL AND bottom IS NOT NULL AND seq IS NOT NULL")
    return placed.groupBy("doc_id", "page").applyInArrow(_page_lines, LINE)


def _cut_at(chars: Column, starts: Column) -> Column:
    """The slices of an array that begin at the given indexes (from 0)."""
    return F.transform(starts, lambda s, k: F.slice(chars, s + 1, F.coalesce(F.try_element_at(starts, k + 2), F.size(chars)) - s))


def segments(chars: str = "chars", font_size: str = "font_size") -> Column:
    """A line's glyphs in parts, cut where the gap is 0.7 of the line's size or more. Blanks are glyphs like others."""
    c, n = F.col(chars), F.size(chars)
    gap = F.col(font_size) * GAP_SHARE
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.try_element_at(c, i + 1)["x0"] - F.try_element_at(c, F.greatest(i, F.lit(1)))["x1"] >= gap))
    return F.when(n > 0, _cut_at(c, starts)).otherwise(F.array().cast(f"array<array<{CHAR}>>"))


def with_columns(df: DataFrame, chars: Column | str = "chars", name: str = "columns") -> DataFrame:
    """Adds the glyphs in columns. Blanks count only by their number: three or more, or a gap between the glyphs around them, make a break;
    blanks within a column stay. The gap is measured by the middle one of the known sizes as they come.

    It works in steps, each a column of its own, so that no step's expression is copied into the next.
    """
    c, inked, starts = F.col("_chars"), F.col("_inked"), F.col("_starts")
    sizes = F.col("_sizes")
    df = df.withColumn("_chars", F.col(chars) if isinstance(chars, str) else chars)
    df = df.withColumn("_sizes", F.filter(F.transform(c, lambda x: x["size"]), lambda s: s > 0))
    df = df.withColumn("_gap", F.coalesce(F.try_element_at(sizes, F.floor(F.size(sizes) / 2).cast("int") + 1), F.lit(FALLBACK_SIZE)) * GAP_SHARE)
    df = df.withColumn("_inked", F.filter(F.transform(c, lambda x, i: F.struct(i.alias("i"), x["ch"].alias("ch"), x["x0"].alias("x0"), x["x1"].alias("x1"))), lambda x: x["ch"] != " "))

    def opens(now: Column, k: Column) -> Column:
        before = F.try_element_at(inked, F.greatest(k, F.lit(1)))
        return (k == 0) | (now["x0"] - before["x1"] >= F.col("_gap")) | (now["i"] - before["i"] - 1 >= BLANKS_OF_A_BREAK)

    marked = F.transform(inked, lambda x, k: F.when(opens(x, k), k))
    df = df.withColumn("_starts", F.filter(marked, lambda k: k.isNotNull()))

    def piece(s: Column, k: Column) -> Column:
        last = F.try_element_at(inked, F.coalesce(F.try_element_at(starts, k + 2), F.size(inked)))["i"]
        first = F.try_element_at(inked, s + 1)["i"]
        return F.slice(c, first + 1, last - first + 1)

    out = F.when(F.size(inked) > 0, F.transform(starts, piece)).when(c.isNotNull(), F.array().cast(f"array<array<{CHAR}>>"))
    return df.withColumn(name, out).drop("_chars", "_sizes", "_gap", "_inked", "_starts")


def text_of(chars: Column) -> Column:
    return F.array_join(F.transform(chars, lambda c: c["ch"]), "")


def box_of(chars: Column) -> Column:
    """The box around the glyphs that aren't blank; null if all are."""
    ink = F.filter(chars, lambda c: ~is_blank(c["ch"]))
    return box_around(ink)


def box_around(boxes: Column) -> Column:
    """The box around an array of structs with x0, top, x1, bottom; null if it is empty."""

    def side(name: str, f) -> Column:
        return f(F.transform(boxes, lambda b: b[name])).alias(name)

    return F.when(F.size(boxes) > 0, F.struct(side("x0", F.array_min), side("top", F.array_min), side("x1", F.array_max), side("bottom", F.array_max)))


def left_of(chars: Column) -> Column:
    """The least x0 of glyphs that aren't blank; 0 if all are."""
    return F.coalesce(F.array_min(F.transform(F.filter(chars, lambda c: ~is_blank(c["ch"])), lambda c: c["x0"])), F.lit(0.0))


def page_texts(lines: DataFrame) -> DataFrame:
    """doc_id, page, text, bbox: each page's lines in order, and the box around them."""
    by = lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"), *[f(k).alias(k) for k, f in (("x0", F.min), ("top", F.min), ("x1", F.max), ("bottom", F.max))])
    return by.select("doc_id", "page", "text", F.struct("x0", "top", "x1", "bottom").alias("bbox"))


def decorative_texts(overlay: DataFrame) -> DataFrame:
    """doc_id, page, text of overlay glyphs, each page's in their own direction of writing."""
    by = overlay.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(reading_position().alias("at"), "seq", "ch"))).alias("g"))
    return by.select("doc_id", "page", squeezed(F.array_join(F.transform("g", lambda g: g["ch"]), "")).alias("text")).filter("text <> ''")


def canonical_text(lines: DataFrame) -> DataFrame:
    """doc_id, text: a document's lines in order. One string a document: for export; the gate works on pieces."""
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
