"""Tables from cell boxes, and what is read from tables.

cell_boxes: doc_id, page, table_no, row_no, col_no, strategy, x0, top, x1, bottom; a null box is a missing cell.

Defined results: a cell without glyphs is an empty text; repeated boxes are one cell; tables without rows are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.text import comparable_label, joined_number, squeezed
from foliograph.operators.glyphs import FALLBACK_SIZE, upright
from foliograph.operators.lines import CENTRE_SHARE
from foliograph.operators.provenance import BOX_TOLERANCE, CELL, _cells

_KEYS = ["doc_id", "page", "table_no", "row_no", "col_no"]
_G = "struct<at:double,along:double,seq:bigint,ch:string,up:boolean>"


def _clusters(glyphs: Column, near: Column) -> Column:
    """Runs of glyphs (sorted by ``at``) whose ``at`` stays near that of the run's first."""

    def add(runs: Column, g: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        fits = F.abs(F.try_element_at(last, F.lit(1))["at"] - g["at"]) <= near
        grown = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.concat(last, F.array(g))))
        return F.when((F.size(runs) > 0) & F.coalesce(fits, F.lit(False)), grown).otherwise(F.concat(runs, F.array(F.array(g))))

    return F.aggregate(glyphs, F.array().cast(f"array<array<{_G}>>"), add)


def _line_texts(runs: Column, rotated: bool) -> Column:
    def one(run: Column) -> Column:
        by = F.array_sort(F.transform(run, lambda g: F.struct(g["along"].alias("a"), g["seq"].alias("s"), g["ch"].alias("ch"))))
        if rotated:
            by = F.when(F.try_element_at(run, F.lit(1))["up"], F.reverse(by)).otherwise(by)
        return squeezed(F.array_join(F.transform(by, lambda g: g["ch"]), ""))

    return F.filter(F.transform(runs, one), lambda t: t != "")


def cells(glyphs: DataFrame, cell_boxes: DataFrame) -> DataFrame:
    """doc_id, page, table_no, row_no, col_no, strategy, bbox, lines, value: the physical lines of each cell, and their join without blanks."""
    t = BOX_TOLERANCE
    g = glyphs.select("doc_id", "page", "seq", "ch", "size", F.coalesce("dy", F.lit(0.0)).alias("dy"), "top", "x0", upright().alias("upright"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("top") + F.col("bottom")) / 2).alias("cy")).distinct()
    g = g.withColumn("gx", F.floor(F.col("cx") / CELL)).withColumn("gy", F.floor(F.col("cy") / CELL))
    boxes = cell_boxes.distinct()
    b = boxes.filter("x0 IS NOT NULL").select(*_KEYS, F.col("x0").alias("bx0"), F.col("top").alias("btop"), F.col("x1").alias("bx1"), F.col("bottom").alias("bbottom"))
    b = b.withColumn("gx", F.explode(_cells(F.col("bx0") - t, F.col("bx1") + t))).withColumn("gy", F.explode(_cells(F.col("btop") - t, F.col("bbottom") + t)))
    inside = g.join(b, ["doc_id", "page", "gx", "gy"]).filter((F.col("cx") >= F.col("bx0") - t) & (F.col("cx") <= F.col("bx1") + t) & (F.col("cy") >= F.col("btop") - t) & (F.col("cy") <= F.col("bbottom") + t))
    across = F.struct(F.col("cy").alias("at"), F.col("x0").alias("along"), "seq", "ch", F.lit(False).alias("up"))
    down = F.struct(F.col("cx").alias("at"), F.col("top").alias("along"), "seq", "ch", (F.col("dy") > 0).alias("up"))
    by = inside.groupBy(*_KEYS).agg(
        *[F.array_sort(F.collect_list(F.when(is_, s))).alias(n) for n, s, is_ in (("_u", across, F.col("upright")), ("_r", down, ~F.col("upright")))],
        *[F.coalesce(F.median(F.when(is_ & (F.col("size") > 0), F.col("size"))), F.lit(FALLBACK_SIZE)).alias(n) for n, is_ in (("_us", F.col("upright")), ("_rs", ~F.col("upright")))],
    )
    lines = by.select(*_KEYS, F.concat(_line_texts(_clusters(F.col("_r"), F.col("_rs") * CENTRE_SHARE), True), _line_texts(_clusters(F.col("_u"), F.col("_us") * CENTRE_SHARE), False)).alias("lines"))
    out = boxes.join(lines, _KEYS, "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    return out.select(*_KEYS, "strategy", F.when(F.col("x0").isNotNull(), F.struct("x0", "top", "x1", "bottom")).alias("bbox"), "lines", joined_number("lines").alias("value"))


def lattice_or_stream(cell_boxes: DataFrame) -> DataFrame:
    """Boxes found by ruling lines; on pages that have none, those found by text."""
    ruled = cell_boxes.filter("strategy = 'lattice'")
    return ruled.unionByName(cell_boxes.filter("strategy = 'stream'").join(ruled.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti"))


def shapes(cells_: DataFrame) -> DataFrame:
    """doc_id, page, table_no, n_rows, n_cols."""
    rows = cells_.groupBy("doc_id", "page", "table_no", "row_no").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("doc_id", "page", "table_no").agg(F.count(F.lit(1)).cast("int").alias("n_rows"), F.max("n").cast("int").alias("n_cols"))


def merge_continued(tables: DataFrame) -> DataFrame:
    """doc_id, page, table_no, merged_page, merged_table from tables (doc_id, page, table_no, n_cols).

    A table goes on the last merged one if both have the same number of columns, more than one, and it lies on the page after the
    merged one's first page; so a third page opens a new table. A fold over a document's tables, which carry no cells.
    """
    one = F.struct("page", "table_no", "n_cols")
    kind = "array<struct<page:int,table_no:int,n_cols:int,mp:int,mt:int>>"

    def put(done: Column, t: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        goes_on = (last["n_cols"] == t["n_cols"]) & (t["n_cols"] > 1) & (t["page"] == last["mp"] + 1)
        joins = F.coalesce(goes_on, F.lit(False))
        new = F.struct(t["page"].alias("page"), t["table_no"].alias("table_no"), t["n_cols"].alias("n_cols"), F.when(joins, last["mp"]).otherwise(t["page"]).alias("mp"), F.when(joins, last["mt"]).otherwise(t["table_no"]).alias("mt"))
        return F.concat(done, F.array(new))

    typed = tables.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("page", "table_no", "n_cols")]).distinct()
    by = typed.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    return by.select("doc_id", F.explode(F.aggregate("t", F.array().cast(kind), put)).alias("m")).select("doc_id", "m.page", "m.table_no", F.col("m.mp").alias("merged_page"), F.col("m.mt").alias("merged_table"))


def data_rows(rows: DataFrame, n_cols: int) -> DataFrame:
    """Rows (…, n_cols, cells array<string>) of tables of a given width whose first cell is a number: index and the cells after it."""
    first = F.trim(F.try_element_at("cells", F.lit(1)))
    return rows.filter((F.col("n_cols") == n_cols) & first.rlike("^[0-9]+$")).withColumn("index", first.cast("int")).withColumn("rest", F.slice("cells", 2, n_cols - 1))


def header_row(rows: DataFrame, n_cols: int) -> DataFrame:
    """doc_id, columns: the filled cells of a document's first row, in tables of a given width, with two or more filled and no number first."""
    filled = F.filter("cells", lambda c: F.trim(c) != "")
    ok = (F.col("n_cols") == n_cols) & (F.size(filled) >= 2) & ~F.trim(F.try_element_at("cells", F.lit(1))).rlike(r"^\p{Nd}+$")
    return rows.filter(ok).groupBy("doc_id").agg(F.min(F.struct("page", "table_no", "row_no", filled.alias("columns"))).alias("m")).select("doc_id", "m.columns")


def labelled_totals(rows: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """doc_id, name, label, value: of each named total the first row whose first cell starts with its prefix.

    prefixes: prefix -> name, of a template, so part of the plan; a first cell takes the first that fits. The value is the next filled cell, else what follows the colon in the first.
    """
    first = F.trim(F.try_element_at("cells", F.lit(1)))
    label = F.split_part(first, F.lit(":"), F.lit(1))
    r = rows.withColumn("label", F.trim(label)).withColumn("_key", comparable_label(label))
    rest = F.try_element_at(F.filter(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c: F.trim(c) != ""), F.lit(1))
    after = F.when(F.contains(first, F.lit(":")), F.nullif(F.trim(F.substr(first, F.locate(":", first) + 1)), F.lit("")))
    r = r.withColumn("value", F.coalesce(rest, after))
    name = F.coalesce(F.lit(None).cast("string"), *[F.when(F.startswith("_key", F.lit(p)), n) for p, n in prefixes.items()])
    hit = r.withColumn("name", name).filter("name IS NOT NULL")
    return hit.groupBy("doc_id", "name").agg(F.min(F.struct("page", "table_no", "row_no", "label", "value")).alias("m")).select("doc_id", "name", "m.label", "m.value")


def lookup_value(rows: DataFrame, label: str) -> DataFrame:
    """doc_id, value: of two-column rows the first whose first cell holds the label and whose second is filled."""
    two = rows.filter((F.col("n_cols") == 2) & F.contains(F.lower(F.try_element_at("cells", F.lit(1))), F.lit(label.lower())) & (F.trim(F.try_element_at("cells", F.lit(2))) != ""))
    return two.groupBy("doc_id").agg(F.min(F.struct("page", "table_no", "row_no", F.trim(F.try_element_at("cells", F.lit(2))).alias("value"))).alias("m")).select("doc_id", "m.value")
