"""Operators on the glyph relation (doc_id, page, seq, ch, x0, x1, top, bottom, fontname, size, dx, dy).

Orders are by ``seq``. Nothing gathers a document: what depends on the row before works in ranges of seq and carries one row
from range to range.

Defined results: exact repeats are dropped first where order matters; a null ch is no mark and has no twin; null geometry
matches nothing; null dx, dy mean upright; a size of null or 0 counts as unknown; an empty table gives no rows; other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions.text import is_blank, nfc, starts_combining

# ---- Fixed values -----------------------------------------------------------------------------------------------------
FALLBACK_SIZE = 12.0
DUPLICATE_SHARE, DUPLICATE_MOST = 0.18, 2.5
OVERLAY_RATIO = 2.2
# ---- end of fixed values ----------------------------------------------------------------------------------------------
CHUNK = 1 << 16


def direction(dx: str = "dx", dy: str = "dy") -> tuple[Column, Column]:
    return F.coalesce(F.col(dx), F.lit(1.0)), F.coalesce(F.col(dy), F.lit(0.0))


def upright() -> Column:
    dx, dy = direction()
    return F.abs(dy) <= F.abs(dx)


def reads_upward() -> Column:
    return direction()[1] > 0


def reading_position() -> Column:
    """Where the glyph's centre lies along its own direction of writing."""
    dx, dy = direction()
    return dx * (F.col("x0") + F.col("x1")) / 2 - dy * (F.col("top") + F.col("bottom")) / 2


def vertical_overlap(top: Column, bottom: Column, other_top: Column, other_bottom: Column) -> Column:
    """The overlap of two vertical extents as a share of the shorter."""
    over = F.least(bottom, other_bottom) - F.greatest(top, other_top)
    shorter = F.least(bottom - top, other_bottom - other_top)
    return F.when((over <= 0) | (shorter <= 0), 0.0).otherwise(over / shorter)


def duplicate_tolerance(size: Column) -> Column:
    return F.when(size <= 0, DUPLICATE_MOST).otherwise(F.least(F.lit(DUPLICATE_SHARE) * size, F.lit(DUPLICATE_MOST)))


def median_size() -> Column:
    """The median of known sizes, as an aggregate. Spark keeps counts of distinct sizes, so a hot key stays small."""
    return F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))), F.lit(FALLBACK_SIZE))


def distinct_glyphs(glyphs: DataFrame) -> DataFrame:
    """Without exact repeats."""
    return glyphs.distinct()


def fold_combining_marks(glyphs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Accents on rows of their own join the row before them in the document, which keeps its place; a document's first row is
    always a base. Columns as before."""
    rows = glyphs.withColumn("_mark", starts_combining("ch")).withColumn("_chunk", F.floor(F.col("seq") / chunk))
    first = rows.groupBy("doc_id").agg(F.min("seq").alias("_first"))
    rows = rows.join(first, "doc_id").withColumn("_base", F.when(~F.col("_mark") | (F.col("seq") == F.col("_first")), F.col("seq"))).drop("_first")
    # The last base up to here, within the chunk; across chunks from one row a chunk.
    w = Window.partitionBy("doc_id", "_chunk").orderBy("seq")
    marks = rows.withColumn("_at", F.last("_base", ignorenulls=True).over(w)).filter("_base IS NULL").select("doc_id", "_chunk", "seq", "ch", "_at")
    ends = rows.groupBy("doc_id", "_chunk").agg(F.max("_base").alias("_end"))
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).select("doc_id", "_chunk", "_carry")
    marks = marks.join(carried, ["doc_id", "_chunk"]).select("doc_id", F.coalesce("_at", "_carry").alias("_base"), F.struct("seq", "ch").alias("m"))
    tails = marks.groupBy("doc_id", "_base").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m.ch), "").alias("_tail"))
    bases = rows.filter("_base IS NOT NULL").join(tails, ["doc_id", "_base"], "left")
    plain = bases.filter("_tail IS NULL").select(*glyphs.columns)
    folded = bases.filter("_tail IS NOT NULL").withColumn("ch", nfc(F.concat(F.coalesce("ch", F.lit("")), "_tail"))).select(*glyphs.columns)
    return plain.unionByName(folded)


def duplicate_flags(glyphs: DataFrame) -> DataFrame:
    """Adds ``duplicate``: drawn again where an earlier kept glyph of the same page and character lies. First drawn wins.

    Keeping is greedy in drawing order, so it is a fold. Folds run over small clusters: glyphs farther apart than the
    largest tolerance, first in top and then in x0, can't meet, however many a page holds.
    """
    page = ["doc_id", "page", "ch"]

    def island(df: DataFrame, axis: str, by: list[str], name: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(axis)
        gap = F.col(axis) - F.lag(axis).over(w)
        return df.withColumn("_gap", F.when(gap <= DUPLICATE_MOST, 0).otherwise(1)).withColumn(name, F.sum("_gap").over(w)).drop("_gap")

    rows = island(island(glyphs, "top", page, "_row"), "x0", [*page, "_row"], "_spot")
    one = F.struct("seq", "x0", "top", duplicate_tolerance(F.col("size")).alias("tol"))
    kept_type = "array<struct<seq:bigint,x0:double,top:double,tol:double>>"

    def keep(kept: Column, g: Column) -> Column:
        near = F.exists(kept, lambda k: (F.abs(k.x0 - g.x0) <= g.tol) & (F.abs(k.top - g.top) <= g.tol))
        return F.when(F.coalesce(near, F.lit(False)), kept).otherwise(F.concat(kept, F.array(g)))

    spot = [*page, "_row", "_spot"]
    several = rows.groupBy(*spot).agg(F.collect_list(one).alias("g")).filter(F.size("g") > 1)
    # Exact repeats have the same seq: the first stands for all, the others are duplicates by position of their own kind.
    kept = F.aggregate(F.array_sort(F.array_distinct("g")), F.array().cast(kept_type), keep)
    lost = several.select("doc_id", F.explode(F.array_except(F.transform(F.array_distinct("g"), lambda g: g.seq), F.transform(kept, lambda g: g.seq))).alias("seq"), F.lit(True).alias("duplicate"))
    return glyphs.join(lost, ["doc_id", "seq"], "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def deduplicate(glyphs: DataFrame) -> DataFrame:
    """Without the glyphs drawn over themselves."""
    return duplicate_flags(glyphs).filter("NOT duplicate").select(*glyphs.columns)


def layer_report(flagged: DataFrame) -> DataFrame:
    """doc_id, total, removed, pages_affected, has_duplicate_layer."""
    pages = flagged.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.count_if("duplicate").alias("d"))
    return pages.groupBy("doc_id").agg(F.sum("n").alias("total"), F.sum("d").alias("removed"), F.sort_array(F.collect_set(F.when(F.col("d") > 0, F.col("page")))).alias("pages_affected")).withColumn("has_duplicate_layer", F.col("removed") > 0)


def overlay_flags(glyphs: DataFrame) -> DataFrame:
    """Adds ``overlay``: a size far above the document's median, such as a watermark's."""
    medians = glyphs.groupBy("doc_id").agg(median_size().alias("_median"))
    return glyphs.join(medians, "doc_id").withColumn("overlay", F.coalesce(F.col("size") > OVERLAY_RATIO * F.col("_median"), F.lit(False))).drop("_median")


def font_usage(glyphs: DataFrame) -> DataFrame:
    """doc_id, fontname, n_chars."""
    return glyphs.groupBy("doc_id", "fontname").agg(F.count(F.lit(1)).alias("n_chars"))


def char_counts(texts: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, ch, n: the multiset of a text's characters. Counted map-side before the shuffle."""
    return texts.select(*keys, F.explode(F.split(F.col(text), "")).alias("ch")).filter("ch <> ''").groupBy(*keys, "ch").agg(F.count(F.lit(1)).alias("n"))


def bounds(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x0, top, x1, bottom around all glyphs that aren't blank."""
    drawn = df.filter(~is_blank("ch"))
    return drawn.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
