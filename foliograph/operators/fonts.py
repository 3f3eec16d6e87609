"""Gates on pages and fonts: whether a file has a text layer, and whether its fonts can be read.

Defined results: a file without pages gets no class; null image areas count as none; a font declared on several pages is readable
only if it is on each; a file without declared fonts has coverage 1; repeated rows change nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.functions.text import font_key

# ---- Fixed values -----------------------------------------------------------------------------------------------------
SCAN_COVERAGE, FEW_CHARS = 0.5, 20
DECORATIVE = "symbol|dingbat|wingding"
TEXT_LAYER, SCANNED, MIXED = "text_layer", "scanned", "mixed"
# ---- end of fixed values ----------------------------------------------------------------------------------------------


def scan_like() -> F.Column:
    """Images over half the page's area or more (areas added up), and hardly any characters."""
    area = F.col("width") * F.col("height")
    return F.coalesce((F.col("image_area") > 0) & (area > 0) & (F.col("image_area") / area >= SCAN_COVERAGE) & (F.col("n_chars") < FEW_CHARS), F.lit(False))


def page_classes(pages: DataFrame) -> DataFrame:
    """doc_id, pdf_class, n_pages, n_scan_like, few_char_pages, rejection (null for a text layer)."""
    by = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(scan_like()).alias("n_scan_like"),
        F.array_sort(F.collect_set(F.when(F.col("n_chars") < FEW_CHARS, F.col("page")))).alias("few_char_pages"),
    )
    kind = F.when(F.col("n_scan_like") == 0, TEXT_LAYER).when(F.col("n_scan_like") == F.col("n_pages"), SCANNED).otherwise(MIXED)
    by = by.withColumn("pdf_class", kind)
    reason = F.when(F.col("pdf_class") == SCANNED, F.lit("no text layer: a scan; only embedded text is exact to 100%")).when(
        F.col("pdf_class") == MIXED, F.concat(F.lit("pages "), F.array_join("few_char_pages", ", "), F.lit(" are scans; a person must confirm first"))
    )
    return by.withColumn("rejection", reason)


def font_audit(glyphs: DataFrame, fonts: DataFrame) -> DataFrame:
    """doc_id, total_fonts, fonts_with_tounicode, missing, affected_characters, declared_but_unused, coverage, is_complete, error.

    Only declared fonts that draw something count. A missing decorative font is no fault.
    """
    declared = fonts.groupBy("doc_id", "base_font").agg(F.bool_and("has_tounicode").alias("ok")).withColumn("key", font_key("base_font"))
    used = glyphs.filter("fontname IS NOT NULL").groupBy("doc_id", "fontname").agg(F.count(F.lit(1)).alias("n"))
    used = used.withColumn("key", font_key("fontname")).groupBy("doc_id", "key").agg(F.sum("n").alias("n"))
    both = declared.join(used, ["doc_id", "key"], "left").withColumn("considered", F.col("n").isNotNull())
    lost = F.col("considered") & ~F.col("ok") & ~F.lower("base_font").rlike(DECORATIVE)
    entry = F.struct(F.col("base_font").alias("key"), F.col("n").alias("value"))
    out = both.groupBy("doc_id").agg(
        F.count_if("considered").cast("int").alias("total_fonts"),
        F.count_if(F.col("considered") & F.col("ok")).cast("int").alias("fonts_with_tounicode"),
        F.array_sort(F.collect_list(F.when(lost, F.col("base_font")))).alias("missing"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(lost, entry)))).alias("affected_characters"),
        F.array_sort(F.collect_list(F.when(~F.col("considered"), F.col("base_font")))).alias("declared_but_unused"),
    )
    coverage = F.when(F.col("total_fonts") == 0, 1.0).otherwise(F.col("fonts_with_tounicode") / F.col("total_fonts"))
    error = F.when(F.size("missing") > 0, F.concat(F.lit("fonts without a Unicode table: "), F.array_join(F.transform("missing", lambda m: F.concat(m, F.lit(" ("), F.coalesce(F.try_element_at("affected_characters", m), F.lit(0)).cast("string"), F.lit(" characters)"))), ", ")))
    return out.withColumn("coverage", coverage).withColumn("is_complete", F.size("missing") == 0).withColumn("error", error)
