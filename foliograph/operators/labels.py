"""Looking values up by a printed label in lines, for templates of documents without a fixed structure.

Each lookup gives at most one row a document: the first place in reading order counts. Labels are compared composed, without plain
blanks and case.

Defined results: a label that no segment holds gives no row; a value of nothing but blanks and separators is no value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.functions.text import SECTION_START, blankless_lower, is_blank, nfc, original_position, sourced_text
from foliograph.operators.lines import box_of, segments, text_of

SEPARATOR = ":"


def label_end(text: F.Column, label: str) -> F.Column:
    """The index in a text just after a label that may be spaced otherwise there; 0 if it isn't there."""
    key = "".join(label.lower().split(" "))
    at = F.locate(key, blankless_lower(text))
    return F.when(at == 0, 0).otherwise(F.least(original_position(text, at - 1 + len(key) - 1) + 1, F.length(text)))


def located(lines: DataFrame, label: str) -> DataFrame:
    """doc_id, page, line_no, k, segment, rest: the first segment with the label, and the line's segments after it."""
    key = "".join(label.lower().split(" "))
    s = lines.withColumn("_s", segments()).select("doc_id", "page", "line_no", F.posexplode("_s").alias("k", "segment"), "_s")
    s = s.filter(F.contains(blankless_lower(text_of(F.col("segment"))), F.lit(key)))
    first = s.groupBy("doc_id").agg(F.min(F.struct("page", "line_no", "k")).alias("m")).select("doc_id", "m.*")
    hit = s.join(first, ["doc_id", "page", "line_no", "k"])
    return hit.select("doc_id", "page", "line_no", "k", "segment", F.flatten(F.slice("_s", F.col("k") + 2, F.size("_s"))).alias("rest"))


def first_line_with(lines: DataFrame, label: str) -> DataFrame:
    """doc_id, page, line_no, text of the first line that holds the label."""
    hit = lines.filter(F.contains(blankless_lower("text"), F.lit("".join(label.lower().split(" ")))))
    return hit.groupBy("doc_id").agg(F.min(F.struct("page", "line_no", "text")).alias("m")).select("doc_id", "m.*")


def segment_with(lines: DataFrame, label: str) -> DataFrame:
    """doc_id, page, value, bbox: the whole first segment that holds the label."""
    hit = located(lines, label)
    return hit.select("doc_id", "page", sourced_text(text_of(F.col("segment")), (SEPARATOR,)).alias("value"), box_of(F.col("segment")).alias("bbox")).filter("value IS NOT NULL")


def value_after(lines: DataFrame, label: str, multiline: bool = False) -> DataFrame:
    """doc_id, page, value: what follows the label's colon, or the segments after it where there is none.

    multiline: with the lines below on the page, up to a blank line or one that opens a section or an item.
    """
    hit = located(lines, label).withColumn("_t", nfc(text_of(F.col("segment"))))
    hit = hit.withColumn("_end", label_end(F.col("_t"), label))
    colon = F.locate(SEPARATOR, F.substr("_t", F.col("_end") + 1))
    hit = hit.withColumn("_own", F.when(colon > 0, F.substr("_t", F.col("_end") + colon + 1)).otherwise(text_of(F.col("rest"))))
    hit = hit.filter(F.col("_own") != "")
    if not multiline:
        return hit.select("doc_id", "page", sourced_text("_own", (SEPARATOR,)).alias("value")).filter("value IS NOT NULL")
    below = lines.select("doc_id", "page", F.col("line_no").alias("_n"), "text").join(hit.select("doc_id", "page", "line_no"), ["doc_id", "page"]).filter("_n > line_no")
    stop = below.filter(F.col("text").rlike(SECTION_START) | is_blank("text")).groupBy("doc_id").agg(F.min("_n").alias("_stop"))
    more = below.join(stop, "doc_id", "left").filter("_stop IS NULL OR _n < _stop").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]), " ").alias("_more"))
    whole = hit.join(more, "doc_id", "left")
    return whole.select("doc_id", "page", sourced_text(F.concat_ws(" ", "_own", "_more"), (SEPARATOR,)).alias("value")).filter("value IS NOT NULL")
