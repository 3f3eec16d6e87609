"""Queries of the document operators over whole tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import text as tx
from foliograph.operators import copydiff, fonts, glyphs, lines, nested, provenance, structure, tables, templates, verify
from foliograph.plans.problem_queries import NODES_SQL
from foliograph.session import cut, table
from foliograph.sources import results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("$WS", r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]").replace("$BULLETS", "('-', '–', '+', '●', '•', '*')")
        return f

    return add


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, text: the documents' lines that aren't blank."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return d.filter(~tx.is_blank("text"))


LINES = r"lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), generate_series(1, len(l)) AS g(i) WHERE NOT regexp_full_match(l[i], '$WS*'))"
GLYPHS = "g AS (SELECT DISTINCT * FROM glyphs)"


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.distinct_glyphs(table(spark, sf_dir, "glyphs"))


# ---- sources ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark, sf_dir).groupBy("sha256").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


# ---- text functions -----------------------------------------------------------------------------------------------------


@query("SELECT claim_id, nfc_normalize(value) AS composed FROM claims WHERE value IS NOT NULL")
def composed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "claims").filter("value IS NOT NULL").select("claim_id", tx.nfc("value").alias("composed"))


@query("""
WITH s AS (SELECT claim_id, trim(regexp_replace(nfc_normalize(value), '$WS+', ' ', 'g')) AS searchable FROM claims WHERE value IS NOT NULL)
SELECT claim_id, searchable, replace(searchable, ' ', '') AS collapsed FROM s
""")
def searchable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "claims").filter("value IS NOT NULL").select("claim_id", tx.searchable("value").alias("searchable"), tx.collapsed("value").alias("collapsed"))


@query("""
WITH s AS (SELECT claim_id, trim(trim(regexp_replace(replace(replace(lower(strip_accents(replace(label, chr(847), chr(983040)))), chr(983040), chr(847)), 'đ', 'd'), '$WS+', ' ', 'g')), ' .:;,-') AS comparable FROM claims WHERE label IS NOT NULL),
k AS (SELECT *, trim(regexp_replace(comparable, '[^a-z0-9]+', '_', 'g'), '_') AS k FROM s)
SELECT claim_id, comparable, CASE WHEN k = '' THEN 'unnamed_field' ELSE k END AS slug FROM k
""")
def comparable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "claims").filter("label IS NOT NULL").select("claim_id", tx.comparable_label("label").alias("comparable"), tx.slug("label").alias("slug"))


@query(r"SELECT doc_id, base_font, lower(regexp_replace(ltrim(base_font, '/'), '^[A-Z]{6}\+', '')) AS font_key FROM fonts")
def font_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fonts").select("doc_id", "base_font", tx.font_key("base_font").alias("font_key"))


@query("""
SELECT claim_id, trim(regexp_replace(split_part(value, ':', 1), '$WS+', ' ', 'g')) AS label, trim(regexp_replace(substr(value, strpos(value, ':') + 1), '$WS+', ' ', 'g')) AS rest FROM claims WHERE contains(value, ':')
""")
def label_value_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "claims").filter(F.contains("value", F.lit(":")))
    return c.select("claim_id", tx.squeezed(F.split_part("value", F.lit(":"), F.lit(1))).alias("label"), tx.squeezed(F.substr("value", F.locate(":", F.col("value")) + 1)).alias("rest"))


@query("""
SELECT claim_id, array_to_string(source_lines, '') AS number_join,
       CASE WHEN len(source_lines) = 0 THEN '' ELSE list_reduce(source_lines, lambda a, x: CASE WHEN a = '' THEN x WHEN suffix(a, '-') THEN a || x ELSE a || ' ' || x END) END AS prose_join
FROM claims WHERE source_lines IS NOT NULL
""")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "claims").filter("source_lines IS NOT NULL").select("claim_id", tx.joined_number("source_lines").alias("number_join"), tx.joined_prose("source_lines").alias("prose_join"))


@query(r"""
WITH """ + LINES + r""", t AS (SELECT *, trim(text) AS s FROM lines)
SELECT doc_id, ord, nullif(regexp_extract(s, '^\s*([IVXLCDM]{1,7})\s*\.\s*(.+)$', 1), '') AS number, nullif(regexp_extract(s, '^\s*([IVXLCDM]{1,7})\s*\.\s*(.+)$', 2), '') AS rest,
       substr(s, 1, 1) IN $BULLETS AS bullet, s IN $BULLETS AS bare FROM t
""")
def headings_and_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select("doc_id", "ord", tx.heading_number("text").alias("number"), tx.heading_rest("text").alias("rest"), tx.starts_with_bullet("text").alias("bullet"), tx.is_bare_bullet("text").alias("bare"))


@query(r"""
WITH """ + LINES + r""", t AS (SELECT *, trim(regexp_replace(text, '^$WS+|$WS+$', '', 'g')) AS s FROM lines),
n AS (SELECT *, nullif(regexp_extract(s, '^\s*([IVXLCDM]{1,7})\s*\.\s*(.+)$', 1), '') AS number FROM t),
o AS (SELECT *, CAST(sum(CASE WHEN number IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS section_no, substr(s, 1, 1) IN $BULLETS AS m FROM n),
b AS (SELECT *, CASE WHEN m THEN trim(substr(s, 2)) ELSE s END AS b FROM o),
v AS (SELECT *, trim(split_part(b, ':', 1)) AS label, CASE WHEN contains(b, ':') THEN substr(b, strpos(b, ':') + 1) END AS v FROM b),
f AS (SELECT *, v IS NOT NULL AND label <> '' AND (len(string_split_regex(label, '$WS+')) <= 8 OR (trim(regexp_replace(v, '$WS+', ' ', 'g')) <> '' AND NOT regexp_matches(label, '\p{Nd}'))) AND regexp_matches(label, '^[\p{Lu}\p{Lt}\p{Nd}]') AS is_field FROM v)
SELECT doc_id, ord, section_no, CASE WHEN number IS NOT NULL THEN 'heading' WHEN is_field THEN 'field' WHEN m THEN 'item' ELSE 'paragraph' END AS kind FROM f
""")
def paragraph_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = document_lines(spark, sf_dir).select("doc_id", "ord", F.lit("p").alias("kind"), "text", F.lit("").alias("location"), F.lit(None).cast("int").alias("list_level"))
    return structure.docx_entries(nodes).select("doc_id", "ord", "section_no", "kind")


# ---- glyphs -------------------------------------------------------------------------------------------------------------


@query("""
WITH """ + GLYPHS + """, d AS (SELECT *, coalesce(dx, 1.0) AS ux, coalesce(dy, 0.0) AS uy FROM g)
SELECT seq, abs(uy) <= abs(ux) AS upright, uy > 0 AS upward, round(ux * (x0 + x1) / 2 - uy * (top + bottom) / 2, 4) AS position FROM d
""")
def reading_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(spark, sf_dir).select("seq", glyphs.upright().alias("upright"), glyphs.reads_upward().alias("upward"), F.round(glyphs.reading_position(), 4).alias("position"))


@query("""
WITH """ + GLYPHS + """, l AS (SELECT seq, size, top, bottom, lag(top) OVER w AS pt, lag(bottom) OVER w AS pb FROM g WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq))
SELECT seq, CASE WHEN size <= 0 THEN 2.5 ELSE least(0.18 * size, 2.5) END AS tolerance,
       CASE WHEN pt IS NULL THEN NULL WHEN least(bottom, pb) - greatest(top, pt) <= 0 OR least(bottom - top, pb - pt) <= 0 THEN 0.0
            ELSE round((least(bottom, pb) - greatest(top, pt)) / least(bottom - top, pb - pt), 4) END AS overlap FROM l
""")
def neighbour_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page").orderBy("seq")
    g = drawn(spark, sf_dir).withColumn("pt", F.lag("top").over(w)).withColumn("pb", F.lag("bottom").over(w))
    over = glyphs.vertical_overlap(F.col("top"), F.col("bottom"), F.col("pt"), F.col("pb"))
    return g.select("seq", glyphs.duplicate_tolerance(F.col("size")).alias("tolerance"), F.when(F.col("pt").isNotNull(), F.round(over, 4)).alias("overlap"))


@query("""
WITH """ + GLYPHS + """, m AS (SELECT doc_id, coalesce(median(size) FILTER (WHERE size > 0), 12.0) AS med FROM g GROUP BY doc_id)
SELECT g.doc_id, m.med AS median_size, count(*) FILTER (WHERE size > 2.2 * med) AS n_overlay, count(*) AS n_glyphs FROM g JOIN m USING (doc_id) GROUP BY 1, 2
""")
def overlay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = drawn(spark, sf_dir)
    n = glyphs.overlay_flags(g).groupBy("doc_id").agg(F.count_if("overlay").alias("n_overlay"), F.count(F.lit(1)).alias("n_glyphs"))
    return g.groupBy("doc_id").agg(glyphs.median_size().alias("median_size")).join(n, "doc_id")


@query("""
WITH """ + GLYPHS + r""", m AS (SELECT *, regexp_matches(ch, '^[\x{0300}-\x{034E}\x{0350}-\x{036F}]') AND seq > min(seq) OVER (PARTITION BY doc_id) AS mark FROM g),
b AS (SELECT *, sum(CASE WHEN mark THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS base FROM m)
SELECT doc_id, min(seq) AS seq, nfc_normalize(string_agg(ch, '' ORDER BY seq)) AS ch FROM b GROUP BY doc_id, base HAVING count(*) > 1
""")
def folded_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = drawn(spark, sf_dir)
    before = g.select("doc_id", "seq", F.col("ch").alias("_was"))
    return glyphs.fold_combining_marks(g).join(before, ["doc_id", "seq"]).filter(~F.col("ch").eqNullSafe(F.col("_was"))).select("doc_id", "seq", "ch")


@query()
def duplicate_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.layer_report(glyphs.duplicate_flags(drawn(spark, sf_dir)))


@query("SELECT doc_id, fontname, count(*) AS n_chars FROM (SELECT DISTINCT * FROM glyphs) GROUP BY 1, 2")
def font_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.font_usage(drawn(spark, sf_dir))


@query(r"""
WITH """ + GLYPHS + r""" SELECT doc_id, page, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM g WHERE NOT regexp_full_match(ch, '$WS*') GROUP BY 1, 2
""")
def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.bounds(drawn(spark, sf_dir), ["doc_id", "page"])


@query("""
WITH """ + GLYPHS + """, c AS (SELECT doc_id, unnest(string_split(ch, '')) AS ch FROM g WHERE ch <> '')
SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1, 2
""")
def char_multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.char_counts(drawn(spark, sf_dir).withColumnRenamed("ch", "text"))


# ---- fonts and pages ----------------------------------------------------------------------------------------------------


@query(r"""
WITH d AS (SELECT doc_id, base_font, bool_and(has_tounicode) AS ok, lower(regexp_replace(ltrim(base_font, '/'), '^[A-Z]{6}\+', '')) AS k FROM fonts GROUP BY doc_id, base_font),
u AS (SELECT doc_id, lower(regexp_replace(ltrim(fontname, '/'), '^[A-Z]{6}\+', '')) AS k, count(*) AS n FROM (SELECT DISTINCT * FROM glyphs) WHERE fontname IS NOT NULL GROUP BY 1, 2),
j AS (SELECT d.*, u.n FROM d LEFT JOIN u ON d.doc_id = u.doc_id AND d.k = u.k)
SELECT doc_id, CAST(count(*) FILTER (WHERE n IS NOT NULL) AS INTEGER) AS total_fonts, CAST(count(*) FILTER (WHERE n IS NOT NULL AND ok) AS INTEGER) AS fonts_with_tounicode,
       coalesce(string_agg(base_font, '|' ORDER BY base_font) FILTER (WHERE n IS NOT NULL AND NOT ok AND NOT regexp_matches(lower(base_font), 'symbol|dingbat|wingding')), '') AS missing,
       CAST(coalesce(sum(n) FILTER (WHERE NOT ok AND NOT regexp_matches(lower(base_font), 'symbol|dingbat|wingding')), 0) AS BIGINT) AS affected,
       coalesce(string_agg(base_font, '|' ORDER BY base_font) FILTER (WHERE n IS NULL), '') AS unused FROM j GROUP BY doc_id
""")
def font_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fonts.font_audit(drawn(spark, sf_dir), table(spark, sf_dir, "fonts"))
    return a.select("doc_id", "total_fonts", "fonts_with_tounicode", F.array_join("missing", "|").alias("missing"), F.aggregate(F.map_values("affected_characters"), F.lit(0).cast("long"), lambda x, y: x + y).alias("affected"), F.array_join("declared_but_unused", "|").alias("unused"))


@query("""
WITH p AS (SELECT doc_id, page, 595.28 AS width, 841.89 AS height, count(*) AS n_chars, CASE WHEN page % 3 = 0 THEN 0.6 * 595.28 * 841.89 ELSE 0.0 END AS image_area FROM (SELECT DISTINCT * FROM glyphs) GROUP BY 1, 2),
s AS (SELECT *, image_area > 0 AND image_area / (width * height) >= 0.5 AND n_chars < 20 AS scan FROM p)
SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE scan) AS n_scan_like, CASE WHEN count(*) FILTER (WHERE scan) = 0 THEN 'text_layer' WHEN count(*) FILTER (WHERE scan) = count(*) THEN 'scanned' ELSE 'mixed' END AS pdf_class FROM s GROUP BY doc_id
""")
def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = drawn(spark, sf_dir).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_chars"))
    pages = n.withColumn("width", F.lit(595.28)).withColumn("height", F.lit(841.89)).withColumn("image_area", F.when(F.col("page") % 3 == 0, F.lit(0.6) * F.col("width") * F.col("height")).otherwise(0.0))
    return fonts.page_classes(pages).select("doc_id", "n_pages", "n_scan_like", "pdf_class")


# ---- lines, tables, structure -------------------------------------------------------------------------------------------


@query()
def grouped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.group_lines(table(spark, sf_dir, "glyphs")).drop("chars")


@query()
def line_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lines.with_columns(lines.group_lines(table(spark, sf_dir, "glyphs")).withColumn("segments", lines.segments()))  # noqa: E741
    return l.select("doc_id", "page", "line_no", F.transform("segments", lines.text_of).alias("segments"), F.transform("columns", lines.text_of).alias("columns"))


@query()
def parsed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = cut(lines.group_lines(glyphs.deduplicate(drawn(spark, sf_dir))))  # noqa: E741
    parts = cut(structure.sectioned(l))
    blocks = parts.filter("part IN ('preface', 'body')")
    return structure.entries(blocks, structure.line_roles(blocks)).select("doc_id", "section_no", "kind", "page", "line_no", "k", "label", "value")


@query("""
WITH """ + GLYPHS + """ SELECT doc_id, page, string_agg(ch, '' ORDER BY seq) AS text FROM g WHERE ch IS NOT NULL GROUP BY 1, 2
""")
def page_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = drawn(spark, sf_dir).filter("ch IS NOT NULL")
    return g.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ch"))), lambda x: x["ch"]), "").alias("text"))


@query()
def merged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table_rows(spark, sf_dir)
    return tables.merge_continued(rows.select("doc_id", "page", "table_no", "n_cols").distinct())


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (the record), page, table_no, row_no, n_cols, cells of the parsed documents' tables."""
    nodes = cut(nested.dewey_nodes(table(spark, sf_dir, "parsed_docs")))
    flat = {k: nested.tables_of(nodes, k) for k in ("table", "cell")}
    number = F.when(F.size("dewey") == 1, F.element_at("dewey", 1)).otherwise(1000 * (F.element_at("dewey", 1) + 1) + F.element_at("dewey", 2))
    t = flat["table"].select("record_id", F.col("node_path").alias("table_path"), number.alias("table_no"), F.expr("try_cast(page AS int)").alias("page"))
    c = flat["cell"].select("record_id", F.col("parent_path").alias("row_path"), F.regexp_replace("parent_path", r"\.rows\[\d+\]$", "").alias("table_path"), F.element_at("dewey", -1).alias("col_no"), F.element_at("dewey", -2).alias("row_no"), F.coalesce("text", F.lit("")).alias("value"))
    rows = c.groupBy("record_id", "table_path", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "value"))), lambda x: x["value"]).alias("cells"))
    width = rows.groupBy("record_id", "table_path").agg(F.max(F.size("cells")).alias("n_cols"))
    return rows.join(width, ["record_id", "table_path"]).join(t, ["record_id", "table_path"]).select(F.col("record_id").cast("string").alias("doc_id"), F.coalesce("page", F.lit(0)).alias("page"), "table_no", "row_no", "n_cols", "cells")


@query()
def table_data_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.data_rows(table_rows(spark, sf_dir), 4).select("doc_id", "page", "table_no", "row_no", "index", "rest")


_SAID = "CASE WHEN json_type(f->'$.{k}') = 'OBJECT' AND json_exists(f, '$.{k}.value') AND json_type(f->'$.{k}.value') NOT IN ('OBJECT', 'ARRAY') THEN f->>'$.{k}.value' ELSE f->>'$.{k}' END"


@query(NODES_SQL + "SELECT record_id, path || '[' || (i - 1) || ']' AS node_path, parent AS parent_path, " + ", ".join(f"{_SAID.format(k=k)} AS {k}" for k in ("label", "value")) + " FROM (SELECT record_id, path, parent, i, l[i] AS f FROM b2, generate_series(1, len(l)) AS g(i) WHERE kind = 'field') WHERE json_type(f) <> 'NULL'")
def section_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = nested.tables_of(nested.dewey_nodes(table(spark, sf_dir, "parsed_docs")), "field")
    return f.select("record_id", "node_path", "parent_path", "label", "value")


# ---- templates ----------------------------------------------------------------------------------------------------------

OFFICES = templates.Template("office_report", ("Hội đồng giá", "Văn phòng đăng ký", "Tổ khảo sát", "Chi nhánh", "Bên đề nghị"))


@query("""
WITH h AS (SELECT doc_id, lower(replace(nfc_normalize(text), ' ', '')) AS h FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, (CAST(contains(h, 'hộiđồnggiá') AS INTEGER) + CAST(contains(h, 'vănphòngđăngký') AS INTEGER) + CAST(contains(h, 'tổkhảosát') AS INTEGER) + CAST(contains(h, 'chinhánh') AS INTEGER) + CAST(contains(h, 'bênđềnghị') AS INTEGER)) / 5.0 AS score FROM h)
SELECT doc_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.6 THEN 'office_report' END AS template_id FROM s
""")
def detected_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.detect(table(spark, sf_dir, "documents").filter("text IS NOT NULL"), (OFFICES,)).select("doc_id", "score", "template_id")


_NAMES = {"": {"don gia": "unit_price", "muc dich su dung": "purpose", "thoi gian con hieu luc": "validity", "certificate": "certificate", "nguoi lap bieu": "compiler", "date of inspection": "inspected_on"}}


@query("""
WITH n(key, name) AS (VALUES ('don gia', 'unit_price'), ('muc dich su dung', 'purpose'), ('thoi gian con hieu luc', 'validity'), ('certificate', 'certificate'), ('nguoi lap bieu', 'compiler'), ('date of inspection', 'inspected_on')),
l AS (SELECT DISTINCT term_id, term, trim(trim(regexp_replace(replace(lower(strip_accents(term)), 'đ', 'd'), '$WS+', ' ', 'g')), ' .:;,-') AS k FROM known_terms),
m AS (SELECT l.*, n.name, n.key = l.k AS e, length(n.key) AS len FROM l LEFT JOIN n ON n.key = l.k OR (length(n.key) >= 8 AND prefix(l.k, n.key || ' ')))
SELECT term_id, term, arg_max(name, CASE WHEN e THEN 1000 ELSE len END) AS field_name,
       coalesce(arg_max(name, CASE WHEN e THEN 1000 ELSE len END), coalesce(nullif(trim(regexp_replace(any_value(k), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed_field')) AS field_key FROM m GROUP BY term_id, term
""")
def named_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "known_terms").select("term_id", "term", F.lit("").alias("section")).distinct()
    return templates.field_names(t, templates.name_table(t, templates.Template("names", (), fields=_NAMES)), label="term").select("term_id", "term", "field_name", "field_key")


@query()
def signature_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signature columns of parsed documents, a person's lines together."""
    s = table(spark, sf_dir, "parsed_docs").select("record_id", F.get_json_object("payload", "$.signature_columns").alias("j")).filter("j IS NOT NULL")
    rows = s.select("record_id", F.posexplode(F.from_json("j", "array<array<string>>")).alias("line_no", "raw")).filter("raw IS NOT NULL")
    said = F.transform("raw", lambda x: F.coalesce(F.get_json_object(x, "$.value"), x))
    people = structure.transposed(rows.withColumn("cells", said), ["record_id"], ["line_no"], "cells").withColumnRenamed("record_id", "doc_id")
    return templates.signature_entries(people)


# ---- verification -------------------------------------------------------------------------------------------------------


def _side(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    c = copydiff.holding(table(spark, sf_dir, name), ["doc_id", "path"], ["value"], "recorded_at", key)
    return c.filter("value IS NOT NULL").select("doc_id", F.col("value").alias("text"))


_SIDES = """
a AS (SELECT doc_id, unnest(string_split(value, '')) AS ch FROM (SELECT doc_id, path, value FROM claims QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY recorded_at DESC, claim_id DESC) = 1) WHERE value <> ''),
b AS (SELECT doc_id, unnest(string_split(value, '')) AS ch FROM (SELECT doc_id, path, value FROM claims_copy QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY recorded_at DESC, copy_id DESC) = 1) WHERE value <> ''),
ca AS (SELECT doc_id, ch, count(*) AS n FROM a WHERE ch <> '' GROUP BY 1, 2), cb AS (SELECT doc_id, ch, count(*) AS n FROM b WHERE ch <> '' GROUP BY 1, 2),
d AS (SELECT coalesce(ca.doc_id, cb.doc_id) AS doc_id, coalesce(ca.ch, cb.ch) AS ch, greatest(coalesce(ca.n, 0) - coalesce(cb.n, 0), 0) AS only_a, greatest(coalesce(cb.n, 0) - coalesce(ca.n, 0), 0) AS only_b FROM ca FULL OUTER JOIN cb ON ca.doc_id = cb.doc_id AND ca.ch = cb.ch)
"""


@query("WITH " + _SIDES + " SELECT * FROM d WHERE only_a > 0 OR only_b > 0")
def multiset_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.multiset_difference(glyphs.char_counts(_side(spark, sf_dir, "claims", "claim_id")), glyphs.char_counts(_side(spark, sf_dir, "claims_copy", "copy_id")))


@query("WITH " + _SIDES + ", r AS (SELECT doc_id, ch, only_a, row_number() OVER (PARTITION BY doc_id ORDER BY only_a DESC, ch) AS k FROM d WHERE only_a > 0) SELECT doc_id, string_agg(ch || ':' || only_a, ' ' ORDER BY k) AS most FROM r WHERE k <= 10 GROUP BY doc_id")
def most_common_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = verify.most_common(multiset_differences(spark, sf_dir), ["doc_id"], "only_a")
    return top.select("doc_id", F.array_join(F.transform(F.map_entries("only_a"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), " ").alias("most"))


def _texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return _side(spark, sf_dir, name, key).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "").alias("text"))


@query()
def compared_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _texts(spark, sf_dir, "claims", "claim_id").select("doc_id", F.lit(0).alias("ord"), F.lit("raw").alias("baseline"), "text")
    return verify.compare_engines(base, _texts(spark, sf_dir, "claims_copy", "copy_id").withColumn("engine", F.lit("copy")))


@query()
def one_sided_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.compare_one_sided(_texts(spark, sf_dir, "claims", "claim_id"), _texts(spark, sf_dir, "claims_copy", "copy_id").withColumn("engine", F.lit("copy")))


@query()
def uncovered_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.uncovered(_texts(spark, sf_dir, "claims", "claim_id"), _texts(spark, sf_dir, "claims_copy", "copy_id"))


# ---- provenance ---------------------------------------------------------------------------------------------------------


def _claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "claims").select("claim_id", "doc_id", "path", "value", "page", "bbox", "source_lines").distinct()


_PROVEN = """
WITH """ + GLYPHS + """, p AS (SELECT doc_id, page, trim(regexp_replace(nfc_normalize(string_agg(ch, '' ORDER BY seq)), '$WS+', ' ', 'g')) AS t FROM g WHERE ch IS NOT NULL GROUP BY 1, 2),
h AS (SELECT doc_id, string_agg(t, ' ' ORDER BY page) AS h FROM p WHERE t <> '' GROUP BY 1),
c AS (SELECT DISTINCT claim_id, doc_id, path, value, source_lines, trim(regexp_replace(nfc_normalize(value), '$WS+', ' ', 'g')) AS n FROM claims),
j AS (SELECT c.*, h.h, coalesce(n <> '' AND (contains(h, n) OR contains(replace(h, ' ', ''), replace(n, ' ', ''))), false) AS two,
      coalesce(n <> '' AND len(source_lines) > 0 AND len(list_filter(source_lines, lambda x: NOT contains(h, trim(regexp_replace(nfc_normalize(x), '$WS+', ' ', 'g'))))) = 0
               AND replace(trim(regexp_replace(nfc_normalize(array_to_string(source_lines, ' ')), '$WS+', ' ', 'g')), ' ', '') = replace(n, ' ', ''), false) AS three FROM c LEFT JOIN h USING (doc_id))
SELECT claim_id, CASE WHEN two THEN 2 WHEN three THEN 3 END AS proof_level, two OR three AS verbatim FROM j
"""


@query(_PROVEN)
def proven_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.verify(_claimed(spark, sf_dir), page_streams(spark, sf_dir)).select("claim_id", "proof_level", "verbatim")


@query("""
WITH """ + GLYPHS + """, b AS (SELECT DISTINCT doc_id, page, path, bbox FROM claims WHERE bbox IS NOT NULL),
i AS (SELECT b.doc_id, b.page, b.path, b.bbox, g.seq, g.ch, g.x0, g.top FROM b JOIN g ON b.doc_id = g.doc_id AND b.page = g.page AND (g.x0 + g.x1) / 2 BETWEEN b.bbox.x0 - 1.5 AND b.bbox.x1 + 1.5 AND (g.top + g.bottom) / 2 BETWEEN b.bbox.top - 1.5 AND b.bbox.bottom + 1.5)
SELECT doc_id, page, path, count(*) AS n_glyphs FROM i WHERE ch IS NOT NULL GROUP BY doc_id, page, path, bbox
""")
def glyphs_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = drawn(spark, sf_dir).filter("ch IS NOT NULL").withColumn("ch", F.lit("x"))
    boxes = table(spark, sf_dir, "claims").select("doc_id", "page", "path", "bbox").distinct()
    return provenance.text_in_boxes(g, boxes, ["doc_id", "page", "path", "bbox"]).select("doc_id", "page", "path", F.length("region").cast("long").alias("n_glyphs"))


@query()
def proven_by_all_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.verify(_claimed(spark, sf_dir), page_streams(spark, sf_dir), drawn(spark, sf_dir)).select("claim_id", "proof_level", "verbatim")


@query("WITH v AS (" + _PROVEN.replace("SELECT claim_id, CASE", "SELECT claim_id, doc_id, path, CASE") + """)
SELECT doc_id, count(*) AS total_values, count(*) FILTER (WHERE verbatim) AS verbatim_values, coalesce(list(path ORDER BY path) FILTER (WHERE NOT verbatim AND path IS NOT NULL), []) AS unverified_paths,
       CAST(count(*) FILTER (WHERE verbatim) AS DOUBLE) / count(*) AS ratio FROM v GROUP BY doc_id
""")
def provenance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: what share of each file's values its own text proves."""
    values = provenance.verify(_claimed(spark, sf_dir), page_streams(spark, sf_dir))
    return provenance.report(values)


_GATES = """
gates AS (SELECT doc_id, CASE WHEN len(missing) > 0 THEN 1 ELSE 0 END AS severity FROM font_audits UNION ALL SELECT doc_id, CASE WHEN value IS NULL THEN 2 ELSE 0 END FROM claims),
s AS (SELECT doc_id, max(severity) AS severity FROM gates GROUP BY 1)
"""


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "font_audits").select("doc_id", F.when(F.size("missing") > 0, 1).otherwise(0).alias("severity"), F.when(F.size("missing") > 0, F.lit("missing fonts")).alias("error"))
    c = table(spark, sf_dir, "claims").select("doc_id", F.when(F.col("value").isNull(), 2).otherwise(0).alias("severity"), F.when(F.col("value").isNull(), F.lit("null value")).alias("error"))
    return f.unionByName(c)


@query("WITH " + _GATES + " SELECT doc_id, CASE severity WHEN 0 THEN 'verified' WHEN 1 THEN 'needs_review' ELSE 'rejected' END AS status FROM s")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.status(_gates(spark, sf_dir)).select("doc_id", "status")


@query("WITH " + _GATES + " SELECT coalesce(max(severity), 2) AS exit_code FROM s")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.exit_code(provenance.status(_gates(spark, sf_dir)))


@query()
def result_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "claims")
    held = copydiff.holding(c, ["doc_id", "path"], ["label", "value", "page", "bbox", "location"], "recorded_at", "claim_id")
    return results.data_json(held.withColumn("ord", F.array(F.lit(0.0))).withColumn("verbatim", F.lit(True)).withColumn("plain", F.lit(False)))
