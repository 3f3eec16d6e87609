"""The whole way from files to results, as one plan over all documents at once.

Every gate gives a row (doc_id, severity, error); statuses are aggregated last. Files without a text layer leave before any
Python stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.functions.text import sourced_text
from foliograph.operators import fonts as font_gates
from foliograph.operators import glyphs as g
from foliograph.operators import lines as ln
from foliograph.operators import provenance, structure, tables, templates, verify
from foliograph.operators.structure import BOX
from foliograph.session import cut
from foliograph.sources import documents as src
from foliograph.sources import results

OK, REVIEW, REJECT = 0, 1, 2
_VALUE = ("doc_id", "ord", "path", "label", "value", "page", "bbox", "location", "source_lines", "plain")


@dataclass
class Outcome:
    """What a run gives: the documents, the values with their proof, the reports, and the finished texts."""

    docs: DataFrame
    values: DataFrame
    reports: DataFrame
    results: DataFrame


def _values(df: DataFrame, ord_: Column, path: Column, value: Column, *, label: Column | None = None, page: Column | None = None, bbox: Column | None = None, location: Column | None = None, lines: Column | None = None, plain: bool = False) -> DataFrame:
    null = F.lit(None)
    return df.select(
        "doc_id", ord_.cast("array<double>").alias("ord"), path.alias("path"), (null if label is None else label).cast("string").alias("label"), value.cast("string").alias("value"),
        (F.lit(0) if page is None else page).cast("int").alias("page"), (null if bbox is None else bbox).cast(BOX).alias("bbox"), (null if location is None else location).cast("string").alias("location"),
        (null if lines is None else lines).cast("array<string>").alias("source_lines"), F.lit(plain).alias("plain"),
    )


def _at(*parts: Column | float) -> Column:
    return F.array(*[F.lit(float(p)) if not isinstance(p, Column) else p.cast("double") for p in parts])


def _numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def structured_values(sections: DataFrame, entries: DataFrame, template: templates.Template) -> DataFrame:
    """Values of sections (doc_id, section_no, number, title, inline_value, page, bbox, location) and entries
    (doc_id, section_no, kind, at array<double>, label, value, page, bbox, location, source_lines). Section 0 is the preface."""
    named = entries.join(sections.select("doc_id", "section_no", "number"), ["doc_id", "section_no"], "left").filter("section_no = 0 OR number IS NOT NULL")
    base = F.when(F.col("section_no") == 0, F.lit("preface")).otherwise(F.concat(F.lit("sections."), F.col("number")))
    named = named.withColumn("base", base).withColumn("section", F.coalesce("number", F.lit("")))
    f = templates.field_names(named.filter("kind = 'field'"), templates.name_table(entries, template))
    group = F.when(F.col("field_name").isNotNull(), ".fields.").otherwise(".unmapped_fields.")
    out = _values(f, F.concat(_at(F.col("section_no"), 3.0), F.col("at")), F.concat("base", group, results.key_step(F.col("field_key"))), F.col("value"), label=F.col("label"), page=F.col("page"), bbox=F.col("bbox"), location=F.col("location"), lines=F.col("source_lines"))
    for k, kind, place in ((4.0, "paragraph", ".paragraphs"), (5.0, "item", ".items")):
        n = _numbered(named.filter(F.col("kind") == kind), ["doc_id", "section_no"], ["at"])
        out = out.unionByName(_values(n, _at(F.col("section_no"), k, F.col("_i")), F.concat("base", F.lit(f"{place}["), F.col("_i").cast("string"), F.lit("]")), F.col("value"), page=F.col("page"), bbox=F.col("bbox"), location=F.col("location"), lines=F.col("source_lines")))
    title = F.concat(F.lit("sections."), F.col("number"))
    names = F.create_map(*[F.lit(x) for kv in (template.section_names or {"": ""}).items() for x in kv])
    out = out.unionByName(_values(sections, _at(F.col("section_no"), 1.0), F.concat(title, F.lit(".name")), F.element_at(names, F.col("number")), plain=True))
    out = out.unionByName(_values(sections, _at(F.col("section_no"), 2.0), F.concat(title, F.lit(".title")), F.col("title"), page=F.col("page"), bbox=F.col("bbox"), location=F.col("location")))
    p = entries.filter("kind = 'paragraph'").groupBy("doc_id", "section_no").agg(F.array_sort(F.collect_list(F.struct("at", "value", "page", "bbox", "location"))).alias("_p"))
    both = sections.join(p, ["doc_id", "section_no"], "left")
    texts = F.transform("_p", lambda x: x["value"])
    first = F.try_element_at("_p", F.lit(1))
    whole = both.withColumn("_v", F.coalesce("inline_value", F.array_join(texts, " "))).filter("_v IS NOT NULL")
    inline = F.col("inline_value").isNotNull()
    place = F.when(inline, F.col("location")).otherwise(first["location"])
    return out.unionByName(_values(whole, _at(F.col("section_no"), 6.0), F.concat(title, F.lit(".value")), F.col("_v"), page=F.when(inline, 0).otherwise(first["page"]), bbox=F.when(~inline, first["bbox"]), location=place, lines=F.when(~inline, texts)))


def table_values(rows: DataFrame, sections: DataFrame, template: templates.Template) -> DataFrame:
    """Values of the table of assets: rows (doc_id, page, table_no, row_no, n_cols, cells, boxes, locations, cell_lines)."""
    home = sections.filter(F.col("number") == template.asset_section).groupBy("doc_id").agg(F.max("section_no").alias("section_no"))
    base = F.lit(f"sections.{template.asset_section}.table")
    order = ["page", "table_no", "row_no"]
    head = templates_header(rows, template).join(home, "doc_id").select("doc_id", "section_no", F.posexplode("columns").alias("_i", "_c"))
    out = _values(head, _at(F.col("section_no"), 7.0, F.col("_i")), F.concat(base, F.lit(".columns["), F.col("_i").cast("string"), F.lit("]")), F.col("_c.value"), page=F.col("_c.page"), bbox=F.col("_c.bbox"), location=F.col("_c.location"))
    data = _numbered(tables.data_rows(rows, template.asset_columns).join(home, "doc_id"), ["doc_id"], order)
    prose = F.aggregate(F.try_element_at("cell_lines", F.lit(2)), F.lit(""), lambda a, x: F.when(a == "", x).when(F.endswith(a, F.lit("-")), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x)))
    row = F.concat(base, F.lit(".rows["), F.col("_i").cast("string"), F.lit("]."))
    out = out.unionByName(_values(data, _at(F.col("section_no"), 8.0, F.col("_i"), 0.0), F.concat(row, F.lit("index")), F.col("index"), plain=True))
    for k, (name, value) in enumerate((("description", F.coalesce(F.nullif(prose, F.lit("")), F.try_element_at("cells", F.lit(2)))), ("area_sqm", F.try_element_at("cells", F.lit(3))), ("amount_vnd", F.try_element_at("cells", F.lit(4)))), 2):
        cell = [F.try_element_at(c, F.lit(k)) for c in ("boxes", "locations", "cell_lines")]
        out = out.unionByName(_values(data, _at(F.col("section_no"), 8.0, F.col("_i"), float(k)), F.concat(row, F.lit(name)), value, page=F.col("page"), bbox=cell[0], location=cell[1], lines=cell[2]))
    totals = tables.labelled_totals(rows, template.totals).join(home, "doc_id")
    return out.unionByName(_values(totals, _at(F.col("section_no"), 9.0), F.concat(base, F.lit(".totals."), F.col("name")), F.col("value"), label=F.col("label")))


def templates_header(rows: DataFrame, template: templates.Template) -> DataFrame:
    """doc_id, columns: the header's filled cells with their places."""
    whole = F.arrays_zip(F.col("cells").alias("value"), F.col("boxes").alias("bbox"), F.col("locations").alias("location"))
    filled = F.transform(F.filter(whole, lambda c: F.trim(c["value"]) != ""), lambda c: F.struct(c["value"].alias("value"), c["bbox"].alias("bbox"), c["location"].alias("location"), F.col("page").alias("page")))
    ok = (F.col("n_cols") == template.asset_columns) & (F.size(filled) >= 2) & ~F.trim(F.try_element_at("cells", F.lit(1))).rlike(r"^\p{Nd}+$")
    return rows.filter(ok).groupBy("doc_id").agg(F.min(F.struct("page", "table_no", "row_no", filled.alias("columns"))).alias("m")).select("doc_id", "m.columns")


def signature_values(people: DataFrame, template: templates.Template) -> DataFrame:
    """Values of signatures (doc_id, person, lines array<string>, places array<struct<page, location>>)."""
    e = templates.signature_entries(people.select("doc_id", "person", "lines").distinct(), template).join(people.select("doc_id", "person", "places"), ["doc_id", "person"])
    base = F.concat(F.lit("signatures["), F.col("person").cast("string"), F.lit("]."))
    first = F.try_element_at("places", F.lit(1))
    out = None
    for k, (name, plain) in enumerate((("role", True), ("role_label", True), ("card_number", False), ("name", False))):
        one = _values(e if plain else e.filter(F.col(name).isNotNull()), _at(1e6, F.col("person"), float(k)), F.concat(base, F.lit(name)), F.col(name), page=first["page"], location=first["location"], plain=plain)
        out = one if out is None else out.unionByName(one)
    lines = e.select("doc_id", "person", F.posexplode(F.arrays_zip("lines", "places")).alias("_i", "_l"))
    return out.unionByName(_values(lines, _at(1e6, F.col("person"), 9.0, F.col("_i")), F.concat(F.lit("signatures["), F.col("person").cast("string"), F.lit("].lines["), F.col("_i").cast("string"), F.lit("]")), F.col("_l.lines"), page=F.col("_l.places.page"), location=F.col("_l.places.location")))


def _people(rows: DataFrame, order: list[str]) -> DataFrame:
    by = rows.groupBy("doc_id", "person").agg(F.array_sort(F.collect_list(F.struct(*order, "value", F.struct("page", "location").alias("place")))).alias("_l"))
    return by.select("doc_id", "person", F.transform("_l", lambda x: x["value"]).alias("lines"), F.transform("_l", lambda x: x["place"]).alias("places"))


def _rows_of(cells: DataFrame) -> DataFrame:
    """doc_id, page, table_no, row_no, n_cols, cells, boxes, locations, cell_lines of cells (…, col_no, value, bbox, location, lines)."""
    one = F.struct("col_no", F.coalesce("value", F.lit("")).alias("value"), "bbox", "location", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
    by = cells.groupBy("doc_id", "page", "table_no", "row_no").agg(F.array_sort(F.collect_list(one)).alias("_c"))
    width = by.groupBy("doc_id", "page", "table_no").agg(F.max(F.size("_c")).alias("n_cols"))
    pick = lambda k: F.transform("_c", lambda c: c[k])
    return by.join(width, ["doc_id", "page", "table_no"]).select("doc_id", "page", "table_no", "row_no", "n_cols", pick("value").alias("cells"), pick("bbox").alias("boxes"), pick("location").alias("locations"), pick("lines").alias("cell_lines"))


def _gate(df: DataFrame, severity: int, error: Column) -> DataFrame:
    return df.select("doc_id", F.lit(severity).alias("severity"), error.alias("error")).filter("error IS NOT NULL")


def pdf_documents(docs: DataFrame, template: templates.Template, engines: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    """values, texts (doc_id, page, line_no, text), glyphs, gates, reports by name, of the PDF files."""
    raw = cut(src.pdf_rows(docs))
    classes = font_gates.page_classes(src.pages(raw))
    gates = _gate(raw.filter("relation = 'error'"), REJECT, F.col("value")).unionByName(_gate(classes, REJECT, F.col("rejection")))
    drawn = cut(g.fold_combining_marks(src.glyphs(raw).join(classes.filter(F.col("pdf_class") == font_gates.TEXT_LAYER).select("doc_id"), "doc_id", "left_semi")))
    audit = font_gates.font_audit(drawn, src.fonts(raw))
    layers = g.duplicate_flags(drawn)
    flagged = cut(g.overlay_flags(g.deduplicate(drawn)))
    body, overlay = flagged.filter("NOT overlay").drop("overlay"), flagged.filter("overlay").drop("overlay")
    lines = cut(ln.group_lines(body))
    notes = cut(src.annotations(raw).withColumn("bbox", src.annotation_box()))
    extra = ln.decorative_texts(overlay).unionByName(notes.groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("text")))
    texts = lines.select("doc_id", "page", "line_no", "text").unionByName(extra.select("doc_id", "page", F.lit(1 << 30).alias("line_no"), "text"))
    gates = gates.unionByName(_gate(audit, REVIEW, F.col("error")))
    excluded = flagged.groupBy("doc_id").agg(F.count_if("overlay").alias("overlay_glyphs_excluded"))
    report = F.struct("total", "removed", "pages_affected", "has_duplicate_layer", "overlay_glyphs_excluded")
    reports = {"pdf_class": classes.select("doc_id", "pdf_class"), "font_audit": audit, "glyph_layers": g.layer_report(layers).join(excluded, "doc_id").select("doc_id", report.alias("glyph_layers"))}
    if engines is not None:
        stream = lambda df, o, name: df.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ch"))), lambda x: x["ch"]), "").alias("text")).select("doc_id", F.lit(o).alias("ord"), F.lit(name).alias("baseline"), "text")
        kept = stream(flagged, 1, "deduplicated")
        forms = notes.filter("kind = 'widget'").groupBy("doc_id").agg(F.array_join(F.collect_list("value"), "").alias("_f"))
        base = stream(drawn, 0, "raw").unionByName(kept).unionByName(kept.join(forms, "doc_id").select("doc_id", F.lit(2).alias("ord"), F.lit("with_form_fields").alias("baseline"), F.concat("text", "_f").alias("text")))
        compared = verify.compare_engines(base, engines)
        reports["cross_verify"] = compared.groupBy("doc_id").agg(F.collect_list(F.struct("engine", "baseline", "chars", "char_multiset_match", "only_in_primary", "only_in_engine")).alias("cross_verify"))
        gates = gates.unionByName(_gate(compared.filter("NOT char_multiset_match"), REVIEW, F.concat(F.lit("reader "), F.col("engine"), F.lit(" disagrees on the characters"))))
    cells = cut(tables.cells(body, src.cell_boxes(raw)))
    shapes = tables.shapes(cells)
    merged = tables.merge_continued(shapes)
    wide = cells.join(shapes.filter(F.col("n_cols") >= structure.DATA_COLUMNS), ["doc_id", "page", "table_no"]).filter("bbox IS NOT NULL").groupBy("doc_id", "page", "table_no").agg(F.min("bbox.x0").alias("x0"), F.min("bbox.top").alias("top"), F.max("bbox.x1").alias("x1"), F.max("bbox.bottom").alias("bottom"))
    parts = cut(structure.sectioned(structure.without_tables(lines, wide)))
    sections = cut(structure.sections(parts).withColumn("location", F.lit(None).cast("string")))
    single = parts.filter("part = 'preface'").filter(F.size(ln.segments()) == 1)
    blocks = parts.filter("part = 'body'").unionByName(single)
    inline = sections.filter("inline_value IS NOT NULL")
    found = structure.entries(blocks, cut(structure.line_roles(blocks, inline))).filter("kind <> 'inline'")
    entries = found.select("doc_id", "section_no", "kind", F.array(F.lit(1.0), F.col("page").cast("double"), F.col("line_no").cast("double"), F.col("k").cast("double")).alias("at"), "label", "value", "page", "bbox", F.lit(None).cast("string").alias("location"), "source_lines")
    several = structure.preface_columns(parts.filter("part = 'preface'"))
    entries = entries.unionByName(several.select("doc_id", F.lit(0).alias("section_no"), "kind", F.array(F.lit(0.0), F.col("page").cast("double"), F.col("line_no").cast("double"), F.col("k").cast("double")).alias("at"), "label", "value", "page", "bbox", F.lit(None).cast("string").alias("location"), F.lit(None).cast("array<string>").alias("source_lines")))
    values = structured_values(sections, cut(entries), template)
    # A continued table is one with the table it goes on: its rows stand there, after that one's.
    joined = cells.join(merged, ["doc_id", "page", "table_no"]).withColumn("location", F.lit(None).cast("string"))
    joined = joined.withColumn("row_no", F.col("row_no") + 1_000_000 * (F.col("page") - F.col("merged_page"))).withColumn("table_no", F.col("merged_table")).withColumn("page", F.col("merged_page"))
    rows = cut(_rows_of(joined))
    values = values.unionByName(table_values(rows, sections, template))
    people = cut(_people(structure.signature_columns(parts).withColumn("location", F.lit(None).cast("string")), ["page", "line_no"]))
    values = values.unionByName(signature_values(people, template))
    feet = _numbered(lines.filter(structure.footers(lines)), ["doc_id"], ["page", "line_no"])
    values = values.unionByName(_values(feet, _at(2e6, F.col("_i")), F.concat(F.lit("page_footers["), F.col("_i").cast("string"), F.lit("]")), sourced_text("text"), page=F.col("page"), bbox=ln.box_of(F.col("chars"))))
    forms = notes.filter("kind = 'widget'")
    values = values.unionByName(_values(forms, _at(3e6, F.col("page"), F.col("ord")), F.concat(F.lit("form_fields."), results.key_step(F.coalesce("name", F.lit("unnamed_field")))), F.col("value"), page=F.col("page"), bbox=F.col("bbox")))
    links = _numbered(notes.filter("kind = 'link'"), ["doc_id"], ["page", "ord"])
    values = values.unionByName(_values(links, _at(4e6, F.col("_i")), F.concat(F.lit("hyperlinks["), F.col("_i").cast("string"), F.lit("]")), F.col("value"), page=F.col("page"), bbox=F.col("bbox")))
    return values, texts, body, gates, reports


def docx_documents(docs: DataFrame, template: templates.Template, engines: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    """values, texts, gates, reports of the DOCX files. They have no pages or boxes: places are locations, gates on glyphs don't apply."""
    nodes = cut(src.docx_nodes(docs))
    texts = src.docx_canonical(nodes)
    gates = _gate(nodes.filter("kind = 'error'"), REJECT, F.col("text")).unionByName(_gate(src.unresolved_error(nodes), REVIEW, F.col("error")))
    reports: dict[str, DataFrame] = {}
    if engines is not None:
        whole = texts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
        compared = verify.compare_one_sided(whole, engines)
        reports["cross_verify"] = compared.groupBy("doc_id").agg(F.collect_list(F.struct("engine", "baseline", "chars", "char_multiset_match", "only_in_primary", "only_in_engine")).alias("cross_verify"))
        gates = gates.unionByName(_gate(compared.filter("NOT char_multiset_match"), REVIEW, F.concat(F.lit("reader "), F.col("engine"), F.lit(" has characters that the document lacks"))))
        gates = gates.unionByName(_gate(whole.join(compared.select("doc_id").distinct(), "doc_id", "left_anti"), REVIEW, F.lit("no independent reader")))
    e = cut(structure.docx_entries(nodes))
    page = F.lit(0)
    sections = e.filter("kind = 'heading'").select("doc_id", "section_no", "number", F.col("label").alias("title"), F.col("value").alias("inline_value"), page.alias("page"), F.lit(None).cast(BOX).alias("bbox"), "location")
    entries = e.filter("kind <> 'heading'").select("doc_id", "section_no", "kind", F.array(F.col("ord").cast("double")).alias("at"), "label", "value", page.alias("page"), F.lit(None).cast(BOX).alias("bbox"), "location", F.lit(None).cast("array<string>").alias("source_lines"))
    values = structured_values(sections, entries, template)
    signed = structure.docx_signature_table(nodes)
    cells = nodes.filter("kind = 'cell'").select("doc_id", page.alias("page"), F.col("tbl").alias("table_no"), F.col("row").alias("row_no"), F.col("cell").alias("col_no"), F.col("text").alias("value"), F.lit(None).cast(BOX).alias("bbox"), "location", F.split("text", "\n").alias("lines"))
    values = values.unionByName(table_values(cut(_rows_of(cells)), sections, template))
    values = values.unionByName(signature_values(cut(_people(signed.withColumn("page", page), ["line"])), template))
    feet = _numbered(nodes.filter("kind = 'footer'"), ["doc_id"], ["ord"])
    values = values.unionByName(_values(feet, _at(2e6, F.col("_i")), F.concat(F.lit("page_footers["), F.col("_i").cast("string"), F.lit("]")), sourced_text("text"), location=F.col("location")))
    return values, texts, gates, reports


def process(spark: SparkSession, files: DataFrame, template: templates.Template = templates.CERTIFICATE, engines: DataFrame | None = None) -> Outcome:
    """Files (path, content, length) to results. engines: doc_id, engine, text of independent readers; by default the second DOCX reader."""
    docs = cut(src.with_format(src.deduplicated(src.fingerprint(files))))
    gates = _gate(docs, REJECT, F.col("error"))
    pdf_values, pdf_texts, glyphs, pdf_gates, pdf_reports = pdf_documents(docs, template, engines)
    docx_values, docx_texts, docx_gates, docx_reports = docx_documents(docs, template, engines if engines is not None else src.plain_docx_texts(docs))
    gates = gates.unionByName(pdf_gates).unionByName(docx_gates)
    texts = cut(pdf_texts.unionByName(docx_texts.select("doc_id", "page", "line_no", "text")))
    found = cut(templates.detect(ln.canonical_text(texts), (template,)).select("doc_id", "template_id", "score"))
    gates = gates.unionByName(_gate(found.filter("template_id IS NULL"), REJECT, F.lit("no known template")))
    kept = found.filter("template_id IS NOT NULL").select("doc_id")
    values = cut(pdf_values.unionByName(docx_values).join(kept, "doc_id", "left_semi"))
    text_layer = texts.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    judged = provenance.verify(values.filter("NOT plain AND value IS NOT NULL"), texts, glyphs)
    judged = cut(judged)
    proof = cut(provenance.report(judged))
    gates = gates.unionByName(_gate(proof.filter("verbatim_values < total_values"), REVIEW, F.concat(F.lit("values without proof: "), F.array_join("unverified_paths", ", "))))
    gates = gates.unionByName(docs.select("doc_id", F.lit(OK).alias("severity"), F.lit(None).cast("string").alias("error")))
    status = cut(provenance.status(gates)).join(found, "doc_id", "left")
    verification = status.join(docs.select("doc_id", F.col("format").alias("input_format")), "doc_id").join(pdf_reports["pdf_class"], "doc_id", "left").join(pdf_reports["font_audit"].drop("error"), "doc_id", "left").join(pdf_reports["glyph_layers"], "doc_id", "left").join(proof, "doc_id", "left")
    crossed = [r["cross_verify"] for r in (pdf_reports, docx_reports) if "cross_verify" in r]
    for k, c in enumerate(crossed):
        verification = verification.join(c.withColumnRenamed("cross_verify", f"_c{k}"), "doc_id", "left")
    crossing = F.coalesce(*[F.col(f"_c{k}") for k in range(len(crossed))]) if crossed else F.lit(None).cast("string")
    audit = F.when(F.col("total_fonts").isNotNull(), F.struct("total_fonts", "fonts_with_tounicode", "missing", "affected_characters", "declared_but_unused", "coverage", "is_complete"))
    shown = F.struct("input_format", "pdf_class", audit.alias("font_audit"), "glyph_layers", crossing.alias("cross_verify"), F.struct(F.coalesce("total_values", F.lit(0)).alias("total_values"), F.coalesce("verbatim_values", F.lit(0)).alias("verbatim_values"), F.coalesce("ratio", F.lit(1.0)).alias("ratio"), F.coalesce("unverified_paths", F.array().cast("array<string>")).alias("unverified_paths")).alias("provenance"))
    reports = verification.select("doc_id", "status", "severity", "errors", "template_id", "score", shown.alias("verification"))
    columns = [*_VALUE, "verbatim", "proof_level"]
    rest = values.filter("plain OR value IS NULL").withColumn("verbatim", F.lit(None).cast("boolean")).withColumn("proof_level", F.lit(None).cast("int"))
    proven = judged.select(*columns).unionByName(rest.select(*columns))
    layer = text_layer.join(kept, "doc_id", "left_semi")
    layer = _numbered(layer, ["doc_id"], ["page"])
    layer_values = _values(layer, _at(9e6, F.col("_i")), F.concat(F.lit("text_layer.pages["), F.col("_i").cast("string"), F.lit("]")), F.col("text"), page=F.col("page")).withColumn("verbatim", F.lit(True)).withColumn("proof_level", F.lit(2))
    data = results.data_json(proven.unionByName(layer_values.select(*columns)))
    # Files of equal content are decoded once, and each has its result.
    every = files.select(F.sha2("content", 256).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    return Outcome(docs, proven, reports, results.envelopes(every, reports, data))
