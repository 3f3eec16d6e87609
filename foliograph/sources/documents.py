"""Sources: files of documents, decoded into relations.

Files come by ``binaryFile`` and are told apart by their bytes. Decoders use the standard library alone and run in Arrow
batches, file by file; a file that can't be read becomes a row with its error, never an exception of the batch.

Defined results: an unknown format has format null and an error; an empty file likewise; a folder without files gives no rows.
"""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions.text import nfc
from foliograph.sources.pdf import PdfFile

# ---- Fixed values -----------------------------------------------------------------------------------------------------
PDF, DOCX = "pdf", "docx"
BODY = "word/document.xml"
# ---- end of fixed values ----------------------------------------------------------------------------------------------


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length of every .pdf and .docx file below a folder, or of one file with any name."""
    reader = spark.read.format("binaryFile")
    if re.search(r"\.(pdf|docx)$", path, re.I) or Path(path).is_file():
        return reader.load(path)
    return reader.option("recursiveFileLookup", "true").load(path).filter(F.lower("path").rlike(r"\.(pdf|docx)$"))


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream that picks up new files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)


def fingerprint(files: DataFrame) -> DataFrame:
    """doc_id (sha256), file, bytes, path, content."""
    return files.select(F.sha2("content", 256).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), "path", "content")


def _is_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k = b.schema.get_field_index("content")
        found = []
        for c in b.column(k).to_pylist():
            try:
                found.append(c is not None and c[:4] == b"PK\x03\x04" and BODY in zipfile.ZipFile(io.BytesIO(c)).namelist())
            except (zipfile.BadZipFile, OSError, ValueError):
                found.append(False)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], [*b.schema.names, "word"])


def with_format(docs: DataFrame) -> DataFrame:
    """Adds ``format`` (pdf, docx or null) and ``error``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kind = F.when(F.startswith("content", F.lit(b"%PDF-")), PDF).when(F.col("word"), DOCX)
    return docs.mapInArrow(_is_word, f"{fields}, word boolean").withColumn("format", kind).drop("word").withColumn("error", F.when(F.col("format").isNull(), F.concat("file", F.lit(": neither PDF (%PDF-) nor DOCX (a ZIP package with word/document.xml)"))))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row for each content, to decode it once; every path keeps its result (``plans.pipeline``)."""
    return docs.dropDuplicates(["doc_id"])


# ---- word-processor files -----------------------------------------------------------------------------------------------
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
NODES = "doc_id string, ord int, kind string, tbl int, row int, cell int, text string, location string, list_level int, unresolved array<string>"


def _text(e: ElementTree.Element) -> str:
    """The text below an element: tabs as blanks, breaks and further paragraphs as line ends."""
    out: list[str] = []

    def go(x: ElementTree.Element) -> None:
        for y in x:
            tag = y.tag.removeprefix(_W)
            if tag == "t":
                out.append(y.text or "")
            elif tag == "tab":
                out.append(" ")
            elif tag in ("br", "cr"):
                out.append("\n")
            else:
                if tag == "p" and out:
                    out.append("\n")
                go(y)

    go(e)
    return "".join(out)


_FIELD_PARTS = {f"{_W}fldChar", f"{_W}instrText", f"{_W}t"}


def _fields(e: ElementTree.Element) -> Iterator[tuple[str, str]]:
    """(code, stored result) of each dynamic field that begins and ends below an element; one that begins within another takes its place."""
    part: dict[str, str] | None = None
    for x in (x for x in e.iter() if x.tag in _FIELD_PARTS):
        match x.tag.removeprefix(_W), x.get(f"{_W}fldCharType"):
            case "fldChar", "begin":
                part = {"instrText": "", "t": ""}
            case "fldChar", "end" if part is not None:
                yield part["instrText"], part["t"]
                part = None
            case ("instrText" | "t") as name, _ if part is not None:
                part[name] += x.text or ""


def _unresolved(e: ElementTree.Element, location: str) -> list[str]:
    """Dynamic fields without a stored result; blanks are a result."""
    return [f"{location}: {code.strip() or '?'}" for code, result in _fields(e) if not result]


def _level(p: ElementTree.Element) -> int | None:
    """The list level; null where none is given, 0 where it is no number."""
    level = p.find(f"{_W}pPr/{_W}numPr/{_W}ilvl")
    if level is None:
        return None
    value = level.get(f"{_W}val", "")
    return int(value) if value.isdigit() else 0


def docx_rows(content: bytes) -> list[dict]:
    """The nodes of a file in body order: direct paragraphs and tables' cells, then footers. Empty paragraphs count in paths only."""
    rows: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read(BODY)).find(f"{_W}body")
        n_p = n_t = 0
        for e in body if body is not None else ():
            if e.tag == f"{_W}p":
                n_p += 1
                here = f"body/p[{n_p}]"
                if (t := _text(e)).strip():
                    rows.append({"kind": "p", "text": t, "location": here, "list_level": _level(e), "unresolved": _unresolved(e, here)})
                elif u := _unresolved(e, here):
                    rows.append({"kind": "p", "text": "", "location": here, "unresolved": u})
            elif e.tag == f"{_W}tbl":
                n_t += 1
                for r, tr in enumerate(e.findall(f"{_W}tr"), 1):
                    for c, tc in enumerate(tr.findall(f"{_W}tc"), 1):
                        here = f"body/tbl[{n_t}]/tr[{r}]/tc[{c}]"
                        rows.append({"kind": "cell", "tbl": n_t, "row": r, "cell": c, "text": _text(tc), "location": here, "unresolved": _unresolved(tc, here)})
        for k, name in enumerate(sorted(n for n in z.namelist() if re.fullmatch(r"word/footer\d*\.xml", n)), 1):
            e = ElementTree.fromstring(z.read(name))
            here = f"sectPr[{k}]/footer"
            if (t := _text(e).strip()) or _unresolved(e, here):
                rows.append({"kind": "footer", "text": t, "location": here, "unresolved": _unresolved(e, here)})
    return [r | {"ord": i} for i, r in enumerate(rows)]


def _docx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in NODES.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
    for b in batches:
        rows = []
        for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                rows += [r | {"doc_id": d} for r in docx_rows(c)]
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, OSError) as e:
                rows.append({"doc_id": d, "ord": 0, "kind": "error", "text": str(e), "location": ""})
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)


def docx_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, ord, kind (p, cell, footer, error), tbl, row, cell, text (composed), location, list_level, unresolved."""
    return docs.filter(F.col("format") == DOCX).select("doc_id", "content").mapInArrow(_docx, NODES).withColumn("text", nfc("text"))


def docx_canonical(nodes: DataFrame) -> DataFrame:
    """doc_id, page 0, line_no, text: the filled nodes in order, footers last."""
    return nodes.filter("kind IN ('p', 'cell', 'footer') AND trim(text) <> ''").select("doc_id", F.lit(0).alias("page"), F.col("ord").alias("line_no"), "text")


def unresolved_error(nodes: DataFrame) -> DataFrame:
    """doc_id, error for files with dynamic fields whose result isn't stored."""
    return nodes.filter("size(unresolved) > 0").groupBy("doc_id").agg(F.concat(F.lit("dynamic fields without a stored result: "), F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "unresolved"))), lambda x: x["unresolved"])), "; ")).alias("error"))


# ---- page-description files ---------------------------------------------------------------------------------------------
PDF_ROWS = "doc_id string, relation string, page int, seq long, ch string, x0 double, x1 double, top double, bottom double, name string, value string, size double, dx double, dy double, flag boolean"


def _pdf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PDF_ROWS.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in PDF_ROWS.split(", ")]
    for b in batches:
        for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                rows = list(PdfFile(c).rows())
            except Exception as e:  # noqa: BLE001 - whatever is wrong in a file is that file's row
                rows = [{"relation": "error", "value": f"{type(e).__name__}: {e}"}]
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(rows), t) if n == "doc_id" else pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)


def pdf_rows(docs: DataFrame) -> DataFrame:
    """All relations of the PDF files in one table; each is read out by the functions below."""
    return docs.filter(F.col("format") == PDF).select("doc_id", "content").mapInArrow(_pdf, PDF_ROWS)


def glyphs(rows: DataFrame) -> DataFrame:
    return rows.filter("relation = 'glyph'").select("doc_id", "page", "seq", nfc("ch").alias("ch"), "x0", "x1", "top", "bottom", F.col("name").alias("fontname"), "size", "dx", "dy")


def pages(rows: DataFrame) -> DataFrame:
    """doc_id, page, width, height, n_chars, image_area."""
    n = rows.filter("relation = 'glyph'").groupBy("doc_id", "page").agg(F.count(F.lit(1)).cast("int").alias("n_chars"))
    p = rows.filter("relation = 'page'").select("doc_id", "page", F.col("x1").alias("width"), F.col("bottom").alias("height"), F.col("size").alias("image_area"))
    return p.join(n, ["doc_id", "page"], "left").withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))


def fonts(rows: DataFrame) -> DataFrame:
    return rows.filter("relation = 'font'").select("doc_id", "page", F.col("name").alias("base_font"), F.col("flag").alias("has_tounicode"))


def annotations(rows: DataFrame) -> DataFrame:
    """doc_id, page, ord, kind (widget, link), name, value, x0, top, x1, bottom as the file has them."""
    return rows.filter("relation IN ('widget', 'link')").select("doc_id", "page", F.col("seq").alias("ord"), F.col("relation").alias("kind"), "name", "value", "x0", "top", "x1", "bottom")


def annotation_box(flip_height: Column | None = None) -> Column:
    """The corners of an annotation in order. The file's origin is at the bottom; with a page height the box is turned to the top."""
    top, bottom = F.least("top", "bottom"), F.greatest("top", "bottom")
    if flip_height is not None:
        top, bottom = flip_height - bottom, flip_height - top
    return F.struct(F.least("x0", "x1").alias("x0"), top.alias("top"), F.greatest("x0", "x1").alias("x1"), bottom.alias("bottom"))


def cell_boxes(rows: DataFrame) -> DataFrame:
    return rows.filter("relation = 'cell'").select("doc_id", "page", *[F.split_part("name", F.lit(" "), F.lit(i)).cast("int").alias(c) for i, c in enumerate(("table_no", "row_no", "col_no"), 1)], F.lit("lattice").alias("strategy"), "x0", "top", "x1", "bottom")


# ---- independent readers ------------------------------------------------------------------------------------------------


def _engine(name: str, suffix: str, command: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if shutil.which(command[0]) is None:
                    continue
                with tempfile.NamedTemporaryFile(suffix=suffix) as f:
                    f.write(c)
                    f.flush()
                    done = subprocess.run([f.name if x == "{}" else x for x in command], capture_output=True, check=False)
                if done.returncode == 0:
                    ids.append(d)
                    texts.append(done.stdout.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([name] * len(ids), pa.string()), pa.array(texts, pa.string())], ["doc_id", "engine", "text"])

    return read


def engine_texts(docs: DataFrame) -> DataFrame:
    """doc_id, engine, text by the programs that are installed (each task's own scratch files only)."""
    schema = "doc_id string, engine string, text string"
    pdf = docs.filter(F.col("format") == PDF).select("doc_id", "content").mapInArrow(_engine("poppler", ".pdf", ["pdftotext", "-layout", "{}", "-"]), schema)
    doc = docs.filter(F.col("format") == DOCX).select("doc_id", "content").mapInArrow(_engine("pandoc", ".docx", ["pandoc", "-f", "docx", "-t", "plain", "{}"]), schema)
    return pdf.unionByName(doc).unionByName(plain_docx_texts(docs))


def plain_docx_texts(docs: DataFrame) -> DataFrame:
    """doc_id, engine ``plain_xml``, text: a second reader of word-processor files, that looks at the text elements alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(c)) as z:
                        parts = [BODY, *sorted(n for n in z.namelist() if re.fullmatch(r"word/footer\d*\.xml", n))]
                        found = [m for p in parts for m in re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", z.read(p).decode("utf-8", "replace"))]
                except (zipfile.BadZipFile, KeyError, OSError):
                    continue
                ids.append(d)
                texts.append("".join(found).replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&apos;", "'").replace("&amp;", "&"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(["plain_xml"] * len(ids), pa.string()), pa.array(texts, pa.string())], ["doc_id", "engine", "text"])

    return docs.filter(F.col("format") == DOCX).select("doc_id", "content").mapInArrow(read, "doc_id string, engine string, text string")
