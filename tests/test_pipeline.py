import json

import pytest

from foliograph.plans.pipeline import process
from foliograph.sources import documents as src
from foliograph.sources.pdf import PdfFile
from foliograph.sources.results import key_step, markdown, steps
from tests.builders import certificate_docx, certificate_pdf, docx, paragraph, pdf


def test_pdf_decoder():
    rows = list(PdfFile(pdf([(77, 60, 12, "Đất m²")], rulings=[(10, 10, 50, 10), (10, 30, 50, 30), (10, 10, 10, 30), (50, 10, 50, 30), (30, 10, 30, 30)], links=[("https://a.example", (1, 2, 3, 4))], forms=[("so", "V")], image=(500, 800))).rows())
    g = [r for r in rows if r["relation"] == "glyph"]
    assert "".join(r["ch"] for r in g) == "Đất m²"
    assert abs(g[0]["x0"] - 77) < 1e-6 and abs(g[0]["bottom"] - 62.64) < 0.01 and g[0]["size"] == 12 and g[0]["dy"] == 0
    assert [r["name"] for r in rows if r["relation"] == "cell"] == ["0 0 0", "0 0 1"]
    assert {(r["relation"], r["value"]) for r in rows if r["relation"] in ("link", "widget")} == {("link", "https://a.example"), ("widget", "V")}
    assert [r["size"] for r in rows if r["relation"] == "page"] == [400000.0]
    assert [(r["name"], r["flag"]) for r in rows if r["relation"] == "font"] == [("ABCDEF+Test Sans", True)]


def test_docx_reader():
    field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
    rows = src.docx_rows(docx(paragraph("") + paragraph("a\tb", level=1) + paragraph("c", raw=field)))
    assert [(r["text"], r["location"], r.get("list_level")) for r in rows] == [("a b", "body/p[2]", 1), ("c", "body/p[3]", None)]
    assert rows[1]["unresolved"] == ["body/p[3]: PAGE"]
    begin, end = ('<w:r><w:fldChar w:fldCharType="%s"/></w:r>' % k for k in ("begin", "end"))
    blank, nothing = f'{begin}<w:r><w:t xml:space="preserve"> </w:t></w:r>{end}', begin + end
    numbered = '<w:p><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>x</w:t></w:r></w:p>'
    rows = src.docx_rows(docx(paragraph("a", raw=blank) + paragraph("b", raw=nothing) + numbered))
    assert [(r["unresolved"], r.get("list_level")) for r in rows] == [([], None), (["body/p[2]: ?"], None), ([], None)]


def test_paths(spark):
    assert steps('sections.I.fields."a.b"[2].c') == ["sections", "I", "fields", "a.b", 2, "c"]
    df = spark.createDataFrame([("a.b",), ("plain",), ('q"x',)], "k string")
    assert [steps(r[0]) for r in df.select(key_step(df.k)).collect()] == [["a.b"], ["plain"], ['q"x']]


@pytest.fixture(scope="module")
def outcome(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    files = {
        "a.docx": certificate_docx(), "b.pdf": certificate_pdf(links=[("https://x.example/900", (1, 2, 3, 4))], forms=[("so_to", "MAP-1")], watermark="BAN SAO"),
        "shadow.PDF": certificate_pdf(shadow=0.6), "fonts.pdf": certificate_pdf(to_unicode=False), "scan.pdf": pdf([(77, 60, 12, "x")], image=(590, 840)), "bad.pdf": b"nothing", "again.pdf": b"nothing", "other.docx": docx(paragraph("Thư từ")),
    }
    for name, content in files.items():
        (d / name).write_bytes(content)
    # A handful of rows through a large plan: compiling it is most of the time, so it is interpreted here.
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    done = process(spark, src.document_files(spark, str(d)))
    out = {r.file: (r.status, json.loads(r.json)) for r in done.results.collect()}
    return out


def test_statuses(outcome):
    assert {k: v[0] for k, v in outcome.items()} == {"a.docx": "verified", "b.pdf": "verified", "shadow.PDF": "verified", "fonts.pdf": "rejected", "scan.pdf": "rejected", "bad.pdf": "rejected", "again.pdf": "rejected", "other.docx": "rejected"}
    assert "100%" in " ".join(outcome["scan.pdf"][1]["errors"]) and "DOCX" in outcome["bad.pdf"][1]["errors"][0]


def said(result):
    d = result["data"]
    fields = {(s, k): f["value"] for s, b in [("", d["preface"]), *d["sections"].items()] for k, f in b["fields"].items()}
    table = d["sections"]["X"]["table"]
    rows = [(r["index"], r["description"]["value"], r["area_sqm"]["value"], r["amount_vnd"]["value"]) for r in table["rows"]]
    return fields, rows, table["totals"]["total"]["value"], list(d["sections"]), [f["value"] for f in d["page_footers"]]


def test_formats_and_variants_agree(outcome):
    want = ({("", "contract_number"): "CONTRACT-900", ("I", "customer_name"): "ÔNG: NGƯỜI-900", ("I", "customer_address"): "PHỐ-900", ("III", "asset_type"): "Bất động sản."}, [(1, "Lô A", "100", "1.000"), (2, "Lô B", "200", "2.000")], "3.000", ["I", "III", "IV", "X"], ["Trang 1/1"])
    for f in ("a.docx", "b.pdf", "shadow.PDF"):
        assert said(outcome[f][1]) == want
    pdf_, word = outcome["b.pdf"][1], outcome["a.docx"][1]
    assert pdf_["data"]["hyperlinks"][0]["value"] == "https://x.example/900" and pdf_["data"]["form_fields"]["so_to"]["value"] == "MAP-1"
    assert pdf_["verification"]["provenance"]["ratio"] == 1.0 and "BAN SAO" not in json.dumps(pdf_["data"]["sections"])
    assert outcome["shadow.PDF"][1]["verification"]["glyph_layers"]["removed"] > 0
    assert word["verification"]["pdf_class"] is None and word["verification"]["font_audit"] is None
    assert word["data"]["signatures"][0]["card_number"]["value"] == "77" and word["data"]["sections"]["IV"]["value"]["value"] == "06 tháng"


def test_markdown(outcome):
    text = markdown("a.docx", outcome["a.docx"][1])
    assert text.startswith("# a.docx\n\n_Đã đọc") and "## I. THÔNG TIN KHÁCH HÀNG" in text and "| STT | Tên | Diện tích | Thành tiền |" in text and "**Tổng cộng:** 3.000" in text
    assert "Trạng thái: rejected" in markdown("bad.pdf", outcome["bad.pdf"][1])
