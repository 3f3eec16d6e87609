"""Small files for tests, made byte by byte."""

import io
import zipfile
import zlib

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, level=None, raw=""):
    props = f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/></w:numPr></w:pPr>' if level is not None else ""
    runs = "<w:r><w:tab/></w:r>".join(f'<w:r><w:t xml:space="preserve">{t}</w:t></w:r>' for t in text.split("\t"))
    return f"<w:p>{props}{runs}{raw}</w:p>"


def docx_table(rows):
    cell = lambda c: "".join(paragraph(x) for x in c.split("\n"))
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{cell(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def docx(body, footer=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {W}><w:body>{body}</w:body></w:document>')
        if footer:
            z.writestr("word/footer1.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:ftr {W}>{paragraph(footer)}</w:ftr>')
    return out.getvalue()


def pdf(lines, *, rulings=(), to_unicode=True, shadow=0.0, links=(), forms=(), image=None, watermark=None):
    """One A4 page; lines: (x, y from the top, size, text). Every character gets a code and, with ``to_unicode``, a table entry."""
    chars = sorted({c for _, _, _, t in lines for c in t} | set(watermark or ""))
    code = {c: i + 1 for i, c in enumerate(chars)}
    hexed = lambda t: "<" + "".join(f"{code[c]:04X}" for c in t) + ">"
    ops = []
    for x, y, size, text in lines:
        for d in (shadow, 0.0) if shadow else (0.0,):
            ops.append(f"BT /F1 {size} Tf 1 0 0 1 {x + d} {841.89 - y - d} Tm {hexed(text)} Tj ET")
    if watermark:
        ops.append(f"BT /F1 60 Tf 0.7071 0.7071 -0.7071 0.7071 100 100 Tm {hexed(watermark)} Tj ET")
    ops += [f"{a} {841.89 - b} m {c} {841.89 - d} l S" for a, b, c, d in rulings]
    if image:
        ops.append(f"q {image[0]} 0 0 {image[1]} 0 0 cm /I1 Do Q")
    cmap = "beginbfchar\n" + "\n".join(f"<{i:04X}> <{c.encode('utf-16-be').hex()}>" for c, i in code.items()) + "\nendbfchar"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        4: _stream("\n".join(ops).encode()),
        5: b"<< /Type /Font /Subtype /Type0 /BaseFont /ABCDEF+Test#20Sans /DescendantFonts [7 0 R]" + (b" /ToUnicode 6 0 R" if to_unicode else b"") + b" >>",
        6: _stream(cmap.encode()),
        7: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /ABCDEF+Test /DW 500 >>",
        8: b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /Length 1 >>\nstream\n0\nendstream",
    }
    notes = []
    for i, (url, r) in enumerate(links):
        objects[20 + i] = f"<< /Type /Annot /Subtype /Link /Rect [{' '.join(map(str, r))}] /A << /S /URI /URI ({url}) >> >>".encode()
        notes.append(20 + i)
    for i, (name, value) in enumerate(forms):
        objects[40 + i] = f"<< /Type /Annot /Subtype /Widget /FT /Tx /T ({name}) /V ({value}) /Rect [10 20 110 40] >>".encode()
        notes.append(40 + i)
    objects[3] = f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595.28 841.89] /Contents 4 0 R /Annots [{' '.join(f'{n} 0 R' for n in notes)}] /Resources << /Font << /F1 5 0 R >> /XObject << /I1 8 0 R >> >> >>".encode()
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in sorted(objects.items())) + b"trailer << /Root 1 0 R >>\n%%EOF"


def _stream(data):
    packed = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed)


BODY = [
    ("CHỨNG THƯ THẨM ĐỊNH GIÁ",),
    ("Số HĐ", "CONTRACT-900"),
    ("I. THÔNG TIN KHÁCH HÀNG",),
    ("Tên khách hàng", "ÔNG: NGƯỜI-900"),
    ("Địa chỉ", "PHỐ-900"),
    ("III. THÔNG TIN VỀ TÀI SẢN THẨM ĐỊNH GIÁ",),
    ("Loại hình tài sản", "Bất động sản."),
    ("IV. THỜI ĐIỂM THẨM ĐỊNH GIÁ: 06 tháng",),
    ("X. GIÁ TRỊ TÀI SẢN THẨM ĐỊNH GIÁ",),
]
ASSETS = [["STT", "Tên", "Diện tích", "Thành tiền"], ["1", "Lô A", "100", "1.000"], ["2", "Lô B", "200", "2.000"], ["Tổng cộng", "", "", "3.000"]]


def certificate_docx(**kw):
    body = "".join(paragraph(r[0] if len(r) == 1 else f"{r[0]}\t: {r[1]}") for r in BODY)
    return docx(body + docx_table(ASSETS) + docx_table([["Thẩm định viên về giá\nSố thẻ: 77\nTÊN A", "Giám đốc\nTÊN B"]]), footer="Trang 1/1", **kw)


def certificate_pdf(**kw):
    lines, y = [], 60.0
    for r in BODY:
        if len(r) == 1:
            lines.append((77, y, 12, r[0]))
        elif not any(b[0].startswith("I.") for b in BODY[: BODY.index(r)]):
            lines.append((77, y, 12, f"{r[0]}: {r[1]}"))  # before the first heading a gap parts columns
        else:
            lines += [(77, y, 12, r[0] + ":"), (198, y, 12, r[1])]
        y += 14
    y += 20
    xs, rulings = [77, 150, 330, 425, 545], []
    ys = [y + 22 * k for k in range(len(ASSETS) + 1)]
    for k, row in enumerate(ASSETS):
        lines += [(xs[c] + 3, ys[k] + 15, 12, t) for c, t in enumerate(row) if t]
    rulings = [(xs[0], v, xs[-1], v) for v in ys] + [(v, ys[0], v, ys[-1]) for v in xs]
    lines.append((77, 800, 10, "Trang 1/1"))
    return pdf(lines, rulings=rulings, **kw)
