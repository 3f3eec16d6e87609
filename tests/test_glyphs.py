import random
import unicodedata

from pyspark.sql import functions as F

from foliograph.operators import glyphs as g
from foliograph.operators import lines as ln
from foliograph.operators import structure, tables

GLYPH = "doc_id string, page int, seq long, ch string, x0 double, x1 double, top double, bottom double, fontname string, size double, dx double, dy double"


def glyph(ch, x0, top, size=12.0, seq=0, page=1, doc="d", dx=1.0, dy=0.0, width=None):
    x0, top = float(x0), float(top)
    return (doc, page, seq, ch, x0, x0 + (0.5 * size if width is None else width), top, top + size, "F", size, dx, dy)


def frame(spark, rows):
    return spark.createDataFrame([(*r[:2], i if r[2] == 0 else r[2], *r[3:]) for i, r in enumerate(rows)], GLYPH)


def written(text, x=77.0, top=50.0, size=12.0, **kw):
    return [glyph(c, x + 0.5 * size * i, top, size, **kw) for i, c in enumerate(text)]


def kept(spark, rows):
    return sorted(r.seq for r in g.deduplicate(frame(spark, rows)).collect())


def test_duplicates_by_place_and_size(spark):
    assert len(kept(spark, [glyph("o", 100, 50), glyph("o", 106, 50)])) == 2
    assert len(kept(spark, [glyph("A", 100, 50), glyph("A", 100, 68)])) == 2
    assert len(kept(spark, [glyph("X", 100, 50, 24.0), glyph("X", 101.2, 50, 24.0)])) == 1
    assert len(kept(spark, [glyph("X", 100, 50, 6.0), glyph("X", 101.2, 50, 6.0)])) == 2
    assert kept(spark, [glyph("o", 10, 50, 10.0), glyph("o", 11.5, 50, 10.0), glyph("o", 13, 50, 10.0)]) == [0, 2]


def test_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    rows = [glyph(rng.choice("ab"), rng.uniform(0, 25), rng.uniform(0, 12), rng.choice([6.0, 12.0, 24.0])) for _ in range(300)]
    alive = []
    for i, r in enumerate(rows):
        tol = min(0.18 * r[9], 2.5)
        if not any(rows[k][3] == r[3] and abs(rows[k][4] - r[4]) <= tol and abs(rows[k][6] - r[6]) <= tol for k in alive):
            alive.append(i)
    assert kept(spark, rows) == alive


def test_shadow_report(spark):
    rows = written("SHADOW", x=77.6, top=49.4) + written("SHADOW")
    r = g.layer_report(g.duplicate_flags(frame(spark, rows))).first()
    assert (r.removed, r.pages_affected, r.has_duplicate_layer) == (6, [1], True)


def test_marks_fold_across_chunks(spark):
    text = "Tối ậñ"
    rows = [glyph(c, 6.0 * i, 50) for i, c in enumerate(unicodedata.normalize("NFD", text))]
    for chunk in (2, 3, 1000):
        out = g.fold_combining_marks(frame(spark, rows), chunk).orderBy("seq").collect()
        assert "".join(r.ch for r in out) == unicodedata.normalize("NFC", text)
    lone = g.fold_combining_marks(frame(spark, [glyph("́", 0, 0), glyph("́", 1, 0), glyph("a", 6, 0)])).orderBy("seq").collect()
    assert [r.ch for r in lone] == ["́́", "a"]


def test_overlay_and_median(spark):
    df = frame(spark, written("body text") + written("XX", size=60.0))
    assert g.overlay_flags(df).filter("overlay").count() == 2
    assert g.overlay_flags(df.limit(0)).count() == 0


def brute_lines(rows):
    """The rule glyph by glyph, on upright glyphs."""
    import statistics

    rows = sorted(rows, key=lambda r: (r[6], r[4]))
    near = 0.3 * statistics.median([r[9] for r in rows])
    buckets = []
    for r in rows:
        for b in buckets:
            a = b["anchor"]
            over = min(a[7], r[7]) - max(a[6], r[6])
            if abs((a[6] + a[7]) / 2 - (r[6] + r[7]) / 2) <= near or over > 0 and over / min(a[7] - a[6], r[7] - r[6]) >= 0.35:
                b["all"].append(r)
                if r[9] > a[9]:
                    b["anchor"] = r
                break
        else:
            buckets.append({"anchor": r, "all": [r]})
    return sorted("".join(r[3] for r in sorted(b["all"], key=lambda r: r[4])) for b in buckets)


def test_lines_against_brute_force(spark):
    rng = random.Random(9)
    rows = [glyph(rng.choice("abcdef"), rng.uniform(0, 500), rng.uniform(0, 60), rng.choice([6.0, 9.0, 12.0, 20.0])) for _ in range(200)]
    out = ln.group_lines(frame(spark, rows)).collect()
    assert sorted(r.text for r in out) == brute_lines([(*r[:2], i, *r[3:]) for i, r in enumerate(rows)])
    assert [r.line_no for r in sorted(out, key=lambda r: (r.top, r.x0))] == list(range(len(out)))


def test_superscript_stays_and_rotation_reads_up(spark):
    rows = [*written("m"), glyph("2", 83, 48, 7.0)] + [glyph(c, 300, 200 - 8.0 * i, dx=0.0, dy=1.0) for i, c in enumerate("STT")]
    assert sorted(r.text for r in ln.group_lines(frame(spark, rows)).collect()) == ["STT", "m2"]


def test_repeated_and_null_rows(spark):
    rows = written("ab") + written("ab")[:1]
    rows = [(*r[:2], i % 2, *r[3:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame([*rows, ("d", 1, 9, None, None, None, None, None, None, None, None, None)], GLYPH)
    assert [r.text for r in ln.group_lines(df).collect()] == ["ab"]
    assert g.duplicate_flags(df.distinct()).count() == 3


def test_segments_and_columns(spark):
    rows = written("Số: 1") + written("Ngày: 2", x=200.0)
    line = ln.with_columns(ln.group_lines(frame(spark, rows)).withColumn("s", F.transform(ln.segments(), ln.text_of))).withColumn("c", F.transform("columns", ln.text_of)).first()
    assert line.s == ["Số: 1", "Ngày: 2"] == line.c
    gap = ln.with_columns(ln.group_lines(frame(spark, written("a   b c")))).select(F.transform("columns", ln.text_of).alias("c")).first()
    assert gap.c == ["a", "b c"]


def parsed(spark, rows):
    l = ln.group_lines(frame(spark, rows))  # noqa: E741
    parts = structure.sectioned(l)
    blocks = parts.filter("part IN ('preface', 'body')")
    e = structure.entries(blocks, structure.line_roles(blocks, structure.sections(parts).filter("inline_value IS NOT NULL")))
    return parts, [(r.section_no, r.kind, r.label, r.value) for r in e.orderBy("section_no", "page", "line_no", "k").collect()]


def test_structure(spark):
    text = [(77, "Mở đầu"), (77, "I. KHÁCH HÀNG"), (77, "Địa chỉ:"), (77, "- Một mục"), (77, "II. HẠN: 06 tháng"), (77, "kể từ ngày"), (77, "Trang 1/2")]
    rows = [r for k, (x, t) in enumerate(text) for r in written(t, x=x, top=50 + 13.0 * k)]
    rows += [r for r in written("PHỐ 9", x=198.0, top=76.0)]
    parts, e = parsed(spark, rows)
    assert [(r.number, r.title, r.inline_value) for r in structure.sections(parts).orderBy("section_no").collect()] == [("I", "KHÁCH HÀNG", None), ("II", "HẠN", "06 tháng")]
    assert (0, "paragraph", None, "Mở đầu") in e
    assert any(x[:3] == (1, "field", "Địa chỉ") and x[3].startswith("PHỐ 9") for x in e)
    assert any(x[1] == "item" or x[2] == "Một mục" or x[3] and "Một mục" in x[3] for x in e)
    assert any(x[1] == "inline" and x[3] == "kể từ ngày" for x in e)


def test_continuations(spark):
    rows = written("Địa chỉ:", top=50.0) + written("PHỐ", x=198.0, top=50.0) + written("QUẬN", x=198.0, top=63.0) + written("liên hệ", x=77.0, top=76.0) + written("xa", x=400.0, top=89.0)
    _, e = parsed(spark, rows)
    assert e == [(0, "field", "Địa chỉ liên hệ", "PHỐ QUẬN"), (0, "paragraph", None, "xa")]


def test_several_fields_on_a_line(spark):
    rows = written("Số: 1", top=50.0) + written("Ngày: 2", x=200.0, top=50.0)
    _, e = parsed(spark, rows)
    assert e == [(0, "field", "Số", "1"), (0, "field", "Ngày", "2")]


def test_signatures(spark):
    rows = written("I. MỘT", top=50.0) + [r for k, (a, b) in enumerate([("Giám đốc", "Kế toán"), ("A", "B")]) for r in written(a, x=150.0, top=80.0 + 14 * k) + written(b, x=350.0, top=80.0 + 14 * k)]
    parts, _ = parsed(spark, rows)
    people = structure.signature_columns(parts).orderBy("person", "line_no").collect()
    assert [(r.person, r.value) for r in people] == [(0, "Giám đốc"), (0, "A"), (1, "Kế toán"), (1, "B")]


def test_cells_and_merging(spark):
    rows = written("1.23", x=80.0, top=50.0) + written("4", x=80.0, top=64.0) + [glyph(c, 150, 90 - 8.0 * i, dx=0.0, dy=1.0) for i, c in enumerate("ab")]
    boxes = spark.createDataFrame([("d", 1, 0, 0, 0, "lattice", 75.0, 45.0, 140.0, 100.0), ("d", 1, 0, 0, 1, "lattice", 140.0, 45.0, 200.0, 110.0), ("d", 1, 0, 0, 2, "lattice", None, None, None, None)], "doc_id string, page int, table_no int, row_no int, col_no int, strategy string, x0 double, top double, x1 double, bottom double")
    out = tables.cells(frame(spark, rows), boxes).orderBy("col_no").collect()
    assert [(r.value, r.lines) for r in out] == [("1.234", ["1.23", "4"]), ("ab", ["ab"]), ("", [])]
    t = spark.createDataFrame([("d", p, k, n) for p, k, n in [(1, 0, 4), (2, 0, 4), (3, 0, 4), (5, 0, 4), (6, 0, 1), (7, 0, 1)]], "doc_id string, page int, table_no int, n_cols int")
    merged = {(r.page, r.table_no): (r.merged_page, r.merged_table) for r in tables.merge_continued(t).collect()}
    assert merged == {(1, 0): (1, 0), (2, 0): (1, 0), (3, 0): (3, 0), (5, 0): (5, 0), (6, 0): (6, 0), (7, 0): (7, 0)}


def test_lookup_by_label(spark):
    from foliograph.operators import labels

    rows = written("Mở", top=30.0) + written("Địa  chỉ: PHỐ 9", top=50.0) + written("quận 1", top=64.0) + written("- mục", top=78.0) + written("Hạn", top=95.0) + written("06 tháng", x=300.0, top=95.0)
    l = ln.group_lines(frame(spark, rows))  # noqa: E741
    assert [r.value for r in labels.value_after(l, "địa chỉ").collect()] == ["PHỐ 9"]
    assert [r.value for r in labels.value_after(l, "Địa chỉ", multiline=True).collect()] == ["PHỐ 9 quận 1"]
    assert [r.value for r in labels.value_after(l, "Hạn").collect()] == ["06 tháng"]
    assert [r.value for r in labels.segment_with(l, "địa chỉ").collect()] == ["Địa chỉ: PHỐ 9"]
    assert labels.first_line_with(l, "hạn").first().line_no == 4 and labels.value_after(l, "không có").count() == 0
