from collections import Counter

from pyspark.sql import functions as F

from foliograph.operators import fonts, provenance, templates, verify

VALUE = "doc_id string, path string, value string, page int, bbox struct<x0:double,top:double,x1:double,bottom:double>, source_lines array<string>"
TEXT = "CHỨNG THƯ THẨM ĐỊNH GIÁ\nCUSTOMER-NAME-001 CUSTOMER-ADDRESS-001"


def verified(spark, rows, text=TEXT, glyphs=None):
    texts = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(text.split("\f"))], "doc_id string, page int, text string")
    df = spark.createDataFrame([("d", *r) for r in rows], VALUE)
    return {r.path: r.proof_level for r in provenance.verify(df, texts, glyphs).collect()}


def test_adversarial_values(spark):
    box = (0.0, 0.0, 5.0, 5.0)
    rows = [
        ("fake", "GIÁ TRỊ NÀY KHÔNG TỒN TẠI", 1, None, None), ("tampered", "CUSTOMER-NAME-999", 1, None, None), ("real", "CHỨNG THƯ THẨM ĐỊNH GIÁ", 1, None, None),
        ("misplaced", "CUSTOMER-ADDRESS-001", 1, box, None), ("empty", "", 1, None, None), ("null", None, 1, None, None), ("spaces", "CHỨNG  THƯ\nTHẨM", 1, None, None),
        ("split", "THẨM CUSTOMER-NAME-001", 1, None, ["THẨM", "CUSTOMER-NAME-001"]), ("badsplit", "THẨM CUSTOMER", 1, None, ["THẨM", "CUSTOMER-NAME-001"]),
    ]
    assert verified(spark, rows) == {"fake": None, "tampered": None, "real": 2, "misplaced": 2, "empty": None, "null": None, "spaces": 2, "split": 3, "badsplit": None}


def test_report_and_pages(spark):
    rows = [("a", "over the page", 1, None, None), ("b", "nowhere", 1, None, None)]
    assert verified(spark, rows, "it runs over\fthe page\fend") == {"a": 2, "b": None}
    texts = spark.createDataFrame([("d", 1, TEXT)], "doc_id string, page int, text string")
    r = provenance.report(provenance.verify(spark.createDataFrame([("d", "fake", "XYZ", 1, None, None)], VALUE), texts)).first()
    assert (r.ratio, r.unverified_paths) == (0.0, ["fake"])
    assert provenance.report(provenance.verify(spark.createDataFrame([], VALUE), texts)).count() == 0


def test_box_proof(spark):
    from tests.test_gates_glyphs import glyph_frame

    g = glyph_frame(spark, "AB CD", 100.0, 50.0)
    rows = [("in", "AB CD", 1, (100.0, 50.0, 130.0, 62.0), None), ("out", "AB CD", 1, (100.0, 50.0, 110.0, 62.0), None)]
    assert verified(spark, rows, "nothing here", g) == {"in": 1, "out": None}


def test_status_and_exit(spark):
    gates = spark.createDataFrame([("a", 0, None), ("b", 1, "x"), ("c", 2, "y"), ("c", 0, None)], "doc_id string, severity int, error string")
    assert {r.doc_id: r.status for r in provenance.status(gates).collect()} == {"a": "verified", "b": "needs_review", "c": "rejected"}
    assert provenance.exit_code(provenance.status(gates)).first().exit_code == 2
    assert provenance.exit_code(provenance.status(gates.limit(0))).first().exit_code == 2


def test_page_classes(spark):
    rows = [("t", 1, 100.0, 100.0, 500, 0.0), ("s", 1, 100.0, 100.0, 0, 9000.0), ("m", 1, 100.0, 100.0, 500, None), ("m", 2, 100.0, 100.0, 3, 5000.0), ("c", 1, 100.0, 100.0, 50, 9999.0)]
    out = {r.doc_id: r for r in fonts.page_classes(spark.createDataFrame(rows, "doc_id string, page int, width double, height double, n_chars int, image_area double")).collect()}
    assert {k: r.pdf_class for k, r in out.items()} == {"t": "text_layer", "s": "scanned", "m": "mixed", "c": "text_layer"}
    assert "100%" in out["s"].rejection and "2" in out["m"].rejection and out["t"].rejection is None


def test_font_audit(spark):
    f = spark.createDataFrame([("d", 1, "/ABCDEF+Good", True), ("d", 1, "Bad", True), ("d", 2, "Bad", False), ("d", 1, "Wingdings", False), ("d", 1, "Unused", False)], "doc_id string, page int, base_font string, has_tounicode boolean")
    g = spark.createDataFrame([("d", n) for n in ["good", "Bad", "GHIJKL+bad", "Wingdings", None]], "doc_id string, fontname string")
    r = fonts.font_audit(g, f).first()
    assert (r.total_fonts, r.fonts_with_tounicode, r.missing, r.affected_characters, r.declared_but_unused, r.is_complete) == (3, 1, ["Bad"], {"Bad": 2}, ["Unused"], False)


ENGINE = "doc_id string, engine string, text string"
BASE = "doc_id string, ord int, baseline string, text string"


def compare(spark, bases, engine):
    return verify.compare_engines(spark.createDataFrame([("d", i, n, t) for i, (n, t) in enumerate(bases)], BASE), spark.createDataFrame([("d", "e", engine)], ENGINE)).first()


def test_engines(spark):
    bases = [("raw", "SHADOWSHADOW"), ("deduplicated", "SHADOW")]
    assert compare(spark, bases, "SHADOWSHADOW").baseline == "raw"
    r = compare(spark, bases, "WODAHS ")
    assert (r.baseline, r.chars, r.char_multiset_match) == ("deduplicated", 6, True)
    r = compare(spark, bases, "SHADOX")
    assert (r.baseline, r.only_in_primary, r.only_in_engine, r.char_multiset_match) == ("none", {"W": 1}, {"X": 1}, False)
    assert compare(spark, [("raw", "ế")], "ế́").baseline == "raw+engine_extra_marks"
    assert compare(spark, [("raw", "a")], "á").baseline == "none"


def test_one_sided_and_coverage(spark):
    doc = spark.createDataFrame([("d", "abc")], "doc_id string, text string")
    e = lambda t: verify.compare_one_sided(doc, spark.createDataFrame([("d", "p", t)], ENGINE)).first()
    assert (e("ab-|+").char_multiset_match, e("abx").char_multiset_match, e("abx").baseline) == (True, False, "none")
    got = verify.uncovered(spark.createDataFrame([("d", "aab")], "doc_id string, text string"), doc).collect()
    assert [(r.ch, r.n) for r in got] == [("a", 1)]
    s = spark.createDataFrame([("abcd", "bcde")], "a string, b string").select(verify.reading_order_similarity("a", "b")).first()[0]
    assert abs(s - 0.75) < 1e-9


def test_top_ten_is_ten(spark):
    a = spark.createDataFrame([("d", chr(97 + i), 20 - i) for i in range(20)], "doc_id string, ch string, n long")
    top = verify.most_common(verify.multiset_difference(a, a.limit(0)), ["doc_id"], "only_a").first().only_a
    assert top == dict(Counter({chr(97 + i): 20 - i for i in range(20)}).most_common(10))


def test_templates(spark):
    t = spark.createDataFrame([("d", " ".join(templates.CERTIFICATE_PHRASES[:3]).replace(" ", "  ")), ("e", "CHỨNG THƯ"), ("f", None)], "doc_id string, text string")
    assert {r.doc_id: (r.template_id, round(r.score, 2)) for r in templates.detect(t).collect()} == {"d": ("chung_thu_tham_dinh_gia", 0.6), "e": (None, 0.0), "f": (None, 0.0)}
    labels = spark.createDataFrame([("", "Số HĐ:"), ("I", "Địa chỉ"), ("XI", "Thời hạn hiệu lực của chứng thư"), ("I", "Khác lạ"), ("I", None), ("I", "Địa chỉ")], "section string, label string")
    out = templates.field_names(labels, templates.name_table(labels, templates.CERTIFICATE)).collect()
    assert Counter((r.section, r.field_key) for r in out) == Counter({("", "contract_number"): 1, ("I", "customer_address"): 2, ("XI", "validity_duration"): 1, ("I", "khac_la"): 1, ("I", None): 1})
    people = spark.createDataFrame([("d", 0, ["Thẩm định viên về giá", "Số thẻ: 77", "TÊN A"]), ("d", 1, ["Giám đốc"])], "doc_id string, person int, lines array<string>")
    s = {r.person: (r.role, r.card_number, r.name) for r in templates.signature_entries(people).collect()}
    assert s == {0: ("valuer", "77", "TÊN A"), 1: ("director", None, None)}
    f = spark.createDataFrame([("d", "k", "A", "1", 1), ("d", "k", "B", "2", 2)], "doc_id string, field_key string, label string, value string, o int")
    r = templates.assembled(f, ["doc_id"], ["o"]).first()
    assert (r.value, r["at"].o) == ("2", 1)
    assert F is not None


def test_proof_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows, hay = [], {}
    for d in ("a", "b", "c"):
        pages = [" ".join("".join(rng.choices("ab.", k=rng.choice([1, 1, 2, 9]))) for _ in range(rng.choice([0, 1, 1, 2, 400]))) for _ in range(700)]
        rows += [(d, i, t) for i, t in enumerate(pages)]
        hay[d] = " ".join(t for t in pages if t)
    values = []
    for d, text in hay.items():
        for _ in range(150):
            n = rng.choice([1, 2, 3, 5, 6, 7, 11, 12, 13, 40, 700, 3000])
            i = rng.randrange(len(text) - n)
            v = text[i : i + n]
            if rng.random() < 0.5 and v.strip():
                k = rng.randrange(len(v))
                v = v[:k] + rng.choice("ab c.") + v[k + 1 :]
            if rng.random() < 0.3:
                v = v.replace(" ", "")
            values.append((d, f"p{len(values)}", v, 1, None, [v[: n // 2], v[n // 2 :]] if rng.random() < 0.6 else None))
    squeeze = lambda t: " ".join(t.split())
    tight = lambda t: "".join(t.split())
    want = {}
    for d, p, v, _, _, parts in values:
        level = None
        if tight(v):
            if tight(v) in tight(hay[d]):
                level = 2
            elif parts and all(squeeze(x) in hay[d] for x in parts) and tight("".join(parts)) == tight(v):
                level = 3
        want[p] = level
    assert set(want.values()) == {None, 2, 3}
    texts = spark.createDataFrame(rows, "doc_id string, page int, text string")
    out = provenance.verify(spark.createDataFrame(values, VALUE), texts).collect()
    assert {r.path: r.proof_level for r in out} == want
    lined = texts.selectExpr("doc_id", "0 AS page", "page AS line_no", "text")
    assert {r.path: r.proof_level for r in provenance.verify(spark.createDataFrame(values, VALUE), lined).collect()} == want


def test_a_value_over_many_pages(spark):
    text = "\f".join("abcdefghijklmnopqrstuvwxyz")
    rows = [("ten", "abcdefghij", 1, None, None), ("all", "a b c d e f g h i j k l m n o p q r s t u v w x y z", 1, None, None), ("no", "a b c d e f g h i j k l m n o p q r s t u v w x y y", 1, None, None), ("one", "q", 1, None, None), ("last", "y z", 1, None, None)]
    assert verified(spark, rows, text) == {"ten": 2, "all": 2, "no": None, "one": 2, "last": 2}


def test_more_than_a_thousand_prefixes(spark):
    from foliograph.operators.tables import labelled_totals

    rows = spark.createDataFrame([("d", 1, 0, 0, 2, ["Tong 1499 (dong)", "7"]), ("d", 1, 0, 1, 2, ["Khac: 5", ""])], "doc_id string, page int, table_no int, row_no int, n_cols int, cells array<string>")
    assert [tuple(r) for r in labelled_totals(rows, {f"tong {i} ": f"t{i}" for i in range(1500)}).collect()] == [("d", "t1499", "Tong 1499 (dong)", "7")]
    assert labelled_totals(rows, {}).count() == 0
