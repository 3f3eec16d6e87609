import random
import unicodedata

from foliograph.llm.disguise import glyph_cases, ordinary, plain, repaired, repairs, term_cases, words_of
from foliograph.llm.encoding import ENCODINGS, damaged_spans, explained, garbled, mistaken, regained, wrongly
from tests.test_glyphs import GLYPH, frame, glyph
from tests.test_glyphs import written as line_of


def test_ordinary_forms():
    assert plain("ｆｉ​x ﬁ \U0001d5a0") == "fix fi A"
    assert ordinary("²") == "²" and ordinary("…") == "…" and plain("Ⅱ") == "II"
    assert plain(unicodedata.normalize("NFD", "Thụy")) == "Thụy"


def test_repairs_only_mixed_tokens():
    assert repairs("сhiếu") == ["chiếu"] and "Được" in repairs("Ðược")
    assert repairs("сор") == [] and repairs("Смежный") == [] and repairs("chiếu") == []
    assert "участок" in repairs("учаcток")
    assert repaired("Рhường Нạ", words_of(["Phường Hạ"])) == "Phường Hạ"
    assert repaired("Рhường Нạ", words_of(["Phường"])) == "Phường Нạ"


def test_term_cases(spark):
    terms = spark.createDataFrame([("label", 1, "Lô 01"), ("label", 2, "Lô O1"), ("label", 3, "Diện tích (m²)"), ("label", 4, "Diện tích (m2)"), ("value", 5, "Office"), ("label", 9, None)], "kind string, term_id long, term string")
    shown = {1: "Lô 01", 2: "Lô О1", 3: unicodedata.normalize("NFD", "Diện tích (m²)"), 4: "Ｄiện tích (m2)", 5: "Oﬃce", 6: "Lô 01", 7: "lô 01", 8: None, 9: "", 10: "Lô  01​"}
    rows = [("claims", "value" if i == 5 else "label", i, t) for i, t in shown.items()] * 2
    texts = spark.createDataFrame(rows, "source_field string, kind string, row_id long, text string")
    assert {(r.row_id, r.term_id) for r in term_cases(texts, terms).collect()} == {(i, i) for i in range(1, 6)}
    assert term_cases(texts.limit(0), terms).count() == 0


def line(text, page, y, seq, doc="d"):
    out = []
    for i, c in enumerate(text):
        out.append(glyph(c, 77 + 6.0 * i, y, seq=seq + i, page=page, doc=doc))
    return out


def test_glyph_cases(spark):
    clean = ["Phần đất thuộc khu", "Người đo: Hesk", "Смежный участок", "Đơn giá m²"]
    rows, seq, want = [], 1, set()
    for k, t in enumerate(clean * 2):
        rows += line(t, 1, 40.0 + 20 * k, seq)
        seq += 50
    for k, (t, at) in enumerate([("Рhần đất", {0}), ("Người đo", {5}), ("Ｈesk", {0}), ("Phần đát", {3, 8}), ("Ðơn giá", {0}), ("учаcток", {3}), ("x​y", {1}), ("Pháº§n", set()), ("giÃ\xa0y", set())]):
        rows += line(t, 2, 40.0 + 20 * k, seq)
        want |= {seq + i for i in at}
        seq += 50
    rows.append(glyph("e\u0302\u0301", 500.0, 700.0, seq=seq, page=2))
    want.add(seq)
    df = spark.createDataFrame(rows + rows[:30], GLYPH)
    assert {r.seq for r in glyph_cases(df).collect()} == want
    assert glyph_cases(df.limit(0)).count() == 0


def test_wrong_decodings_come_back():
    text = "Đường dẫn vào: Thượng Kiều – m²"
    for e in ENCODINGS:
        assert regained(wrongly(text, e), e) == text
        assert f"utf8>{e}" in explained(wrongly("ườ", e), "ườ")
    for sound in ("Ô ĐẤT SỐ ÂÊÔƯ", "AVALIAÇÃO DE IMÓVEIS: SÃO", "Œuvre: l’îlot n° 12 «Nord»", "Kaufpreis £ 40 ± 2 §5", "Площадь участка", "沙洲宋体", "Þinglýst eign, síða 3 ©", "Сёла"):
        assert damaged_spans(sound) == []
    assert damaged_spans("x� y") == [(1, 2)]
    twice = wrongly(wrongly("quyển Ø", "cp1252"), "cp1252")
    assert {i for a, z in damaged_spans(twice) for i in range(a, z)} == {i for i, c in enumerate(twice) if c > "\x7f"}


def test_learning_on_held_out_lines(spark):
    """Encodings and letters are learned from twins of common lines, and applied to lines without a twin."""
    rng = random.Random(1)
    common = ["Phần đất thuộc khu", "Người đo", "Giá trị còn lại", "Đường dẫn vào", "đã đối chiếu", "Số quyển", "Chủ sở hữu", "Tổ khảo sát xác nhận hai bản gốc"]
    tcvn = {"ầ": "Ç", "ấ": "Ê", "đ": "®", "ộ": "é", "ư": "\xad", "ờ": "ê", "ã": "·", "á": "¸", "ả": "¶", "ủ": "ñ", "ở": "ë", "à": "µ", "ậ": "Ë", "ị": "Þ", "ố": "è", "ợ": "î", "ô": "«", "ế": "Õ", "ò": "ß", "ạ": "¹", "ể": "Ó", "Đ": "§", "ẫ": "É", "ữ": "÷", "ổ": "æ"}
    rare = ["Nghĩa Quán", "Lạc Thịnh", "Doãn Bích Đoan"]
    rows, seq, want, y = [], 1, set(), 0
    for k in range(240):
        t = rng.choice(rare) if k % 12 == 0 else rng.choice(common)
        kind = [None, None, "cp1252", "mac_roman", None, "tcvn", "lost"][k % 7]
        g = "".join(tcvn.get(c, c) for c in t) if kind == "tcvn" else "".join("�" if ord(c) > 127 else c for c in t) if kind == "lost" else wrongly(t, kind) if kind else t
        if kind == "tcvn" and any(ord(c) > 255 for c in g):
            g, kind = t, None
        rows += line(g, 1 + k // 30, 40.0 + 20 * (k % 30), seq)
        if kind:
            want |= {str(seq + i) for i, c in enumerate(g) if ord(c) > 127}
        seq += 100
        y += 1
    names = ["Mực Tím"] * 5 + [wrongly("Mực Tím", "cp1252"), "Søborg", "Í`"]
    fonts = spark.createDataFrame([(f"d{i}", 1, n, True) for i, n in enumerate(names)], "doc_id string, page int, base_font string, has_tounicode boolean")
    audits = spark.createDataFrame([("d1", [wrongly("Mực Tím", "cp1252"), None, "Mực Tím"], {wrongly("Søborg", "mac_roman"): 3}), ("d2", None, None), ("d3", [], {})], "doc_id string, missing array<string>, affected_characters map<string,int>")
    out = garbled(spark.createDataFrame(rows + rows[:40], GLYPH), fonts, audits).collect()
    got = {r.item for r in out if r.source_field == "ch"}
    assert len(want - got) <= 0.03 * len(want) and not got - want
    assert {(r.source_field, r.doc_id, r.original) for r in out if r.source_field != "ch"} >= {("fontname", "d5", "Mực Tím"), ("missing", "d1", "Mực Tím"), ("affected_characters", "d1", "Søborg")}
    none = spark.createDataFrame([], GLYPH)
    assert garbled(none, fonts.limit(0), audits.limit(0)).count() == 0


TCVN = {"ế": "Õ", "ậ": "Ë", "ố": "è", "ể": "Ó", "đ": "®", "ầ": "Ç", "ấ": "Ê", "ị": "Þ", "ộ": "é", "ả": "¶"}


def written(texts, seq=1):
    rows = []
    for k, t in enumerate(texts):
        rows += line(t, 1 + k // 30, 40.0 + 20 * (k % 30), seq)
        seq += 100
    return rows


def test_old_font_lines_without_a_symbol(spark):
    """Letters learned from lines with symbols find the lines whose letters are all ordinary ones."""
    old = lambda t: "".join(TCVN.get(c, c) for c in t)
    clean = ["Kết luận", "Số quyển", "Phần đất kết luận số quyển"]
    texts = clean * 4 + [old(clean[2])] * 2 + [old("Kết luận") + " ..... 1000", old("Số quyển"), "Conférence ..... 1000", "Évêché: thèse"]
    rows = written(texts)
    none = spark.createDataFrame([], "doc_id string, page int, base_font string, has_tounicode boolean")
    audits = spark.createDataFrame([], "doc_id string, missing array<string>, affected_characters map<string,int>")
    got = {(r.item, r.original) for r in garbled(spark.createDataFrame(rows, GLYPH), none, audits).collect()}
    want = {(str(1 + 100 * k + i), y) for k, y in [(12, clean[2]), (13, clean[2]), (14, "Kết luận ..... 1000"), (15, "Số quyển")] for i, c in enumerate(texts[k]) if c > "\x7f"}
    assert got == want


def test_names_of_several_bytes_a_character(spark):
    """Bytes that become ASCII letters don't part a name from its twin; figures and the subset prefix stay as they are."""
    clean = ["霧島ゴシック", "明朝体ソフト 12", "標楷體", "微软雅黑", "新細明體", "Ｓ光明体"]
    wrong = [mistaken(clean[0], "shift_jis", "cp1252"), mistaken(clean[1], "shift_jis", "cp1252"), mistaken(clean[2], "big5", "cp1252"), mistaken(clean[3], "gb18030", "latin_1"), mistaken(clean[4], "big5", "cp1252")]
    assert any(c.isascii() and c.isalpha() for c in wrong[0])
    items = clean * 2 + ["ABCDEF+" + wrong[0], *wrong[1:], "Søborg"]
    fonts = spark.createDataFrame([(f"d{i}", 1, n, True) for i, n in enumerate(items)], "doc_id string, page int, base_font string, has_tounicode boolean")
    audits = spark.createDataFrame([], "doc_id string, missing array<string>, affected_characters map<string,int>")
    got = {(r.item, r.original) for r in garbled(spark.createDataFrame([], GLYPH), fonts, audits).collect()}
    assert got == {("ABCDEF+" + wrong[0], "ABCDEF+" + clean[0]), *zip(wrong[1:], clean[1:5], strict=True)}


def test_any_number_of_twins_of_one_skeleton(spark):
    """Texts without ASCII share one skeleton: each meets its twin all the same, in names and in lines."""
    clean = ["Газета", "Лазурский", "Обыкновенная", "Журнальная", "Петербург", "Академия", "Футура"]
    wrong = [mistaken(c, "cp1251", "cp1252") for c in clean]
    fonts = spark.createDataFrame([(f"d{i}", 1, n, True) for i, n in enumerate(clean * 2 + wrong)], "doc_id string, page int, base_font string, has_tounicode boolean")
    audits = spark.createDataFrame([], "doc_id string, missing array<string>, affected_characters map<string,int>")
    sjis = mistaken("霧島ゴシック", "shift_jis", "cp1252")
    texts = ["霧島ゴシック: 12"] * 3 + [f"{c} {n}" for c in clean for n in (1, 2)] + [f"{w} 3" for w in wrong] + [f"{sjis}: 500"]
    out = garbled(spark.createDataFrame(written(texts), GLYPH), fonts, audits).collect()
    assert {(r.item, r.original) for r in out if r.source_field == "fontname"} == set(zip(wrong, clean, strict=True))
    want = {(str(1 + 100 * (17 + k) + i), f"{c} 3") for k, c in enumerate(clean) for i in range(len(c))}
    want |= {(str(1 + 100 * 24 + i), "霧島ゴシック: 500") for i in range(len(sjis))}
    assert {(r.item, r.original) for r in out if r.source_field == "ch"} == want


def test_a_line_over_many_chunks_is_seen_whole(spark):
    from foliograph.llm.disguise import glyph_cases
    from foliograph.llm.encoding import line_records

    text = "xin Vinh chào " * 30 + "Вinh ﻿" + "đất " * 40
    rows = line_of(text, x=10.0)
    df = frame(spark, rows)
    whole = glyph_cases(df).collect()
    assert whole
    for chunk, pad in ((64, 4), (16, 1)):
        assert sorted(r.seq for r in glyph_cases(df, chunk, pad).collect()) == sorted(r.seq for r in whole)
        found = line_records(df, chunk, pad)
        assert {r.text for r in found.collect()} == {r.text for r in line_records(df).collect()}
        assert sorted(s for r in found.collect() for s in set(r.seqs)) == sorted(s for r in line_records(df).collect() for s in set(r.seqs))


def test_many_texts_of_one_key(spark):
    from foliograph.llm.encoding import learned

    df = spark.range(30_000).selectExpr("'line' AS kind", "concat(char(int(1072 + id % 32)), char(int(1072 + id / 32 % 32)), char(int(1072 + id / 1024 % 32)), char(int(1072 + id / 32768)), 'я') AS text")
    model, twins, lettered = learned(df)
    assert model.encodings == () and twins.count() == 0 and lettered.count() == 0


def test_every_clean_side_of_a_skeleton_votes(spark):
    """However many more frequent texts share its skeleton, a garbled text's twin tells of its encoding, its letters and its script."""
    from foliograph.llm.encoding import learned

    frequent = ["Газета", "Лазурский", "Обыкновенная", "Журнальная", "Петербург"]
    letters = ["ấxấ", "ấxấấ", "ấấxấấ", "ấấấxấ", "ấấấxấấ"]
    texts = [t for t in frequent + letters for _ in range(9)] + ["Футура", "ậđxế", "ตัวอักษร"] * 2 + [wrongly("Футура", "koi8_r"), "Ë®xÕ"]
    model, _, _ = learned(spark.createDataFrame([("line", t) for t in texts], "kind string, text string"))
    assert model.encodings == ("koi8_r",) and model.letters == {"Ë": "ậ", "®": "đ", "Õ": "ế"} and "Thai" in model.repertoire


def test_votes_are_those_of_all_pairs(spark):
    """The votes by equi-joins are those of every text with every clean side of its skeleton."""
    from collections import Counter

    from foliograph.llm.encoding import VOTE, _letter_votes, _utf8_votes, aligned, legacy_line

    rng = random.Random(3)
    pool = ["a", " ", "ế", "đ", "é", "®", "Õ", "𝕏", wrongly("ế", "cp1252"), wrongly("đ", "koi8_r"), wrongly(wrongly("đ", "cp1252"), "cp1252")]
    texts = {"".join(rng.choice(pool[: 8 if k % 2 else 11]) for _ in range(rng.randint(1, 6))): rng.randint(1, 4) for k in range(900)}
    texts = {t: n for t, n in texts.items() if not t.isascii()}
    key = {t: "".join(c for c in t if c < "\x80") for t in texts}
    utf8, letter = Counter(), Counter()
    for g in texts:
        sides = [c for c in texts if key[c] == key[g] and c != g and texts[c] >= texts[g] and not damaged_spans(c)]
        for c in sides:
            for x, y in aligned(g, c):
                if names := explained(x, y):
                    utf8["|".join(names)] += len(y)
        if legacy_line(g):
            twins = [c for c in sides if not legacy_line(c) and (p := aligned(g, c)) and all(len(x) == len(y) for x, y in p)]
            for c in twins:
                letter.update({k: VOTE // len(twins) * n for k, n in Counter(pq for x, y in aligned(g, c, equal=True) for pq in zip(x, y, strict=True)).items()})
    keyed = spark.createDataFrame([(t, n, key[t]) for t, n in texts.items()], "part string, count long, key string")
    assert len(utf8) >= 3 and {r.name: r.n for r in _utf8_votes(keyed).collect()} == utf8
    old = keyed.filter(keyed.part.isin([t for t in texts if legacy_line(t)]))
    assert len(letter) >= 9 and {(r.p, r.q): int(r.n) for r in _letter_votes(keyed, old).collect()} == letter
