import pytest

from foliograph.llm.sentences import sentence_units, sentences

CASES = {
    "vi": [["TS. Quách Đoan và ThS. Mẫn Khải ký tại Q. 6, TP. Phù Bình."], ["Phí 35.593.000 đ."], ["Theo Đ. 44 k. 5, giá giữ nguyên."], ["Có sân, v.v."], ["Người kiểm tra ghi: \"Mốc bị dời. Cần đo lại.\" rồi trả lại hồ sơ."], ["“Ai đã ký? Không rõ.”"], ["Đó là ghi chú."]],
    "en": [["Mr. Orvell of the U.S. office met K. H. Hesk at 9 a.m. on Oct. 5, 2024."], ["The buyer is Hesk & Tallowin Ltd."], ["Was it sealed in time?!"], ["It keeps (room 3, cf. Fig. 2.) the file."], ["See https://a.example/f?id=7.2 for No. 36."], ["\"When does it lapse?\""], ["That was all."], ["A factor applies ... and to no others."]],
    "de": [["„Wer hat unterschrieben? Niemand weiß es.“"], ["So steht es im Protokoll."], ["Der Prüfer schrieb: „Bitte neu messen. Danach vorlegen.“ und ging."], ["Gem. Abs. 2 Nr. 4 gilt es, z. B. am 7. März im 2. Stock."], ["Zum Bestand gehören Zäune usw."], ["Dipl.-Ing. Kolvane kam."]],
    "fr": [["M. le notaire et Mme Orvell ont vu la p. 14."], ["L'avis expire le 8 janv. 2024 !"], ["« Qui a signé ? Personne ne sait. »"], ["Voilà la note."], ["Il écrit : « À revoir. Puis finir. » avant de partir."]],
    "ru": [["Отчёт составлен 6 сент. 2024 г. и подшит в дело."], ["инж. Велкин указал 5 тыс. руб."], ["г-н Тальмин стоит на ул. Ветловой, д. 14."], ["«Кто подписал? Неизвестно.» — так записано."]],
    "hi": [["क्षेत्रफल 430 वर्ग मी. है।"], ["श्री ने रु. 61 बताया।"], ["उसने लिखा: \"किसने? पता नहीं।\" और गया।"]],
    "ar": [["أكد م. ماهر القصب ذلك."], ["كتب الموظف: «من وقّع؟ لا أحد يعلم.» ثم أعاد الملف."], ["لماذا بلغ الفرق 34%؟"], ["تنتهي المهلة!"]],
    "lower": [["ks. ổn vỹ lập tại tp. trúc."], ["hệ số 1.05 áp dụng."], ["câu hỏi \"đã nhận. chờ duyệt.\" được ghi."], ["phí 35.000 đ."], ["hội đồng họp."]],
}


def check(pieces, glue):
    text, want = "", []
    for p in pieces:
        text += glue if text else ""
        want.append((len(text), len(text) + len(p)))
        text += p
    assert [text[a:z] for a, z in sentences(text)] == pieces
    assert sentences(text) == want


@pytest.mark.parametrize("lang", CASES)
@pytest.mark.parametrize("glue", [" ", "\n", "  ", "\n \n"])
def test_languages(lang, glue):
    check([c[0] for c in CASES[lang]], glue)


def test_unspaced_scripts():
    check(["附件见第717号第3.2节（含图2。）的说明。", "审核员写道：“谁签的字？没有人知道。”然后退回了案卷。", "系数只适用于此……其他不适用。", "为什么？"], "")
    check(["担当者は「誰か。分からない。」と書いて差し戻した。", "有効期間は六か月です！"], "　")


def test_thai():
    check(["เนื้อที่คือ 780.5 ตร.ม. แต่ได้เพียง 525.7 ตร.ม.", "น.ส. ธารินทร์ วงเวียน ยืนยัน", "จดว่า \"ใครเซ็น ไม่ทราบ\" แล้ว"], "  ")
    check(["รายงานเลขที่ 341", "เหตุใด"], "\n")


def test_blocks_lists_and_headings():
    text = "I. THÔNG TIN CHUNG\n\nPhần 3. Kết quả\n \n- Một. Hai\n• Ba.\n\n1. Vier\n2. Fünf\n\nunfinished end"
    assert [text[a:z] for a, z in sentences(text)] == ["I. THÔNG TIN CHUNG", "Phần 3. Kết quả", "- Một. Hai", "• Ba.", "1. Vier", "2. Fünf", "unfinished end"]
    wrapped = "Ist die Frist bis zum\n12. März 2024 gewahrt? Ja."
    assert [wrapped[a:z] for a, z in sentences(wrapped)] == ["Ist die Frist bis zum\n12. März 2024 gewahrt?", "Ja."]
    assert [len(sentences(x)) for x in ("có dấu giáp lai.Câu hỏi", "a.b.c v1.2.3 x.y")] == [2, 1]


def test_edges(spark):
    long = "Một câu dài. " * 20000
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n 　"), (4, "A."), (4, "A."), (5, long)], "doc_id long, text string").selectExpr("*", "0 AS start_char")
    out = sentence_units(df).collect()
    assert sum(r.doc_id == 5 for r in out) == 20000 and sum(r.doc_id == 4 for r in out) == 2 and not any(r.doc_id in (1, 2, 3) for r in out)
    assert sentence_units(df.limit(0)).count() == 0


def test_digits_of_hindi_and_thai_stay():
    for text in ("क्र. ५. भवन", "ข้อ ๕. อาคาร"):
        assert [text[a:z] for a, z in sentences(text)] == [text]


def test_long_quotations_and_brackets_stay_whole():
    for n in (10, 60, 5000):
        inner = "Mốc bị dời. Cần đo lại. " * n
        for a, z in ("“”", "«»", "„“", '""', "「」"):
            text = f"Người kiểm tra ghi: {a}{inner.strip()}{z} rồi trả lại. Hội đồng họp."
            assert [text[x:y] for x, y in sentences(text)] == [text[: -len(" Hội đồng họp.")], "Hội đồng họp."]
        for a, z in ("()", "[]"):
            text = f"It keeps {a}{'One stop. Two. ' * n}(and three. Yes.) end{z} the file. That was all."
            assert [text[x:y] for x, y in sentences(text)] == [text[: -len(" That was all.")], "That was all."]


def test_marks_without_partner_are_none():
    text = "The file (page 3 is lost. Nobody saw “it. Then (see p. 4.) it rained. „Gut.“ Done."
    assert [text[a:z] for a, z in sentences(text)] == ["The file (page 3 is lost.", "Nobody saw “it.", "Then (see p. 4.) it rained.", "„Gut.“", "Done."]


def test_decomposed_text_has_its_own_offsets():
    import unicodedata

    pieces = ["TS. Quách Đoan và ThS. Mẫn Khải ký.", "Người kiểm tra ghi: \"Mốc bị dời. Cần đo lại.\" rồi trả lại hồ sơ.", "Ắ! Ế? Ổ."]
    text = unicodedata.normalize("NFD", " ".join(pieces))
    assert [unicodedata.normalize("NFC", text[a:z]) for a, z in sentences(text)] == [*pieces[:2], "Ắ!", "Ế?", "Ổ."]


@pytest.mark.parametrize("part", ["“", "(", "a.b", "3.5  ", "x. y", "「。", 'a "', "Ā. ", "ก 1  ", "http://a.b.c/", "no. "])
def test_long_texts_take_linear_time(part):
    import time

    def seconds(n):
        began = time.perf_counter()
        sentences(part * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 30 * max(seconds(8_000), 0.01)
