import unicodedata

from pyspark.sql import functions as F

from foliograph.functions import text as tx

ODD = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first().x


def test_white_space_is_pythons(spark):
    df = spark.createDataFrame([(chr(c),) for c in range(1, 0x3100)], "c string")
    assert {r.c for r in df.filter(tx.is_blank("c")).collect()} == set(ODD)


def test_normal_forms_and_labels(spark):
    assert one(spark, tx.nfc("t"), t="ế") == "ế"
    assert one(spark, tx.searchable("t"), t=f" a{ODD}b ") == "a b"
    assert one(spark, tx.collapsed("t"), t="a  b") == "ab"
    assert one(spark, tx.comparable_form("t"), t="ế x") == unicodedata.normalize("NFD", "ế") + "x"
    assert one(spark, tx.comparable_label("t"), t="  Địa  chỉ: ") == "dia chi"
    assert one(spark, tx.slug("t"), t="Số CMND/CCCD:") == "so_cmnd_cccd"
    assert one(spark, tx.slug("t"), t="---") == "unnamed_field"
    assert one(spark, tx.font_key("t"), t="/ABCDEF+Some Font") == "some font"
    assert one(spark, tx.slug("t"), t=None) is None


def test_prefixes_headings_bullets(spark):
    assert one(spark, tx.sourced_text("t", tx.BULLETS), t=" - – x -") == "x -"
    assert one(spark, tx.sourced_text("t", tx.BULLETS), t="– - x") == "- x"  # each once, in order
    assert one(spark, tx.sourced_text("t", tx.BULLETS), t=" • ") is None
    assert one(spark, tx.heading_number("t"), t=" XI . Hạn: 06 tháng ") == "XI"
    assert one(spark, tx.heading_title("t"), t="XI. Hạn: 06 tháng") == "Hạn"
    assert one(spark, tx.heading_inline("t"), t="XI. Hạn: 06  tháng") == "06 tháng"
    assert one(spark, tx.heading_number("t"), t="xi. no") is None
    assert one(spark, tx.is_bare_bullet("t"), t=" ● ") is True


def test_labels(spark):
    assert one(spark, tx.looks_like_label("t"), t="- Địa chỉ") is True
    assert one(spark, tx.looks_like_label("t"), t="a b") is False
    assert one(spark, tx.looks_like_label("t"), t="A b c d e f g") is False
    assert one(spark, tx.looks_like_label("t", allow_long=True), t="A b c d e f g") is True
    assert one(spark, tx.looks_like_docx_label("t", F.lit(True)), t="A b c d e f g h i") is True
    assert one(spark, tx.looks_like_docx_label("t", F.lit(True)), t="A b c d e f g h 9") is False


def test_joins_and_rounding(spark):
    assert one(spark, tx.joined_number("a"), a=["1.23", "4.000"]) == "1.234.000"
    assert one(spark, tx.joined_prose("a"), a=["Quyền sử", "dụng-", "đất"]) == "Quyền sử dụng-đất"
    assert one(spark, tx.binary_round("v", 2), v=2.675) == round(2.675, 2)
    assert one(spark, tx.binary_round("v", 2), v=0.125) == round(0.125, 2)
    assert one(spark, tx.original_position("t", F.lit(2)), t="a b c") == 4
