"""Templates: recognising a kind of document by its phrases, and naming what it holds by lookup tables.

A template is data: phrases, and tables of labels. Users add their own by building another ``Template``.

Defined results: text without any phrase scores 0; a label without a name keeps null and its slug; ties go to the longer key, then
to the name; null labels have no name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.text import blankless_lower, comparable_label, slug

# ---- Fixed values -----------------------------------------------------------------------------------------------------
LEAST_SCORE, LEAST_PREFIX = 0.6, 8
CERTIFICATE_PHRASES = ("CHỨNG THƯ THẨM ĐỊNH GIÁ", "THÔNG TIN KHÁCH HÀNG", "THÔNG TIN VỀ TÀI SẢN THẨM ĐỊNH GIÁ", "THỜI ĐIỂM THẨM ĐỊNH GIÁ", "GIÁ TRỊ TÀI SẢN THẨM ĐỊNH GIÁ")
CERTIFICATE_SECTIONS = {"I": "customer_info", "II": "valuation_company", "III": "asset_info", "IV": "valuation_date", "V": "valuation_purpose", "VI": "value_basis", "VII": "assumptions", "VIII": "valuation_approach", "IX": "valuation_method", "X": "asset_values", "XI": "validity_period", "XII": "exclusions_and_limitations", "XIII": "attached_documents"}
CERTIFICATE_FIELDS = {
    "": {"so hd": "contract_number", "so ctph": "certificate_number", "kinh gui": "recipient"},
    "I": {
        "ten khach hang": "customer_name", "khach hang": "customer_name", "ten khach hang/don vi": "customer_name", "dia chi": "customer_address", "dia chi lien he": "customer_address",
        "cccd/mst": "customer_identity_number", "cccd": "customer_identity_number", "cmnd": "customer_identity_number", "cmnd/cccd": "customer_identity_number", "so cccd": "customer_identity_number",
        "so cmnd": "customer_identity_number", "cccd/cmnd/mst": "customer_identity_number", "mst": "customer_tax_id", "ma so thue": "customer_tax_id", "ngay cap": "customer_identity_issued_on",
        "noi cap": "customer_identity_issued_by", "dien thoai": "customer_phone", "so dien thoai": "customer_phone", "email": "customer_email",
    },
    "II": {
        "don vi thuc hien": "company_branch", "dia chi": "company_address", "ma so thue": "company_tax_id", "dai dien": "company_representative", "nguoi dai dien": "company_representative",
        "chuc vu": "company_representative_position", "chuc danh": "company_representative_position", "dien thoai": "company_phone", "so dien thoai": "company_phone", "email": "company_email",
        "so giay phep": "company_licence_number",
    },
    "III": {
        "loai hinh tai san": "asset_type", "tai san tham dinh": "asset_under_valuation", "ho so phap ly khach hang cung cap": "legal_documents_provided",
        "dac diem kinh te - ky thuat va hien trang": "technical_and_condition_notes", "dac diem kinh te ky thuat va hien trang": "technical_and_condition_notes",
        "ho so phap ly": "legal_documents_provided", "giay chung nhan": "land_certificate", "so to ban do": "map_sheet_number", "so thua dat": "land_lot_number", "vi tri": "asset_location",
        "tong dien tich": "total_area",
    },
    "XI": {
        "thoi han hieu luc cua ket qua tham dinh gia trong chung thu tinh tu ngay phat hanh la": "validity_duration", "thoi han hieu luc": "validity_duration", "so to ban do": "map_sheet_number",
        "nguoi kiem tra": "checked_by",
    },
    "XIII": {"cac phu luc chi tiet kem theo": "appendix_list_heading", "phu luc so 01": "appendix_01", "phu luc so 02": "appendix_02", "mot so luu y": "notes_heading"},
}
CERTIFICATE_ROLES = {"tham dinh vien ve gia": "valuer", "giam doc chi nhanh": "branch_director", "giam doc": "director", "tong giam doc": "general_director"}
CERTIFICATE_CARD = "so the"
CERTIFICATE_TOTALS = {"tong cong": "total", "lam tron": "total_rounded", "bang chu": "total_in_words"}
# ---- end of fixed values ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """What makes a kind of document, and what its labels mean. ``fields`` by section number; "" is the preface."""

    template_id: str
    phrases: tuple[str, ...]
    section_names: dict[str, str] = field(default_factory=dict)
    fields: dict[str, dict[str, str]] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)
    card_label: str = ""
    totals: dict[str, str] = field(default_factory=dict)
    asset_section: str = ""
    asset_columns: int = 4


CERTIFICATE = Template("chung_thu_tham_dinh_gia", CERTIFICATE_PHRASES, CERTIFICATE_SECTIONS, CERTIFICATE_FIELDS, CERTIFICATE_ROLES, CERTIFICATE_CARD, CERTIFICATE_TOTALS, "X")


def score(text: Column | str, template: Template) -> Column:
    """The share of a template's phrases that a text holds; plain blanks and case don't matter, line breaks do."""
    hay = blankless_lower(text)
    hits = [F.contains(hay, F.lit(p.replace(" ", "").lower())).cast("int") for p in template.phrases]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return F.coalesce(total, F.lit(0)) / F.lit(float(len(hits)))


def detect(texts: DataFrame, templates: tuple[Template, ...] = (CERTIFICATE,)) -> DataFrame:
    """texts with template_id and score: the best of 0.6 or more, the first of equals; null if there is none."""
    scored = F.array(*[F.struct(score("text", t).alias("score"), F.lit(-i).alias("i"), F.lit(t.template_id).alias("id")) for i, t in enumerate(templates)])
    best = texts.withColumn("_best", F.array_max(scored))
    return best.withColumn("template_id", F.when(F.col("_best.score") >= F.lit(LEAST_SCORE), F.col("_best.id"))).withColumn("score", F.col("_best.score")).drop("_best")


def name_table(df: DataFrame, template: Template) -> DataFrame:
    rows = [(s, k, n) for s, names in template.fields.items() for k, n in names.items()]
    return df.sparkSession.createDataFrame(rows, "section string, key string, name string")


def field_names(labels: DataFrame, names: DataFrame, section: str = "section", label: str = "label") -> DataFrame:
    """labels with ``field_name`` and ``field_key``: the name of the exact label in its section, else of the longest key of eight letters or
    more that it starts with, before a blank; the key is the name or the label's slug.

    Distinct labels are named, so a label's copies cost nothing. The names join on the section; each distinct label meets the
    few keys of its section.
    """
    distinct = labels.select(F.coalesce(F.col(section), F.lit("")).alias("_s"), F.col(label).alias("_l")).filter("_l IS NOT NULL").distinct().withColumn("_k", comparable_label("_l"))
    met = distinct.join(names, F.col("_s") == F.col("section")).filter((F.col("_k") == F.col("key")) | (F.length("key") >= LEAST_PREFIX) & F.startswith("_k", F.concat("key", F.lit(" "))))
    best = met.groupBy("_s", "_l").agg(F.max_by("name", F.struct((F.col("_k") == F.col("key")).alias("e"), F.length("key").alias("n"), "name")).alias("field_name"))
    named = distinct.join(best, ["_s", "_l"], "left").select("_s", "_l", "field_name", F.coalesce("field_name", slug("_l")).alias("field_key"))
    return labels.withColumn("_s", F.coalesce(F.col(section), F.lit(""))).withColumn("_l", F.col(label)).join(named, ["_s", "_l"], "left").drop("_s", "_l")


def signature_entries(people: DataFrame, template: Template = CERTIFICATE) -> DataFrame:
    """doc_id, person, role, role_label, card_number, name, lines from each person's lines (array<string>)."""
    roles = F.create_map(*[F.lit(x) for kv in template.roles.items() for x in kv])
    e = people.select("doc_id", "person", "lines", F.posexplode("lines").alias("i", "line")).withColumn("_k", comparable_label("line"))
    e = e.withColumn("_role", F.element_at(roles, F.col("_k"))).withColumn("_card", F.startswith("_k", F.lit(template.card_label)) & F.contains("line", F.lit(":")))
    last = F.col("i") == F.size("lines") - 1
    return e.groupBy("doc_id", "person", "lines").agg(
        F.min_by("_role", F.when(F.col("_role").isNotNull(), F.col("i"))).alias("role"),
        F.min_by("line", F.when(F.col("_role").isNotNull(), F.col("i"))).alias("role_label"),
        F.max_by(F.trim(F.substr("line", F.locate(":", F.col("line")) + 1)), F.when(F.col("_card"), F.col("i"))).alias("card_number"),
        F.max(F.when(last & F.col("_role").isNull() & ~F.startswith("_k", F.lit(template.card_label)), F.col("line"))).alias("name"),
    )


def assembled(fields: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, field_key, label, value: of fields of one key the last counts, at the place of the first (``at``)."""
    return fields.groupBy(*keys, "field_key").agg(F.min(F.struct(*order)).alias("at"), F.max_by(F.struct("label", "value"), F.struct(*order)).alias("_v")).select(*keys, "field_key", "at", "_v.label", "_v.value")


def section_value(paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, section_no, value: a section's inline value, else its paragraphs joined by blanks."""
    p = paragraphs.groupBy("doc_id", "section_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "value"))), lambda x: x["value"]), " ").alias("_joined"))
    return sections.join(p, ["doc_id", "section_no"], "left").select("doc_id", "section_no", F.coalesce("inline_value", "_joined").alias("value"))
