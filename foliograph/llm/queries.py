"""Queries of the training-data problems, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliograph.llm.disguise import visual_cases
from foliograph.llm.encoding import garbled
from foliograph.llm.leaks import leaks
from foliograph.llm.mixing import mixture
from foliograph.llm.runs import glyph_runs
from foliograph.llm.sentences import sentence_units
from foliograph.session import table

#: Where the public tokenizers' vocabularies lie on the machines of this project's data.
TOKENIZERS = "/opt/tokenizers"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim that shows a known term in other characters, and every glyph that isn't the character it shows."""
    return visual_cases(*[table(spark, sf_dir, t) for t in ("claims", "known_terms", "glyphs")]).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every glyph and font name that came out of a wrong decoding."""
    return garbled(*[table(spark, sf_dir, t) for t in ("glyphs", "fonts", "font_audits")]).select("source_field", "doc_id", "item").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of a glyph drawn again at nearly the same place."""
    return glyph_runs(table(spark, sf_dir, "glyphs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that shares a long enough passage with an evaluation item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents chosen for the target shares, with their repeats."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), TOKENIZERS)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's target and actual share."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), TOKENIZERS)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document."""
    return sentence_units(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found}

SQL = {
    "p5_found": """
WITH g AS (SELECT DISTINCT doc_id, page, seq, ch, x0, top, size FROM glyphs WHERE seq IS NOT NULL),
l AS (SELECT *, lag(ch) OVER w AS pch, lag(x0) OVER w AS px, lag(top) OVER w AS ptop FROM g WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq)),
s AS (SELECT *, CASE WHEN pch = ch AND abs(x0 - px) <= 0.15 * size + 1e-9 AND abs(top - ptop) <= 0.15 * size + 1e-9 THEN 0 ELSE 1 END AS fresh FROM l),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY seq) AS run FROM s)
SELECT doc_id, page, min(seq) AS first_seq, max(seq) AS last_seq, CAST(count(*) AS INTEGER) AS n_glyphs FROM r GROUP BY doc_id, page, run HAVING count(*) > 1
""",
    "p6_found": r"""
WITH w AS (SELECT item_id, lang, regexp_extract_all(FOLDED, '[\p{L}\p{N}]+') AS t FROM eval_items WHERE text IS NOT NULL),
i AS (SELECT item_id, CASE WHEN lang IN ('zh', 'ja') THEN 24 ELSE 12 END AS n, CASE WHEN lang IN ('zh', 'ja') THEN string_split(array_to_string(t, ''), '') ELSE t END AS t FROM w),
gi AS (SELECT DISTINCT item_id, n, array_to_string(t[k : k + n - 1], ' ') AS g FROM i, generate_series(1, len(t)) AS s(k) WHERE k + n - 1 <= len(t)),
d AS (SELECT doc_id, regexp_extract_all(FOLDED, '[\p{L}\p{N}]+') AS t FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, 12 AS n, t FROM d UNION ALL SELECT doc_id, 24, string_split(array_to_string(t, ''), '') FROM d),
gd AS (SELECT doc_id, n, array_to_string(t[k : k + n - 1], ' ') AS g FROM u, generate_series(1, len(t)) AS s(k) WHERE k + n - 1 <= len(t))
SELECT DISTINCT doc_id, item_id FROM gi JOIN gd USING (n, g)
""".replace("FOLDED", "nfc_normalize(replace(lower(nfc_normalize(text)), 'ß', 'ss'))"),
}
