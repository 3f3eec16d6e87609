"""The provenance gate: a value is accepted only if it is proven verbatim.

values: doc_id, path, value, page, bbox, source_lines; texts: doc_id, page, text and, where a row is a line, line_no (the canonical
text, in this order); glyphs as in ``operators.glyphs``. Levels of proof: 1 the glyphs inside the value's box read as the value, 2 the value is
part of the document's text (white space squeezed, or left out), 3 each of its fragments is, and together they make the value.

The document's text is never one string, and no value meets a piece of text. Every character that is no blank has two places in its
document, one that counts blanks and one that doesn't, by running sums over ranges of pages. The text becomes grams with these places, a
value a chain of grams that cover it; a gram of a value meets the same gram of its document in an equi-join. Of each value the
gram that its document has least gives the places where it may begin, and it stands there if all others stand at their distances.
So the length of a value, and the number of pages it runs over, don't matter. Values shorter than a gram meet the distinct beginnings
of grams. Equal values of a document are proven once. The range join of level 1 has (doc_id, page) as its key, with grid cells, so one
page's glyphs meet only the boxes they may lie in.

Defined results: a null or blank value is unproven; a null document proves nothing; a wrong box does not fail a value that the text
holds; a document without text proves nothing; null fragments don't count and the noncharacter U+FDD0 parts one; repeated rows are one
value; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions.text import binary_round, collapsed, nfc, searchable, squeezed
from foliograph.session import cut

# ---- Fixed values -----------------------------------------------------------------------------------------------------
BOX_TOLERANCE = 1.5
# ---- end of fixed values ----------------------------------------------------------------------------------------------
CELL = 64.0
#: Characters of a gram; characters within which a gram surely ends, blanks included; characters of a part of text; pages and lines of a range.
GRAM = 6
REACH, PART, PAGES, LINES = 2 * GRAM - 1, 512, 256, 4096
_FORM = rf"^(?:[^ ] ?){{0,{GRAM - 1}}}[^ ]"
_FRAGMENTS, _MOST = "\ufdd0", (1 << 31) - 1
#: What a needle's places count: characters without blanks, or all.
TIGHT, SPACED = "tight", "spaced"


def _cells(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / CELL), F.floor(high / CELL))


def text_in_boxes(glyphs: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, region: the characters whose centres lie in each box (doc_id, page, bbox), by line (top to one decimal), then x0."""
    t = BOX_TOLERANCE
    g = glyphs.select("doc_id", "page", "seq", "ch", "x0", "top", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("top") + F.col("bottom")) / 2).alias("cy"))
    g = g.withColumn("gx", F.floor(F.col("cx") / CELL)).withColumn("gy", F.floor(F.col("cy") / CELL))
    b = boxes.filter("bbox IS NOT NULL AND bbox.x1 >= bbox.x0 AND bbox.bottom >= bbox.top").select("doc_id", "page", *[k for k in keys if k not in ("doc_id", "page")], "bbox")
    b = b.withColumn("gx", F.explode(_cells(F.col("bbox.x0") - t, F.col("bbox.x1") + t))).withColumn("gy", F.explode(_cells(F.col("bbox.top") - t, F.col("bbox.bottom") + t)))
    inside = g.join(b, ["doc_id", "page", "gx", "gy"]).filter((F.col("cx") >= F.col("bbox.x0") - t) & (F.col("cx") <= F.col("bbox.x1") + t) & (F.col("cy") >= F.col("bbox.top") - t) & (F.col("cy") <= F.col("bbox.bottom") + t))
    inside = inside.withColumn("_line", binary_round("top", 1))
    return inside.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "x0", "seq", "ch"))), lambda c: c.ch), "").alias("region"))


def _tight(c: Column | str) -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit(" "), F.lit(""))


def _parts(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(PART)), lambda i: F.substr(text, i + 1, F.lit(PART)))


def numbered_text(texts: DataFrame) -> DataFrame:
    """doc_id, part, ahead, tight_at, spaced_at: each document's searchable text in parts, what follows each, and where it begins."""
    line = F.coalesce(F.col("line_no"), F.lit(0)) if "line_no" in texts.columns else F.lit(0)
    rows = texts.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.col("page"), F.lit(0)).alias("page"), line.cast("long").alias("line"), searchable("text").alias("text")).filter("text <> ''")
    # Files without pages have all their lines on page 0: there lines make the ranges.
    rows = rows.select("doc_id", "page", "line", F.floor(F.col("page") / PAGES).alias("range"), F.when(F.col("page") == 0, F.floor(F.col("line") / LINES)).otherwise(0).alias("sub"), F.posexplode(_parts(F.concat("text", F.lit(" ")))).alias("k", "part"))
    w = Window.partitionBy("doc_id", "range", "sub").orderBy("page", "line", "k", "part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = {"tight": F.length(_tight("part")), "spaced": F.length("part")}
    rows = rows.select(
        "doc_id", "range", "sub", "part", F.row_number().over(w).alias("i"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{k}_at") for k, n in sizes.items()],
        F.array_join(F.collect_list(F.substring("part", 1, REACH - 1)).over(w.rowsBetween(1, REACH - 1)), "").alias("ahead"),
    )
    rows = cut(rows)
    # Between ranges, from one row a range: how much lies before it, and what it begins with.
    heads = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("i") < REACH, F.struct("i", F.substring("part", 1, REACH - 1).alias("h"))))), lambda x: x["h"]), "")
    ranges = rows.groupBy("doc_id", "range", "sub").agg(*[F.sum(n).alias(k) for k, n in sizes.items()], F.substring(heads, 1, REACH - 1).alias("head"))
    v = Window.partitionBy("doc_id").orderBy("range", "sub")
    ranges = ranges.select("doc_id", "range", "sub", *[F.coalesce(F.sum(k).over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{k}") for k in sizes], F.array_join(F.collect_list("head").over(v.rowsBetween(1, REACH - 1)), "").alias("_next"))
    whole = rows.join(cut(ranges), ["doc_id", "range", "sub"])
    return whole.select("doc_id", "part", F.substring(F.concat("ahead", "_next"), 1, REACH - 1).alias("ahead"), *[(F.col(f"{k}_at") + F.col(f"_{k}")).alias(f"{k}_at") for k in sizes])


def _inked(text: Column) -> Column:
    """The places (from 1) of a text's characters that are no blanks."""
    return F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)) != " ")


def grams(numbered: DataFrame) -> DataFrame:
    """doc_id, form (a gram with the blanks within it; shorter at the end of a document), gram, and its places tight and spaced."""
    at = numbered.withColumn("_w", F.concat("part", "ahead")).select("doc_id", "_w", "tight_at", "spaced_at", F.posexplode(_inked(F.col("part"))).alias("j", "i"))
    form = F.regexp_extract(F.substr("_w", F.col("i"), F.lit(REACH)), _FORM, 0)
    return at.select("doc_id", form.alias("form"), (F.col("tight_at") + F.col("j")).alias(TIGHT), (F.col("spaced_at") + F.col("i") - 1).alias(SPACED)).withColumn("gram", _tight("form"))


def _chain(needles: DataFrame) -> DataFrame:
    """doc_id, kind, needle, off, form, gram: grams that cover each needle, GRAM characters or longer, and their distance from its first character."""
    n, whole = F.col("needle"), F.length("needle")
    names = ["doc_id", "kind", "needle"]
    # Without blanks every GRAM-th place begins a gram; the last one ends with the needle.
    parts = F.transform(F.sequence(F.lit(0), whole - 1, F.lit(PART * GRAM)), lambda p: F.struct(p.alias("at"), F.substr(n, p + 1, F.lit((PART + 1) * GRAM)).alias("text")))
    tight = needles.filter(F.col("kind") == TIGHT).select(*names, F.explode(parts).alias("_p"))
    cuts = F.sequence(F.lit(0), F.least(F.length("_p.text"), F.lit(PART * GRAM)) - 1, F.lit(GRAM))
    tight = tight.select(*names, F.explode(F.transform(cuts, lambda i: F.struct((F.col("_p.at") + i).alias("off"), F.substr(F.col("_p.text"), i + 1, F.lit(GRAM)).alias("form")))).alias("_c"))
    # With blanks every GRAM-th character that is none, in each part.
    part = needles.filter(F.col("kind") == SPACED).select(*names, F.posexplode(F.transform(F.sequence(F.lit(0), whole - 1, F.lit(PART)), lambda i: F.substr(n, i + 1, F.lit(PART + REACH)))).alias("k", "_p"))
    every = F.filter(_inked(F.substring("_p", 1, PART)), lambda _, j: j % GRAM == 0)
    spaced = part.select(*names, F.explode(F.transform(every, lambda i: F.struct((F.col("k") * PART + i - 1).alias("off"), F.regexp_extract(F.substr(F.col("_p"), i, F.lit(REACH)), _FORM, 0).alias("form")))).alias("_c"))
    end = F.regexp_extract(F.substr(n, F.greatest(whole - REACH + 1, F.lit(1))), rf"(?:[^ ] ?){{{GRAM - 1}}}[^ ]$", 0)
    ends = F.when(F.col("kind") == TIGHT, F.substring("needle", -GRAM, GRAM)).otherwise(end)
    last = needles.filter((F.col("kind") == SPACED) | (whole % GRAM != 0)).select(*names, ends.alias("form")).select(*names, F.struct((whole - F.length("form")).alias("off"), "form").alias("_c"))
    return tight.unionByName(spaced).unionByName(last).select(*names, "_c.*").withColumn("gram", _tight("form")).filter(F.length("gram") == GRAM)


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """The needles (doc_id, kind, needle) that their document's text holds: TIGHT ones without regard to blanks, SPACED ones with them.

    Needles are searchable, TIGHT ones without blanks.
    """
    needles = needles.filter("doc_id IS NOT NULL AND needle <> ''").distinct()
    names = ["doc_id", "kind", "needle"]
    numbered = numbered_text(texts)
    size = F.length(_tight("needle"))
    chain = cut(_chain(needles.filter(size >= GRAM)))
    met = cut(grams(numbered).join(chain.select("doc_id", "gram").distinct(), ["doc_id", "gram"], "left_semi"))
    # The gram that the document has least is the one to begin with; with one that it lacks, the needle is lost.
    counts = met.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    seed = F.min(F.least(F.coalesce("n", F.lit(0)), F.lit(_MOST)) * (_MOST + 1) + F.col("off")).alias("s")
    seeds = chain.join(counts, ["doc_id", "gram"], "left").groupBy(*names).agg(seed, F.count(F.lit(1)).alias("links")).filter(F.col("s") > _MOST).withColumn("off", F.col("s") % (_MOST + 1))
    head = F.regexp_extract(F.substr("needle", F.col("off").cast("int") + 1, F.lit(REACH)), _FORM, 0)
    seeds = seeds.select(*names, "links", "off", head.alias("form")).withColumn("gram", _tight("form"))
    place = F.when(F.col("kind") == TIGHT, F.col(TIGHT)).otherwise(F.col(SPACED))
    starts = seeds.join(met.withColumnRenamed("form", "_form"), ["doc_id", "gram"]).filter("kind = 'tight' OR form = _form").select(*names, "links", (place - F.col("off")).alias("start"))
    several = starts.filter("links > 1").join(chain, names).withColumn("at", F.col("start") + F.col("off"))
    key = F.when(F.col("kind") == TIGHT, F.col("gram")).otherwise(F.col("form"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key"), F.col(k).alias("at")) for k, c in ((TIGHT, "gram"), (SPACED, "form"))]))
    there = several.withColumn("key", key).join(met.select("doc_id", kinds.alias("_k")).select("doc_id", "_k.*"), ["doc_id", "kind", "key", "at"], "left_semi")
    chained = there.groupBy(*names, "start", "links").agg(F.count(F.lit(1)).alias("n")).filter("n = links")
    long = starts.filter("links = 1").select(*names).unionByName(chained.select(*names))
    # Shorter than a gram: what grams begin with. Equal beginnings combine before they move.
    short = needles.filter(size < GRAM)
    kinds_ = {r.kind for r in short.select("kind").distinct().collect()}
    for kind, of, most in ((TIGHT, "gram", GRAM - 1), (SPACED, "form", REACH - 1)):
        if kind not in kinds_:
            continue
        own = short.filter(F.col("kind") == kind)
        begun = grams(numbered.join(own.select("doc_id").distinct(), "doc_id", "left_semi"))
        keys = begun.select("doc_id", F.lit(kind).alias("kind"), F.explode(F.array(*[F.substring(of, 1, k) for k in range(1, most + 1)])).alias("needle")).distinct()
        long = long.unionByName(own.join(keys, names, "left_semi"))
    return long.distinct()


def verify(values: DataFrame, texts: DataFrame, glyphs: DataFrame | None = None) -> DataFrame:
    """values with ``proof_level`` (1, 2, 3 or null) and ``verbatim``."""
    fragments = F.split(nfc(F.array_join(F.coalesce("source_lines", F.array().cast("array<string>")), _FRAGMENTS)), _FRAGMENTS)
    named = values.withColumn("_needle", searchable("value")).withColumn("_tight", _tight("_needle")).withColumn("_parts", F.when(F.size("source_lines") > 0, F.transform(fragments, squeezed)))
    named = cut(named.withColumn("_parts", F.when(_tight(F.array_join("_parts", "")) == F.col("_tight"), F.col("_parts"))))
    whole = named.select("doc_id", F.lit(TIGHT).alias("kind"), F.col("_tight").alias("needle"))
    # One fragment alone proves no more than the whole does.
    lines = named.filter("size(_parts) > 1").select("doc_id", "_parts").distinct()
    parts = lines.select("doc_id", "_parts", F.explode("_parts").alias("needle"))
    found = cut(contained(whole.unionByName(parts.select("doc_id", F.lit(SPACED).alias("kind"), "needle")), texts))
    level2 = found.filter(F.col("kind") == TIGHT).select("doc_id", F.col("needle").alias("_tight"), F.lit(True).alias("_2"))
    held = parts.join(found.filter(F.col("kind") == SPACED).select("doc_id", "needle", F.lit(True).alias("_f")), ["doc_id", "needle"], "left")
    level3 = held.groupBy("doc_id", "_parts").agg(F.bool_and(F.coalesce("_f", F.col("needle") == "")).alias("_3"))
    out = named.join(level2, ["doc_id", "_tight"], "left").join(level3, ["doc_id", "_parts"], "left")
    if glyphs is not None:
        # A value is told from others of its path by its box.
        region = text_in_boxes(glyphs, values.select("doc_id", "page", "path", "bbox").distinct(), ["doc_id", "page", "path", "bbox"]).withColumn("region", collapsed("region"))
        out = out.join(region, ["doc_id", "page", "path", "bbox"], "left").withColumn("_1", F.coalesce(F.col("region") == F.col("_tight"), F.lit(False))).drop("region")
    else:
        out = out.withColumn("_1", F.lit(False))
    level = F.when(F.coalesce(F.col("_needle"), F.lit("")) == "", F.lit(None)).when(F.col("_1"), 1).when(F.col("_2"), 2).when(F.col("_3"), 3)
    return out.withColumn("proof_level", level).withColumn("verbatim", F.col("proof_level").isNotNull()).select(*values.columns, "proof_level", "verbatim")


def report(verified: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, total_values, verbatim_values, ratio (1 for none), and the unverified paths in the order of the result (``ord``, where there is one, then path)."""
    order = [c for c in ("ord", "path") if c in verified.columns]
    unproven = F.transform(F.array_sort(F.collect_list(F.when(~F.col("verbatim"), F.struct(*order)))), lambda x: x["path"])
    out = verified.groupBy(by).agg(F.count(F.lit(1)).alias("total_values"), F.count_if("verbatim").alias("verbatim_values"), unproven.alias("unverified_paths"))
    return out.withColumn("ratio", F.when(F.col("total_values") == 0, 1.0).otherwise(F.col("verbatim_values") / F.col("total_values")))


def status(gates: DataFrame) -> DataFrame:
    """doc_id, status, errors from gates (doc_id, severity 0..2, error): the worst severity decides."""
    by = gates.groupBy("doc_id").agg(F.max("severity").alias("severity"), F.array_sort(F.collect_list("error")).alias("errors"))
    return by.withColumn("status", F.element_at(F.array(F.lit("verified"), F.lit("needs_review"), F.lit("rejected")), F.col("severity") + 1))


def exit_code(statuses: DataFrame) -> DataFrame:
    """exit_code: 0 all verified, 1 some to review, 2 some rejected or no document at all."""
    return statuses.agg(F.coalesce(F.max("severity"), F.lit(2)).alias("exit_code"))
