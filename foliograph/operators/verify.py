"""Cross-verification of independent readers by multisets of characters.

Texts are compared in ``comparable_form``. Multisets are counts by (doc_id, name, ch), aggregated map-side; comparisons are one
full outer join on (doc_id, ch). Nothing but the reports holds more than a row a character.

Defined results: a document without an engine's text has no comparison with it, and ``all`` over none is true; null and empty
texts have empty multisets and equal each other; ties among differing characters go by the character.
"""

from __future__ import annotations

import difflib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from foliograph.functions.text import comparable_form, starts_combining
from foliograph.operators.glyphs import char_counts

# ---- Fixed values -----------------------------------------------------------------------------------------------------
MOST_DIFFERENCES = 10
EXTRA_MARKS = "+engine_extra_marks"
NONE, DOCUMENT = "none", "document"
TABLE_ART = "-=|+:"
# ---- end of fixed values ----------------------------------------------------------------------------------------------


def comparable(texts: DataFrame) -> DataFrame:
    """The column ``text`` in comparable form."""
    return texts.withColumn("text", F.coalesce(comparable_form("text"), F.lit("")))


def multiset_difference(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, ch, only_a, only_b from two counts (keys, ch, n); rows that differ only."""
    joined = a.withColumnRenamed("n", "_a").join(b.withColumnRenamed("n", "_b"), [*keys, "ch"], "full_outer")
    d = F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))
    return joined.select(*keys, "ch", F.greatest(d, F.lit(0)).alias("only_a"), F.greatest(-d, F.lit(0)).alias("only_b")).filter("only_a > 0 OR only_b > 0")


def most_common(differences: DataFrame, keys: list[str], side: str, most: int = MOST_DIFFERENCES) -> DataFrame:
    """keys, ``side``: the most frequent characters on one side as a map. Ranked by window, so no list outgrows ``most``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(side), "ch")
    top = differences.filter(F.col(side) > 0).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
    return top.groupBy(*keys).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("_k", "ch", side))), lambda x: F.struct(x.ch, x[side]))).alias(side))


def compare_engines(baselines: DataFrame, engines: DataFrame) -> DataFrame:
    """Each engine's text against the baselines, in their order.

    baselines: doc_id, ord, baseline, text; engines: doc_id, engine, text. Gives doc_id, engine, baseline, chars,
    char_multiset_match, only_in_primary, only_in_engine. The first baseline with an equal multiset counts; else the first
    to which the engine only adds combining marks that the baseline has too; else none, and the last baseline shows the difference.
    """
    base, eng = comparable(baselines), comparable(engines)
    b = char_counts(base, keys=("doc_id", "ord"))
    e = char_counts(eng, keys=("doc_id", "engine"))
    pairs = base.select("doc_id", "ord", "baseline").join(eng.select("doc_id", "engine", F.length("text").alias("chars")), "doc_id")
    left = pairs.select("doc_id", "ord", "engine").join(b, ["doc_id", "ord"])
    right = pairs.select("doc_id", "ord", "engine").join(e, ["doc_id", "engine"]).select("doc_id", "ord", "engine", "ch", "n")
    keys = ["doc_id", "ord", "engine"]
    joined = left.withColumnRenamed("n", "_a").join(right.withColumnRenamed("n", "_b"), [*keys, "ch"], "full_outer")
    a, z = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    diff = joined.select(*keys, "ch", F.greatest(a - z, F.lit(0)).alias("only_in_primary"), F.greatest(z - a, F.lit(0)).alias("only_in_engine"), (a > 0).alias("_has")).filter("only_in_primary > 0 OR only_in_engine > 0")
    state = diff.withColumn("_mark", starts_combining("ch")).groupBy(*keys).agg(F.sum("only_in_primary").alias("lost"), F.bool_and((F.col("only_in_engine") == 0) | F.col("_mark") & F.col("_has")).alias("marks"))
    judged = pairs.join(state, keys, "left").withColumn("_equal", F.col("lost").isNull()).withColumn("_marks", F.coalesce((F.col("lost") == 0) & F.col("marks"), F.lit(False)))
    pick = judged.groupBy("doc_id", "engine", "chars").agg(
        F.min(F.when(F.col("_equal"), F.struct("ord", "baseline"))).alias("_e"),
        F.min(F.when(F.col("_marks"), F.struct("ord", "baseline"))).alias("_m"),
        F.max("ord").alias("_last"),
    )
    chosen = pick.select(
        "doc_id", "engine", "chars", F.coalesce("_e.ord", "_m.ord", "_last").alias("ord"),
        F.coalesce("_e.baseline", F.concat("_m.baseline", F.lit(EXTRA_MARKS)), F.lit(NONE)).alias("baseline"),
        (F.col("_e").isNotNull() | F.col("_m").isNotNull()).alias("char_multiset_match"),
    )
    sides = [most_common(diff, keys, s) for s in ("only_in_primary", "only_in_engine")]
    return reduce(lambda x, y: x.join(y, keys, "left"), sides, chosen).drop("ord")


def compare_one_sided(document: DataFrame, engines: DataFrame) -> DataFrame:
    """A reader may add the drawing of tables, but no other character that the document lacks. Columns as ``compare_engines``, with similarity 1 or 0."""
    doc, eng = comparable(document), comparable(engines)
    pairs = eng.select("doc_id", "engine", F.length("text").alias("chars"))
    a = pairs.select("doc_id", "engine").join(char_counts(doc), "doc_id")
    diff = multiset_difference(a, char_counts(eng, keys=("doc_id", "engine")), ("doc_id", "engine")).withColumnsRenamed({"only_a": "only_in_primary", "only_b": "only_in_engine"})
    keys = ["doc_id", "engine"]
    foreign = diff.groupBy(*keys).agg(F.count_if((F.col("only_in_engine") > 0) & ~F.col("ch").isin(*TABLE_ART)).alias("_bad"))
    out = pairs.join(foreign, keys, "left").withColumn("char_multiset_match", F.coalesce(F.col("_bad"), F.lit(0)) == 0).drop("_bad")
    out = out.withColumn("baseline", F.when(F.col("char_multiset_match"), DOCUMENT).otherwise(NONE)).withColumn("reading_order_similarity", F.col("char_multiset_match").cast("double"))
    return reduce(lambda x, y: x.join(y, keys, "left"), [most_common(diff, keys, s) for s in ("only_in_primary", "only_in_engine")], out)


@arrow_udf(DoubleType())
def reading_order_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratio of matching blocks of two texts, in reading order. Quadratic and for reports only: call it on the pairs in question."""
    return pa.array([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def uncovered(document: DataFrame, output: DataFrame) -> DataFrame:
    """doc_id, ch, n: characters of the documents (doc_id, text) that the outputs don't hold as often."""
    d = multiset_difference(char_counts(comparable(document)), char_counts(comparable(output)))
    return d.filter("only_a > 0").select("doc_id", "ch", F.col("only_a").alias("n"))
