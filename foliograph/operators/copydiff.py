"""Differences between two copies of a dataset, by content-defined chunks.

Both sides are reduced to the row that holds for each key, spread over the same buckets by a hash of the key, and sorted by key
in each bucket. A chunk ends where a rolling hash over the last rows meets a condition, so an inserted or missing row moves no
cut but its neighbours'. Chunks whose fingerprints occur on the other side in the same bucket are equal and drop out by an
anti-join of a few bytes a chunk; only the rows of the rest meet in a join and are compared field by field.

The reduction is an ordinary two-phase aggregate: versions of a hot key combine before the shuffle. Buckets hold keys, not
values, so no file or value can make one large.

Defined results: null is a key like any other and equals null; texts are compared byte for byte; of rows of one key with the
same time the one with the greatest ``tie`` column holds (null least), then the greatest values, so repeated rows change nothing; an empty
side makes every key of the other a difference; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.session import cut

BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 1 << 24


def holding(df: DataFrame, keys: Sequence[str], fields: Sequence[str], version: str, tie: str | None = None) -> DataFrame:
    """The row with the latest ``version`` of each key: keys and fields."""
    order = [F.col(version).alias("_v"), *([F.col(tie).alias("_t")] if tie else []), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)]]
    return df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_m")).select(*keys, *[F.col(f"_m._f{i}").alias(f) for i, f in enumerate(fields)])


def chunked(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], buckets: int, mean_rows: int, window: int) -> DataFrame:
    """Adds _bucket, _row (hash of the whole row) and _chunk (number of the chunk in its bucket)."""
    full = [F.struct(*[F.col(c) for c in (*keys, *fields)])]
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in (*keys, *fields)])
    w = Window.partitionBy("_bucket").orderBy(*keys)
    rolling = F.sum(F.shiftrightunsigned("_row", 8)).over(w.rowsBetween(-(window - 1), 0))
    return (
        rows.withColumn("_bucket", F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), F.lit(buckets)).cast("int"))
        .withColumn("_row", F.xxhash64(*full, nulls))
        .withColumn("_cut", (F.pmod(F.xxhash64(rolling), F.lit(mean_rows)) == 0).cast("long"))
        .withColumn("_chunk", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_chunk", F.coalesce("_chunk", F.lit(0)))
        .drop("_cut")
    )


def buckets_for(left: DataFrame, right: DataFrame) -> int:
    """A bucket is sorted as a whole, so their number follows the larger side's size as the optimizer knows it; at least four a shuffle partition."""
    size = max(int(str(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for x in (left, right))
    return max(4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // BUCKET_BYTES, MOST_BUCKETS))


def copy_differences(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], only_left: str, only_right: str, buckets: int | None = None, mean_rows: int = 16, window: int = 2) -> DataFrame:
    """keys and difference: ``only_left``, ``only_right`` or the name of a field that differs. The sides come reduced (``holding``).

    buckets: the same on both sides; by default as many as keep one at about ``BUCKET_BYTES``. mean_rows: of a chunk. window: rows in the rolling hash.
    """
    buckets = buckets or buckets_for(left, right)
    sides = [cut(chunked(x, keys, fields, buckets, mean_rows, window)) for x in (left, right)]
    prints = [x.groupBy("_bucket", "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("_row")).alias("_a"), F.bit_xor("_row").alias("_b")) for x in sides]
    same = ["_bucket", "_n", "_a", "_b"]
    rest = []
    for x, mine, other in ((sides[0], prints[0], prints[1]), (sides[1], prints[1], prints[0])):
        unmatched = mine.join(other.select(*same), same, "left_anti").select("_bucket", "_chunk")
        rest.append(x.join(unmatched, ["_bucket", "_chunk"], "left_semi").select(*keys, F.struct(*fields).alias("_f")))
    a, b = rest[0].alias("a"), rest[1].alias("b")
    both = a.join(b, reduce(lambda p, q: p & q, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]), "full_outer")
    differs = F.array(*[F.when(~F.col(f"a._f.{f}").eqNullSafe(F.col(f"b._f.{f}")), F.lit(f)) for f in fields])
    return both.select(
        *[F.when(F.col("a._f").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys],
        F.explode(F.when(F.col("b._f").isNull(), F.array(F.lit(only_left))).when(F.col("a._f").isNull(), F.array(F.lit(only_right))).otherwise(F.array_compact(differs))).alias("difference"),
    )
