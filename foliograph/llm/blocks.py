"""A stated list of texts in blocks that a task can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_blocks(rows: DataFrame, keys: list[str], text: str, most_chars: int) -> list[DataFrame]:
    """The rows in blocks of at most ``most_chars`` characters of ``text`` each; a longer text is a block by itself (with rows equal to it).

    Blocks go by a hash, whose number of values grows until the largest block is small enough.
    """
    key = F.xxhash64(*keys)
    sized = rows.select(key.alias("k"), F.length(text).alias("n")).groupBy("k").agg(F.sum("n").alias("n"))
    alone = [r.k for r in sized.filter(F.col("n") > most_chars).select("k").collect()]
    rest = sized.filter(F.col("n") <= most_chars)
    n = max(1, -(-(rest.agg(F.sum("n")).first()[0] or 0) // most_chars))
    while n > 1 and not rest.groupBy(F.pmod("k", F.lit(n)).alias("b")).agg(F.sum("n").alias("n")).filter(F.col("n") > most_chars).isEmpty():
        n *= 2
    if n == 1 and not alone:
        return [rows]
    shared = rows.filter(~key.isin(*alone)) if alone else rows
    return [shared.filter(F.pmod(key, F.lit(n)) == i) for i in range(n)] + [rows.filter(key == k) for k in alone]
