"""Repeated consecutive events (glyphs drawn again at the same place), collapsed to one with count and extent.

Boundary interval lookup: the rows of an entity's chunk come sorted by ``seq``; the positions where a run starts make a sorted
array, every event finds its run there by binary search, and runs are aggregated at once. An entity is a (doc_id, page), its
chunks ranges of seq, so a hot page is many tasks' work. Only the first and last run of a chunk can go on beyond it: these, two rows a
chunk, are joined afterwards in a window over the entity.

Defined results: exactly repeated rows (the same seq) are one event; a null ch never repeats; null x0, top or size is near to
nothing; null doc_id or page is an entity; rows without seq are left out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.glyphstream import CHUNK, changes, codes, floats, near, streamed, whole_groups
from foliograph.session import cut

SHARE = 0.15
_RUN = "doc_id string, page int, first_seq long, last_seq long, n_glyphs int, head boolean, tail boolean, ch string, ax double, atop double, asize double, zx double, ztop double"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["doc_id", "page", "chunk"]):
        seq = t.column("seq").to_numpy()
        group = changes(t, ["doc_id", "page", "chunk"])
        keep = group.copy()
        keep[1:] |= seq[1:] != seq[:-1]
        if not keep.all():
            t, seq, group = t.filter(pa.array(keep)), seq[keep], group[keep]
        ch, x0, top, size = t.column("ch"), floats(t, "x0"), floats(t, "top"), floats(t, "size")
        c = codes(ch)
        known = ch.is_valid().to_numpy()
        again = np.zeros(len(seq), bool)
        again[1:] = ~group[1:] & (c[1:] == c[:-1]) & known[1:] & near(x0, top, size, SHARE)
        starts = np.flatnonzero(~again)  # sorted positions at which a run starts
        run = np.searchsorted(starts, np.arange(len(seq)), side="right") - 1  # each event's run
        n = np.bincount(run, minlength=len(starts)).astype(np.int32)
        ends = starts + n - 1
        head = group[starts]
        tail = np.append(head[1:], True)
        take = np.flatnonzero((n > 1) | head | tail)
        a, z = starts[take], ends[take]
        pick = pa.array(a)
        yield pa.RecordBatch.from_arrays(
            [*[_one(t.column(k).take(pick)) for k in ("doc_id", "page")], pa.array(seq[a]), pa.array(seq[z]), pa.array(n[take]), pa.array(head[take]), pa.array(tail[take]), _one(ch.take(pick)), *[_nullable(v) for v in (x0[a], top[a], size[a], x0[z], top[z])]],
            ["doc_id", "page", "first_seq", "last_seq", "n_glyphs", "head", "tail", "ch", "ax", "atop", "asize", "zx", "ztop"],
        )


def _one(a: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)


def _nullable(v: np.ndarray) -> pa.Array:
    return pa.array(v, from_pandas=True)


def glyph_runs(glyphs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, page, first_seq, last_seq, n_glyphs of every longest run of two or more."""
    runs = cut(streamed(glyphs, ["ch", "x0", "top", "size"], chunk).mapInArrow(_runs, _RUN))
    name = ["doc_id", "page", "first_seq", "last_seq", "n_glyphs"]
    inner = runs.filter(~F.col("head") & ~F.col("tail")).select(*name)
    w = Window.partitionBy("doc_id", "page").orderBy("first_seq")
    far = SHARE * F.col("asize") + 1e-9
    joins = F.lag("tail").over(w) & F.col("head") & (F.lag("ch").over(w) == F.col("ch")) & (F.abs(F.col("ax") - F.lag("zx").over(w)) <= far) & (F.abs(F.col("atop") - F.lag("ztop").over(w)) <= far)
    edges = runs.filter(F.col("head") | F.col("tail")).withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    whole = edges.groupBy("doc_id", "page", "_run").agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.sum("n_glyphs").cast("int").alias("n_glyphs"))
    return inner.unionByName(whole.filter("n_glyphs > 1").select(*name))
