"""Glyph rows in drawing order, streamed through Arrow in bounded chunks of a page.

A page's rows are spread by ranges of ``seq`` (``CHUNK`` wide), so neither a large file nor a large page makes a large task,
and sorted inside the shuffle's partitions; Python then sees flat, sorted columns batch by batch. Where an operator needs the
neighbourhood of a row (its line), rows within ``PAD`` of a chunk's end also go to the chunk beside it as context, and each
result is taken from the row's own chunk only. A chunk with a line that reaches to the end of its context is read again with a wider one
(``by_lines``), so no line is seen cut. Neighbours in a line are taken to lie at most ``PAD`` apart in seq.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.session import cut

CHUNK, PAD, WIDER = 1 << 16, 1 << 10, 16
#: Columns of a chunk that has to be read again; null in results.
OPEN = "open_doc string, open_page int, open_chunk long"


def streamed(glyphs: DataFrame, columns: list[str], chunk: int = CHUNK, pad: int = 0, chunks: DataFrame | None = None) -> DataFrame:
    """doc_id, page, chunk, seq and ``columns``, sorted by these in partitions that hold whole chunks. Rows without a seq have no place and are left out.

    chunks: (doc_id, page, chunk) to read only.
    """
    rows = glyphs.filter(F.col("seq").isNotNull())
    if pad:
        rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("seq") - pad) / chunk).cast("long"), F.floor((F.col("seq") + pad) / chunk).cast("long"))))
    else:
        rows = rows.withColumn("chunk", F.floor(F.col("seq") / chunk).cast("long"))
    names = ["doc_id", "page", "chunk", "seq"]
    rows = rows.select(*names, *columns)
    if chunks is not None:
        c = chunks.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("chunk").alias("_c"))
        rows = rows.join(c, rows["doc_id"].eqNullSafe(c["_d"]) & rows["page"].eqNullSafe(c["_p"]) & (rows["chunk"] == c["_c"]), "left_semi")
    return rows.repartition("doc_id", "page", "chunk").sortWithinPartitions(*names)


def by_lines(glyphs: DataFrame, columns: list[str], kernel: Callable[[int], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]], schema: str, chunk: int = CHUNK, pad: int = PAD) -> DataFrame:
    """What the kernel finds in whole lines: ``schema``. The kernel, made for a width of context, gives the columns OPEN besides, for chunks that
    hold a line cut short (``Lines.open``)."""
    names = [c.split()[0] for c in schema.split(", ")]
    found, todo = [], None
    while True:
        out = cut(streamed(glyphs, columns, chunk, pad, todo).mapInArrow(kernel(pad), f"{schema}, {OPEN}"))
        found.append(out.filter("open_chunk IS NULL").select(*names))
        todo = out.filter("open_chunk IS NOT NULL").select(F.col("open_doc").alias("doc_id"), F.col("open_page").alias("page"), F.col("open_chunk").alias("chunk")).distinct()
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, found)
        pad *= WIDER


def with_open(columns: list[pa.Array], names: list[str], lines: Lines) -> pa.RecordBatch:
    """A kernel's results, and the chunks to read again."""
    n, t = len(lines.open), lines.table
    rows = pa.array(lines.open, pa.int64())
    size = len(columns[0])
    out = [pa.concat_arrays([c, pa.nulls(n, c.type)]) for c in columns]
    for k in ("doc_id", "page", "chunk"):
        own = t.column(k).take(rows)
        out.append(pa.concat_arrays([pa.nulls(size, own.type), *own.chunks]))
    return pa.RecordBatch.from_arrays(out, [*names, "open_doc", "open_page", "open_chunk"])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group of equal ``keys`` (adjacent rows) ends; as large as a batch, or as the largest group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = changes(b, keys)
        new[0] = False
        at = np.flatnonzero(new)
        if not len(at):
            if held and differs(held[-1], b, keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b)
            continue
        last = int(at[-1])
        if held and differs(held[-1], b, keys):
            yield pa.Table.from_batches(held)
            held = []
        yield pa.Table.from_batches([*held, b.slice(0, last)])
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def codes(a: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Whole numbers that are equal where the values are; null is a value."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
        if isinstance(a, pa.ChunkedArray):
            a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    return a.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def changes(b: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from the row's before it; True for the first row."""
    out = np.zeros(b.num_rows, bool)
    out[:1] = True
    for k in keys:
        c = codes(b.column(k))
        out[1:] |= c[1:] != c[:-1]
    return out


def differs(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return any(a.column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys)


def floats(b: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return np.asarray(b.column(name).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(name).to_numpy(), dtype=float)


def near(x0: np.ndarray, top: np.ndarray, size: np.ndarray, share: float) -> np.ndarray:
    """For each row but the first: at most ``share`` of its size from the row before it, in x0 and in top. A null is near to nothing."""
    far = share * size[1:] + 1e-9
    with np.errstate(invalid="ignore"):
        return (np.abs(np.diff(x0)) <= far) & (np.abs(np.diff(top)) <= far)


class Lines:
    """The drawn lines of a sorted table of glyphs (whole chunks): for line k the rows ``start[k] : end[k]``.

    A line ends where the pen jumps: across both axes, back along the line, or far ahead. ``again`` marks rows that draw the
    character before them a second time at the same place; ``home`` rows that are no context. Exact repeats are dropped.
    ``whole`` lines belong to a chunk none of whose own lines goes on beyond its context; ``open`` are the first rows of the other chunks.
    """

    def __init__(self, t: pa.Table, chunk: int, pad: int = 0, gap: int = PAD, again_share: float = 0.15):
        seq = t.column("seq").to_numpy()
        group = changes(t, ["doc_id", "page", "chunk"])
        keep = group.copy()
        keep[1:] |= seq[1:] != seq[:-1]
        if not keep.all():
            t, seq, group = t.filter(pa.array(keep)), seq[keep], group[keep]
        self.table, self.seq = t, seq
        x0, top = floats(t, "x0"), floats(t, "top")
        size = floats(t, "size")
        self.ch = t.column("ch").to_pylist()
        s = np.where(np.isnan(size) | (size <= 0), 12.0, size)[1:]
        dx, dy = np.diff(x0), np.diff(top)
        ax, ay = np.abs(dx), np.abs(dy)
        with np.errstate(invalid="ignore"):
            jump = (np.minimum(ax, ay) > 0.6 * s) | ((ay <= 0.6 * s) & ((dx < -0.55 * s) | (dx > 2.5 * s))) | ((ax <= 0.6 * s) & (ay > 1.2 * s)) | np.isnan(ax) | np.isnan(ay)
        new = group.copy()
        new[1:] |= jump
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], len(seq))
        self.again = np.zeros(len(seq), bool)
        if len(seq):
            c = codes(t.column("ch"))
            self.again[1:] = ~new[1:] & (c[1:] == c[:-1]) & near(x0, top, size, again_share)
        self.home = np.floor_divide(seq, chunk) == t.column("chunk").to_numpy()
        first = np.flatnonzero(group)
        number = np.cumsum(group) - 1
        last = np.append(first[1:], len(seq)) - 1
        self.whole, self.open = np.ones(len(self.start), bool), []
        if len(seq) and not self.home.all():
            of = number[self.start]
            own = np.logical_or.reduceat(self.home, self.start)
            low = t.column("chunk").to_numpy()[self.start] * chunk - pad
            # A row at the end of its context, and near enough to that end for a neighbour beyond it.
            at_start = (self.start == first[of]) & ~self.home[self.start] & (seq[self.start] - low < gap)
            at_end = (self.end - 1 == last[of]) & ~self.home[self.end - 1] & (low + chunk + 2 * pad - seq[self.end - 1] <= gap)
            short = own & (at_start | at_end)
            bad = np.unique(of[short])
            self.whole = ~np.isin(of, bad)
            self.open = first[bad].tolist()
