"""Evaluation texts leaking into training text, by suffix arrays over shards of the corpus.

Documents stream through Arrow; every ``SHARD`` tokens make a shard with a suffix array of its own, built by prefix doubling on
whole token ranks together with the evaluation items' tokens, so that both share one order. Doubling ends at the least length of a match:
suffixes that agree in so many tokens are matches in any order, so their order beyond that isn't needed. Every evaluation suffix is
binary-searched in the shard's array; the equal range, without the places where the match begins earlier, gives every longest match, whose
length the ranks of the doubling tell.
Nothing is shuffled but the few matches. A document longer than a shard is a shard by itself.

The items are a stated query set: they go to the tasks in blocks of at most ``BLOCK_CHARS`` characters, as many passes as
that takes, so what a task holds is bounded whatever their number.

Tokens are words (longest stretches of letters and digits, NFC, casefolded), or for items in a script without
word gaps (zh, ja) single letters and digits. Such items can only match where ``min_chars`` tokens run on; documents that have no
token of the items' own scripts are passed by where the items have no stretch that long outside them, which is checked.

Defined results: null and empty texts match nothing; repeated rows give repeated matches (``p6_found`` is distinct); other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.blocks import bounded_blocks

MIN_WORDS, MIN_CHARS, SHARD, BLOCK_CHARS = 12, 24, 400_000, 4_000_000
UNSPACED = ("zh", "ja")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_CHAR = regex.compile(r"[\p{L}\p{N}]")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_SPAN = regex.compile(r"[\p{L}\p{N}]+")


def folded(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


def words(text: str) -> list[str]:
    return _WORD.findall(folded(text))


def chars(text: str) -> list[str]:
    return list("".join(_WORD.findall(folded(text))))


def rank_levels(tokens: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """By prefix doubling, for 1, 2, 4, … up to ``depth`` tokens: the rank of each position's next so many tokens among all positions; 0 is past the end.

    Stretches that meet a separator (a token that occurs once) differ from all others.
    """
    rank, have = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1, 1
    levels = [(1, rank)]
    while have < depth:
        step = min(have, depth - have)
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        rank = np.unique(rank * (rank.max() + 1) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        have += step
        levels.append((have, rank))
    return levels


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each position's next ``depth`` tokens among all positions."""
    return rank_levels(tokens, depth)[-1][1]


def shard_matches(docs: list[np.ndarray], items: list[np.ndarray], depth: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, tokens in the match, its first token in the document, in the item) of every longest match of ``depth`` or more.

    Suffixes are ordered by their first ``depth`` tokens, and those that agree in them by the token before: so of an equal range only the
    places where the match can't begin a token earlier are taken. A text that repeats itself has few of these.
    """
    joined, owner, place, sep = [], [], [], -1
    for side in (docs, items):
        for i, t in enumerate(side):
            joined += [t, np.array([sep])]
            sep -= 1
            owner.append(np.full(len(t) + 1, i))
            place.append(np.arange(len(t) + 1))
    if not joined:
        return
    split = sum(len(t) + 1 for t in docs)
    levels = rank_levels(np.concatenate(joined), depth)
    one, rank = levels[0][1], levels[-1][1]
    owner, place = np.concatenate(owner), np.concatenate(place)
    before = np.concatenate([[0], one[:-1]])
    wide = one.max() + 1
    corpus, query = rank[:split], rank[split:]
    order = np.lexsort((before[:split], corpus))  # the shard's suffix array
    ordered = corpus[order] * wide + before[:split][order]
    low, high = np.searchsorted(ordered, query * wide, "left"), np.searchsorted(ordered, (query + 1) * wide, "left")
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return
    # Without those with the same token before: what lies before them in the range, and what lies after.
    same = query[hit] * wide + before[split:][hit]
    a, z = np.searchsorted(ordered, same, "left"), np.searchsorted(ordered, same, "right")
    starts, n = np.concatenate([low[hit], z]), np.concatenate([a - low[hit], high[hit] - z])
    q = np.repeat(np.concatenate([hit, hit]), n)
    x = order[np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    y = split + q
    # How far each match goes on: whole depths first, then the smaller levels.
    length = np.full(len(x), depth)
    going = np.arange(len(x))
    for size, r in [levels[-1], *levels[::-1]]:
        going = np.arange(len(x)) if size < depth else going
        while len(going):
            i, j = x[going] + length[going], y[going] + length[going]
            inside = (i < len(r)) & (j < len(r))
            on = np.zeros(len(going), bool)
            on[inside] = r[i[inside]] == r[j[inside]]
            going = going[on]
            length[going] += size
            if size < depth:
                break
    yield from zip(owner[x].tolist(), owner[y].tolist(), length.tolist(), place[x].tolist(), place[y].tolist(), strict=True)


class _Kind:
    """One way to cut tokens, the items that use it, and the shard being filled."""

    def __init__(self, cut, items: list[tuple[int, str]], depth: int):
        self.cut, self.depth, self.vocabulary = cut, depth, {}
        self.ids, self.items = [i for i, _ in items], []
        for _, t in items:
            v = self.vocabulary
            self.items.append(np.array([v.setdefault(w, len(v)) for w in cut(t)], dtype=np.int64))
        self.clear()

    def clear(self) -> None:
        self.docs, self.tokens, self.size = [], [], 0

    def add(self, doc: int, text: str) -> None:
        get = self.vocabulary.get
        t = np.array([get(w, -1) for w in self.cut(text)], dtype=np.int64)
        # A stretch holds no token that no item has, so each of those may end it.
        known = np.flatnonzero(t >= 0)
        if len(known) < self.depth:
            return
        t = np.where(t < 0, 1 << 40, t)
        odd = t == 1 << 40
        t[odd] += np.arange(odd.sum()) + self.size
        self.docs.append(doc)
        self.tokens.append(t)
        self.size += len(t)

    def flush(self) -> list[tuple]:
        out = [(self.docs[d], self.ids[i], n, x, y) for d, i, n, x, y in shard_matches(self.tokens, self.items, self.depth)] if self.docs else []
        self.clear()
        return out


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, shard: int = SHARD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_tokens, doc_token, item_token: every longest verbatim match, with places counted in tokens."""
    items = items.filter(F.col("text").isNotNull()).select("item_id", "lang", "text").distinct()
    out = None
    for block in bounded_blocks(items, ["item_id", "lang", "text"], "text", block_chars):
        one = _pass(documents, [tuple(r) for r in block.collect()], min_words, min_chars, shard)
        out = one if out is None else out.unionByName(one)
    return out


def _pass(documents: DataFrame, block: list[tuple], min_words: int, min_chars: int, shard: int) -> DataFrame:
    spaced = [(i, t) for i, lang, t in block if lang not in UNSPACED]
    unspaced = [(i, t) for i, lang, t in block if lang in UNSPACED]
    # A match of min_chars tokens holds a wide letter if no item has that many others in a row.
    only_wide = all(len(x) < min_chars for _, t in unspaced for x in _WIDE.split("".join(chars(t))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [_Kind(words, spaced, min_words), _Kind(chars, unspaced, min_chars)]

        def result(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([],) * 5)], ["doc_id", "item_id", "n_tokens", "doc_token", "item_token"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                if kinds[0].items:
                    kinds[0].add(d, t)
                if kinds[1].items and (not only_wide or _WIDE.search(t)):
                    kinds[1].add(d, t)
                for k in kinds:
                    if k.size >= shard:
                        yield result(k.flush())
        for k in kinds:
            yield result(k.flush())

    return documents.select("doc_id", "text").mapInArrow(search, "doc_id long, item_id long, n_tokens long, doc_token long, item_token long")


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold no match."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
