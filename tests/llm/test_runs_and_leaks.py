import random

import numpy as np

from foliograph.llm.leaks import chars, leaks, suffix_ranks, without_leaks, words
from foliograph.llm.runs import glyph_runs
from tests.test_glyphs import GLYPH, glyph


def brute_runs(rows):
    out, seen = set(), {}
    for r in rows:
        seen[r[2]] = r
    by = {}
    for r in sorted(seen.values(), key=lambda r: r[2]):
        by.setdefault(r[:2], []).append(r)
    for (d, p), rs in by.items():
        run = [rs[0]]
        for a, b in [*zip(rs, rs[1:], strict=False), (rs[-1], None)]:
            near = b is not None and b[3] is not None and a[3] == b[3] and None not in (a[4], b[4], b[9]) and abs(a[4] - b[4]) <= 0.15 * b[9] + 1e-9 and abs(a[6] - b[6]) <= 0.15 * b[9] + 1e-9
            if near:
                run.append(b)
                continue
            if len(run) > 1:
                out.add((d, p, run[0][2], run[-1][2], len(run)))
            run = [b]
    return out


def test_runs_against_brute_force(spark):
    rng = random.Random(2)
    rows, seq = [], 0
    for page in (1, 1, 2, None):
        x = 50.0
        for _ in range(120):
            ch, n = rng.choice(["a", "b", None, "c"]), rng.choice([1, 1, 1, 2, 5])
            for _ in range(n):
                seq += rng.choice([1, 1, 3])
                rows.append((*glyph(ch, x + rng.uniform(0, 0.8), 50.0, seq=seq)[:1], page, *glyph(ch, x + rng.uniform(0, 0.8), 50.0, seq=seq)[2:]))
            x += 6
    want = brute_runs(rows)
    rows += rng.sample(rows, 40)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, GLYPH).withColumnRenamed("fontname", "first_seq")
    for chunk in (4, 16, 1 << 16):
        got = glyph_runs(df, chunk).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert glyph_runs(df.limit(0)).count() == 0


def test_suffix_ranks():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 3, 300)
    for depth in (1, 5, 12):
        r = suffix_ranks(t, depth)
        keys = [tuple(t[i : i + depth]) for i in range(len(t) - depth)]
        order = sorted(set(keys))
        assert [order.index(k) for k in keys] == list(np.unique(r[: len(keys)], return_inverse=True)[1])


def test_words():
    assert words("Straße, ÉCOLE 3.5 của") == ["strasse", "école", "3", "5", "của"]
    assert chars("盐 a-b。") == ["盐", "a", "b"]


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, "en" if i % 3 else "zh", " ".join(rng.choices(vocabulary, k=60)) if i % 3 else "".join(chr(0x4E00 + rng.randrange(60)) for _ in range(80))) for i in range(9)]
    docs = [(0, None), (1, ""), (2, items[1][2].upper()), (3, items[1][2] + " x " + items[2][2])]
    for k in range(4, 60):
        i, lang, t = rng.choice(items)
        parts = t.split() if lang == "en" else list(t)
        n = rng.choice([8, 11, 12, 13, 23, 24, 25])
        a = rng.randrange(len(parts) - n)
        cut = parts[a : a + n]
        docs.append((k, "prefix " + ("  \n".join(cut) if lang == "en" else "，".join(cut)) + " suffix " + " ".join(rng.choices(vocabulary, k=20))))
    want = set()
    for i, lang, t in items:
        cut, n = (words, 12) if lang == "en" else (chars, 24)
        grams = {tuple(cut(t)[k : k + n]) for k in range(len(cut(t)) - n + 1)}
        for d, x in docs:
            tokens = cut(x or "")
            if any(tuple(tokens[k : k + n]) in grams for k in range(len(tokens) - n + 1)):
                want.add((d, i))
    documents = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'z' AS item_id")
    table = spark.createDataFrame(items + items[:2] + [(99, "en", None)], "item_id long, lang string, text string")
    for kw in ({}, {"shard": 30}, {"block_chars": 900}):
        found = leaks(documents, table, **kw)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    longest = found.filter("doc_id = 2 AND item_id = 1").first()
    assert (longest.n_tokens, longest.doc_token, longest.item_token) == (60, 0, 0)
    assert without_leaks(documents, found).filter("doc_id IN (2, 3)").count() == 0
    assert leaks(documents.limit(0), table).count() == 0 and leaks(documents, table.limit(0)).count() == 0


def test_a_text_that_repeats_itself_is_no_product(spark):
    from foliograph.llm.leaks import shard_matches

    doc, item = np.zeros(30_000, np.int64), np.zeros(20_000, np.int64)
    found = list(shard_matches([doc], [item], 12))
    assert max(n for _, _, n, _, _ in found) == 20_000 and len(found) <= 50_000
    docs = spark.createDataFrame([(1, "w " * 3000), (2, "w " * 11)], "doc_id long, text string")
    assert {r.doc_id for r in leaks(docs, spark.createDataFrame([(1, "en", "w " * 2000)], "item_id long, lang string, text string")).collect()} == {1}


def test_longest_matches_against_brute_force():
    from foliograph.llm.leaks import shard_matches

    rng = np.random.default_rng(3)
    for depth in (1, 3, 12):
        docs, items = [rng.integers(0, 2, n) for n in (0, 1, 40, 70)], [rng.integers(0, 2, n) for n in (0, 5, 60)]
        want = set()
        for d, a in enumerate(docs):
            for i, b in enumerate(items):
                for x in range(len(a)):
                    for y in range(len(b)):
                        if x and y and a[x - 1] == b[y - 1]:
                            continue
                        n = 0
                        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                            n += 1
                        if n >= depth:
                            want.add((d, i, n, x, y))
        got = list(shard_matches(docs, items, depth))
        assert set(got) == want and len(got) == len(want)


def test_blocks_are_bounded(spark):
    from pyspark.sql import functions as F

    from foliograph.llm.blocks import bounded_blocks

    items = spark.createDataFrame([(i, "x" * (1 + i % 90)) for i in range(300)] + [(999, "y" * 5000)], "k long, t string")
    blocks = bounded_blocks(items, ["k", "t"], "t", 4000)
    sizes = [b.agg(F.sum(F.length("t")), F.count("*")).first() for b in blocks]
    assert all((n or 0) <= 4000 or c == 1 for n, c in sizes) and sum(c for _, c in sizes) == 301
