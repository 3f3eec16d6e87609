import random

from functools import partial

from foliograph.llm import mixing
from foliograph.llm.mixing import step
from foliograph.llm.queries import TOKENIZERS

mixture = partial(mixing.mixture, folder=TOKENIZERS)


def test_step_keeps_the_balance():
    rng = random.Random(1)
    for _ in range(200):
        u = [[i, rng.uniform(0.05, 0.95), rng.randrange(1, 500)] for i in range(3)]
        p, x = sum(a[1] for a in u), sum(a[1] * a[2] for a in u)
        step(u, rng.random())
        assert abs(sum(a[1] for a in u) - p) < 1e-6 and abs(sum(a[1] * a[2] for a in u) - x) < 1e-3
        assert any(a[1] in (0.0, 1.0) for a in u) and all(0 <= a[1] <= 1 for a in u)


def test_shares_and_caps(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["đất"] * rng.randrange(1, 80)), ["Big-One", "big_one ", "BIG_ONE"][i % 3] if i < 3000 else "small" if i < 3200 else "untargeted" if i < 3300 else None) for i in range(3400)]
    rows += [(9001, None, "small"), (9002, "", "small"), (9003, "  ", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS repeats")
    targets = spark.createDataFrame([("big_one", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    for block in (50_000, 100):
        chosen, shares = mixture(docs, targets, block=block)
        by = {r.source: r for r in shares.collect()}
        assert by["absent"].actual_share == 0
        assert abs(by["big_one"].actual_share - 0.6 / 0.9) < 0.01 and abs(by["small"].actual_share - 0.3 / 0.9) < 0.01
        assert all(by[s].most_repeats <= by[s].max_repeats for s in by)
        got = chosen.collect()
        assert len({r.doc_id for r in got}) == len(got) and {r.source for r in got} == {"big_one", "small"}
    limited = {r.source: r for r in mixture(docs, targets, total_tokens=3000)[1].collect()}
    assert abs(sum(r.mixed_tokens for r in limited.values()) - 3000) < 300
    assert mixture(docs.limit(0), targets)[0].count() == 0
    assert mixture(docs, targets.limit(0))[1].count() == 0


def test_same_choice_again(spark):
    docs = spark.createDataFrame([(i, "chữ " * (i % 9 + 1), "a" if i % 2 else "b") for i in range(200)], "doc_id long, text string, source string").repartition(3)
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    a, b, c = ({(r.doc_id, r.repeats) for r in mixture(d, targets)[0].collect()} for d in (docs, docs, docs.repartition(7, "text")))
    assert a == b == c


def test_many_sources(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "repeat('chữ ', 1 + int(id % 9)) AS text", "concat('s', id % 300) AS source")
    targets = spark.range(300).selectExpr("concat('s', id) AS source", "1D / 300 AS target_share", "2 AS max_repeats")
    chosen, shares = mixture(docs, targets)
    assert shares.count() == 300 and shares.filter("most_repeats > 2").count() == 0 and chosen.count() > 300
