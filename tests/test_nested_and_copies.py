import json
import random

from foliograph.operators.copydiff import copy_differences, holding
from foliograph.operators.nested import PARSED_DOCUMENT, dewey_nodes, flat_tables, parsed, schema_paths, tables_of, with_paths

DOC = {
    "preface": {"fields": {"label": "A"}, "paragraphs": [None, "p"], "items": None},
    "sections": [
        {"number": "I", "title": {"value": "T"}, "block": {"fields": [None, {"label": {"value": "L"}, "value": None}], "items": ["i"]}, "tables": {"page": 1, "rows": [["", {"value": "x"}, None], [], None]}},
        None,
    ],
    "tables": [{"rows": [[1]]}],
    "signature_columns": [["s"]],
    "page_footers": ["f"],
}
PATHS = {
    ("field", "preface.fields[0]", "preface"), ("paragraph", "preface.paragraphs[1]", "preface"), ("section", "sections[0]", ""), ("field", "sections[0].block.fields[1]", "sections[0]"),
    ("item", "sections[0].block.items[0]", "sections[0]"), ("table", "sections[0].tables[0]", "sections[0]"), ("row", "sections[0].tables[0].rows[0]", "sections[0].tables[0]"),
    ("cell", "sections[0].tables[0].rows[0][0]", "sections[0].tables[0].rows[0]"), ("cell", "sections[0].tables[0].rows[0][1]", "sections[0].tables[0].rows[0]"),
    ("row", "sections[0].tables[0].rows[1]", "sections[0].tables[0]"), ("table", "tables[0]", ""), ("row", "tables[0].rows[0]", "tables[0]"), ("cell", "tables[0].rows[0][0]", "tables[0].rows[0]"),
}


def paths_by_record(nodes):
    by = {}
    for r in with_paths(nodes).collect():
        by.setdefault(r.record_id, set()).add((r.node_kind, r.node_path, r.parent_path))
    return by


def test_nodes_in_any_wrapping(spark):
    s = json.dumps(DOC, ensure_ascii=False)
    payloads = [s, json.dumps(s), json.dumps([DOC]), json.dumps({"document": DOC, "schema": 2}), s[:-3], "", None, "null", "[]", json.dumps(DOC, indent=1)]
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "record_id long, payload string, node_path string")
    nodes = dewey_nodes(df)
    assert paths_by_record(nodes) == paths_by_record(dewey_nodes(df, bodies=False)) == {i: PATHS for i in (0, 1, 2, 3, 9)}
    first = nodes.filter("record_id = 0")
    flat = flat_tables(first)
    assert set(flat) == set(schema_paths(PARSED_DOCUMENT))
    assert [(r.number, r.title) for r in flat["sections"].collect()] == [("I", "T")]
    assert [r.label for r in flat["preface.fields"].collect()] == ["A"] and [r.label for r in flat["sections.block.fields"].collect()] == ["L"]
    assert sorted(r.text or "" for r in flat["sections.tables.rows[]"].collect()) == ["", "x"] and [r.text for r in flat["tables.rows[]"].collect()] == ["1"]
    assert {tuple(r.dewey) for r in tables_of(first, "cell").collect()} == {(0, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0)}
    assert dewey_nodes(df.limit(0)).count() == 0


def test_envelopes_of_any_depth_and_blanks_around(spark):
    deep, texts, wide = DOC, json.dumps(DOC), DOC
    for _ in range(40):
        deep = {"document": deep}
    for _ in range(9):
        texts = "\n " + json.dumps(texts)
    for _ in range(20):
        wide = {"payload": "  \t" + json.dumps({"inner": wide})} if len(json.dumps(wide)) < 200_000 else wide
    bottomless = "[" * 50_000 + json.dumps(DOC) + "]" * 50_000
    payloads = [json.dumps(deep), texts, json.dumps(wide), "\ufeff " + json.dumps(DOC), bottomless, bottomless[:-1], "[" * 50_000]
    df = spark.createDataFrame(list(enumerate(payloads)), "record_id long, payload string")
    assert paths_by_record(dewey_nodes(df, bodies=False)) == {i: PATHS for i in range(5)}


def test_parser_with_a_stack():
    from foliograph.operators.nested import _parsed_deep

    good = [DOC, [], {}, [1, -2.5e3, True, None, "a\\\"b,]}"], {"a": {"b": [[]]}, "c": ""}, "text", 0]
    for x in good:
        assert _parsed_deep(json.dumps(x)) == _parsed_deep(json.dumps(x, indent=2)) == x
    for bad in ("", "[1,]", "{,}", '{"a"}', '{"a":1,}', "[1 2]", "]", "[}", '{"a":1]', "1 2", '"a', "{1:2}", "[,1]", "nul"):
        for read in (parsed, _parsed_deep):
            try:
                read(bad)
            except ValueError:
                continue
            raise AssertionError(bad)


SIDE = "id long, k string, p string, v string, n int, at timestamp, other string"


def test_differences_against_brute_force(spark):
    rng = random.Random(3)
    a = {(f"d{i // 40}", None if i % 97 == 0 else f"p{i}"): (rng.choice(["x", "y", None]), i % 5 or None) for i in range(2000)}
    b = dict(a)
    for k in rng.sample(sorted(a, key=str), 60):
        b[k] = ("changed", b[k][1]) if rng.random() < 0.5 else (b[k][0], 99)
    for k in rng.sample(sorted(a, key=str), 40):
        b.pop(k, None)
    b |= {("new", str(i)): ("z", 1) for i in range(15)}
    want = {(*k, "only_a") for k in a.keys() - b.keys()} | {(*k, "only_b") for k in b.keys() - a.keys()} | {(*k, f) for k in a.keys() & b.keys() for i, f in enumerate("vn") if a[k][i] != b[k][i]}

    def side(rows):
        import datetime as dt

        new, old = dt.datetime(2024, 2, 1), dt.datetime(2024, 1, 1)
        data = [(i, *k, *v, new, "o") for i, (k, v) in enumerate(rows.items())]
        data += [(i + 5000, *k, "old", 7, old, "o") for i, k in enumerate(list(rows)[:100])] + data[:50]
        rng.shuffle(data)
        return holding(spark.createDataFrame(data, SIDE), ["k", "p"], ["v", "n"], "at", "id")

    for mean in (1, 4, 100):
        out = copy_differences(side(a), side(b), ["k", "p"], ["v", "n"], "only_a", "only_b", buckets=8, mean_rows=mean).collect()
        assert len(out) == len(want) and {tuple(r) for r in out} == want
    empty = side(a).limit(0)
    assert copy_differences(side(a), empty, ["k", "p"], ["v", "n"], "only_a", "only_b").count() == len(a)
    assert copy_differences(empty, empty, ["k", "p"], ["v", "n"], "only_a", "only_b").count() == 0
