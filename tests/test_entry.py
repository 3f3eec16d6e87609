import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_queries_and_sql_agree_in_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_the_subpackage():
    for f in (ROOT / "foliograph").rglob("*.py"):
        if "llm" in f.relative_to(ROOT / "foliograph").parts:
            continue
        for n in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
            assert not any("llm" in x for x in names), f


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "total_values", "verbatim_values", "unverified_paths", "ratio"] and df.count() > 0
