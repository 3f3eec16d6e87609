"""Queries of the general problems (nested records, copies)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators.copydiff import copy_differences, holding
from foliograph.operators.nested import dewey_nodes, with_paths
from foliograph.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every ParsedDocument with its parent."""
    nodes = dewey_nodes(table(spark, sf_dir, "parsed_docs"), bodies=False).distinct()
    return with_paths(nodes).select("record_id", "node_kind", "node_path", "parent_path")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys missing on either side, and the fields that differ."""
    keys, fields = ["doc_id", "path"], ["value", "location", "page"]
    a = holding(table(spark, sf_dir, "claims"), keys, fields, "recorded_at", "claim_id")
    b = holding(table(spark, sf_dir, "claims_copy"), keys, fields, "recorded_at", "copy_id")
    return copy_differences(a, b, keys, fields, "only_in_claims", "only_in_copy")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p3_found": p3_found}

def _listed(j: str, scalars: bool) -> str:
    """A JSON value as a list: an object alone is a list of one, and a text or number where they may stand; null is none."""
    return f"CASE json_type({j}) WHEN 'ARRAY' THEN {j}->'$[*]' WHEN 'NULL' THEN [] WHEN 'OBJECT' THEN [{j}] ELSE {f'[{j}]' if scalars else '[]'} END"


#: The nested parts of every record as relations.
NODES_SQL = f"""
WITH RECURSIVE d(record_id, j) AS (
    SELECT record_id, CAST(payload AS JSON) FROM (SELECT record_id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM parsed_docs) WHERE payload IS NOT NULL
    UNION ALL
    SELECT record_id, unnest(CASE json_type(j) WHEN 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN [CAST(j->>'$' AS JSON)] ELSE [] END WHEN 'ARRAY' THEN j->'$[*]' ELSE j->'$.*' END)
    FROM d WHERE json_type(j) IN ('VARCHAR', 'ARRAY') OR json_type(j) = 'OBJECT' AND NOT list_has_any(json_keys(j), ['preface', 'sections', 'tables', 'signature_columns', 'page_footers'])
),
docs AS (SELECT record_id, j FROM d WHERE json_type(j) = 'OBJECT' AND list_has_any(json_keys(j), ['preface', 'sections', 'tables', 'signature_columns', 'page_footers'])),
sl AS (SELECT record_id, {_listed("(j->'$.sections')", False)} AS l FROM docs),
sec AS (SELECT record_id, i - 1 AS i, l[i] AS s FROM sl, generate_series(1, len(l)) AS g(i) WHERE json_type(l[i]) <> 'NULL'),
b0 AS (SELECT record_id, 'preface' AS path, 'preface' AS parent, j->'$.preface' AS b FROM docs UNION ALL SELECT record_id, 'sections[' || i || '].block', 'sections[' || i || ']', s->'$.block' FROM sec),
b1 AS (SELECT record_id, path, parent, CASE WHEN json_type(b) = 'ARRAY' AND json_array_length(b) = 1 THEN b->'$[0]' ELSE b END AS b FROM b0),
b2 AS (
    SELECT record_id, 'field' AS kind, path || '.fields' AS path, parent, {_listed("(b->'$.fields')", False)} AS l FROM b1
    UNION ALL SELECT record_id, 'paragraph', path || '.paragraphs', parent, {_listed("(b->'$.paragraphs')", True)} FROM b1
    UNION ALL SELECT record_id, 'item', path || '.items', parent, {_listed("(b->'$.items')", True)} FROM b1
),
t0 AS (SELECT record_id, 'tables' AS path, '' AS parent, j->'$.tables' AS t FROM docs UNION ALL SELECT record_id, 'sections[' || i || '].tables', 'sections[' || i || ']', s->'$.tables' FROM sec),
t1 AS (SELECT record_id, path, parent, {_listed("t", False)} AS l FROM t0),
t AS (SELECT record_id, path || '[' || (i - 1) || ']' AS path, parent, l[i] AS t FROM t1, generate_series(1, len(l)) AS g(i) WHERE json_type(l[i]) <> 'NULL'),
r1 AS (SELECT record_id, path AS parent, {_listed("(t->'$.rows')", False)} AS l FROM t),
r AS (SELECT record_id, parent || '.rows[' || (i - 1) || ']' AS path, parent, l[i] AS r FROM r1, generate_series(1, len(l)) AS g(i) WHERE json_type(l[i]) <> 'NULL'),
c1 AS (SELECT record_id, path AS parent, {_listed("r", True)} AS l FROM r)
"""

SQL = {
    "p1_found": NODES_SQL + """SELECT DISTINCT * FROM (
    SELECT record_id, 'section' AS node_kind, 'sections[' || i || ']' AS node_path, '' AS parent_path FROM sec
    UNION ALL SELECT record_id, kind, path || '[' || (i - 1) || ']', parent FROM b2, generate_series(1, len(l)) AS g(i) WHERE json_type(l[i]) <> 'NULL'
    UNION ALL SELECT record_id, 'table', path, parent FROM t
    UNION ALL SELECT record_id, 'row', path, parent FROM r
    UNION ALL SELECT record_id, 'cell', parent || '[' || (i - 1) || ']', parent FROM c1, generate_series(1, len(l)) AS g(i) WHERE json_type(l[i]) <> 'NULL'
)
""",
    "p3_found": """
WITH a AS (SELECT doc_id, path, value, location, page FROM claims QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY recorded_at DESC NULLS LAST, claim_id DESC NULLS LAST) = 1),
b AS (SELECT doc_id, path, value, location, page FROM claims_copy QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY recorded_at DESC NULLS LAST, copy_id DESC NULLS LAST) = 1),
j AS (SELECT a.doc_id AS ad, a.path AS ap, b.doc_id AS bd, b.path AS bp, a.value AS av, b.value AS bv, a.location AS al, b.location AS bl, a.page AS apg, b.page AS bpg
      FROM a FULL OUTER JOIN b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.path IS NOT DISTINCT FROM b.path)
SELECT ad AS doc_id, ap AS path, 'only_in_claims' AS difference FROM j WHERE bd IS NULL AND bp IS NULL
UNION ALL SELECT bd, bp, 'only_in_copy' FROM j WHERE ad IS NULL AND ap IS NULL
UNION ALL SELECT ad, ap, 'value' FROM j WHERE ad IS NOT NULL AND bd IS NOT NULL AND av IS DISTINCT FROM bv
UNION ALL SELECT ad, ap, 'location' FROM j WHERE ad IS NOT NULL AND bd IS NOT NULL AND al IS DISTINCT FROM bl
UNION ALL SELECT ad, ap, 'page' FROM j WHERE ad IS NOT NULL AND bd IS NOT NULL AND apg IS DISTINCT FROM bpg
""",
}
