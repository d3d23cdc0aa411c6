"""Queries of the general problems (2 and 3), with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.operators.nested import child_table, flatten_records
from quillmark.operators.references import orphan_report, project_orphans
from quillmark.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return project_orphans(spark, folder).select("ref_table", "ref_field", "source_id", "record_id", "target_id")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(project_orphans(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return flatten_records(table(spark, folder, "raw_items"), values=False).select("raw_id", "child", "parent_pos", "pos").distinct()


#: flat table -> (child, columns as JSON paths)
CHILD_TABLES = {
    "p3_regions": ("region", {"page": "$.page", "box": "$.values"}),
    "p3_steps": ("step", {"tool": "$.tool", "version": "$.version", "parameters": "$.parameters"}),
    "p3_cells": ("cell", {"text": "$.text", "colspan": "$.colspan"}),
    "p3_warnings": ("warning", {"code": "$.code", "message": "$.message"}),
    "p3_entities": ("entity", {"name": "$.name", "type": "$.type"}),
    "p3_mentions": ("mention", {"start": "$.start", "stop": "$.end"}),
    "p3_relations": ("relation", {"subject": "$.subject", "predicate": "$.predicate", "object": "$.object"}),
}


def _child_query(name: str):
    child, fields = CHILD_TABLES[name]
    return lambda spark, folder: child_table(flatten_records(table(spark, folder, "raw_items"), kinds=(child,)), child, fields)


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found} | {n: _child_query(n) for n in CHILD_TABLES}

_BLANKS = r"'^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$', '', 'g'"


def _refs(name: str, field: str, record: str, moment: str, kind: str) -> str:
    return f"""SELECT DISTINCT '{name}' AS ref_table, '{field}' AS ref_field, source_id, record_id, '{kind}' AS kind, ref_at, regexp_replace(x, {_BLANKS}) AS target_id
    FROM (SELECT source_id, {record} AS record_id, ref_at, unnest({field}) AS x FROM (SELECT source_id, {record}, min({moment}) AS ref_at, arg_min({field}, {moment}) AS {field} FROM {name} GROUP BY 1, 2))
    WHERE x IS NOT NULL AND regexp_replace(x, {_BLANKS}) <> ''"""


_ORPHANS = f"""WITH refs AS ({_refs("chunks", "item_ids", "chunk_id", "ingested_at", "item")}
  UNION ALL {_refs("chunks", "asset_ids", "chunk_id", "ingested_at", "asset")}
  UNION ALL {_refs("package_items", "asset_ids", "item_id", "ingested_at", "asset")}
  UNION ALL {_refs("eval_cases", "evidence_item_ids", "id", "created_at", "item")}),
parents AS (SELECT 'item' AS kind, source_id, item_id AS target_id, ingested_at, deleted_at FROM package_items
  UNION ALL SELECT 'asset', source_id, asset_id, ingested_at, deleted_at FROM assets),
judged AS (SELECT r.ref_table, r.ref_field, r.source_id, r.record_id, r.target_id, r.ref_at,
  coalesce(bool_or(p.ingested_at <= r.ref_at AND (p.deleted_at IS NULL OR p.deleted_at > r.ref_at)), false) AS there,
  CASE WHEN count(p.target_id) = 0 THEN 'missing' WHEN bool_or(p.ingested_at <= r.ref_at) THEN 'deleted' ELSE 'late' END AS reason
  FROM refs r LEFT JOIN parents p USING (kind, source_id, target_id) GROUP BY ALL)
"""

def _unwrap(x: str) -> str:
    """The value of a part, also where it is written as JSON text."""
    return f"(CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({x}->>'$') THEN ({x}->>'$')::JSON END ELSE {x} END)"


def _elements(x: str) -> str:
    """The elements of an array with their places; an object is its own only one."""
    return f"(CASE json_type({x}) WHEN 'ARRAY' THEN list_transform(json_extract({x}, '$[*]'), lambda v, i: {{'v': v, 'pos': i}}) WHEN 'OBJECT' THEN [{{'v': {x}, 'pos': 1}}] ELSE [] END)"


def _unnest(name: str, source: str, array: str, keep: str = "raw_id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT {keep}, e.pos, e.v FROM (SELECT {keep}, unnest({_elements(array)}) AS e FROM {source})) WHERE coalesce(json_type(v), 'NULL') <> 'NULL')"


_CHILDREN = f"""WITH r AS (SELECT raw_id, {_unwrap("record::JSON")} AS j FROM raw_items WHERE json_valid(record)),
a AS (SELECT raw_id, {_unwrap("(j->'bbox')")} AS box, {_unwrap("(j->'provenance')")} AS prov, {_unwrap("(j->'content')")} AS content, j->'semantic' AS top FROM r),
b AS (SELECT raw_id, {_unwrap("(box->'regions')")} AS regions, {_unwrap("(prov->'steps')")} AS steps, {_unwrap("(content->'table')")} AS tab, CASE WHEN coalesce(json_type(content->'semantic'), 'NULL') <> 'NULL' THEN content->'semantic' ELSE top END AS s0 FROM a),
c AS (SELECT *, {_unwrap("s0")} AS sem FROM b),
d AS (SELECT raw_id, regions, steps, {_unwrap("(tab->'rows')")} AS rs, {_unwrap("(tab->'cells')")} AS cs, {_unwrap("(sem->'entities')")} AS entities, {_unwrap("(sem->'relations')")} AS relations FROM c),
{_unnest("region", "d", "regions")}, {_unnest("step", "d", "steps")}, {_unnest("entity", "d", "entities")}, {_unnest("relation", "d", "relations")}, {_unnest("rws", "d", "rs")}, {_unnest("cls", "d", "cs")},
w AS (SELECT raw_id, pos AS parent_pos, {_unwrap("(u->'warnings')")} AS x FROM (SELECT raw_id, pos, {_unwrap("v")} AS u FROM step)), m AS (SELECT raw_id, pos AS parent_pos, {_unwrap("(u->'mentions')")} AS x FROM (SELECT raw_id, pos, {_unwrap("v")} AS u FROM entity)),
o AS (SELECT raw_id, pos AS parent_pos, {_unwrap("v")} AS x FROM rws), {_unnest("warning", "w", "x", "raw_id, parent_pos")}, {_unnest("mention", "m", "x", "raw_id, parent_pos")}, {_unnest("cell", "o", "x", "raw_id, parent_pos")},
placed AS (SELECT raw_id, try_cast(u->>'row' AS DOUBLE) AS r, try_cast(u->>'col' AS DOUBLE) AS c, u AS v FROM (SELECT raw_id, {_unwrap("v")} AS u FROM cls)),
found AS (SELECT raw_id, 'region' AS child, 0 AS parent_pos, pos, v FROM region UNION ALL SELECT raw_id, 'step', 0, pos, v FROM step UNION ALL SELECT raw_id, 'entity', 0, pos, v FROM entity UNION ALL SELECT raw_id, 'relation', 0, pos, v FROM relation
  UNION ALL SELECT raw_id, 'warning', parent_pos, pos, v FROM warning UNION ALL SELECT raw_id, 'mention', parent_pos, pos, v FROM mention UNION ALL SELECT raw_id, 'cell', parent_pos, pos, v FROM cell
  UNION ALL SELECT raw_id, 'cell', r::INT + 1, c::INT + 1, v FROM placed WHERE r = floor(r) AND c = floor(c))
"""


def _child_sql(name: str) -> str:
    child, fields = CHILD_TABLES[name]
    cols = ", ".join(f"v->>'{path}' AS {c}" if path != "$.text" else f"coalesce(v->>'$.text', CASE WHEN json_type(v) = 'VARCHAR' THEN v->>'$' END) AS {c}" for c, path in fields.items())
    return _CHILDREN + f"SELECT raw_id, parent_pos, pos, {cols} FROM found WHERE child = '{child}'"


ORACLE = {n: _child_sql(n) for n in CHILD_TABLES} | {
    "p3_found": _CHILDREN + "SELECT DISTINCT raw_id, child, parent_pos, pos FROM found",
    "p2_found": _ORPHANS + "SELECT DISTINCT ref_table, ref_field, source_id, record_id, target_id FROM judged WHERE NOT there",
    "p2_report": _ORPHANS
    + """SELECT ref_table, ref_field, strftime(ref_at, '%Y-%m') AS period, count(*) AS orphans, count(*) FILTER (reason = 'missing') AS missing,
    count(*) FILTER (reason = 'deleted') AS deleted, count(*) FILTER (reason = 'late') AS late FROM judged WHERE NOT there GROUP BY 1, 2, 3""",
}
