"""Registered queries: nested merges and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitalake.operators import nested
from vitalake.plans import views as v
from vitalake.plans.registry import query

#: Two nested documents per order, as one text that both engines read: members come and go, change their kind, and nest three levels deep; some records have one side only.
OLD = """CASE WHEN o_orderkey % 13 <> 1 THEN '{"audio":{"notes":["a' || o_orderkey % 4 || '","b"],"team":{"lead":"clerk ' || o_orderkey % 97 || '","size":' || o_orderkey % 7 ||
  CASE WHEN o_orderkey % 3 = 0 THEN ',"tags":["x","' || o_orderpriority || '","x"]' ELSE '' END || '}},"empty":' ||
  CASE o_orderkey % 5 WHEN 0 THEN 'null' WHEN 1 THEN '""' WHEN 2 THEN '[]' WHEN 3 THEN '{}' ELSE '"kept"' END ||
  ',"events":[{"at":"' || o_orderkey % 11 || '","n":' || o_orderkey % 2 || '}],"status":"' || o_orderstatus || '"' ||
  CASE WHEN o_orderkey % 6 = 0 THEN ',"turn":{"a":{"b":1}}' WHEN o_orderkey % 6 = 1 THEN ',"turn":[1,2]' ELSE ',"turn":"plain"' END || '}' END"""
NEW = """CASE WHEN o_orderkey % 17 <> 1 THEN '{"audio":{"notes":["b","c' || o_custkey % 3 || '","c' || o_custkey % 3 || '"],"team":{' ||
  CASE WHEN o_custkey % 2 = 0 THEN '"lead":"clerk ' || o_custkey || '",' WHEN o_custkey % 3 = 0 THEN '"lead":"",' ELSE '' END ||
  '"size":' || o_orderkey % 7 || ',"tags":' || CASE WHEN o_custkey % 4 = 0 THEN '[]' ELSE '["' || o_orderpriority || '","new"]' END || ',"zone":null}},"empty":"filled",' ||
  CASE WHEN o_custkey % 3 = 0 THEN '"events":[],' ELSE '"events":[{"at":"' || o_custkey % 11 || '","n":' || o_custkey % 2 || '}],' END ||
  '"fresh":{"deep":{"er":[' || o_custkey || ']}},"status":' || CASE WHEN o_custkey % 5 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END ||
  CASE WHEN o_custkey % 4 = 0 THEN ',"turn":{"a":{"b":2,"c":[]}}' WHEN o_custkey % 4 = 1 THEN ',"turn":[3]' ELSE ',"turn":"plain"' END || '}' END"""


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    orders = v.load_spread(spark, sf, "orders", "o_orderkey")
    return tuple(orders.selectExpr("o_orderkey AS cv_id", f"{text} AS document") for text in (OLD, NEW))


# nodes outside lists; the objects that both sides have are walked through, the nodes right below them are decided
SIDES = f"""WITH a AS (SELECT o_orderkey AS cv_id, {OLD} AS d FROM orders),
b AS (SELECT o_orderkey AS cv_id, {NEW} AS d FROM orders),
an AS (SELECT a.cv_id, t.fullkey, t.path, t.type, t.value::VARCHAR AS value FROM a, json_tree(a.d) t WHERE NOT contains(t.fullkey, '[')),
bn AS (SELECT b.cv_id, t.fullkey, t.path, t.type, t.value::VARCHAR AS value FROM b, json_tree(b.d) t WHERE NOT contains(t.fullkey, '[')),
walked AS (SELECT an.cv_id, an.fullkey FROM an JOIN bn ON an.cv_id = bn.cv_id AND an.fullkey = bn.fullkey WHERE an.type = 'OBJECT' AND bn.type = 'OBJECT'),
nodes AS (
  SELECT coalesce(x.cv_id, y.cv_id) AS cv_id, coalesce(x.fullkey, y.fullkey) AS fullkey, coalesce(x.path, y.path) AS path,
    x.type AS atype, x.value AS av, y.type AS btype, y.value AS bv
  FROM an x FULL JOIN bn y ON x.cv_id = y.cv_id AND x.fullkey = y.fullkey),
decided AS (
  SELECT n.* FROM nodes n WHERE (n.cv_id, n.fullkey) NOT IN (SELECT (cv_id, fullkey) FROM walked)
    AND ((n.cv_id, n.path) IN (SELECT (cv_id, fullkey) FROM walked) AND n.fullkey <> '$' OR n.fullkey = '$'))"""
FLAT = """,
spread AS (SELECT p.cv_id, p.fullkey || substr(t.fullkey, 2) AS fullkey, t.type, t.value::VARCHAR AS value
  FROM picked p, json_tree(p.value) t WHERE p.value IS NOT NULL AND NOT contains(t.fullkey, '['))
SELECT cv_id, substr(fullkey, 3) AS path, value FROM spread WHERE type <> 'OBJECT'"""
LIST = "(SELECT '[' || coalesce(string_agg(x, ',' ORDER BY i), '') || ']' FROM ({}))"
ITEMS = "SELECT unnest(json_extract({0}::JSON, '$[*]'))::VARCHAR AS x, generate_subscripts(json_extract({0}::JSON, '$[*]'), 1) + {1} AS i"
EXTENSION_SQL = SIDES + f""",
picked AS (
  SELECT cv_id, fullkey, CASE
    WHEN coalesce(btype, 'NULL') = 'NULL' THEN av WHEN atype IS NULL THEN bv
    WHEN atype = 'ARRAY' AND btype = 'ARRAY' THEN {LIST.format(ITEMS.format('av', 0) + " UNION ALL SELECT * FROM (" + ITEMS.format('bv', 100000) + ") WHERE x NOT IN (SELECT x FROM (" + ITEMS.format('av', 0) + "))")}
    WHEN av IN ('null', '""', '[]', '{{}}') THEN bv ELSE av END AS value
  FROM decided)""" + FLAT
PARTIAL_SQL = SIDES + f""",
picked AS (
  SELECT cv_id, fullkey, CASE
    WHEN btype IS NULL THEN av WHEN atype IS NULL THEN bv WHEN bv IN ('null', '""', '[]') THEN av
    WHEN atype = 'ARRAY' AND btype = 'ARRAY' AND json_extract(av::JSON, '$[0]')::VARCHAR LIKE '"%' THEN {LIST.format("SELECT x, min(i) AS i FROM (" + ITEMS.format('av', 0) + " UNION ALL " + ITEMS.format('bv', 100000) + ") GROUP BY x")}
    WHEN atype = 'ARRAY' AND btype = 'ARRAY' THEN {LIST.format(ITEMS.format('av', 0) + " UNION ALL " + ITEMS.format('bv', 100000))}
    ELSE bv END AS value
  FROM decided)""" + FLAT


def _merged(spark, sf, rule: str) -> DataFrame:
    old, new = _sides(spark, sf)
    levels = nested.levels_of((old, "document"), (new, "document"))
    return nested.flatten(nested.merge_documents(old, new, rule, levels=levels), "merged", levels=levels)


@query("merge_extension_nested", "M10", EXTENSION_SQL)
def merge_extension_nested(spark, sf):
    return _merged(spark, sf, "extension")


@query("merge_partial_deep", "M17", PARTIAL_SQL)
def merge_partial_deep(spark, sf):
    return _merged(spark, sf, "partial")


@query("mapping_list_changes", "W16", SIDES + """
SELECT cv_id, substr(fullkey, 3) || CASE WHEN atype = 'ARRAY' AND btype = 'ARRAY' THEN ' (length)' ELSE '' END AS path
FROM decided WHERE nullif(av, 'null') IS DISTINCT FROM nullif(bv, 'null')
  AND NOT (coalesce(atype = 'ARRAY' AND btype = 'ARRAY', false) AND json_array_length(av) = json_array_length(bv))""")
def mapping_list_changes(spark, sf):
    return nested.changed_paths(*_sides(spark, sf))
