"""Batch changes applied to the fragment views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import changes as ch
from .registry import query

NOW = "TIMESTAMP '2025-06-01 00:00:00'"
_EDITS = """SELECT o.o_orderkey AS edit_no, f.fragment_id, CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE o.o_orderkey % 20 END AS line_count,
 'edit ' || o.o_orderpriority AS notes, 'x' AS bogus, CASE WHEN o.o_orderkey % 3 = 0 THEN 'Berlin' END AS museum
FROM {orders} o JOIN {fragments_v} f ON f.id = o.o_custkey"""
_EDITS_SQL = _EDITS.replace("{", "").replace("}", "")
_LAST = f"SELECT *, row_number() OVER (PARTITION BY fragment_id ORDER BY edit_no DESC) AS rn FROM ({_EDITS_SQL}) e"


def _edits(src):
    return src.spark.sql(_EDITS, orders=src("orders"), fragments_v=src("fragments_v"))


@query("update_metadata", "C1", f"""SELECT f.id, CASE WHEN e.rn = 1 THEN e.line_count ELSE f.line_count END AS line_count,
CASE WHEN e.rn = 1 THEN e.notes ELSE f.notes END AS notes, CASE WHEN e.rn = 1 THEN e.museum ELSE f.museum END AS museum,
CASE WHEN e.rn = 1 THEN {NOW} END AS updated_at
FROM fragments_v f LEFT JOIN (SELECT * FROM ({_LAST}) x WHERE rn = 1) e ON e.fragment_id = f.fragment_id""")
def update_metadata(src):
    done = ch.update_metadata(src("fragments_v"), _edits(src), custom=["museum"], order="edit_no", now=F.expr(NOW))
    return done.table.select("id", "line_count", "notes", "museum", "updated_at")


@query("update_changes", "C1", "SELECT count(DISTINCT o_custkey) AS changes FROM orders JOIN part ON p_partkey = o_custkey")
def update_changes(src):
    return ch.update_metadata(src("fragments_v"), _edits(src), order="edit_no").changes


@query("bulk_update", "C1", f"""SELECT id, CASE WHEN hit AND ok THEN CASE id % 3 WHEN 0 THEN 'South Turkestan Brahmi' WHEN 1 THEN 'Turkestan Gupta Type' END ELSE script_type END AS script_type, CASE WHEN hit AND ok THEN v ELSE line_count END AS line_count,
CASE WHEN hit AND ok THEN NULL ELSE museum END AS museum, notes, CASE WHEN hit AND ok THEN {NOW} END AS updated_at FROM (
SELECT f.*, f.id % 130 - 10 AS v, f.id % 130 - 10 BETWEEN 0 AND 100 AS ok, f.fragment_id IN (SELECT fragment_a_id FROM matches_v WHERE score < 0.1) AS hit FROM fragments_v f) q""")
def bulk_update(src):
    ids = src("matches_v").filter("score < 0.1").select(F.col("fragment_a_id").alias("fragment_id")).distinct()
    ids = src("fragments_v").join(ids, "fragment_id", "left_semi")
    values = {"line_count": F.expr("id % 130 - 10").cast("double"), "museum": F.lit("  "), "notes": F.lit("not allowed here"), "script_type": F.expr("CASE id % 3 WHEN 0 THEN 'South Turkestan Brāhmī (main type)' WHEN 1 THEN 'Turkestan Gupta Type' ELSE '' END")}
    done = ch.bulk_update(src("fragments_v"), ids, values, custom=["museum"], now=F.expr(NOW))
    return done.table.select("id", "script_type", F.col("line_count").cast("long").alias("line_count"), "museum", "notes", "updated_at")


@query("rejected_updates", "C1 B15", """SELECT id, CASE WHEN id % 130 - 10 < 0 THEN 'Line count cannot be negative' ELSE 'Line count must be 100 or less' END AS error
FROM fragments_v WHERE NOT (id % 130 - 10 BETWEEN 0 AND 100)""")
def rejected_updates(src):
    edits = src("fragments_v").selectExpr("id", "CAST(id % 130 - 10 AS DOUBLE) AS line_count", "' ' AS script_type")
    return ch.split_valid(edits)[1].select("id", "error")


@query("update_rotations", "C2", """SELECT f.id, CASE WHEN r.rotation IS NOT NULL AND f.id % 10 <> 3 THEN round(r.rotation - floor(r.rotation / 360) * 360, 6) ELSE ui_rotation END AS ui_rotation
FROM fragments_v f LEFT JOIN (SELECT l_partkey, arg_max(l_extendedprice / 10 - 4000, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || l_linenumber || '-' || l_suppkey) AS rotation FROM lineitem GROUP BY l_partkey) r ON r.l_partkey = f.id""")
def update_rotations(src):
    turns = src.spark.sql(
        """SELECT fragment_id, lpad(CAST(l_orderkey AS STRING), 12, '0') || l_linenumber || '-' || l_suppkey AS edit_no,
        CASE WHEN f.id % 10 = 3 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice / 10 - 4000 END AS rotation
        FROM {lineitem} JOIN {fragments_v} f ON f.id = l_partkey""",
        lineitem=src("lineitem"), fragments_v=src("fragments_v"),
    )
    done = ch.update_rotations(src("fragments_v"), turns, order="edit_no")
    return done.table.select("id", F.round("ui_rotation", 6).alias("ui_rotation"))


_GONE = "SELECT fragment_id FROM fragments_v WHERE processing_status = 'failed'"


def _deleted(src):
    gone = src("fragments_v").filter("processing_status = 'failed'").select("fragment_id")
    blank = src("region").selectExpr("repeat(' ', r_regionkey) AS fragment_id")
    return ch.bulk_delete(src("fragments_v"), src("project_fragments_v"), src("matches_v"), gone.union(blank))


@query("bulk_delete_fragments", "C3", f"SELECT id, fragment_id FROM fragments_v WHERE fragment_id NOT IN ({_GONE})")
def bulk_delete_fragments(src):
    return _deleted(src).fragments.select("id", "fragment_id")


@query("bulk_delete_project_rows", "C3", f"SELECT row_id, fragment_id FROM project_fragments_v WHERE fragment_id NOT IN ({_GONE})")
def bulk_delete_project_rows(src):
    return _deleted(src).project_fragments.select("row_id", "fragment_id")


@query("bulk_delete_matches", "C3", f"""SELECT match_id FROM matches_v WHERE fragment_a_id NOT IN ({_GONE}) AND fragment_b_id NOT IN ({_GONE})""")
def bulk_delete_matches(src):
    return _deleted(src).matches.select("match_id")


@query("create_filters", "C4 B24", """SELECT p_partkey AS label_no, CASE WHEN p_partkey % 9 = 0 THEN 'Filter name is required' WHEN p_partkey % 7 = 0 THEN 'Invalid filter type'
WHEN p_partkey % 2 = 0 AND p_partkey % 5 = 0 THEN 'Dropdown filters require at least one option' END AS error,
CASE WHEN p_partkey % 2 = 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN 'ring,' || p_brand WHEN p_partkey % 2 = 0 AND p_partkey % 7 <> 0 THEN '' END AS options FROM part""")
def create_filters(src):
    requests = src("part").selectExpr(
        "p_partkey AS label_no", "CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE p_name END AS label",
        "CASE WHEN p_partkey % 7 = 0 THEN 'slider' WHEN p_partkey % 2 = 0 THEN 'multiselect' ELSE 'text' END AS type",
        "CASE WHEN p_partkey % 5 = 0 THEN array(' ', '') ELSE array(' ring ', p_brand, '', 'ring', p_brand) END AS options",
    )
    taken = src("region").selectExpr("lower(r_name) AS filter_key")
    return ch.create_filters(requests, taken).select("label_no", "error", F.array_join("options", ",").alias("options"))


@query("list_filters", "C4", """SELECT p_partkey AS id, p_type AS label, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'a,' || p_brand END END AS options FROM part""")
def list_filters(src):
    registry = src("part").selectExpr(
        "p_partkey AS id", "'k' || p_partkey AS filter_key", "p_type AS label",
        "CASE WHEN p_partkey % 2 = 0 THEN 'multiselect' ELSE 'text' END AS type",
        """CASE WHEN p_partkey % 3 = 0 THEN '[broken' ELSE '[" a", "' || p_brand || '", "a", ""]' END AS options""",
    )
    return ch.list_filters(registry).select("id", "label", F.array_join("options", ",").alias("options"))


@query("delete_filter", "C4", "SELECT id, CAST(NULL AS VARCHAR) AS museum FROM fragments_v")
def delete_filter(src):
    registry = src("region").selectExpr("r_regionkey AS id", "'museum' AS filter_key", "'text' AS type")
    return ch.delete_filter(registry, src("fragments_v"), "museum")[1].select("id", "museum")


@query("update_filter_options", "C4", "SELECT id, CASE WHEN museum IN ('London', 'Paris') THEN museum END AS museum FROM fragments_v")
def update_filter_options(src):
    registry = src("region").selectExpr("r_regionkey AS id", "'museum' AS filter_key", "'multiselect' AS type", "'[]' AS options")
    return ch.update_filter_options(registry, src("fragments_v"), "museum", [" London", "Paris", "", "Paris "])[1].select("id", "museum")


_STATE = """SELECT project_id + 1 AS project_id, fragment_id, x, y, CASE WHEN z_index = 2 THEN 0 ELSE width END AS width, height, rotation,
CASE WHEN z_index = 3 THEN CAST(0 AS DOUBLE) WHEN z_index = 4 THEN NULL ELSE scale_x END AS scale_x, scale_y, z_index,
CASE WHEN z_index = 5 THEN false END AS show_segmented FROM {project_fragments_v} WHERE project_id % 2 = 0"""


@query("save_projects", "C5", """SELECT project_id, fragment_id, width, scale_x, z_index, show_segmented, n FROM (
SELECT project_id, fragment_id, width, scale_x, z_index, CAST(NULL AS BOOLEAN) AS show_segmented, 1 AS n FROM project_fragments_v WHERE project_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT s.project_id, fragment_id, CASE WHEN z_index <> 2 THEN width END, CASE WHEN z_index IN (3, 4) THEN 1 ELSE scale_x END, z_index, z_index <> 5, 1
FROM (SELECT project_id + 1 AS project_id, fragment_id, width, scale_x, z_index FROM project_fragments_v WHERE project_id % 2 = 0) s WHERE s.project_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) q""")
def save_projects(src):
    states = src.spark.sql(_STATE, project_fragments_v=src("project_fragments_v")).withColumn("is_locked", F.lit(None).cast("boolean"))
    saved = src("orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS project_id")
    return ch.save_projects(src("project_fragments_v"), states, saved).select(
        "project_id", "fragment_id", "width", "scale_x", "z_index", "show_segmented", F.lit(1).alias("n")
    )


@query("load_project", "C5", "SELECT fragment_id, x, y, z_index FROM project_fragments_v WHERE project_id = 101")
def load_project(src):
    return ch.load_project(src("project_fragments_v"), 101).select("fragment_id", "x", "y", "z_index")


@query("list_projects", "C5", "SELECT id, project_name, updated_at FROM projects_v ")
def list_projects(src):
    return ch.list_projects(src("projects_v"))


@query("list_saved_projects", "C5", f"""SELECT id, updated_at, row_number() OVER (ORDER BY updated_at DESC, id) AS place FROM (SELECT id, CASE WHEN id % 3 = 1 THEN {NOW} ELSE updated_at END AS updated_at FROM projects_v) p ORDER BY updated_at DESC, id LIMIT 500""")
def list_saved_projects(src):
    """A saved project leads the list."""
    saved = src("orders").filter("o_orderkey % 3 = 1").selectExpr("o_orderkey AS project_id")
    first = ch.list_projects(ch.stamp_projects(src("projects_v"), saved, F.expr(NOW))).limit(500)
    place = F.row_number().over(Window.orderBy(F.col("updated_at").desc(), "id"))  # of the 500 rows of the page
    return first.select("id", "updated_at", place.alias("place"))


@query("rename_projects", "C5", f"""SELECT id, CASE WHEN id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'renamed' ELSE project_name END AS project_name,
CASE WHEN id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN {NOW} ELSE updated_at END AS updated_at FROM projects_v""")
def rename_projects(src):
    names = src("customer").filter("c_acctbal < 0").selectExpr("c_custkey AS id", "'renamed' AS new_name")
    return ch.rename_projects(src("projects_v"), names, F.expr(NOW))


@query("create_projects", "C5", f"""SELECT id, project_name, CAST(NULL AS VARCHAR) AS description, updated_at FROM projects_v
UNION ALL SELECT c_custkey + 1000000000, c_name, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END, {NOW} FROM customer""")
def create_projects(src):
    new = src("customer").selectExpr(
        "c_custkey + 1000000000 AS id", "c_name AS project_name", "CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS description"
    )
    return ch.create_projects(src("projects_v"), new, F.expr(NOW)).select("id", "project_name", "description", "updated_at")


@query("delete_projects", "C5", """SELECT 'project' AS kind, CAST(id AS VARCHAR) AS id FROM projects_v WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'row', row_id FROM project_fragments_v WHERE project_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def delete_projects(src):
    ids = src("orders").filter("o_orderstatus = 'P'").selectExpr("o_orderkey AS id")
    projects, rows = ch.delete_projects(src("projects_v"), src("project_fragments_v"), ids)
    return projects.select(F.lit("project").alias("kind"), F.col("id").cast("string").alias("id")).union(rows.select(F.lit("row"), "row_id"))


@query("ensure_columns", "C6", """SELECT id, line_count, CAST(NULL AS DOUBLE) AS line_confidence, CAST(NULL AS VARCHAR) AS embedding_path FROM fragments_v""")
def ensure_columns(src):
    spec = {"line_count": "bigint", "line_confidence": "double", "embedding_path": "string"}
    grown = ch.ensure_columns(ch.ensure_columns(src("fragments_v"), spec), spec)
    return grown.select("id", *spec)
