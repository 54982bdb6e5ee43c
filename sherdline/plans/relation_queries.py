"""Joins over the fragment views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations as rel
from .registry import query

_BEST = """SELECT fragment_a_id, fragment_b_id, match_id, score, target_script, place FROM (
SELECT m.*, f.script_type AS target_script, row_number() OVER (PARTITION BY fragment_a_id ORDER BY score, match_id) AS place FROM (
SELECT *, row_number() OVER (PARTITION BY fragment_a_id, fragment_b_id ORDER BY score, match_id) AS rn FROM matches_v) m
JOIN fragments_v f ON f.fragment_id = m.fragment_b_id WHERE rn = 1) q"""
_COLUMNS = ["fragment_a_id", "fragment_b_id", "match_id", "score", "target_script"]


@query("matches_for", "D1", """SELECT match_id, fragment_b_id, edge_a_name, score, image_path AS target_path, line_count AS target_lines
FROM matches_v m JOIN fragments_v f ON f.fragment_id = m.fragment_b_id WHERE fragment_a_id = 'OR25_25A'""")
def matches_for(src):
    return rel.matches_for(src("matches_v"), src("fragments_v"), "OR25_25A").select(
        "match_id", "fragment_b_id", "edge_a_name", "score", "target_path", "target_lines"
    )


@query("best_matches", "D2", f"{_BEST} WHERE place <= 20")
def best_matches(src):
    slim = src("matches_v").select("fragment_a_id", "edge_a_name", "fragment_b_id", "edge_b_name", "score", "match_id")
    return rel.best_matches(slim, src("fragments_v")).select(*_COLUMNS, "place")


@query("best_matches_of_one", "D2", f"{_BEST} WHERE place <= 20 AND fragment_a_id = 'OR25_25A'")
def best_matches_of_one(src):
    return rel.best_matches(src("matches_v"), src("fragments_v"), anchor="OR25_25A").select(*_COLUMNS, "place")


@query("orphan_project_rows", "D3", "SELECT row_id, fragment_id FROM project_fragments_v WHERE fragment_id NOT IN (SELECT fragment_id FROM fragments_v)")
def orphan_project_rows(src):
    return rel.orphans(src("project_fragments_v"), src("fragments_v"), "fragment_id", "fragment_id").select("row_id", "fragment_id")


@query("unlabelled_images", "D3", """SELECT 'image' AS kind, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'label', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def unlabelled_images(src):
    documents, labels = src("documents"), src("labels")
    images = rel.orphans(documents, labels, "doc_id", "doc_id").select(F.lit("image").alias("kind"), "doc_id")
    return images.union(rel.orphans(labels, documents.filter("lang = 'en'"), "doc_id", "doc_id").select(F.lit("label"), "doc_id"))


def _samples(src, **options):
    fragments = src("fragments_v").withColumn("segmentation_coords", F.expr("CASE WHEN has_segmentation THEN '{}' ELSE '' END"))
    listing = src("fragments_v").filter("image_width <> 763").select(F.col("image_path").alias("path"))
    return rel.build_samples(src("annotations_v"), fragments, listing, **options)


_JOINED = """SELECT a.id, replace(a.path, chr(92), '/') AS path, f.collection, a.has_top_edge, a.has_bottom_edge, a.has_left_edge, a.has_right_edge,
a.has_top_edge IS NOT NULL AND a.has_bottom_edge IS NOT NULL AND a.has_left_edge IS NOT NULL AND a.has_right_edge IS NOT NULL AS complete,
f.id IS NOT NULL AS found, coalesce(f.has_segmentation, false) AS seg, f.pixels_per_unit,
coalesce(f.pixels_per_unit IS NOT NULL AND f.scale_detection_status = 'success', false) AS sc, coalesce(f.image_width <> 763, false) AS disk
FROM annotations_v a LEFT JOIN fragments_v f ON f.image_path = replace(a.path, chr(92), '/') WHERE a.reviewed AND NOT a.skipped"""


@query("sample_funnel", "D4", f"""SELECT count(*) AS reviewed_non_skipped, count(*) FILTER (complete) AS complete_labels,
count(*) FILTER (complete AND found) AS matched_db, count(*) FILTER (complete AND found AND seg) AS with_segmentation,
count(*) FILTER (complete AND found AND seg AND sc) AS with_scale, count(*) FILTER (complete AND found AND seg AND disk) AS usable_samples FROM ({_JOINED}) q""")
def sample_funnel(src):
    return rel.sample_funnel(_samples(src))


@query("build_samples", "D4 G8", f"""SELECT path, collection, has_top_edge, pixels_per_unit,
CASE WHEN (has_top_edge OR has_bottom_edge) AND (has_left_edge OR has_right_edge) THEN 'corner' WHEN has_top_edge OR has_bottom_edge OR has_left_edge OR has_right_edge THEN 'edge' ELSE 'interior' END AS piece_type
FROM ({_JOINED}) q WHERE complete AND found AND seg AND sc AND disk""")
def build_samples(src):
    return _samples(src, require_scale=True).filter("usable").select("path", "collection", "has_top_edge", "pixels_per_unit", "piece_type")


_WANTED = "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 45"


@query("completeness", "D7", f"""SELECT (SELECT count(*) FROM ({_WANTED}) w) AS total, count(*) FILTER (processing_status IN ('completed', 'completed_low_confidence')) AS completed,
count(*) FILTER (line_count IS NOT NULL AND script_type IS NOT NULL AND script_type <> '' AND pixels_per_unit IS NOT NULL) AS required_ok,
count(*) FILTER (line_count IS NULL) AS missing_line_count, count(*) FILTER (script_type IS NULL OR script_type = '') AS missing_script_type,
count(*) FILTER (pixels_per_unit IS NULL) AS missing_pixels_per_unit FROM fragments_v WHERE id IN ({_WANTED})""")
def completeness(src):
    ids = src("lineitem").filter("l_quantity > 45").selectExpr("l_partkey AS id").distinct()
    return rel.completeness(
        src("fragments_v"), ids, ["line_count", "script_type", "pixels_per_unit"], ["completed", "completed_low_confidence"]
    )


@query("status_counts", "D7", f"SELECT coalesce(processing_status, 'NULL') AS status, count(*) AS n FROM fragments_v WHERE id IN ({_WANTED}) GROUP BY 1")
def status_counts(src):
    ids = src("lineitem").filter("l_quantity > 45").selectExpr("l_partkey AS id")
    return rel.status_counts(src("fragments_v"), ids)
