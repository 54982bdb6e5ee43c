"""Catalogue queries over the fragment views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import catalogue as cat
from ..operators.ordering import sorted_rank
from .registry import query

FILTERS = {
    "line_count_min": 3,
    "line_count_max": 12,
    "scripts": ["North Turkestan Brahmi", "South Turkestan Brahmi", "Turkestan Gupta Type"],
    "is_edge_piece": True,
    "has_circle": False,
    "search": "r_1",
    "custom": {"museum": ["London", "Paris", "Urumqi"], "unknown": "x", "notes; --": "x"},
}
REGISTERED = ["museum"]
SHOW = ["id", "fragment_id", "line_count", "script_type", "processing_status"]

_FILTERED = """FROM catalogue_v WHERE line_count >= 3 AND line_count <= 12
AND script_type IN ('North Turkestan Brahmi', 'South Turkestan Brahmi', 'Turkestan Gupta Type')
AND edge_piece AND has_circle = false
AND (fragment_id ILIKE '%r_1%' OR transcription ILIKE '%r_1%' OR notes ILIKE '%r_1%')
AND museum IN ('London', 'Paris', 'Urumqi')"""


@query("scan_fragments", "A1", """SELECT id, fragment_id, processing_status FROM fragments_v
WHERE processing_status = 'completed' AND image_path ILIKE 'col1%' ORDER BY id LIMIT 50 OFFSET 20""")
def scan_fragments(src):
    return cat.scan_fragments(src("fragments_v"), limit=50, offset=20, status="completed", collection="col1").select(
        "id", "fragment_id", "processing_status"
    )


@query("scan_ids", "A1", """SELECT id, fragment_id FROM fragments_v WHERE fragment_id IN ('OR10_10A', 'OR13_13B', 'OR16_16A', 'none')
UNION ALL SELECT -id, fragment_id FROM fragments_v WHERE processing_status = 'failed'""")
def scan_ids(src):
    """Named fragments, then an empty list of names, which leaves out none."""
    named = cat.scan_fragments(src("fragments_v"), ids=["OR10_10A", "OR13_13B", "OR16_16A", "none"]).select("id", "fragment_id")
    return named.union(cat.scan_fragments(src("fragments_v"), ids=[], status="failed").select(-F.col("id"), "fragment_id"))


@query("scan_offset_without_limit", "A1 B9", "SELECT id, fragment_id FROM fragments_v WHERE processing_status = 'pending'")
def scan_offset_without_limit(src):
    return cat.scan_fragments(src("fragments_v"), offset=30, status="pending").select("id", "fragment_id")


@query("filter_fragments", "B1", f"SELECT id, fragment_id, line_count, script_type, processing_status {_FILTERED}")
def filter_fragments(src):
    return cat.filter_fragments(src("catalogue_v"), FILTERS, REGISTERED).select(*SHOW)


@query("filter_flags", "B1", """SELECT id, fragment_id FROM fragments_v WHERE has_top_edge AND NOT has_bottom_edge
AND has_left_edge = false AND NOT has_right_edge""")
def filter_flags(src):
    wanted = {"has_top_edge": True, "has_bottom_edge": False, "has_left_edge": False, "has_right_edge": False}
    return cat.filter_fragments(src("fragments_v"), wanted).select("id", "fragment_id")


@query("count_fragments", "B2", f"SELECT count(*) AS n {_FILTERED}")
def count_fragments(src):
    return cat.count_fragments(src("catalogue_v"), FILTERS, REGISTERED)


@query("keyword_search", "B3", """SELECT id, fragment_id FROM catalogue_v
WHERE fragment_id ILIKE '%the%on%' OR transcription ILIKE '%the%on%' OR notes ILIKE '%the%on%'""")
def keyword_search(src):
    return src("catalogue_v").filter(cat.keyword_predicate("the%on")).select("id", "fragment_id")


@query("suggest_fragments", "B3", """SELECT fragment_id FROM catalogue_v
WHERE fragment_id ILIKE '%widget%' OR transcription ILIKE '%widget%' OR notes ILIKE '%widget%' ORDER BY fragment_id LIMIT 10""")
def suggest_fragments(src):
    return cat.suggest(src("catalogue_v"), "  Widget ").select("fragment_id")


@query("custom_filter", "B4", "SELECT id, museum FROM fragments_v WHERE museum = 'London' OR museum = 'Urumqi'")
def custom_filter(src):
    wanted = {"museum": ["London", "Urumqi"], "colour": "red", "empty": ""}
    return src("fragments_v").filter(cat.custom_predicate(wanted, ["museum", "empty"])).select("id", "museum")


@query("filter_client", "B5", """SELECT id, line_count, script_type FROM (SELECT *, CASE WHEN id % 21 = 0 THEN NULL ELSE 1 END AS created_at FROM fragments_v) q
WHERE (line_count IS NULL OR line_count >= 4) AND (line_count IS NULL OR line_count <= 9)
AND script_type IN ('South Turkestan Brahmi', 'Turkestan Gupta Type') AND edge_piece IS NOT DISTINCT FROM false AND created_at IS NOT NULL""")
def filter_client(src):
    return cat.filter_client(
        src("fragments_v"), 4, 9, ["South Turkestan Brahmi", "Turkestan Gupta Type"], False,
        has_metadata=F.col("id") % 21 != 0,
    ).select("id", "line_count", "script_type")


@query("available_scripts", "B6", "SELECT DISTINCT script_type FROM fragments_v WHERE script_type <> ''")
def available_scripts(src):
    return cat.available_scripts(src("fragments_v"))


@query("get_by_id", "B7", """SELECT id, fragment_id, line_count FROM fragments_v
WHERE fragment_id IN (SELECT fragment_a_id FROM matches_v WHERE score < 0.1)""")
def get_by_id(src):
    wanted = src("matches_v").filter("score < 0.1").select(F.col("fragment_a_id").alias("fragment_id"))
    return cat.get_by_id(src("fragments_v"), wanted).select("id", "fragment_id", "line_count")


@query("sort_by_relevance", "B8", """SELECT fragment_id, relevance,
row_number() OVER (ORDER BY relevance, sort_id, fragment_id) AS place FROM (SELECT fragment_id, lower(fragment_id) AS sort_id,
CASE WHEN lower(fragment_id) = 'or12_12a_l [col12]' THEN 0 WHEN lower(fragment_id) LIKE 'or12_12a_l [col12]%' THEN 1 ELSE 2 END AS relevance
FROM fragments_v) q""")
def sort_by_relevance(src):
    found = cat.with_relevance(src("fragments_v"), " OR12_12A_L [COL12] ")
    order = [F.col("relevance"), F.col("sort_id"), F.col("fragment_id")]
    return sorted_rank(found, [], order, out="place").select("fragment_id", "relevance", "place")


@query("relevance_top", "B8", """SELECT fragment_id, relevance FROM (SELECT fragment_id, lower(fragment_id) AS sort_id,
CASE WHEN lower(fragment_id) = 'or1' THEN 0 WHEN lower(fragment_id) LIKE 'or1%' THEN 1 ELSE 2 END AS relevance
FROM fragments_v WHERE fragment_id ILIKE '%or1%') q ORDER BY relevance, sort_id, fragment_id LIMIT 100""")
def relevance_top(src):
    found = src("fragments_v").filter(text.like_anywhere(F.col("fragment_id"), "or1"))
    return cat.sort_by_relevance(found, "or1").limit(100).select("fragment_id", "relevance")


@query("page_fragments", "B9", "SELECT id, fragment_id FROM fragments_v ORDER BY fragment_id LIMIT 100 OFFSET 100")
def page_fragments(src):
    return cat.page(src("fragments_v"), 100, 100).select("id", "fragment_id")


@query("page_after", "B9", "SELECT id, fragment_id FROM fragments_v WHERE fragment_id > 'OR3' ORDER BY fragment_id LIMIT 100")
def page_after(src):
    return cat.page_after(src("fragments_v"), "OR3", 100).select("id", "fragment_id")


@query("sort_az", "B10", """SELECT fragment_id, row_number() OVER (ORDER BY fragment_id) AS up,
row_number() OVER (ORDER BY fragment_id DESC) AS down FROM fragments_v""")
def sort_az(src):
    placed = sorted_rank(src("fragments_v").select("fragment_id"), [], [F.col("fragment_id")], out="up")
    return placed.select("fragment_id", "up", (F.col("up_of") + 1 - F.col("up")).alias("down"))


@query("sort_za_page", "B10", "SELECT id, fragment_id FROM fragments_v ORDER BY fragment_id DESC LIMIT 100")
def sort_za_page(src):
    return cat.sort_az(src("fragments_v"), descending=True).limit(100).select("id", "fragment_id")


_DISPLAY = """CASE script_type WHEN 'Early South Turkestan Brahmi' THEN 'Early South Turkestan Brāhmī'
 WHEN 'North Turkestan Brahmi' THEN 'North Turkestan Brāhmī' WHEN 'North Turkestan Brahmi, type a' THEN 'North Turkestan Brāhmī, type a'
 WHEN 'South Turkestan Brahmi' THEN 'South Turkestan Brāhmī (main type)' WHEN '' THEN NULL ELSE script_type END"""


@query("display_records", "B11", f"""SELECT id, fragment_id AS name, ui_rotation AS rotation, line_count, {_DISPLAY} AS script,
edge_piece, has_circle, CASE WHEN scale_unit IS NOT NULL AND pixels_per_unit <> 0 THEN scale_unit END AS unit,
CASE WHEN scale_unit IS NOT NULL AND pixels_per_unit <> 0 THEN CASE WHEN scale_detection_status = 'success' THEN 'success' ELSE 'error' END END AS status,
transcription, museum FROM catalogue_v""")
def display_records(src):
    shown = cat.to_display(src("catalogue_v"), ["museum"])
    meta = F.col("metadata")
    return shown.select(
        "id", "name", "rotation", meta["line_count"].alias("line_count"), meta["script"].alias("script"),
        meta["edge_piece"].alias("edge_piece"), meta["has_circle"].alias("has_circle"),
        meta["scale"]["unit"].alias("unit"), meta["scale"]["status"].alias("status"),
        meta["transcription"].alias("transcription"), F.element_at(meta["custom"], F.lit("museum")).alias("museum"),
    )


@query("script_names", "B12", f"""SELECT shown, stored, count(*) AS n FROM (SELECT {_DISPLAY} AS shown,
CASE WHEN script_type = '' THEN NULL ELSE script_type END AS stored FROM fragments_v) q GROUP BY shown, stored""")
def script_names(src):
    shown = src("fragments_v").select(text.script_display(F.col("script_type")).alias("shown"))
    return shown.withColumn("stored", text.script_stored(F.col("shown"))).groupBy("shown", "stored").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("reverse_side", "B13", """SELECT f.fragment_id, g.fragment_id AS reverse FROM fragments_v f
JOIN fragments_v g ON g.id = CASE WHEN f.id % 2 = 0 THEN f.id + 1 ELSE f.id - 1 END""")
def reverse_side(src):
    return src("fragments_v").select("fragment_id", text.reverse_side_id(F.col("fragment_id")).alias("reverse"))


@query("recto_verso_pairs", "B14", """SELECT f.fragment_id AS side, g.fragment_id AS other_side, g.id AS other_row FROM fragments_v f
JOIN fragments_v g ON floor(f.id / 2.0) = floor(g.id / 2.0) AND f.id <> g.id""")
def recto_verso_pairs(src):
    return cat.pair_recto_verso(src("fragments_v"))


@query("validate_metadata", "B15", """SELECT id, NOT bad_count AS count_ok, CASE WHEN NOT bad_count THEN NULL WHEN v < 0 AND v = floor(v) THEN 'Line count cannot be negative'
 WHEN v <> floor(v) THEN 'Line count must be a whole number' ELSE 'Line count must be 100 or less' END AS count_error,
 CASE WHEN r <= 0 THEN 'Pixels per unit must be positive' WHEN r > 10000 THEN 'Value seems too large' END AS ratio_error,
 CASE WHEN s NOT IN ('Turkestan Gupta Type', '') THEN 'Please select a valid script type from the dropdown' END AS script_error,
 CASE WHEN u IN ('cm', 'mm') THEN NULL ELSE 'Scale unit must be "cm" or "mm"' END AS unit_error FROM (SELECT *,
 coalesce(v <> floor(v) OR v < 0 OR v > 100, false) AS bad_count FROM (SELECT id, (id % 240 - 20) / CAST(CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS v,
 CAST(id * 17 % 12000 - 300 AS DOUBLE) AS r, CASE WHEN id % 3 = 0 THEN 'Turkestan Gupta Type' WHEN id % 3 = 1 THEN 'Latin' ELSE '' END AS s,
 scale_unit AS u FROM fragments_v) q) q2""")
def validate_metadata(src):
    edits = src("fragments_v").selectExpr(
        "id",
        "(id % 240 - 20) / CAST(CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS v",
        "CAST(id * 17 % 12000 - 300 AS DOUBLE) AS r",
        "CASE WHEN id % 3 = 0 THEN ' Turkestan Gupta Type ' WHEN id % 3 = 1 THEN 'Latin' ELSE '' END AS s",
        "scale_unit AS u",
    )
    count, ratio = rules.validate_line_count(F.col("v")), rules.validate_pixels_per_unit(F.col("r"))
    return edits.select(
        "id", count["valid"].alias("count_ok"), count["error"].alias("count_error"), ratio["error"].alias("ratio_error"),
        rules.validate_script(F.col("s"))["error"].alias("script_error"),
        rules.validate_unit(F.col("u"))["error"].alias("unit_error"),
    )


SEGMENTATION_TEXT = """CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '{"contours": [[[1' WHEN 3 THEN '{"contours": [[[10, 20], [30, 5]]]}'
WHEN 4 THEN '{"contours": [[[' || CAST(id AS VARCHAR(20)) || ', 7], [10, 90]], [[1, 1], [2, 2], [3, 1]]], "confidence": 0.9}'
ELSE '{"contours": [[[0, 0], [5, 0], [5, 5]]], "image_shape": [' || CAST(id + 10 AS VARCHAR(20)) || ', 640]}' END"""


def _with_segmentation(src):
    return src("fragments_v").selectExpr("*", f"{SEGMENTATION_TEXT} AS segmentation_coords")


@query("valid_segmentation", "B16", "SELECT id, id % 6 IN (4, 5) AS valid, id % 6 > 1 AS has_text FROM fragments_v")
def valid_segmentation(src):
    seg = F.col("segmentation_coords")
    return _with_segmentation(src).select(
        "id", cat.has_valid_segmentation(seg).alias("valid"), F.coalesce(F.length(seg) > 0, F.lit(False)).alias("has_text")
    )


@query("image_dims", "B17", """SELECT id, CASE id % 6 WHEN 3 THEN 34 WHEN 4 THEN CAST(floor(greatest(id, 10) * 1.1e0) AS BIGINT) + 1 WHEN 5 THEN 640 ELSE 1000 END AS width,
CASE id % 6 WHEN 3 THEN 23 WHEN 4 THEN 100 WHEN 5 THEN id + 10 ELSE 1000 END AS height FROM fragments_v""")
def image_dims(src):
    dims = cat.image_dims(F.col("segmentation_coords"))
    return _with_segmentation(src).select("id", dims["width"].cast("long").alias("width"), dims["height"].cast("long").alias("height"))


_UI = "greatest(50, least(2000, floor({0} / pixels_per_unit * CASE WHEN scale_unit = 'mm' THEN 0.1e0 ELSE 1e0 END * 25 + 0.5e0)))"
_JOB = "greatest(50, least(2000, round_even({0} / pixels_per_unit * CASE WHEN scale_unit = 'mm' THEN 0.1e0 ELSE 1e0 END * 25, 0)))"


@query("display_sizes", "B18", f"""SELECT id,
round(CASE WHEN pixels_per_unit IS NOT NULL THEN {_UI.format('w')} WHEN w > h AND w > 300 THEN 300 WHEN w <= h AND h > 300 THEN w * 300 / h ELSE w END, 6) AS ui_width,
round(CASE WHEN pixels_per_unit IS NOT NULL THEN {_UI.format('h')} WHEN w > h AND w > 300 THEN h * 300 / w WHEN w <= h AND h > 300 THEN 300 ELSE h END, 6) AS ui_height,
CASE WHEN pixels_per_unit IS NOT NULL THEN {_JOB.format('w')} ELSE least(300, w) END AS job_width,
CASE WHEN pixels_per_unit IS NOT NULL THEN {_JOB.format('h')} ELSE least(300, h) END AS job_height
FROM (SELECT *, CAST(image_width AS DOUBLE) AS w, CAST(image_height AS DOUBLE) AS h FROM fragments_v) q""")
def display_sizes(src):
    args = [F.col(c) for c in ("image_width", "image_height", "pixels_per_unit", "scale_unit")]
    ui, job = rules.display_size(*args), rules.display_size(*args, job=True)
    return src("fragments_v").select(
        "id", F.round(ui["width"], 6).alias("ui_width"), F.round(ui["height"], 6).alias("ui_height"),
        job["width"].alias("job_width"), job["height"].alias("job_height"),
    )


@query("scale_from_resize", "B19", """SELECT row_id, round((1200 / (width / 25) + 900 / (height / 25)) / 2, 6) AS per_cm FROM project_fragments_v""")
def scale_from_resize(src):
    ratio = rules.scale_from_resize(F.col("width"), F.col("height"), F.lit(1200.0), F.lit(900.0))
    return src("project_fragments_v").select("row_id", F.round(ratio, 6).alias("per_cm"))


@query("path_parts", "B20", """SELECT id, replace(path, chr(92), '/') AS path, split_part(replace(path, chr(92), '/'), '/', 1) AS collection FROM annotations_v""")
def path_parts(src):
    return src("annotations_v").select(
        "id", text.normalize_path(F.col("path")).alias("path"), text.collection_of(F.col("path")).alias("collection")
    )


@query("eligible_fragments", "B21", """SELECT id, pixels_per_unit, CASE id % 6 WHEN 3 THEN 34 WHEN 4 THEN CAST(floor(greatest(id, 10) * 1.1e0) AS BIGINT) + 1 WHEN 5 THEN 640 ELSE 1000 END AS width
FROM fragments_v WHERE pixels_per_unit IS NOT NULL AND id % 6 > 1""")
def eligible_fragments(src):
    return cat.eligible_fragments(_with_segmentation(src)).select("id", "pixels_per_unit", F.col("width").cast("long").alias("width"))


_SIDES = ("has_top_edge", "has_bottom_edge", "has_left_edge", "has_right_edge")


@query("edge_piece_flag", "B22", """SELECT id, CASE WHEN coalesce(has_top_edge, false) OR coalesce(has_bottom_edge, false) OR coalesce(has_left_edge, false) OR coalesce(has_right_edge, false) THEN true
WHEN has_top_edge IS NULL OR has_bottom_edge IS NULL OR has_left_edge IS NULL OR has_right_edge IS NULL THEN NULL ELSE false END AS edge_piece FROM annotations_v""")
def edge_piece_flag(src):
    return src("annotations_v").select("id", rules.any_edge(*[F.col(c) for c in _SIDES]).alias("edge_piece"))


@query("filter_images", "B23", "SELECT id, path FROM annotations_v WHERE lower(collection) = 'col0' AND contains(lower(path), '/1')")
def filter_images(src):
    return cat.filter_images(src("annotations_v"), "Col0", "/1").select("id", "path")


@query("filter_keys", "B24", """SELECT p_partkey AS label_no, base || CASE WHEN n = 1 THEN '' ELSE '_' || CAST(n AS VARCHAR) END AS filter_key FROM (
SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) + CASE WHEN base = 'red_ring' THEN 1 ELSE 0 END AS n FROM (
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'f_' || CAST(p_size AS VARCHAR) || '_' ELSE '' END || replace(p_name, ' ', '_') AS base FROM part) q) q2""")
def filter_keys(src):
    labels = src("part").selectExpr(
        "p_partkey AS label_no",
        "CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS STRING) || ' - ' ELSE ' !' END || upper(p_name) || '? ' AS label",
    )
    taken = src("part").filter("p_name = 'red ring'").selectExpr("replace(p_name, ' ', '_') AS filter_key").distinct()
    return cat.assign_filter_keys(labels, taken, text.filter_key(F.col("label"))).select("label_no", "filter_key")
