"""Splits, orders, samples, ranks and layouts over the fragment views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as lay
from ..operators import metrics as mt
from ..operators import ranking as rk
from .metric_queries import TARGETS_SQL, target_rows
from .registry import query

_CUT = "CASE WHEN place <= floor(n * {a} + 0.5e0) THEN 'train' WHEN place <= floor(n * ({a} + {b}) + 0.5e0) THEN 'val' ELSE 'test' END AS split"


@query("stratified_split", "F1", f"""SELECT image_id, {_CUT.format(a='0.7e0', b='0.15e0')} FROM (SELECT image_id, row_number() OVER (PARTITION BY truth ORDER BY md5('42|' || image_id), image_id) AS place,
count(*) OVER (PARTITION BY truth) AS n FROM counts_v) q""")
def stratified_split(src):
    return rk.stratified_split(src("counts_v"), "truth", "image_id").select("image_id", "split")


@query("random_split", "F2", f"""SELECT doc_id, {_CUT.format(a='0.7e0', b='0.2e0')} FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS place, count(*) OVER () AS n
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) q""")
def random_split(src):
    return rk.random_split(src("documents"), src("labels"), "doc_id", seed="7").select("doc_id", "split")


def _samples(src):
    return src("annotations_v").filter("reviewed AND NOT skipped")


@query("group_split", "F3 A7")
def group_split(src):
    return rk.group_split(_samples(src)).select("id", "collection", "split")


_SEEN = "(SELECT collection, count(*) FILTER (reviewed) AS seen FROM annotations_v GROUP BY collection) c"


@query("balanced_order", "F4", f"""SELECT path, row_number() OVER (ORDER BY tier, nth, seen, md5('s::' || tier || '|rank|' || q.collection), q.collection) AS position FROM (SELECT path, collection, tier,
row_number() OVER (PARTITION BY tier, collection ORDER BY md5('s::' || tier || '|' || path), path) AS nth FROM (SELECT *, CASE WHEN reviewed THEN 2 ELSE 1 END AS tier FROM annotations_v) a) q JOIN {_SEEN} ON c.collection = q.collection""")
def balanced_order(src):
    return rk.balanced_order(src("annotations_v"), "s").select("path", "position")


_WEIGHTS = f"""SELECT label, greatest(1, greatest(max(reviewed_positives) OVER (), 1) - reviewed_positives) * CASE WHEN label = 'corner' THEN 1.15e0 ELSE 1e0 END AS w FROM ({TARGETS_SQL}) t WHERE label IN ('corner', 'left', 'right')"""
_HITS = """SELECT id, 'top' AS label, has_top_edge AS hit FROM fragments_v UNION ALL SELECT id, 'bottom', has_bottom_edge FROM fragments_v UNION ALL SELECT id, 'left', has_left_edge FROM fragments_v
UNION ALL SELECT id, 'right', has_right_edge FROM fragments_v UNION ALL SELECT id, 'corner', coalesce(CAST(has_top_edge AS INT), 0) + coalesce(CAST(has_bottom_edge AS INT), 0) + coalesce(CAST(has_left_edge AS INT), 0) + coalesce(CAST(has_right_edge AS INT), 0) >= 2 FROM fragments_v"""


@query("targeted_order", "F5", f"""WITH scored AS (SELECT a.path, a.collection, a.reviewed, CASE WHEN a.reviewed THEN 0 ELSE coalesce(s.score, 0) END AS score FROM annotations_v a
LEFT JOIN (SELECT id, sum(w) AS score FROM ({_HITS}) h JOIN ({_WEIGHTS}) w ON w.label = h.label WHERE hit GROUP BY id) s ON s.id = a.id),
tiered AS (SELECT *, CASE WHEN reviewed THEN 2 WHEN score > 0 THEN 0 ELSE 1 END AS tier FROM scored),
nth AS (SELECT *, max(score) OVER (PARTITION BY tier, collection) AS best, row_number() OVER (PARTITION BY tier, collection ORDER BY score DESC, md5('s::' || tier || '|' || path), path) AS nth FROM tiered)
SELECT path, tier, row_number() OVER (ORDER BY tier, nth, seen, best DESC, md5('s::' || tier || '|rank|' || n.collection), n.collection) AS position FROM nth n JOIN {_SEEN} ON c.collection = n.collection""")
def targeted_order(src):
    summary = target_rows(src).filter("label IN ('corner', 'left', 'right')")
    predictions = src("fragments_v").join(src("annotations_v").select("id", "path"), "id")
    return rk.targeted_order(src("annotations_v"), predictions, summary, "s").select("path", "tier", "position")


@query("weighted_sample", "F6", """WITH classes AS (SELECT truth, count(*) AS size, row_number() OVER (ORDER BY truth) - 1 AS k, count(*) OVER () AS m FROM logits_v GROUP BY truth),
places AS (SELECT image_id, truth, row_number() OVER (PARTITION BY truth ORDER BY md5('42|' || image_id), image_id) AS place FROM logits_v),
draws AS (SELECT draw, CAST('0x' || substr(md5('42::class|' || draw), 1, 13) AS BIGINT) / 4503599627370496e0 AS u, CAST('0x' || substr(md5('42::place|' || draw), 1, 13) AS BIGINT) / 4503599627370496e0 AS v FROM (SELECT unnest(range(1, 5001)) AS draw) r)
SELECT draw, c.truth, image_id FROM draws JOIN classes c ON c.k = CAST(floor(u * m) AS BIGINT) JOIN places p ON p.truth = c.truth AND p.place = CAST(floor(v * size) AS BIGINT) + 1""")
def weighted_sample(src):
    scored = src("logits_v").select("image_id", F.col("truth").cast("long").alias("truth"))
    return rk.weighted_sample(scored, "truth", "image_id", 5000).select("draw", "truth", "image_id")


@query("limit_sample", "F7", "SELECT id, path FROM annotations_v ORDER BY md5('9|' || path), path LIMIT 300")
def limit_sample(src):
    return rk.limit_sample(src("annotations_v"), "path", 300, "9").select("id", "path")


@query("rank_matches", "F8", """SELECT match_id, row_number() OVER (PARTITION BY fragment_a_id, edge_a_name ORDER BY score, match_id) AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY fragment_a_id, edge_a_name ORDER BY score, match_id) AS place FROM matches_v) q
WHERE place <= 9 AND relative_x_cm IS NOT NULL AND line_no % 7 <> 2 QUALIFY new_rank <= 3""")
def rank_matches(src):
    keep = F.col("relative_x_cm").isNotNull() & (F.col("line_no") % 7 != 2)
    return rk.rank_matches(src("matches_v"), 3, keep).select("match_id", "new_rank")


@query("rerank", "F9", """SELECT match_id, row_number() OVER (PARTITION BY fragment_a_id, edge_a_name ORDER BY round(score * (1 + line_no % 3), 6), rank, match_id) AS new_rank FROM matches_v""")
def rerank(src):
    score = F.round(F.col("score") * (1 + F.col("line_no") % 3), 6)
    slim = src("matches_v").select("match_id", "fragment_a_id", "edge_a_name", "rank", "score", "line_no")
    return rk.rerank(slim, score).select("match_id", "new_rank")


@query("top_matches", "F10", "SELECT match_id, fragment_a_id, fragment_b_id, score FROM matches_v WHERE rank = 1 ORDER BY score, match_id LIMIT 10")
def top_matches(src):
    return rk.top_matches(src("matches_v")).select("match_id", "fragment_a_id", "fragment_b_id", "score")


_TOP = "SELECT *, row_number() OVER (ORDER BY score, match_id) - 1 AS k FROM matches_v WHERE rank = 1 {0} ORDER BY score, match_id LIMIT {1}"
_SIZE = "CASE WHEN pixels_per_unit IS NOT NULL THEN greatest(50, least(2000, round_even({0} / pixels_per_unit * CASE WHEN scale_unit = 'mm' THEN 0.1e0 ELSE 1e0 END * 25, 0))) ELSE least(300, {0}) END"


@query("pair_layout", "F11", f"""SELECT p.fragment_id, round(x, 6) AS x, round(y, 6) AS y, {_SIZE.format('image_width')} AS width, {_SIZE.format('image_height')} AS height, rotation, z_index FROM (
SELECT fragment_a_id AS fragment_id, 100 + 500 * k AS x, 200 AS y, 0 AS rotation, 2 * k AS z_index FROM ({_TOP.format('', 10)}) a
UNION ALL SELECT fragment_b_id, 100 + 500 * k + coalesce(relative_x_cm, 0) * 25, 200 + coalesce(relative_y_cm, 0) * 25, coalesce(rotation_deg, 0), 2 * k + 1 FROM ({_TOP.format('', 10)}) b) p
JOIN fragments_v f ON f.fragment_id = p.fragment_id""")
def pair_layout(src):
    done = lay.pair_layout(src("matches_v"), src("fragments_v"))
    return done.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query("auto_layout", "F12")
def auto_layout(src):
    return lay.auto_layout(src("matches_v"))


@query("place_matches", "F13", """SELECT row_id, b AS placed_id, round(x + px * cos(radians(rotation)) - py * sin(radians(rotation)), 4) AS x, round(y + px * sin(radians(rotation)) + py * cos(radians(rotation)), 4) AS y,
round(turn + rotation, 4) AS rotation FROM (SELECT p.*, m.fragment_b_id AS b, coalesce(m.relative_x_cm, 0) * 25 AS px, coalesce(m.relative_y_cm, 0) * 25 AS py, coalesce(m.rotation_deg, 0) AS turn FROM project_fragments_v p
JOIN (SELECT *, row_number() OVER (PARTITION BY fragment_a_id ORDER BY score, match_id) AS rn FROM matches_v) m ON m.fragment_a_id = p.fragment_id AND m.rn = 1) q""")
def place_matches(src):
    anchors = src("project_fragments_v").select("row_id", "fragment_id", "x", "y", "rotation")
    done = lay.place_matches(anchors, src("matches_v"))
    return done.select("row_id", "placed_id", *[F.round(c, 4).alias(c) for c in ("x", "y", "rotation")])


@query("stagger_layout", "F14", """SELECT row_id, 100 + 50 * (row_number() OVER (PARTITION BY project_id ORDER BY z_index, row_id) - 1) AS x FROM project_fragments_v""")
def stagger_layout(src):
    rows = src("project_fragments_v").select("row_id", "project_id", "z_index")
    return lay.stagger_layout(rows, ["project_id"], [F.col("z_index"), F.col("row_id")]).select("row_id", "x")
