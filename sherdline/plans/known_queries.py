"""Jobs on shapes and signals built from the rows of the tables so that SQL can state the answer.

They exercise the numeric helpers whose general results SQL cannot express: peaks at known places, rigid
motions with known angle and shift, rectangles moved by whole cells, rectangles at known angles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shapes import find_corners
from ..operators import borders as bd
from ..operators import matching as mm
from ..operators import ruler as ru
from .contour_queries import _arcs
from .registry import query


@query("known_corners", "H4", "SELECT id, k AS corner_no, 20 + id % 7 + 40 * k AS place FROM (SELECT id, unnest(range(3 + id % 3)) AS k FROM fragments_v) q")
def known_corners(src):
    """Curvature that is flat but for three to five spikes."""
    spikes = "transform(sequence(0, 199), i -> CASE WHEN i >= 20 + id % 7 AND (i - 20 - id % 7) % 40 = 0 AND (i - 20 - id % 7) / 40 < 3 + id % 3 THEN 1.0D ELSE 0.0D END)"
    return src.spread("fragments_v").select("id", F.posexplode(find_corners(F.expr(spikes))).alias("corner_no", "place")).select(
        "id", F.col("corner_no").cast("long").alias("corner_no"), F.col("place").cast("long").alias("place")
    )


_TICKS = "SELECT id, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS places, count(*) AS n FROM (SELECT id, unnest(range(5 + id % 6)) * 40 + 100 + id % 11 AS place FROM fragments_v) q WHERE place > 150 GROUP BY id"


@query("known_ticks", "J2 J3 J4 J5 J6", f"SELECT id, places AS fixed, places AS adaptive, 40 AS pixels_per_unit, 'success' AS status FROM ({_TICKS}) t")
def known_ticks(src):
    """Ruler profiles with a spike every 40 pixels, the first of them under the text."""
    zeros = "array_repeat(0.0D, CAST({} AS INT))".format
    comb = f"flatten(array_repeat(concat(array(100.0D), {zeros(39)}), CAST(5 + id % 6 AS INT)))"
    spikes = f"coalesce(concat({zeros('100 + id % 11')}, {comb}, {zeros('900 - id % 11 - 40 * (5 + id % 6)')}), {zeros(1000)})"
    profiles = src.spread("fragments_v").select("id", F.expr(spikes).alias("profile"), (F.col("id") % 4000).cast("double").alias("image_height"), F.lit(150).alias("text_end"))
    record = ru.scale_record(F.col("ticks"), F.lit("mm"), "3.1")
    rows = ru.detect_ticks(profiles).withColumn("r", record)
    text = lambda c: F.array_join(F.transform(c, lambda t: t.cast("string")), ",").alias(c)
    return rows.select("id", text("fixed"), text("adaptive"), F.col("r.pixels_per_unit").alias("pixels_per_unit"), F.col("r.scale_detection_status").alias("status"))


_MOVED = "SELECT c.id, q, radians((c.id * 7 + q * 3) % 36 * 10 - 175) AS t, CAST(c.id % 7 AS DOUBLE) AS sx, CAST(c.id % 5 - 2 AS DOUBLE) AS sy FROM contours_v c, (SELECT unnest(range(4)) AS q) a"


@query("known_placement", "I4", f"""SELECT id, q, round(-(cos(t) * sx + sin(t) * sy), 4) AS relative_x_cm, round(sin(t) * sx - cos(t) * sy, 4) AS relative_y_cm, round(-degrees(t), 4) AS rotation_deg, 0 AS alignment_error FROM ({_MOVED}) m""")
def known_placement(src):
    """Every quarter arc against a turned and shifted copy of itself: the fit is the motion back."""
    t = F.radians((F.col("id") * 7 + F.col("q") * 3) % 36 * 10 - 175)
    sx, sy = (F.col("id") % 7).cast("double"), (F.col("id") % 5 - 2).cast("double")
    arcs = _arcs(src).select("id", "q", F.transform("xs", lambda v: v / 50).alias("x"), F.transform("ys", lambda v: v / 50).alias("y"), F.cos(t).alias("c"), F.sin(t).alias("s"), sx.alias("sx"), sy.alias("sy"))
    turned = lambda f: F.zip_with("x", "y", f)
    pairs = arcs.select(
        "id", "q", F.struct(F.lit("left").alias("position"), F.col("x").alias("cm_x"), F.col("y").alias("cm_y")).alias("a"),
        F.struct(
            F.lit("right").alias("position"), turned(lambda x, y: F.col("c") * x - F.col("s") * y + F.col("sx")).alias("cm_x"),
            turned(lambda x, y: F.col("s") * x + F.col("c") * y + F.col("sy")).alias("cm_y"),
        ).alias("b"),
    )
    made = pairs.withColumn("p", mm.placement("a", "b"))
    return made.select("id", "q", *[F.round(f"p.{c}", 4).alias(c) for c in ("relative_x_cm", "relative_y_cm", "rotation_deg", "alignment_error")])


@query("known_overlap", "I5", """SELECT id, round(greatest(0, w - abs(dx)) * greatest(0, h - abs(dy)) / CAST(w * h AS DOUBLE), 6) AS overlap, greatest(0, w - abs(dx)) * greatest(0, h - abs(dy)) / CAST(w * h AS DOUBLE) <= 0.25 AS valid
FROM (SELECT id, 4 + id % 5 AS w, 3 + id % 4 AS h, id % 13 - 6 AS dx, id % 7 - 3 AS dy FROM fragments_v) q""")
def known_overlap(src):
    """Rectangles moved by whole cells."""
    corners = src.spread("fragments_v").selectExpr(
        "id", "array(0.0D, 4.0D + id % 5, 4.0D + id % 5, 0.0D) AS x", "array(0.0D, 0.0D, 3.0D + id % 4, 3.0D + id % 4) AS y",
        "CAST(id % 13 - 6 AS DOUBLE) AS dx", "CAST(id % 7 - 3 AS DOUBLE) AS dy",
    )
    ratio = mm.overlap_ratio(1.0)(F.col("x"), F.col("y"), F.col("x"), F.col("y"), F.col("dx"), F.col("dy"), F.lit(0.0))
    rows = corners.withColumn("overlap", ratio)
    return rows.select("id", F.round("overlap", 6).alias("overlap"), (F.col("overlap") <= 0.25).alias("valid"))


_TURNED = """SELECT id, w, h, CASE id % 4 WHEN 0 THEN dx WHEN 1 THEN dx - h WHEN 2 THEN dx - w ELSE dx END AS x, CASE id % 4 WHEN 0 THEN dy WHEN 1 THEN dy WHEN 2 THEN dy - h ELSE dy - w END AS y,
CASE id % 2 WHEN 0 THEN w ELSE h END AS across, CASE id % 2 WHEN 0 THEN h ELSE w END AS down FROM (SELECT id, 4 + id % 5 AS w, 3 + id % 4 AS h, id % 11 - 2 AS dx, id % 7 - 1 AS dy FROM fragments_v) q"""


@query("known_overlap_turned", "I5", f"SELECT id, round(greatest(0, least(w, x + across) - greatest(0, x)) * greatest(0, least(h, y + down) - greatest(0, y)) / CAST(w * h AS DOUBLE), 6) AS overlap FROM ({_TURNED}) t")
def known_overlap_turned(src):
    """Rectangles turned about a corner by quarters and moved by whole cells."""
    corners = src.spread("fragments_v").selectExpr(
        "id", "array(0.0D, 4.0D + id % 5, 4.0D + id % 5, 0.0D) AS x", "array(0.0D, 0.0D, 3.0D + id % 4, 3.0D + id % 4) AS y",
        "CAST(id % 11 - 2 AS DOUBLE) AS dx", "CAST(id % 7 - 1 AS DOUBLE) AS dy", "90.0D * (id % 4) AS turn",
    )
    ratio = mm.overlap_ratio(1.0)(*[F.col(c) for c in ("x", "y", "x", "y", "dx", "dy", "turn")])
    return corners.select("id", F.round(ratio, 6).alias("overlap"))


def _rectangles(src, angle: str):
    """Outlines of rectangles about (300, 300) whose sides and angle depend on the row."""
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    at = lambda first, second, sign: ", ".join(f"300 + {i} * w * {first} {sign} ({j}) * h * {second}" for i, j in corners)
    sized = src.spread("fragments_v").selectExpr("id", "70.0D + id % 60 AS w", "40.0D + id % 25 AS h", f"radians({angle}) AS t", "CAST(20 + id % 100 AS DOUBLE) AS pixels_per_unit")
    return sized.selectExpr("id", f"array({at('cos(t)', 'sin(t)', '-')}) AS xs", f"array({at('sin(t)', 'cos(t)', '+')}) AS ys", "pixels_per_unit")


_ALL_SIDES = "SELECT id, unnest(['top_edge', 'bottom_edge', 'left_edge', 'right_edge']) AS side, true AS border FROM fragments_v"

for _name, _method, _covers, _angle in (
    ("known_hull_segments", bd.hull_segments, "H16", "0"),
    ("known_oriented_runs", bd.oriented_runs, "H17", "id % 40"),
    ("known_oriented_runs_scaled", bd.oriented_runs_scaled, "H18", "id % 40"),
):

    @query(_name, _covers, _ALL_SIDES)
    def _known_borders(src, method=_method, angle=_angle):
        return method(_rectangles(src, angle)).select("id", "side", "border")
