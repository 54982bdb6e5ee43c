"""Contour geometry over the outline view; the SQL texts work on its long form, one row per point."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import polyline as pl
from ..functions.rules import per_cm
from ..operators import borders as bd
from ..operators import contours as ct
from .registry import query

E_ = "e0"
# quarter arcs of every outline, by index: an open polyline per (id, q)
_ARCS = "SELECT p.id, q, i - CAST(floor(q * n / 4.0) AS BIGINT) AS j, x, y FROM points_v p, (SELECT unnest(range(4)) AS q) a WHERE i >= floor(q * n / 4.0) AND i <= floor((q + 1) * n / 4.0) - 1"


def _arcs(src):
    n = F.size("xs")
    cut = lambda c: F.slice(F.col(c), F.floor(F.col("q") * n / 4.0).cast("int") + 1, (F.floor((F.col("q") + 1) * n / 4.0) - F.floor(F.col("q") * n / 4.0)).cast("int"))
    exploded = src("contours_v").withColumn("q", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])))
    return pl.hold(exploded, {"xs": cut("xs"), "ys": cut("ys")})


def _round(df, *names, places=4):
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


def _nested(src):
    """Several contours per fragment: the outline, one too short, and a square of varying size."""
    side = (F.col("id") % 900).cast("double")
    square = F.array(*[F.array(a, b) for a, b in ((F.lit(0.0), F.lit(0.0)), (side, F.lit(0.0)), (side, side), (F.lit(0.0), side))])
    short = F.array(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(5000.0), F.lit(1.0)))
    outline = F.zip_with("xs", "ys", lambda x, y: F.array(x, y))
    return src("contours_v").select("id", F.array(short, outline, square).alias("contours"))


_AREA = "abs(sum(x * ny - nx * y)) / 2 FROM (SELECT id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM points_v WINDOW w AS (PARTITION BY id ORDER BY i)) p GROUP BY id"


@query("largest_contour", "H1", f"""SELECT id, greatest(a, s * s) AS area, CASE WHEN a >= s * s THEN 1 ELSE 2 END AS contour_no, CASE WHEN a >= s * s THEN n ELSE 4 END AS points FROM (
SELECT r.id, a, CAST(r.id % 900 AS DOUBLE) AS s, n FROM (SELECT id, {_AREA.replace('/ 2 FROM', '/ 2 AS a FROM')}) r JOIN contours_v c ON c.id = r.id) q""")
def largest_contour(src):
    best = _nested(src).select("id", ct.largest_contour(F.col("contours")).alias("b"))
    return best.select("id", "b.area", F.col("b.contour_no").cast("long").alias("contour_no"), F.size("b.xs").cast("long").alias("points"))


@query("explode_contours", "H1", """SELECT id, 1 AS contour_no, n AS points FROM contours_v UNION ALL SELECT id, 2, 4 FROM contours_v""")
def explode_contours(src):
    return ct.explode_contours(_nested(src)).select("id", "contour_no", F.size("xs").cast("long").alias("points"))


def _points(df, x="xs", y="ys"):
    return df.select("id", F.posexplode(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y"))).alias("i", "p")).select("id", "i", "p.x", "p.y")


def _window_mean(source: str, radius: int, outer: str) -> str:
    """SQL moving average: the ring padded by the radius at both ends, then a row window."""
    return f"""SELECT id, n, k AS i, {outer.format('x')} AS x, {outer.format('y')} AS y FROM (SELECT id, n, k, avg(x) OVER w AS x, avg(y) OVER w AS y FROM (
SELECT id, n, i AS k, x, y FROM {source} UNION ALL SELECT id, n, i - n, x, y FROM {source} WHERE i >= n - {radius} UNION ALL SELECT id, n, i + n, x, y FROM {source} WHERE i < {radius}) pad
WINDOW w AS (PARTITION BY id ORDER BY k ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)) sm WHERE k >= 0 AND k < n"""


@query("smooth_contour", "H2", f"SELECT id, i, x, y FROM ({_window_mean('points_v', 3, 'round({0}, 4)')}) q")
def smooth_contour(src):
    return _round(_points(ct.smooth_contour(src("contours_v"), 7)), "x", "y")


@query("smooth_whole_pixels", "H2", f"""WITH once AS ({_window_mean('points_v', 2, 'trunc({0})')}) SELECT id, i, x, y FROM ({_window_mean('once', 2, 'trunc({0})')}) q""")
def smooth_whole_pixels(src):
    return _points(ct.smooth_contour(src("contours_v"), 5, passes=2, whole_pixels=True))


@query("curvature", "H3", """SELECT id, i, round(CASE WHEN na > 0 AND nb > 0 THEN pi() - acos(greatest(-1, least(1, (a_x * b_x + a_y * b_y) / (na * nb)))) ELSE 0 END, 4) AS curvature FROM (
SELECT *, sqrt(a_x * a_x + a_y * a_y) AS na, sqrt(b_x * b_x + b_y * b_y) AS nb FROM (SELECT p.id, p.i, p.x - b.x AS a_x, p.y - b.y AS a_y, f.x - p.x AS b_x, f.y - p.y AS b_y
FROM points_v p JOIN points_v b ON b.id = p.id AND b.i = (p.i - 5 + p.n) % p.n JOIN points_v f ON f.id = p.id AND f.i = (p.i + 5) % p.n) q) r""")
def curvature(src):
    bent = src("contours_v").select("id", F.posexplode(pl.curvature(F.col("xs"), F.col("ys"))).alias("i", "curvature"))
    return _round(bent, "curvature")


@query("find_corners", "H4")
def find_corners(src):
    return ct.with_corners(src("contours_v")).select("id", F.posexplode("corners").alias("corner_no", "place"))


@query("segment_contour", "H5", """WITH corners AS (SELECT c.id, n, k * 70 + c.id % 30 AS place, k, 5 + (CASE WHEN 350 + c.id % 30 < n - 1 THEN 1 ELSE 0 END) AS m FROM contours_v c, (SELECT unnest(range(6)) AS k) a WHERE k * 70 + c.id % 30 < n - 1),
cuts AS (SELECT *, coalesce(lead(place) OVER (PARTITION BY id ORDER BY k), first_value(place) OVER (PARTITION BY id ORDER BY k)) AS until FROM corners),
kept AS (SELECT id, n, place AS a, until AS b, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS segment_id FROM cuts WHERE CASE WHEN until > place THEN until - place + 1 ELSE n - place + until + 1 END >= 60)
SELECT k.id, segment_id, a AS start_idx, b AS end_idx, count(*) AS points, sum(x) AS sum_x FROM kept k JOIN points_v p ON p.id = k.id AND (CASE WHEN b > a THEN p.i BETWEEN a AND b ELSE p.i >= a OR p.i <= b END) GROUP BY ALL""")
def segment_contour(src):
    corners = F.filter(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: (k * 70 + F.col("id") % 30).cast("int")), lambda c: c < F.size("xs") - 1)
    cut = ct.segment_contour(src("contours_v").withColumn("corners", corners), shortest=60)
    return cut.select("id", F.col("segment_id").cast("long"), "start_idx", "end_idx", F.size("xs").cast("long").alias("points"), pl.total(F.col("xs")).alias("sum_x"))


_PROPS = f"""SELECT id, q, sum(step) AS length, sum(step) / nullif(sqrt(power(max(lx) - max(fx), 2) + power(max(ly) - max(fy), 2)), 0) AS straightness,
0.5e0 * atan2(2 * sum((x - mx) * (y - my)), sum((x - mx) * (x - mx)) - sum((y - my) * (y - my))) AS direction, max(mx) AS centroid_x, max(my) AS centroid_y FROM (
SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, first_value(x) OVER o AS fx, first_value(y) OVER o AS fy, last_value(x) OVER a AS lx, last_value(y) OVER a AS ly,
coalesce(sqrt(power(x - lag(x) OVER o, 2) + power(y - lag(y) OVER o, 2)), 0) AS step FROM ({_ARCS}) arcs
WINDOW w AS (PARTITION BY id, q), o AS (PARTITION BY id, q ORDER BY j), a AS (PARTITION BY id, q ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) p GROUP BY id, q"""


@query("segment_props", "H6", f"""SELECT id, q, round(length, 4) AS length, round(straightness, 4) AS straightness, round(abs(direction), 4) AS direction, round(centroid_x, 4) AS centroid_x, round(centroid_y, 4) AS centroid_y FROM ({_PROPS}) r""")
def segment_props(src):
    props = ct.with_segment_props(_arcs(src)).withColumn("direction", F.abs("direction"))
    names = ("length", "straightness", "direction", "centroid_x", "centroid_y")
    return _round(props, *names).select("id", "q", *names)


_LABEL = """CASE WHEN NOT upright AND ny < 0.35 THEN 'top' WHEN NOT upright AND ny > 0.65 THEN 'bottom' WHEN upright AND nx < 0.35 THEN 'left' WHEN upright AND nx > 0.65 THEN 'right'
WHEN ny < 0.25 THEN 'top' WHEN ny > 0.75 THEN 'bottom' WHEN nx < 0.25 THEN 'left' WHEN nx > 0.75 THEN 'right' ELSE 'corner' END"""
_LABELLED = f"""SELECT *, {_LABEL} AS position, CASE WHEN straightness > 1.1 THEN 'tear' ELSE 'border' END AS edge_type FROM (
SELECT r.*, abs(direction) >= pi() / 4 AND abs(direction) <= 3 * pi() / 4 AS upright, centroid_x / 1200 AS nx, centroid_y / 1000 AS ny FROM ({_PROPS}) r) s"""


@query("segment_labels", "H7", f"SELECT id, q, position, edge_type FROM ({_LABELLED}) t")
def segment_labels(src):
    framed = ct.with_segment_props(_arcs(src)).withColumn("image_width", F.lit(1200)).withColumn("image_height", F.lit(1000))
    return ct.with_segment_labels(framed).select("id", "q", "position", "edge_type")


@query("quadrant_edges", "H8", """WITH side_points AS (SELECT id, i, x, y, 'top_edge' AS side FROM points_v WHERE y < 250 UNION ALL SELECT id, i, x, y, 'bottom_edge' FROM points_v WHERE y > 750
UNION ALL SELECT id, i, x, y, 'left_edge' FROM points_v WHERE x < 300 UNION ALL SELECT id, i, x, y, 'right_edge' FROM points_v WHERE x > 900),
stepped AS (SELECT *, sqrt(power(x - lag(x) OVER o, 2) + power(y - lag(y) OVER o, 2)) AS step FROM side_points WINDOW o AS (PARTITION BY id, side ORDER BY i))
SELECT id, side, count(*) AS points, round(sum(step), 4) AS length, CASE WHEN sqrt(power(arg_max(x, i) - arg_min(x, i), 2) + power(arg_max(y, i) - arg_min(y, i), 2)) = 0 THEN true
ELSE sum(step) / sqrt(power(arg_max(x, i) - arg_min(x, i), 2) + power(arg_max(y, i) - arg_min(y, i), 2)) > 1.15 END AS torn FROM stepped GROUP BY id, side HAVING count(*) > 10""")
def quadrant_edges(src):
    framed = src("contours_v").withColumn("image_width", F.lit(1200)).withColumn("image_height", F.lit(1000))
    made = ct.quadrant_edges(framed)
    return made.select("id", "side", F.size("xs").cast("long").alias("points"), F.round(pl.path_length(F.col("xs"), F.col("ys")), 4).alias("length"), "torn")


# resampled arcs: target t of 80 lies in the step whose running length brackets it
_SAMPLED = f"""SELECT id, q, t, x0 + (x - x0) * w AS x, y0 + (y - y0) * w AS y FROM (SELECT r.id, r.q, t, s.x0, s.x, s.y0, s.y, greatest(0, least(1, (r.total * t / 79 - s.before) / s.step)) AS w,
row_number() OVER (PARTITION BY r.id, r.q, t ORDER BY s.j) AS rn FROM (SELECT id, q, max(along) AS total FROM along GROUP BY id, q) r, (SELECT unnest(range(80)) AS t) g, along s
WHERE s.id = r.id AND s.q = r.q AND s.step > 0 AND (s.along >= r.total * t / 79 - 1e-9)) z WHERE rn = 1"""
_ALONG = f"""WITH steps AS (SELECT *, lag(x) OVER o AS x0, lag(y) OVER o AS y0, sqrt(power(x - lag(x) OVER o, 2) + power(y - lag(y) OVER o, 2)) AS step FROM ({_ARCS}) arcs WINDOW o AS (PARTITION BY id, q ORDER BY j)),
along AS (SELECT *, sum(step) OVER (PARTITION BY id, q ORDER BY j) AS along, sum(step) OVER (PARTITION BY id, q ORDER BY j) - step AS before FROM steps),
sampled AS ({_SAMPLED})"""


@query("resample", "H9", f"{_ALONG} SELECT id, q, t, round(x, 4) AS x, round(y, 4) AS y FROM sampled")
def resample(src):
    sampled = ct.resample(_arcs(src))
    long = sampled.select("id", "q", F.posexplode(F.arrays_zip(F.col("rx").alias("x"), F.col("ry").alias("y"))).alias("t", "p"))
    return _round(long.select("id", "q", "t", "p.x", "p.y"), "x", "y")


def _descriptors(src):
    framed = _arcs(src).withColumn("image_width", F.lit(1200)).withColumn("image_height", F.lit(1000)).withColumn("segment_id", F.col("q"))
    return ct.edge_descriptors(ct.with_segment_labels(ct.with_segment_props(framed)))


_KEPT = f"""kept AS (SELECT l.id, l.q, position || '_seg' || CAST(l.q AS VARCHAR) AS edge_name, length / (pixels_per_unit * CASE WHEN scale_unit = 'mm' THEN 10 ELSE 1 END) AS length_cm FROM ({_LABELLED}) l JOIN fragments_v f ON f.id = l.id
WHERE edge_type = 'tear' AND position <> 'corner' AND length / (pixels_per_unit * CASE WHEN scale_unit = 'mm' THEN 10 ELSE 1 END) >= 0.3),
shaped AS (SELECT s.id, s.q, t, edge_name, length_cm, s.x - avg(s.x) OVER w AS cx, s.y - avg(s.y) OVER w AS cy, s.x, s.y FROM sampled s JOIN kept k ON k.id = s.id AND k.q = s.q WINDOW w AS (PARTITION BY s.id, s.q)),
normal AS (SELECT *, cx / max(sqrt(cx * cx + cy * cy)) OVER (PARTITION BY id, q) AS nx, cy / max(sqrt(cx * cx + cy * cy)) OVER (PARTITION BY id, q) AS ny FROM shaped)"""


@query("edge_descriptors", "H10", f"{_ALONG}, {_KEPT} SELECT id, edge_name, round(length_cm, 4) AS length_cm, t, round(nx, 4) AS shape_x, round(ny, 4) AS shape_y FROM normal")
def edge_descriptors(src):
    long = _descriptors(src).select(
        "id", "edge_name", "length_cm", F.posexplode(F.arrays_zip("shape_x", "shape_y")).alias("t", "p")
    ).select("id", "edge_name", "length_cm", "t", "p.shape_x", "p.shape_y")
    return _round(long, "length_cm", "shape_x", "shape_y")


@query("fourier", "H11", f"""{_ALONG}, {_KEPT}, shapes AS MATERIALIZED (SELECT id, edge_name, list(nx ORDER BY t) AS xs, list(ny ORDER BY t) AS ys FROM normal GROUP BY id, edge_name),
terms AS (SELECT id, edge_name, list_transform(range(1, 17), lambda k: sqrt(power(list_sum(list_transform(range(80), lambda t: xs[t + 1] * cos(2 * pi() * k * t / 80) + ys[t + 1] * sin(2 * pi() * k * t / 80))), 2)
+ power(list_sum(list_transform(range(80), lambda t: ys[t + 1] * cos(2 * pi() * k * t / 80) - xs[t + 1] * sin(2 * pi() * k * t / 80))), 2))) AS ms FROM shapes)
SELECT id, edge_name, k, round(ms[k] / ms[1], 4) AS term FROM terms, (SELECT unnest(range(1, 17)) AS k) a""")
def fourier(src):
    long = _descriptors(src).select("id", "edge_name", F.posexplode("fourier").alias("k", "term"))
    return _round(long.withColumn("k", F.col("k") + 1), "term")


# turning angles of the raw arcs, where most points lie on whole pixels
_TURNS = f"""SELECT id, q, acos(greatest(-1, least(1, (a_x * b_x + a_y * b_y) / (sqrt(a_x * a_x + a_y * a_y) * sqrt(b_x * b_x + b_y * b_y))))) AS angle FROM (SELECT *, x - lag(x) OVER o AS a_x, y - lag(y) OVER o AS a_y, lead(x) OVER o - x AS b_x, lead(y) OVER o - y AS b_y
FROM ({_ARCS}) arcs WINDOW o AS (PARTITION BY id, q ORDER BY j)) s WHERE a_x * a_x + a_y * a_y > 0 AND b_x * b_x + b_y * b_y > 0"""


@query("curvature_histogram", "H12", f"""SELECT id, q, b AS bin, round(count(*) FILTER (least(floor(angle / pi() * 8), 7) = b) / CAST(count(*) AS DOUBLE), 4) AS share FROM ({_TURNS}) t, (SELECT unnest(range(8)) AS b) a GROUP BY id, q, b""")
def curvature_histogram(src):
    long = _arcs(src).select("id", "q", F.posexplode(pl.curvature_histogram(F.col("xs"), F.col("ys"))).alias("bin", "share"))
    return _round(long, "share")


@query("complexity", "H13", f"SELECT id, q, round(stddev_pop(angle), 4) AS complexity FROM ({_TURNS}) t GROUP BY id, q")
def complexity(src):
    return _arcs(src).select("id", "q", F.round(pl.complexity(F.col("xs"), F.col("ys")), 4).alias("complexity"))


@query("to_cm", "H14", "SELECT id, round(pixels_per_unit * CASE WHEN scale_unit = 'mm' THEN 10 ELSE 1 END, 6) AS per_cm FROM fragments_v")
def to_cm(src):
    return src("fragments_v").select("id", F.round(per_cm(F.col("pixels_per_unit"), F.col("scale_unit")), 6).alias("per_cm"))


@query("line_fit", "H19", f"""SELECT m.id, m.q, round(avg(abs((x - mx) * sin(d) - (y - my) * cos(d))), 4) AS err, round(max(abs(degrees(d))), 4) AS angle FROM (SELECT id, q, direction AS d, centroid_x AS mx, centroid_y AS my FROM ({_PROPS}) r) m
JOIN ({_ARCS}) p ON p.id = m.id AND p.q = m.q GROUP BY m.id, m.q""")
def line_fit(src):
    fit = _arcs(src).select("id", "q", pl.line_fit(F.col("xs"), F.col("ys")).alias("f"))
    return _round(fit.select("id", "q", "f.err", "f.angle"), "err", "angle")


# ---- borders ------------------------------------------------------------------------------------------

_NEAR = """WITH box AS (SELECT id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, greatest(1, max(x) - min(x) + 1) AS bw, greatest(1, max(y) - min(y) + 1) AS bh FROM points_v GROUP BY id),
near AS (SELECT p.id, p.n, p.i, p.x, p.y, side FROM points_v p JOIN box b ON b.id = p.id, (SELECT unnest(['top_edge', 'bottom_edge', 'left_edge', 'right_edge']) AS side) s WHERE CASE side
WHEN 'top_edge' THEN abs(y - y0) <= greatest(2, floor(bh * 0.05e0)) WHEN 'bottom_edge' THEN abs(y - y1) <= greatest(2, floor(bh * 0.05e0)) WHEN 'left_edge' THEN abs(x - x0) <= greatest(2, floor(bw * 0.05e0)) ELSE abs(x - x1) <= greatest(2, floor(bw * 0.05e0)) END),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY id, side ORDER BY i) AS island FROM near),
runs AS (SELECT id, side, island, min(i) AS a, max(i) AS b, max(n) AS n, count(*) AS points, max(x) - min(x) AS sx, max(y) - min(y) AS sy FROM islands GROUP BY id, side, island),
ends AS (SELECT *, bool_or(a = 0) OVER s AND bool_or(b = n - 1) OVER s AND count(*) OVER s > 1 AS wraps FROM runs WINDOW s AS (PARTITION BY id, side)),
rated AS (SELECT e.*, CASE WHEN side IN ('top_edge', 'bottom_edge') THEN sx / bw ELSE sy / bh END AS coverage FROM ends e JOIN box b ON b.id = e.id WHERE points >= 20 AND NOT (wraps AND (a = 0 OR b = n - 1))),
best AS (SELECT *, row_number() OVER (PARTITION BY id, side ORDER BY coverage DESC, a) AS rn FROM rated WHERE coverage >= 0.05),
centre AS (SELECT r.id, r.side, r.coverage, avg(p.x) AS mx, avg(p.y) AS my, r.a, r.b FROM best r JOIN points_v p ON p.id = r.id AND p.i BETWEEN r.a AND r.b WHERE rn = 1 GROUP BY ALL),
angled AS (SELECT c.id, c.side, c.coverage, c.mx, c.my, c.a, c.b, 0.5e0 * atan2(2 * sum((x - mx) * (y - my)), sum((x - mx) * (x - mx)) - sum((y - my) * (y - my))) AS d FROM centre c JOIN points_v p ON p.id = c.id AND p.i BETWEEN c.a AND c.b GROUP BY ALL),
fitted AS (SELECT g.id, g.side, g.coverage, avg(abs((x - mx) * sin(d) - (y - my) * cos(d))) AS err FROM angled g JOIN points_v p ON p.id = g.id AND p.i BETWEEN g.a AND g.b GROUP BY g.id, g.side, g.coverage)
SELECT c.id, s.side, round(coalesce(f.coverage, 0), 4) AS coverage, round(err, 4) AS line_err, err <= 18 AS border FROM contours_v c CROSS JOIN (SELECT unnest(['top_edge', 'bottom_edge', 'left_edge', 'right_edge']) AS side) s LEFT JOIN fitted f ON f.id = c.id AND f.side = s.side"""


@query("bbox_runs", "H15", _NEAR)
def bbox_runs(src):
    return _round(bd.bbox_runs(src("contours_v")), "coverage", "line_err")


@query("hull_segments", "H16")
def hull_segments(src):
    return _round(bd.hull_segments(src("contours_v")), "coverage", "line_err")


@query("oriented_runs", "H17")
def oriented_runs(src):
    return _round(bd.oriented_runs(src("contours_v")), "coverage", "line_err", "confidence").drop("judged")


@query("oriented_runs_scaled", "H18")
def oriented_runs_scaled(src):
    return _round(bd.oriented_runs_scaled(src("contours_v")), "coverage", "line_err", "confidence").drop("judged")


# failed by the classifier: a quarter; of those some without an outline row, with a NULL one, or with two points
_FALLBACK = f"""WITH sides AS ({_NEAR}), flags AS (SELECT id, coalesce(bool_or(border) FILTER (side = 'top_edge'), false) AS t, coalesce(bool_or(border) FILTER (side = 'bottom_edge'), false) AS b,
coalesce(bool_or(border) FILTER (side = 'left_edge'), false) AS l, coalesce(bool_or(border) FILTER (side = 'right_edge'), false) AS r FROM sides GROUP BY id),
chosen AS (SELECT f.id, f.id % 4 = 1 AS failed, CASE WHEN f.id % 20 IN (1, 5) THEN 'segmentation_coords missing contours' WHEN f.id % 20 = 9 THEN 'No valid contours' END AS second,
CASE WHEN f.id % 4 = 1 THEN g.t ELSE coalesce(has_top_edge, false) END AS t, CASE WHEN f.id % 4 = 1 THEN g.b ELSE coalesce(has_bottom_edge, false) END AS b,
CASE WHEN f.id % 4 = 1 THEN g.l ELSE coalesce(has_left_edge, false) END AS l, CASE WHEN f.id % 4 = 1 THEN g.r ELSE coalesce(has_right_edge, false) END AS r FROM fragments_v f JOIN flags g ON g.id = f.id)
SELECT id, CASE WHEN second IS NULL THEN t END AS has_top_edge, CASE WHEN second IS NOT NULL THEN NULL WHEN failed THEN 'bbox_runs' ELSE 'classifier' END AS method, second AS error, CASE WHEN failed THEN 'no model' END AS fallback_error,
CASE WHEN second IS NOT NULL THEN NULL WHEN (t OR b) AND (l OR r) THEN 'corner' WHEN t OR b OR l OR r THEN 'edge' ELSE 'interior' END AS piece_type FROM chosen"""


def _with_fallback(src, method: str):
    flags = [f"coalesce(has_{s}, false) AS has_{s}" for s in bd.SIDE_EDGES]
    classified = src("fragments_v").selectExpr("id", *flags, "CASE WHEN id % 4 = 1 THEN 'no model' END AS error")
    spoilt = lambda c: f"CASE WHEN id % 20 = 5 THEN NULL WHEN id % 20 = 9 THEN slice({c}, 1, 2) ELSE {c} END AS {c}"
    outlines = src("contours_v").filter("id % 20 <> 1").selectExpr("id", "pixels_per_unit", spoilt("xs"), spoilt("ys"))
    return bd.edges_with_fallback(outlines, classified, method)


@query("edges_with_fallback", "H20 G7", _FALLBACK)
def edges_with_fallback(src):
    return _with_fallback(src, "bbox_runs").select("id", "has_top_edge", "method", "error", "fallback_error", "piece_type")


def _fallback_outcome(method: str) -> str:
    """What becomes of each fragment, whichever the heuristic: method, errors, and flags where there are any."""
    return f"""SELECT id, CASE WHEN id % 4 <> 1 THEN 'classifier' WHEN id % 20 IN (1, 5, 9) THEN NULL ELSE '{method}' END AS method, CASE WHEN id % 20 IN (1, 5) THEN 'segmentation_coords missing contours'
WHEN id % 20 = 9 THEN 'No valid contours' END AS error, CASE WHEN id % 4 = 1 THEN 'no model' END AS fallback_error, id % 20 NOT IN (1, 5, 9) AS judged FROM fragments_v"""


for _method in ("hull_segments", "oriented_runs", "oriented_runs_scaled"):

    @query(f"fallback_{_method}", "H20 " + {"hull_segments": "H16", "oriented_runs": "H17", "oriented_runs_scaled": "H18"}[_method], _fallback_outcome(_method))
    def _outcome(src, method=_method):
        flags = [F.col(f"has_{s}").isNotNull() for s in bd.SIDE_EDGES]
        judged = flags[0] & flags[1] & flags[2] & flags[3] & F.col("piece_type").isNotNull()
        return _with_fallback(src, method).select("id", "method", "error", "fallback_error", judged.alias("judged"))
