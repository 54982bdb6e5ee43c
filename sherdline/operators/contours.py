"""Contour geometry: from outlines to torn-edge descriptors, one row per contour or edge, no shuffles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polyline as pl
from ..functions.rules import per_cm
from ..functions.shapes import find_corners, fourier_terms, resampler

MIN_SEGMENT = 50
MIN_EDGE_CM = 0.3
TEAR_STRAIGHTNESS = 1.10
SAMPLES = 80


def explode_contours(df: DataFrame, contours: str = "contours") -> DataFrame:
    """Adds ``contour_no, xs, ys`` for every contour of at least three two-value points."""
    flat = df.select("*", F.posexplode(contours).alias("contour_no", "__points")).drop(contours)
    valid = (F.size("__points") >= 3) & F.forall("__points", lambda p: F.size(p) == 2)
    axis = lambda i: F.transform("__points", lambda p: F.get(p, F.lit(i)))
    return pl.hold(flat.filter(valid), {"xs": axis(0), "ys": axis(1)}).drop("__points")


def largest_contour(contours: Column) -> Column:
    """``struct<area, contour_no, xs, ys>`` of the contour with the largest area, the first of equals."""

    def measured(points: Column, number: Column) -> Column:
        axes = F.struct(
            F.transform(points, lambda p: F.get(p, F.lit(0))).alias("xs"), F.transform(points, lambda p: F.get(p, F.lit(1))).alias("ys")
        )
        return pl.let(
            axes,
            lambda a: F.struct(
                pl.area(a["xs"], a["ys"]).alias("area"), (-number).alias("order"), a["xs"].alias("xs"), a["ys"].alias("ys")
            ),
        )

    numbered = F.transform(contours, lambda c, i: F.struct(c.alias("points"), i.alias("number")))
    valid = F.filter(numbered, lambda c: (F.size(c["points"]) >= 3) & F.forall(c["points"], lambda p: F.size(p) == 2))
    best = F.array_max(F.transform(valid, lambda c: measured(c["points"], c["number"])))
    return pl.let(
        best,
        lambda b: F.when(
            b.isNotNull(), F.struct(b["area"].alias("area"), (-b["order"]).alias("contour_no"), b["xs"].alias("xs"), b["ys"].alias("ys"))
        ),
    )


def smooth_contour(df: DataFrame, window: int = 7, passes: int = 1, whole_pixels: bool = False) -> DataFrame:
    smooth = lambda c: pl.moving_average(F.col(c), window, passes, whole_pixels)
    return pl.hold(df, {"xs": smooth("xs"), "ys": smooth("ys")})


def with_corners(df: DataFrame) -> DataFrame:
    """Adds ``corners``: places of the curvature peaks, ascending."""
    bent = pl.hold(df, {"__curvature": pl.curvature(F.col("xs"), F.col("ys"))})
    return bent.withColumn("corners", find_corners(F.col("__curvature"))).drop("__curvature")


def segment_contour(df: DataFrame, corners: str = "corners", shortest: int = MIN_SEGMENT) -> DataFrame:
    """Cuts contours between consecutive corners (the last piece wraps); short pieces are dropped and
    ``segment_id`` counts what is left.  Below two corners the whole contour is one piece."""
    n, c = F.size("xs"), F.col(corners)
    piece = lambda i: F.struct(
        F.get(c, i).alias("start"), F.get(c, F.pmod(i + 1, F.size(c))).alias("end")
    )
    length = lambda s: F.when(s["end"] > s["start"], s["end"] - s["start"] + 1).otherwise(n - s["start"] + s["end"] + 1)
    cut = F.filter(F.transform(pl.indices(F.size(c)), piece), lambda s: length(s) >= shortest)
    whole = F.array(F.struct(F.lit(0).alias("start"), (n - 1).alias("end")))
    pieces = F.when(F.size(c) < 2, whole).otherwise(cut)
    exploded = df.select("*", F.posexplode(pieces).alias("segment_id", "__s"))
    start, end = F.col("__s.start"), F.col("__s.end")
    arcs = {"xs": pl.arc(F.col("xs"), start, end), "ys": pl.arc(F.col("ys"), start, end)}
    return pl.hold(exploded.withColumn("start_idx", start).withColumn("end_idx", end), arcs).drop("__s", corners)


def with_segment_props(df: DataFrame) -> DataFrame:
    """Adds ``length, straightness, direction, centroid_x, centroid_y`` of an open polyline."""
    xs, ys = F.col("xs"), F.col("ys")
    enough = F.size("xs") >= 2
    m = pl.hold(df, {"__m": pl.moments(xs, ys)})
    zero = F.lit(0.0)
    return m.withColumns(
        {
            "length": F.when(enough, pl.path_length(xs, ys)).otherwise(zero),
            "straightness": F.when(enough, pl.straightness(xs, ys)).otherwise(F.lit(1.0)),
            "direction": F.when(enough, pl.direction_of(F.col("__m"))).otherwise(zero),
            "centroid_x": F.when(enough, F.col("__m.mx")).otherwise(zero),
            "centroid_y": F.when(enough, F.col("__m.my")).otherwise(zero),
        }
    ).drop("__m")


def position_label(direction: Column, cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """Side of the image a segment lies on, from its direction and the place of its centroid."""
    nx, ny, turn = cx / width, cy / height, F.abs(direction)
    level = (turn < math.pi / 4) | (turn > 3 * math.pi / 4)
    upright = (turn >= math.pi / 4) & (turn <= 3 * math.pi / 4)
    return (
        F.when(level & (ny < 0.35), "top").when(level & (ny > 0.65), "bottom")
        .when(upright & (nx < 0.35), "left").when(upright & (nx > 0.65), "right")
        .when(ny < 0.25, "top").when(ny > 0.75, "bottom").when(nx < 0.25, "left").when(nx > 0.75, "right")
        .otherwise("corner")
    )


def edge_type(straightness: Column) -> Column:
    return F.when(straightness > TEAR_STRAIGHTNESS, "tear").otherwise("border")


def with_segment_labels(df: DataFrame, width: str = "image_width", height: str = "image_height") -> DataFrame:
    label = position_label(*[F.col(c) for c in ("direction", "centroid_x", "centroid_y", width, height)])
    return df.withColumn("position", label).withColumn("edge_type", edge_type(F.col("straightness")))


def resample(df: DataFrame, n: int = SAMPLES, out: tuple[str, str] = ("rx", "ry")) -> DataFrame:
    sampled = df.withColumn("__r", resampler(n)(F.col("xs"), F.col("ys")))
    return sampled.withColumn(out[0], F.col("__r.xs")).withColumn(out[1], F.col("__r.ys")).drop("__r")


def edge_descriptors(segments: DataFrame) -> DataFrame:
    """Descriptors of the torn, non-corner segments that are long enough.

    ``segments`` has ``fragment_id, segment_id, xs, ys``, the properties and labels, and the
    fragment's ``pixels_per_unit, scale_unit, line_count, script_type``.
    """
    ratio = per_cm(F.col("pixels_per_unit"), F.col("scale_unit"))
    kept = (
        segments.filter((F.col("edge_type") == "tear") & (F.col("position") != "corner"))
        .withColumn("per_cm", ratio)
        .withColumn("length_cm", F.col("length") / F.col("per_cm"))
        .filter(F.col("length_cm") >= MIN_EDGE_CM)
    )
    sampled = resample(kept).filter(F.col("rx").isNotNull())
    # radius_cm is the unit of the normalised shape, so shape times radius_cm is the centred edge in cm
    centre = pl.hold(sampled, {"__cx": pl.centred(F.col("rx")), "__cy": pl.centred(F.col("ry"))})

    radius = F.array_max(F.zip_with("__cx", "__cy", lambda x, y: F.sqrt(x * x + y * y)))

    def scaled(name: str) -> Column:
        return pl.let(F.when(radius > 0, radius).otherwise(1.0), lambda r: F.transform(name, lambda v: v / r))

    in_cm = lambda name: pl.let(F.col("per_cm"), lambda r: F.transform(name, lambda v: v / r))
    shaped = pl.hold(centre, {"shape_x": scaled("__cx"), "shape_y": scaled("__cy"), "__radius": radius})
    return shaped.withColumns(
        {
            "edge_name": F.concat("position", F.lit("_seg"), F.col("segment_id").cast("string")),
            "fourier": fourier_terms(16)(F.col("shape_x"), F.col("shape_y")),
            "histogram": pl.curvature_histogram(F.col("rx"), F.col("ry")),
            "complexity": pl.complexity(F.col("rx"), F.col("ry")),
            "cm_x": in_cm("xs"),
            "cm_y": in_cm("ys"),
            "radius_cm": F.when(F.col("__radius") > 0, F.col("__radius")).otherwise(1.0) / F.col("per_cm"),
        }
    ).drop("__cx", "__cy", "__radius", "rx", "ry")


def extract_edges(contours: DataFrame) -> DataFrame:
    """Whole chain from outlines (``xs, ys``, at least 20 points) to edge descriptors."""
    # held, or the optimizer tests the size before the rows are spread, and so makes outlines twice, first in few tasks
    enough = pl.hold(contours, {"xs": F.col("xs"), "ys": F.col("ys")}).filter(F.size("xs") >= 20)
    segments = with_segment_labels(with_segment_props(segment_contour(with_corners(enough))))
    return edge_descriptors(segments)


def quadrant_edges(df: DataFrame, width: str = "image_width", height: str = "image_height") -> DataFrame:
    """Outer-quarter points of each side as one polyline; sides of more than ten points are torn when
    their path is over 1.15 times the chord, or the chord is zero.  One row per such side."""
    points = F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y"))
    tests = {
        "top_edge": lambda p: p["y"] < F.col(height) / 4,
        "bottom_edge": lambda p: p["y"] > 3 * F.col(height) / 4,
        "left_edge": lambda p: p["x"] < F.col(width) / 4,
        "right_edge": lambda p: p["x"] > 3 * F.col(width) / 4,
    }
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.filter(points, t).alias("points")) for s, t in tests.items()])
    rows = df.select("*", F.explode(F.filter(sides, lambda s: F.size(s["points"]) > 10)).alias("__s"))
    axis = lambda c: F.transform("__s.points", lambda p: p[c])
    lined = pl.hold(rows.withColumn("side", F.col("__s.side")), {"xs": axis("x"), "ys": axis("y")}).drop("__s")
    return lined.withColumn("torn", pl.straightness(F.col("xs"), F.col("ys")) > 1.15)
