"""Which sides of a fragment are straight borders and which are tears, by four heuristics.

Each heuristic takes outlines (``id, xs, ys`` and, for the scaled one, ``pixels_per_unit``) and gives
one row per fragment and side: ``side, coverage, line_err`` and ``border`` (NULL without support).  No
fragment is left out: one without an outline, or with one that cannot be judged, has four sides without
support, and ``edges_by_method`` names the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polyline as pl
from ..functions.rules import piece_type
from ..functions.shapes import PIECE, RUN, hull_sides, side_runs
from .model_outputs import SIDE_EDGES, crop_geometry


def _horizontal(side: Column) -> Column:
    return side.isin("top_edge", "bottom_edge")


def _side_rows(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """One row per side with the runs of points that lie near it."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), m.alias("mask")) for s, m in masks.items()])
    rows = df.select("*", F.explode(sides).alias("__s"))
    return pl.hold(rows.withColumn("side", F.col("__s.side")), {"__runs": pl.circular_runs(F.col("__s.mask"))}).drop("__s")


def bbox_runs(df: DataFrame, near: float = 0.05, min_run: float = 0.05, max_err: float = 18.0) -> DataFrame:
    """Widest run of points near each side of the bounding box; straight enough ones are borders.

    A run joined over the start of the outline is not used: there the slice of its points is empty.
    """
    ends = {n: f(c) for n, f, c in (("__x0", F.array_min, "xs"), ("__x1", F.array_max, "xs"), ("__y0", F.array_min, "ys"), ("__y1", F.array_max, "ys"))}
    boxed = pl.hold(df, ends)
    bw = F.greatest(F.lit(1.0), F.col("__x1") - F.col("__x0") + 1)
    bh = F.greatest(F.lit(1.0), F.col("__y1") - F.col("__y0") + 1)
    tolerance = lambda size: F.greatest(F.lit(2.0), F.floor(size * near).cast("double"))
    close = lambda axis, to, size: F.transform(axis, lambda v: F.abs(v - F.col(to)) <= tolerance(size))
    masks = {
        "top_edge": close("ys", "__y0", bh), "bottom_edge": close("ys", "__y1", bh),
        "left_edge": close("xs", "__x0", bw), "right_edge": close("xs", "__x1", bw),
    }
    rows = _side_rows(boxed, masks)
    level = _horizontal(F.col("side"))

    def covered(run: Column) -> Column:
        cut = lambda c: F.slice(c, run["a"] + 1, run["b"] - run["a"] + 1)
        return F.when(level, pl.span(cut("xs")) / bw).otherwise(pl.span(cut("ys")) / bh)

    long_enough = F.filter("__runs", lambda r: r["b"] - r["a"] + 1 >= 20)
    rated = F.transform(long_enough, lambda r: F.struct(covered(r).alias("coverage"), (-r["a"]).alias("first"), r["a"], r["b"]))
    best = pl.hold(rows, {"__best": F.array_max(F.filter(rated, lambda r: r["coverage"] >= min_run))})
    a, b = F.col("__best.a"), F.col("__best.b")
    fitted = best.withColumn("__fit", pl.line_fit(F.slice("xs", a + 1, b - a + 1), F.slice("ys", a + 1, b - a + 1)))
    return fitted.select(
        "id", "side", F.coalesce("__best.coverage", F.lit(0.0)).alias("coverage"), F.col("__fit.err").alias("line_err"),
        (F.col("__fit.err") <= max_err).alias("border"),
    )


def hull_segments(
    df: DataFrame, err_thresh: float = 3.5, min_cov: float = 0.45, max_err: float = 4.5, near: float = 0.06,
    angle_h: float = 12.0, angle_v: float = 78.0,
) -> DataFrame:
    """Straight pieces of the convex hull that run along a side of the 1..99 percentile box."""
    rows = _rated_sides(df, hull_sides(err_thresh, min_cov, near, angle_h, angle_v), PIECE)
    # every input row has its sides, rows of one id all the best of them; a NULL id is nobody's
    best = rows.groupBy("id", "side").agg(F.max(F.when(F.col("id").isNotNull(), F.col("rated"))).alias("best"), F.count(F.lit(1)).alias("__n"))
    return best.select("*", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(
        "id", "side", F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"), F.col("best.err").alias("line_err"),
        (F.col("best.err") <= max_err).alias("border"),
    )


def _rated_sides(df: DataFrame, sides, names: tuple[str, ...]) -> DataFrame:
    """Four rows of each row: ``id, side, judged`` and ``rated``, the best run or piece, NULL where there is none."""
    made = df.select("id", sides(F.col("xs"), F.col("ys")).alias("__s"))
    zipped = F.arrays_zip(*[F.col(f"__s.{n}").alias(n) for n in names])
    label = F.element_at(F.array(*[F.lit(s) for s in ("top_edge", "bottom_edge", "left_edge", "right_edge")]), F.col("__no") + 1)
    return made.select("id", F.col("__s.judged").alias("judged"), F.posexplode(zipped).alias("__no", "__r")).select(
        "id", label.alias("side"), "judged", F.when(~F.isnan("__r.first"), F.col("__r")).alias("rated")
    )


def oriented_runs(
    df: DataFrame, near: float = 0.04, min_run: float = 0.40, max_line_err: float = 0.02, max_offset: float = 0.025,
    angle_tol: float = 18.0, min_confidence: float = 0.60, window: int = 7, passes: int = 2, trim: float = 0.10,
) -> DataFrame:
    """Runs near the sides of the oriented frame, rated by coverage, straightness, offset and angle."""
    rows = _rated_sides(df, side_runs(near, min_run, max_line_err, max_offset, angle_tol, window, passes, trim), RUN)
    best = rows.groupBy("id", "side").agg(F.max("judged").alias("judged"), F.max("rated").alias("best"))
    b = lambda c: F.col(f"best.{c}")
    border = (
        (b("line_err") <= max_line_err) & (b("offset") <= max_offset) & (b("angle_err") <= angle_tol) & (b("confidence") >= min_confidence)
    )
    return best.select(
        "id", "side", F.coalesce(b("coverage"), F.lit(0.0)).alias("coverage"), b("line_err").alias("line_err"),
        b("offset").alias("offset"), b("angle_err").alias("angle_err"), F.coalesce(b("confidence"), F.lit(0.0)).alias("confidence"),
        border.alias("border"), "judged",
    )


def oriented_runs_scaled(df: DataFrame, target: float = 100.0, pad: int = 4, longest: int = 8192, **options) -> DataFrame:
    """As :func:`oriented_runs` after bringing the outline to the target ratio; without a ratio unchanged."""
    far = lambda c: F.array_max(c) + pad + 1  # noqa: E731 - the outline lies inside its image
    crop = crop_geometry(F.col("xs"), F.col("ys"), far("xs"), far("ys"), F.col("pixels_per_unit"), target, pad, longest, True)
    placed = pl.hold(df.select("id", "xs", "ys", "pixels_per_unit"), {"__crop": crop})
    known = F.col("pixels_per_unit") > 0
    moved = lambda c, low: F.when(
        known, F.transform(c, lambda p: (p - F.col(f"__crop.{low}")) * F.col("__crop.factor"))
    ).otherwise(F.col(c))
    return oriented_runs(pl.hold(placed, {"xs": moved("xs", "x0"), "ys": moved("ys", "y0")}), **options)


METHODS = {
    "bbox_runs": bbox_runs, "hull_segments": hull_segments,
    "oriented_runs": oriented_runs, "oriented_runs_scaled": oriented_runs_scaled,
}


def fragment_flags(sides: DataFrame) -> DataFrame:
    """Side rows to the flags and piece type of a fragment."""
    flag = lambda s: F.coalesce(F.bool_or(F.when(F.col("side") == s, F.col("border"))), F.lit(False))
    judged = [F.max("judged").alias("judged")] if "judged" in sides.columns else []
    wide = sides.groupBy("id").agg(*[flag(s).alias(f"has_{s}") for s in SIDE_EDGES], *judged)
    flags = [F.col(f"has_{s}") for s in SIDE_EDGES]
    kind = piece_type(*flags)
    return wide.withColumn("piece_type", kind).withColumn("edge_piece", kind != "interior")


def _outline_error() -> Column:
    n = F.coalesce(F.size("xs"), F.lit(0))
    return F.when(n < 1, "segmentation_coords missing contours").when(n < 3, "No valid contours")


def edges_by_method(df: DataFrame, method: str) -> DataFrame:
    """Flags, piece type and ``error`` of every fragment; flags are NULL where there is an error."""
    if method not in METHODS:
        raise ValueError(f"Unsupported edge method: {method}")
    sides = METHODS[method](df)
    found = fragment_flags(sides)  # with ``judged`` where the heuristic has it, so that it runs once
    if "judged" not in found.columns:
        found = found.withColumn("judged", F.lit(True))
    rows = df.select("id", _outline_error().alias("error")).join(found, "id", "left")
    error = F.coalesce("error", F.when(~F.coalesce("judged", F.lit(False)), F.lit("Contour too small")))
    names = [c for c in found.columns if c not in ("id", "judged")]
    return rows.withColumn("error", error).select("id", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in names], "error")


def edges_with_fallback(df: DataFrame, classified: DataFrame, fallback: str | None) -> DataFrame:
    """Classifier flags where it gave any; rows it failed on go through the fallback heuristic.

    ``classified`` has ``id``, the four ``has_<side>`` flags and ``error``.  ``method`` says what gave the
    flags; ``fallback_error`` keeps why the classifier failed.  Every id comes back: where the fallback
    fails too, or there is none, ``method`` and the flags are NULL and ``error`` is the last error.
    """
    flags = [f"has_{s}" for s in SIDE_EDGES]
    kind = piece_type(*[F.col(f) for f in flags])
    none = F.lit(None).cast("string")
    good = classified.filter("error IS NULL").select(
        "id", *flags, kind.alias("piece_type"), (kind != "interior").alias("edge_piece"),
        F.lit("classifier").alias("method"), none.alias("error"), none.alias("fallback_error"),
    )
    failed = classified.filter("error IS NOT NULL").select("id", F.col("error").alias("fallback_error"))
    if fallback in (None, "", "none"):
        return good.unionByName(failed.select("id", F.col("fallback_error").alias("error")), allowMissingColumns=True)
    again = edges_by_method(df.join(failed.select("id"), "id", "left_semi"), fallback).withColumn("__seen", F.lit(True))
    tried = failed.join(again, "id", "left").withColumn(
        "error", F.when(F.col("__seen").isNull(), F.lit("segmentation_coords missing contours")).otherwise(F.col("error"))
    )
    return good.unionByName(tried.withColumn("method", F.when(F.col("error").isNull(), F.lit(fallback))).drop("__seen"))
