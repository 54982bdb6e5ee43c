"""Canvas positions for matched pairs and selections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import display_size, place_on_anchor
from .ordering import sorted_rank
from .ranking import top_matches


def _numbered(top: DataFrame) -> DataFrame:
    """0-based place of the already limited report rows (``n`` of them, so one window task is enough)."""
    order = Window.partitionBy(F.lit(0)).orderBy("score", "match_id")
    return top.withColumn("k", F.row_number().over(order) - 1)


def pair_layout(matches: DataFrame, fragments: DataFrame, n: int = 10, grid: float = 25.0) -> DataFrame:
    """The ``n`` best pairs side by side: pair k starts at (100 + 500k, 200), its partner at the offset."""
    pairs = _numbered(top_matches(matches, n))
    left_x, left_y = F.lit(100.0) + F.col("k") * 500.0, F.lit(200.0)
    dx, dy = (F.coalesce(F.col(c), F.lit(0.0)) * grid for c in ("relative_x_cm", "relative_y_cm"))
    two = F.array(
        F.struct(F.col("fragment_a_id").alias("fragment_id"), left_x.alias("x"), left_y.alias("y"),
                 F.lit(0.0).alias("rotation"), (F.col("k") * 2).alias("z_index")),
        F.struct(F.col("fragment_b_id").alias("fragment_id"), (left_x + dx).alias("x"), (left_y + dy).alias("y"),
                 F.coalesce("rotation_deg", F.lit(0.0)).alias("rotation"), (F.col("k") * 2 + 1).alias("z_index")),
    )
    rows = pairs.select(F.explode(two).alias("r")).select("r.*")
    sizes = fragments.select(
        "fragment_id",
        display_size(F.col("image_width"), F.col("image_height"), F.col("pixels_per_unit"), F.col("scale_unit"), grid, job=True).alias("size"),
    )
    return rows.join(sizes, "fragment_id", "left").select("fragment_id", "x", "y", "size.width", "size.height", "rotation", "z_index")


def auto_layout(matches: DataFrame, min_confidence: float = 0.5, max_pairs: int = 50, grid: float = 25.0) -> DataFrame:
    """Pairs in score order on a 5-wide grid of 200 pixels; a fragment already placed keeps its place
    and anchors its partner.

    A place depends on the pairs before it, so the best ``max_pairs`` pairs are folded in order in one
    small group; the limit is the size of the report, and the sort that finds them is distributed.
    """
    pairs = _numbered(top_matches(matches, max_pairs, min_confidence)).select(
        "k", "fragment_a_id", "fragment_b_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("relative_x_cm", "relative_y_cm", "rotation_deg")]
    )

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        anchors = pd.DataFrame({"fragment_id": group["fragment_a_id"], "on": None, "x": group["k"] % 5 * 200.0, "y": group["k"] // 5 * 200.0, "rotation": 0.0, "z_index": 2 * group["k"]})
        partners = pd.DataFrame({
            "fragment_id": group["fragment_b_id"], "on": group["fragment_a_id"], "x": group["relative_x_cm"] * grid, "y": group["relative_y_cm"] * grid,
            "rotation": group["rotation_deg"], "z_index": 2 * group["k"] + 1,
        })
        first = pd.concat([anchors, partners]).sort_values("z_index").drop_duplicates("fragment_id").set_index("fragment_id")
        for fragment, anchor in first["on"].dropna().items():  # offsets become places, each after its anchor's
            first.loc[fragment, ["x", "y"]] += first.loc[anchor, ["x", "y"]]
        return first.reset_index()[["fragment_id", "x", "y", "rotation", "z_index"]]

    return pairs.withColumn("layout", F.lit("auto")).groupBy("layout").applyInPandas(fold, "fragment_id string, x double, y double, rotation double, z_index long")


def place_matches(anchors: DataFrame, matches: DataFrame, grid: float = 25.0) -> DataFrame:
    """Best partner of each fragment on a canvas, placed by the anchor's position and rotation.

    ``anchors`` has ``project_id, fragment_id, x, y, rotation``.
    """
    best = matches.groupBy(F.col("fragment_a_id").alias("fragment_id")).agg(
        F.min_by(F.struct("fragment_b_id", "relative_x_cm", "relative_y_cm", "rotation_deg"), F.struct("score", "match_id")).alias("m")
    )
    spot = place_on_anchor(
        F.col("x"), F.col("y"), F.col("rotation"), F.col("m.relative_x_cm"), F.col("m.relative_y_cm"), F.col("m.rotation_deg"), grid
    )
    return anchors.join(best, "fragment_id").withColumn("spot", spot).select(
        *[c for c in anchors.columns if c not in ("x", "y", "rotation")], F.col("m.fragment_b_id").alias("placed_id"), "spot.*"
    )


def stagger_layout(selection: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The i-th fragment of a selection goes to (100 + 50i, 100 + 50i)."""
    placed = sorted_rank(selection, keys, order, out="__i")
    spot = F.lit(100.0) + (F.col("__i") - 1) * 50.0
    return placed.withColumn("x", spot).withColumn("y", spot).drop("__i", "__i_of")
