"""Joins between fragments, matches, annotations and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import collection_of, normalize_path

SIDES = ("has_top_edge", "has_bottom_edge", "has_left_edge", "has_right_edge")


def _target(fragments: DataFrame) -> DataFrame:
    return fragments.select(
        F.col("fragment_id").alias("fragment_b_id"),
        F.col("image_path").alias("target_path"),
        F.col("script_type").alias("target_script"),
        F.col("line_count").alias("target_lines"),
    )


def matches_for(matches: DataFrame, fragments: DataFrame, anchor: str) -> DataFrame:
    """Every match of one anchor with its target's record, best first."""
    return (
        matches.filter(F.col("fragment_a_id") == anchor)
        .join(_target(fragments), "fragment_b_id")
        .orderBy("score", "match_id")
    )


def best_matches(matches: DataFrame, fragments: DataFrame, n: int = 20, anchor: str | None = None) -> DataFrame:
    """The best row per target, then the ``n`` best targets, for one anchor or for all of them.

    The best row per pair is a partial aggregate; the ``place <= n`` filter lets Spark drop rows
    beyond ``n`` before the shuffle, so an anchor with a third of the matches ships few of them.
    """
    if anchor is not None:
        matches = matches.filter(F.col("fragment_a_id") == anchor)
    rest = [c for c in matches.columns if c not in ("fragment_a_id", "fragment_b_id", "score", "match_id")]
    best = matches.groupBy("fragment_a_id", "fragment_b_id").agg(
        F.min(F.struct("score", "match_id", *rest)).alias("best")
    ).select("fragment_a_id", "fragment_b_id", "best.*")
    known = best.join(_target(fragments), "fragment_b_id")
    order = Window.partitionBy("fragment_a_id").orderBy("score", "match_id")
    return known.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent; a NULL key has none."""
    keys = parent.select(F.col(parent_key).alias(child_key)).filter(F.col(child_key).isNotNull()).distinct()
    return child.join(keys, child_key, "left_anti")


def build_samples(annotations: DataFrame, fragments: DataFrame, listing: DataFrame, require_scale: bool = False, excluded: str = "uploads/example.png") -> DataFrame:
    """Annotations beside their fragment, with one flag per step of the funnel.

    ``fragments`` has ``id, image_path, segmentation_coords, pixels_per_unit, scale_detection_status``; of
    several rows with one path the last by id counts.  ``listing`` has the ``path`` of every image file there is.
    """
    known = F.struct(
        F.lit(True).alias("in_catalogue"),
        (F.length("segmentation_coords") > 0).alias("segmented"),
        (F.col("pixels_per_unit").isNotNull() & (F.col("scale_detection_status") == "success")).alias("scaled"),
        "pixels_per_unit",
    )
    by_path = fragments.groupBy(normalize_path(F.col("image_path")).alias("path")).agg(F.max_by(known, F.col("id")).alias("known"))
    catalogue = by_path.select("path", "known.*")
    files = listing.select("path", F.lit(True).alias("on_disk")).dropDuplicates(["path"])
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    labelled = F.lit(True)
    for side in SIDES:
        labelled = labelled & F.col(side).isNotNull()
    joined = (
        annotations.withColumn("path", normalize_path(F.col("path")))
        .filter((F.col("path") != excluded) & yes("reviewed") & ~yes("skipped"))
        .join(catalogue, "path", "left")
        .join(files, "path", "left")
    )
    matched = labelled & yes("in_catalogue")
    segmented = matched & yes("segmented")
    scaled = segmented & yes("scaled")
    usable = (scaled if require_scale else segmented) & yes("on_disk")
    return joined.select(
        "path", collection_of(F.col("path")).alias("collection"), *SIDES, "pixels_per_unit",
        labelled.alias("complete"), matched.alias("matched"), segmented.alias("segmented"), scaled.alias("scaled"),
        usable.alias("usable"), rules.piece_type(*[F.col(s) for s in SIDES]).alias("piece_type"),
    )


def sample_funnel(samples: DataFrame) -> DataFrame:
    count = lambda name: F.count_if(F.col(name))
    return samples.agg(
        F.count(F.lit(1)).alias("reviewed_non_skipped"), count("complete").alias("complete_labels"),
        count("matched").alias("matched_db"), count("segmented").alias("with_segmentation"),
        count("scaled").alias("with_scale"), count("usable").alias("usable_samples"),
    )


def _missing(name: str, df: DataFrame) -> Column:
    gap = F.col(name).isNull()
    return gap | (F.trim(F.col(name)) == "") if df.schema[name].dataType.typeName() == "string" else gap


def completeness(fragments: DataFrame, ids: DataFrame, required: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """One row: asked-for ids, completed and gap-free fragments, gaps per required field."""
    found = fragments.join(ids.select("id").distinct(), "id", "left_semi")
    gaps = {f: F.coalesce(_missing(f, fragments), F.lit(True)) for f in required}
    complete = F.lit(True)
    for gap in gaps.values():
        complete = complete & ~gap
    counted = found.agg(
        F.count_if(F.col("processing_status").isin(*allowed)).alias("completed"),
        F.count_if(complete).alias("required_ok"),
        *[F.count_if(gap).alias(f"missing_{f}") for f, gap in gaps.items()],
    )
    total = ids.agg(F.count(F.lit(1)))
    return counted.withColumn("total", total.scalar())


def status_counts(fragments: DataFrame, ids: DataFrame) -> DataFrame:
    found = fragments.join(ids.select("id").distinct(), "id", "left_semi")
    label = F.when(F.length("processing_status") > 0, F.col("processing_status")).otherwise("NULL")
    return found.groupBy(label.alias("status")).agg(F.count(F.lit(1)).alias("n"))
