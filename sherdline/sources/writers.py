"""Writing matches, exports and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import any_edge
from ..functions.text import collection_of
from ..operators.relations import SIDES


def write_matches(matches: DataFrame, path: str) -> None:
    """Replaces the rows of every algorithm version in ``matches`` and leaves other versions alone."""
    (
        matches.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("algorithm_version")
        .parquet(path)
    )


def annotation_export(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """The review table: every image with its labels, the derived edge flag and review state."""
    joined = images.select("path").join(annotations, "path", "left")
    return joined.select(
        F.col("path").alias("relative_path"), collection_of(F.col("path")).alias("collection"),
        F.element_at(F.split("path", "/"), -1).alias("filename"), *SIDES, any_edge(*[F.col(s) for s in SIDES]).alias("edge_piece"),
        F.coalesce("reviewed", F.lit(False)).alias("reviewed"), F.coalesce("skipped", F.lit(False)).alias("skipped"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        *(["updated_at"] if "updated_at" in annotations.columns else []),
    )


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_manifests(samples: DataFrame, path: str) -> None:
    """One folder of JSON lines per split."""
    samples.write.mode("overwrite").partitionBy("split").json(path)
