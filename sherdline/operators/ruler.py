"""Scale from a ruler: unit text, tick positions, pixels per unit, the catalogue record.

A profile is one array of one image row, so all of it runs where the row is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polyline as pl
from ..functions.shapes import ticks_adaptive, ticks_fixed


def unit_from_text(images: DataFrame, tokens: DataFrame) -> DataFrame:
    """Unit and the end of its text per image: the first token that holds mm or cm (mm wins inside one).

    ``images`` has ``image_id, width``; ``tokens`` has ``image_id, token_no, text, x_max``.  Without a
    token the unit is cm and the text is taken to fill a tenth of the width.
    """
    text = F.lower(F.trim("text"))
    kind = F.when(text.contains("mm"), "mm").when(text.contains("cm"), "cm")
    units = tokens.withColumn("unit", kind).filter("unit IS NOT NULL").groupBy("image_id").agg(
        F.min_by(F.struct("unit", (F.col("x_max").cast("int") + 10).alias("text_end")), F.col("token_no")).alias("first")
    )
    return images.join(units, "image_id", "left").select(
        "image_id", F.coalesce("first.unit", F.lit("cm")).alias("unit"),
        F.coalesce("first.text_end", F.floor(F.col("width") * 0.10).cast("int")).alias("text_end"),
    )


def _spacing_score(ticks: Column, width: Column) -> Column:
    least = F.greatest(F.lit(12.0), F.floor(width * 0.008).cast("double"))
    n = F.size(ticks)
    closest = F.array_min(pl.differences(ticks))
    return (
        F.when(n < 2, 0).when(closest < least, F.greatest(F.lit(0), n - 5))
        .when((n >= 3) & (n <= 15), n + 10).when(n == 2, n + 5).otherwise(n)
    )


def pick_ticks(fixed: Column, adaptive: Column, width: Column) -> Column:
    """The better of two tick lists by count and spacing; the fixed one on equal scores."""
    return F.when(_spacing_score(fixed, width) >= _spacing_score(adaptive, width), fixed).otherwise(adaptive)


def pixels_per_unit(ticks: Column) -> Column:
    """Median gap between neighbouring ticks, NULL below two ticks."""
    return F.when(F.size(ticks) >= 2, pl.linear_percentile(pl.differences(ticks), 0.5))


def scale_record(ticks: Column, unit: Column, version: str) -> Column:
    """The catalogue fields: values on success, NULLs and the reason otherwise; the version always."""
    ratio = pixels_per_unit(ticks)
    reason = F.concat(F.lit("error: Not enough ticks detected ("), F.size(ticks).cast("string"), F.lit(")"))
    good = ratio.isNotNull()
    return F.struct(
        F.when(good, unit).alias("scale_unit"), ratio.alias("pixels_per_unit"),
        F.when(good, "success").otherwise(reason).alias("scale_detection_status"), F.lit(version).alias("scale_model_version"),
    )


def detect_ticks(profiles: DataFrame) -> DataFrame:
    """``profiles`` has ``profile, image_height, text_end``; adds ``fixed, adaptive, ticks``."""
    found = profiles.withColumn("fixed", ticks_fixed(F.col("profile"), F.col("text_end"))).withColumn(
        "adaptive", ticks_adaptive(F.col("profile"), F.col("image_height"), F.col("text_end"))
    )
    return found.withColumn("ticks", pick_ticks(F.col("fixed"), F.col("adaptive"), F.size("profile")))


def detect_scale(profiles: DataFrame, tokens: DataFrame, version: str) -> DataFrame:
    """Whole ruler job: ``profiles`` has ``image_id, profile, image_height``."""
    units = unit_from_text(profiles.select("image_id", F.size("profile").alias("width")), tokens)
    ticked = detect_ticks(profiles.join(units, "image_id"))
    return ticked.withColumn("record", scale_record(F.col("ticks"), F.col("unit"), version)).select("image_id", "record.*")
