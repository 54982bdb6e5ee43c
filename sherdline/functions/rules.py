"""Column rules: validation messages, three-valued flags, sizes on the canvas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SCRIPT_DISPLAY

SHOWN_SCRIPTS = sorted(set(SCRIPT_DISPLAY.values()))


def _result(*steps: tuple[Column, str]) -> Column:
    """``struct<valid, error>`` with the first message whose condition holds."""
    error = F.lit(None).cast("string")
    for condition, message in reversed(steps):
        error = F.when(condition, F.lit(message)).otherwise(error)
    return F.struct(error.isNull().alias("valid"), error.alias("error"))


def validate_line_count(value: Column) -> Column:
    return _result(
        (F.isnan(value), "Line count must be a number"),
        (value != F.floor(value), "Line count must be a whole number"),
        (value < 0, "Line count cannot be negative"),
        (value > 100, "Line count must be 100 or less"),
    )


def validate_pixels_per_unit(value: Column) -> Column:
    return _result(
        (F.isnan(value), "Must be a valid number"),
        (value <= 0, "Pixels per unit must be positive"),
        (value > 10000, "Value seems too large"),
    )


def validate_script(value: Column) -> Column:
    given = F.trim(value)
    return _result(
        ((given != "") & ~given.isin(SHOWN_SCRIPTS), "Please select a valid script type from the dropdown")
    )


def validate_unit(value: Column) -> Column:
    return _result((~F.coalesce(value.isin("cm", "mm"), F.lit(False)), 'Scale unit must be "cm" or "mm"'))


def any_edge(*flags: Column) -> Column:
    """Three-valued OR: any true is true, all false is false, else unknown."""
    result = flags[0]
    for flag in flags[1:]:
        result = result | flag
    return result


def piece_type(top: Column, bottom: Column, left: Column, right: Column) -> Column:
    """interior without borders, corner with two adjacent ones, else edge; unknown counts as no border."""
    t, b, l, r = (F.coalesce(x, F.lit(False)) for x in (top, bottom, left, right))
    return F.when((t | b) & (l | r), "corner").when(t | b | l | r, "edge").otherwise("interior")


def per_cm(pixels_per_unit: Column, unit: Column) -> Column:
    return F.when(unit == "mm", pixels_per_unit * 10.0).otherwise(pixels_per_unit)


def _half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("double")


def display_size(width: Column, height: Column, pixels_per_unit: Column, unit: Column, grid: float = 25.0, job: bool = False) -> Column:
    """Canvas size ``struct<width, height>``.

    With a scale: centimetres times the grid, rounded, held to 50..2000.  Without: the interactive
    form fits the long side to 300 keeping the shape, the batch form (``job``) clamps each side to
    300.  The interactive form rounds halves up, the batch form to even.
    """
    w, h = width.cast("double"), height.cast("double")
    factor = F.when(unit == "mm", F.lit(0.1)).otherwise(F.lit(1.0))
    nearest = F.bround if job else _half_up

    def scaled(side: Column) -> Column:
        return F.greatest(F.lit(50.0), F.least(F.lit(2000.0), nearest(side / pixels_per_unit * factor * grid)))

    if job:
        plain_w, plain_h = F.least(F.lit(300.0), w), F.least(F.lit(300.0), h)
        known = pixels_per_unit.isNotNull()
    else:
        long_side = F.greatest(w, h)
        shrink = F.when(long_side > 300, F.lit(300.0) / long_side).otherwise(F.lit(1.0))
        plain_w = F.when((w > h) & (w > 300), F.lit(300.0)).otherwise(w * shrink)
        plain_h = F.when((w <= h) & (h > 300), F.lit(300.0)).otherwise(h * shrink)
        known = (F.coalesce(unit, F.lit("")) != "") & (F.coalesce(pixels_per_unit, F.lit(0.0)) != 0)
    return F.struct(
        F.when(known, scaled(w)).otherwise(plain_w).alias("width"),
        F.when(known, scaled(h)).otherwise(plain_h).alias("height"),
    )


def scale_from_resize(width: Column, height: Column, original_width: Column, original_height: Column, grid: float = 25.0) -> Column:
    """Mean of the width and height pixels per centimetre after a resize to the grid."""
    return (original_width / (width / grid) + original_height / (height / grid)) / 2.0


def place_on_anchor(x: Column, y: Column, rotation: Column, dx_cm: Column, dy_cm: Column, turn: Column, grid: float = 25.0) -> Column:
    """Position of a match on the canvas: its offset turned with the anchor, rotations added."""
    base = F.coalesce(rotation, F.lit(0.0))
    px, py = F.coalesce(dx_cm, F.lit(0.0)) * grid, F.coalesce(dy_cm, F.lit(0.0)) * grid
    cos, sin = F.cos(F.radians(base)), F.sin(F.radians(base))
    return F.struct(
        (x + px * cos - py * sin).alias("x"),
        (y + px * sin + py * cos).alias("y"),
        (F.coalesce(turn, F.lit(0.0)) + base).alias("rotation"),
    )
