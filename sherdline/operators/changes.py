"""Batch changes to the catalogue tables, copy-on-write.

Each operator takes a table and a DataFrame of changes and returns the new table; one edit from a
person is a batch of one.  Counts of changed rows are DataFrames too, so nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import clean_options, filter_key, script_stored
from .catalogue import IDENTIFIER, assign_filter_keys

# The fields a person may edit.  The bulk form leaves out the two text fields.
BULK_FIELDS = [
    "edge_piece", "has_top_edge", "has_bottom_edge", "has_left_edge", "has_right_edge", "has_circle", "line_count", "script_type",
    "scale_unit", "pixels_per_unit", "scale_detection_status", "ui_rotation",
]
STATIC_FIELDS = [*BULK_FIELDS, "transcription", "notes"]


class Changed(NamedTuple):
    table: DataFrame
    changes: DataFrame


def _last_edit(updates: DataFrame, key: str, fields: Sequence[str], order: str | None) -> DataFrame:
    """One row per key: the edit with the highest ``order``; partial maxima keep a hot key off one task.
    Without ``order`` a key may come once only."""
    values = F.struct(*[F.col(f) for f in fields])
    if order is None:
        twice = F.raise_error(F.concat(F.lit("several edits without an order for "), F.any_value(F.col(key)).cast("string")))
        return updates.groupBy(key).agg(F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.any_value(values)).alias("__new"))
    return updates.groupBy(key).agg(F.max_by(values, F.col(order)).alias("__new"))


def _apply(table: DataFrame, latest: DataFrame, key: str, fields: Sequence[str], now: Column) -> Changed:
    hit = F.col("__new").isNotNull()
    joined = table.join(latest, key, "left")
    columns = [
        F.when(hit, F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in table.columns
        if c != "updated_at"
    ]
    old_stamp = F.col("updated_at") if "updated_at" in table.columns else F.lit(None).cast("timestamp")
    new = joined.select(*columns, F.when(hit, now).otherwise(old_stamp).alias("updated_at"))
    changes = table.join(latest, key, "left_semi").agg(F.count(F.lit(1)).alias("changes"))
    return Changed(new, changes)


def update_metadata(
    table: DataFrame,
    updates: DataFrame,
    key: str = "fragment_id",
    custom: Sequence[str] = (),
    order: str | None = None,
    bulk: bool = False,
    now: Column | None = None,
) -> Changed:
    """Sets the allowed columns of ``updates`` on the rows they name; NULL is a legal new value."""
    allowed = {*(BULK_FIELDS if bulk else STATIC_FIELDS), *custom}
    fields = [c for c in updates.columns if c in allowed and c in table.columns]
    if not fields:
        raise ValueError("No valid fields to update")
    return _apply(table, _last_edit(updates, key, fields, order), key, fields, now if now is not None else F.current_timestamp())


def split_valid(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blank text becomes NULL, then rows that break a field rule are set aside with the first message."""
    checks = {
        "line_count": rules.validate_line_count,
        "pixels_per_unit": rules.validate_pixels_per_unit,
        "script_type": rules.validate_script,
    }
    blank_to_null = [
        F.when(F.trim(F.col(f.name)) != "", F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name)
        for f in updates.schema.fields
    ]
    cleaned = updates.select(*blank_to_null)
    errors = [check(F.col(c))["error"] for c, check in checks.items() if c in cleaned.columns]
    if "scale_unit" in cleaned.columns:
        errors.append(F.when(F.col("scale_unit").isNotNull(), rules.validate_unit(F.col("scale_unit"))["error"]))
    judged = cleaned.withColumn("error", F.coalesce(*errors) if errors else F.lit(None).cast("string"))
    return judged.filter("error IS NULL").drop("error"), judged.filter("error IS NOT NULL")


def bulk_update(table: DataFrame, ids: DataFrame, values: Mapping[str, Column], custom: Sequence[str] = (), now: Column | None = None) -> Changed:
    """The same values on many rows: checked first, script names as shown, then stored by their stored name."""
    good, _ = split_valid(ids.select("fragment_id", *[v.alias(k) for k, v in values.items()]))
    if "script_type" in good.columns:
        good = good.withColumn("script_type", script_stored(F.col("script_type")))
    return update_metadata(table, good.distinct(), custom=custom, bulk=True, now=now)


def update_rotations(table: DataFrame, rotations: DataFrame, order: str | None = None, now: Column | None = None) -> Changed:
    """Sets ``ui_rotation`` folded into 0..360; non-finite angles and blank ids are dropped."""
    finite = rotations.filter(
        (F.length("fragment_id") > 0)
        & F.col("rotation").isNotNull()
        & ~F.isnan("rotation")
        & (F.abs("rotation") < float("inf"))
    ).withColumn("ui_rotation", F.pmod(F.col("rotation"), F.lit(360.0)))
    latest = _last_edit(finite, "fragment_id", ["ui_rotation"], order)
    return _apply(table, latest, "fragment_id", ["ui_rotation"], now if now is not None else F.current_timestamp())


def _named(table: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """The rows of ``table`` whose ``key`` is in ``ids`` (``left_semi``) or is not (``left_anti``; a NULL key is not).
    Each task holds its ids in a hash table and lets the rows pass, which a merge of sorted rows would keep in memory."""
    return table.join(ids.hint("shuffle_hash"), key, how)


class Remaining(NamedTuple):
    fragments: DataFrame
    project_fragments: DataFrame
    matches: DataFrame


def bulk_delete(fragments: DataFrame, project_fragments: DataFrame, matches: DataFrame, ids: DataFrame) -> Remaining:
    """Drops fragments with their project rows and their matches on either side."""
    gone = ids.filter(F.trim("fragment_id") != "").select("fragment_id").distinct()
    as_a = gone.withColumnRenamed("fragment_id", "fragment_a_id")
    as_b = gone.withColumnRenamed("fragment_id", "fragment_b_id")
    return Remaining(
        fragments.join(gone, "fragment_id", "left_anti"),
        project_fragments.join(gone, "fragment_id", "left_anti"),
        matches.join(as_a, "fragment_a_id", "left_anti").join(as_b, "fragment_b_id", "left_anti"),
    )


# ---- custom filters ------------------------------------------------------------------------------


def create_filters(requests: DataFrame, taken: DataFrame) -> DataFrame:
    """Judges a batch of filter requests ``(label_no, label, type, options)``.

    Accepted rows get a free column name and cleaned options, the others the first error.
    """
    label = F.trim(F.coalesce("label", F.lit("")))
    options = clean_options(F.coalesce("options", F.array().cast("array<string>")))
    error = (
        F.when(label == "", "Filter name is required")
        .when(~F.coalesce(F.col("type").isin("multiselect", "text"), F.lit(False)), "Invalid filter type")
        .when((F.col("type") == "multiselect") & (F.size(options) == 0), "Dropdown filters require at least one option")
    )
    judged = requests.select(
        "label_no", label.alias("label"), "type",
        F.when(F.col("type") == "multiselect", options).alias("options"), error.alias("error"),
    )
    named = assign_filter_keys(judged.filter("error IS NULL").select("label_no", "label"), taken, filter_key(F.col("label")))
    return judged.join(named.select("label_no", "filter_key"), "label_no", "left")


def list_filters(registry: DataFrame) -> DataFrame:
    """Filters in id order; malformed option text counts as no options, text filters have none."""
    parsed = clean_options(F.coalesce(F.from_json("options", "array<string>"), F.array().cast("array<string>")))
    return registry.select(
        "id", "filter_key", "label", "type", F.when(F.col("type") == "multiselect", parsed).alias("options")
    ).orderBy("id")


def add_filter_columns(fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        if not IDENTIFIER.match(key):
            raise ValueError("Generated filter key is invalid")
    return ensure_columns(fragments, {key: "string" for key in keys})


def _filter_row(registry: DataFrame, key: str):
    """The registry's row of a filter, whose columns are few."""
    row = registry.filter(F.col("filter_key") == key).select("filter_key", "type").first()
    if row is None:
        raise ValueError("Filter not found")
    if not IDENTIFIER.match(key):
        raise ValueError("Invalid filter key")
    return row


def delete_filter(registry: DataFrame, fragments: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Drops the filter; its column stays with NULLs.  An unknown key is an error."""
    _filter_row(registry, key)
    return registry.filter(F.col("filter_key") != key), fragments.withColumn(key, F.lit(None).cast("string"))


def update_filter_options(registry: DataFrame, fragments: DataFrame, key: str, options: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """New options for a dropdown; values outside them become NULL.  An unknown key, and a filter that is no
    dropdown, is an error."""
    if _filter_row(registry, key)["type"] != "multiselect":
        raise ValueError("Only dropdown filters have options")
    cleaned = list(dict.fromkeys(o.strip() for o in options if o.strip()))
    if not cleaned:
        raise ValueError("At least one option is required")
    new_registry = registry.withColumn(
        "options",
        F.when(F.col("filter_key") == key, F.to_json(F.array(*[F.lit(o) for o in cleaned]))).otherwise(F.col("options")),
    )
    return new_registry, fragments.withColumn(key, F.when(F.col(key).isin(*cleaned), F.col(key)))


# ---- projects --------------------------------------------------------------------------------------


def create_projects(projects: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Adds ``(id, project_name, description)`` rows; a missing description is empty."""
    rows = new.select("id", "project_name", F.coalesce("description", F.lit("")).alias("description"), now.alias("updated_at"))
    return projects.unionByName(rows, allowMissingColumns=True)


def save_projects(project_fragments: DataFrame, states: DataFrame, saved: DataFrame) -> DataFrame:
    """Replaces every row of the ``saved`` projects by their canvas state, with the defaults filled in."""

    def number(name: str, default: float) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit(0.0)) != 0, F.col(name)).otherwise(F.lit(default)).alias(name)

    size = lambda name: F.when(F.col(name) != 0, F.col(name)).alias(name)
    ids = saved.select("project_id").distinct()
    rows = _named(states, ids, "project_id", "left_semi").select(
        "project_id", "fragment_id", "x", "y", size("width"), size("height"), number("rotation", 0.0),
        number("scale_x", 1.0), number("scale_y", 1.0),
        F.coalesce("is_locked", F.lit(False)).alias("is_locked"),
        F.coalesce("z_index", F.lit(0)).alias("z_index"),
        F.coalesce("show_segmented", F.lit(True)).alias("show_segmented"),
    )
    kept = _named(project_fragments, ids, "project_id", "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def stamp_projects(projects: DataFrame, saved: DataFrame, now: Column) -> DataFrame:
    """Saved projects (``project_id``) get a new time stamp, so that they lead the list."""
    hits = saved.select(F.col("project_id").alias("id"), F.lit(True).alias("__saved")).distinct()
    stamped = projects.join(hits, "id", "left")
    return stamped.withColumn("updated_at", F.when(F.col("__saved"), now).otherwise(F.col("updated_at"))).drop("__saved")


def load_project(project_fragments: DataFrame, project_id: int) -> DataFrame:
    return project_fragments.filter(F.col("project_id") == project_id).orderBy("z_index")


def list_projects(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.col("updated_at").desc(), F.col("id"))


def rename_projects(projects: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """``names`` has ``id, new_name``; renamed projects get a new time stamp."""
    joined = projects.join(names, "id", "left")
    hit = F.col("new_name").isNotNull()
    return joined.withColumn("project_name", F.coalesce("new_name", "project_name")).withColumn(
        "updated_at", F.when(hit, now).otherwise(F.col("updated_at"))
    ).drop("new_name")


def delete_projects(projects: DataFrame, project_fragments: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("id").distinct()
    of_project = gone.withColumnRenamed("id", "project_id")
    return _named(projects, gone, "id", "left_anti"), _named(project_fragments, of_project, "project_id", "left_anti")


def ensure_columns(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Adds the columns of ``spec`` (name to type) that are missing, as NULLs; running it again changes nothing."""
    missing = {n: F.lit(None).cast(t) for n, t in spec.items() if n.lower() not in {c.lower() for c in df.columns}}
    return df.withColumns(missing) if missing else df
