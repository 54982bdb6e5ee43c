"""Catalogue search: predicates, paging, display records and identifier joins."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_anywhere, reverse_side_id, script_display

FLAG_COLUMNS = {
    "is_edge_piece": "edge_piece",
    "has_top_edge": "has_top_edge",
    "has_bottom_edge": "has_bottom_edge",
    "has_left_edge": "has_left_edge",
    "has_right_edge": "has_right_edge",
    "has_circle": "has_circle",
}
IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")

SEGMENTATION_SCHEMA = (
    "struct<contours:array<array<array<double>>>,confidence:double,model_version:string,image_shape:array<int>>"
)


def _all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def keyword_predicate(text: str) -> Column:
    return reduce(lambda a, b: a | b, [like_anywhere(F.col(c), text) for c in ("fragment_id", "transcription", "notes")])


def custom_predicate(values: Mapping[str, object], registered: Sequence[str]) -> Column:
    """Equality on user-defined columns; empty values and unregistered keys are passed over."""
    conditions = []
    for key, value in values.items():
        if key not in registered or not IDENTIFIER.match(key):
            continue
        if isinstance(value, (list, tuple)):
            if value:
                conditions.append(F.col(key).isin(*value))
        elif isinstance(value, str) and value:
            conditions.append(F.col(key) == value)
    return _all_of(conditions)


def fragment_predicate(filters: Mapping[str, object], registered: Sequence[str] = ()) -> Column:
    """One conjunctive condition from a filter record; a NULL flag or count never passes its test."""
    conditions: list[Column] = []
    if filters.get("line_count_min") is not None:
        conditions.append(F.col("line_count") >= filters["line_count_min"])
    if filters.get("line_count_max") is not None:
        conditions.append(F.col("line_count") <= filters["line_count_max"])
    if filters.get("scripts"):
        conditions.append(F.col("script_type").isin(*filters["scripts"]))
    for key, column in FLAG_COLUMNS.items():
        if filters.get(key) is not None:
            conditions.append(F.col(column) == F.lit(bool(filters[key])))
    if filters.get("search"):
        conditions.append(keyword_predicate(str(filters["search"])))
    if filters.get("custom"):
        conditions.append(custom_predicate(filters["custom"], registered))
    return _all_of(conditions)


def page(df: DataFrame, limit: int | None = None, offset: int | None = None, order: str = "fragment_id") -> DataFrame:
    """Rows in id order; the offset counts only when a limit is given."""
    ordered = df.orderBy(order)
    if not limit:
        return ordered
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_after(df: DataFrame, last_id: str, limit: int) -> DataFrame:
    """Keyset form for deep pages: no rows before the page are sorted or shipped."""
    return df.filter(F.col("fragment_id") > last_id).orderBy("fragment_id").limit(limit)


def filter_fragments(df: DataFrame, filters: Mapping[str, object], registered: Sequence[str] = ()) -> DataFrame:
    return page(df.filter(fragment_predicate(filters, registered)), filters.get("limit"), filters.get("offset"))


def count_fragments(df: DataFrame, filters: Mapping[str, object], registered: Sequence[str] = ()) -> DataFrame:
    return df.filter(fragment_predicate(filters, registered)).agg(F.count(F.lit(1)).alias("n"))


def scan_fragments(
    df: DataFrame,
    limit: int | None = None,
    offset: int | None = None,
    ids: Sequence[str] | None = None,
    status: str | None = None,
    collection: str | None = None,
) -> DataFrame:
    """A page of the catalogue by id; ``ids`` are fragment ids, and an empty list means all."""
    conditions = []
    if ids:
        conditions.append(F.col("fragment_id").isin(*ids))
    if status is not None:
        conditions.append(F.col("processing_status") == status)
    if collection is not None:
        conditions.append(F.col("image_path").ilike(collection + "%"))
    return page(df.filter(_all_of(conditions)), limit, offset, order="id")


def suggest(df: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """The first matches for a typed text; blank text suggests nothing."""
    typed = text.strip()
    if not typed:
        return df.limit(0)
    return df.filter(keyword_predicate(typed)).orderBy("fragment_id").limit(limit)


def filter_client(
    df: DataFrame,
    line_count_min: int | None = None,
    line_count_max: int | None = None,
    scripts: Sequence[str] = (),
    is_edge_piece: bool | None = None,
    has_metadata: Column | None = None,
) -> DataFrame:
    """The display-side variant: an unknown line count passes its bounds, an unknown script fails."""
    conditions = []
    if line_count_min is not None:
        conditions.append(F.col("line_count").isNull() | (F.col("line_count") >= line_count_min))
    if line_count_max is not None:
        conditions.append(F.col("line_count").isNull() | (F.col("line_count") <= line_count_max))
    if scripts:
        conditions.append(F.coalesce(F.col("script_type").isin(*scripts), F.lit(False)))
    if is_edge_piece is not None:
        conditions.append(F.col("edge_piece").eqNullSafe(F.lit(is_edge_piece)))
    if has_metadata is not None and conditions:
        conditions.append(has_metadata)
    return df.filter(_all_of(conditions))


def available_scripts(df: DataFrame) -> DataFrame:
    return df.filter(F.length("script_type") > 0).select("script_type").distinct().orderBy("script_type")


def get_by_id(df: DataFrame, wanted: DataFrame, key: str = "fragment_id") -> DataFrame:
    return df.join(wanted.select(key), key, "left_semi")


def with_relevance(df: DataFrame, text: str) -> DataFrame:
    """Adds the two sort keys of a search result: 0 exact, 1 prefix, 2 the rest; then the lower-cased id."""
    wanted = text.lower().strip()
    lowered = F.lower("fragment_id")
    tier = F.when(lowered == wanted, 0).when(lowered.startswith(wanted), 1).otherwise(2)
    return df.withColumn("relevance", tier).withColumn("sort_id", lowered)


def sort_by_relevance(df: DataFrame, text: str) -> DataFrame:
    return with_relevance(df, text).orderBy("relevance", "sort_id", "fragment_id")


def sort_az(df: DataFrame, descending: bool = False) -> DataFrame:
    return df.orderBy(F.col("fragment_id").desc() if descending else F.col("fragment_id").asc())


def to_display(df: DataFrame, custom: Sequence[str] = ()) -> DataFrame:
    """The display record: nested metadata, a scale only when unit and ratio are both there."""
    has_scale = (F.length("scale_unit") > 0) & (F.col("pixels_per_unit") != 0)
    scale = F.when(
        has_scale,
        F.struct(
            F.col("scale_unit").alias("unit"),
            F.col("pixels_per_unit").alias("pixels_per_unit"),
            F.when(F.col("scale_detection_status") == "success", "success").otherwise("error").alias("status"),
        ),
    )
    fields = [
        F.col("line_count"),
        script_display(F.col("script_type")).alias("script"),
        *[F.col(c) for c in FLAG_COLUMNS.values()],
        scale.alias("scale"),
        F.col("transcription"),
        F.col("notes"),
    ]
    if custom:
        fields.append(
            F.map_from_arrays(
                F.array(*[F.lit(c) for c in custom]), F.array(*[F.col(c).cast("string") for c in custom])
            ).alias("custom")
        )
    return df.select(
        "id",
        F.col("fragment_id").alias("name"),
        "image_path",
        F.coalesce("ui_rotation", F.lit(0.0)).alias("rotation"),
        F.struct(*fields).alias("metadata"),
    )


def pair_recto_verso(df: DataFrame) -> DataFrame:
    """Each fragment beside the fragment that carries its reverse-side id."""
    left = df.select(F.col("fragment_id").alias("side"), reverse_side_id(F.col("fragment_id")).alias("other_side"))
    right = df.select(F.col("fragment_id").alias("other_side"), F.col("id").alias("other_row"))
    return left.filter(F.col("other_side").isNotNull()).join(right, "other_side")


def parse_segmentation(text: Column) -> Column:
    """JSON text to a struct; malformed text gives NULL fields."""
    return F.from_json(text, SEGMENTATION_SCHEMA)


def has_valid_segmentation(text: Column) -> Column:
    contours = parse_segmentation(text)["contours"]
    return F.coalesce(F.exists(contours, lambda c: F.size(c) >= 3), F.lit(False))


def image_dims(text: Column, default: tuple[int, int] = (1000, 1000)) -> Column:
    """``struct<width, height>``: the stored shape, else 1.1 times the far corner of the first contour."""
    seg = parse_segmentation(text)
    first = F.get(seg["contours"], F.lit(0))
    far = lambda axis: F.array_max(F.transform(first, lambda p: F.get(p, F.lit(axis))))
    grown = lambda axis: F.floor(far(axis) * 1.1).cast("int") + 1
    stored = lambda place: F.get(seg["image_shape"], F.lit(place))
    return F.struct(
        F.coalesce(stored(1), grown(0), F.lit(default[0])).alias("width"),
        F.coalesce(stored(0), grown(1), F.lit(default[1])).alias("height"),
    )


def eligible_fragments(df: DataFrame, seg: str = "segmentation_coords") -> DataFrame:
    """Fragments with a scale ratio and a segmentation, with their image size."""
    kept = df.filter(F.col("pixels_per_unit").isNotNull() & (F.length(seg) > 0))
    dims = image_dims(F.col(seg))
    return kept.withColumn("width", dims["width"]).withColumn("height", dims["height"])


def filter_images(df: DataFrame, collection: str | None = None, match: str | None = None) -> DataFrame:
    conditions = []
    if collection:
        conditions.append(F.lower("collection") == collection.lower())
    if match:
        conditions.append(F.lower("path").contains(match.lower()))
    return df.filter(_all_of(conditions))


def assign_filter_keys(labels: DataFrame, taken: DataFrame, key: Column) -> DataFrame:
    """Unique column names for a batch of labels: a taken or repeated name gets ``_2``, ``_3`` and so on.

    ``labels`` has ``label_no, label``; ``taken`` has ``filter_key``.  The labels come from people, but
    one name may still repeat many times, so the place inside a name is a skew-safe rank.
    """
    from .ordering import sorted_rank

    based = labels.withColumn("base", key)
    ranked = sorted_rank(based, ["base"], [F.col("label_no")], out="__nth")
    numbered = taken.select(F.col("filter_key").alias("name")).union(
        based.filter(F.col("base").rlike(r"_\d+$")).select("base").distinct()
    )
    suffixes = (
        numbered.select(
            F.regexp_extract("name", r"^(.+)_(\d+)$", 1).alias("base"),
            F.regexp_extract("name", r"^(.+)_(\d+)$", 2).try_cast("int").alias("n"),
        )
        .filter(F.col("n") > 1)
        .union(taken.select(F.col("filter_key").alias("base"), F.lit(1).alias("n")))
        .groupBy("base")
        .agg(F.sort_array(F.collect_set("n")).alias("used"))
    )
    joined = ranked.join(suffixes, "base", "left")
    # the nth number that is free: every used number at or below it moves it up by one
    free = F.aggregate(
        F.coalesce("used", F.array().cast("array<int>")),
        F.col("__nth"),
        lambda number, used: F.when(used <= number, number + 1).otherwise(number),
    )
    named = F.when(free == 1, F.col("base")).otherwise(F.concat_ws("_", "base", free.cast("string")))
    return joined.select("label_no", "label", named.alias("filter_key"))
