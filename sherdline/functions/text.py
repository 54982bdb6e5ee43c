"""Column functions on identifiers, paths, labels and script names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stored script name -> name shown to people.
SCRIPT_DISPLAY = {
    "Early South Turkestan Brahmi": "Early South Turkestan Brāhmī",
    "North Turkestan Brahmi": "North Turkestan Brāhmī",
    "North Turkestan Brahmi, type a": "North Turkestan Brāhmī, type a",
    "South Turkestan Brahmi": "South Turkestan Brāhmī (main type)",
    "Turkestan Gupta Type": "Turkestan Gupta Type",
    "North Turkestan Brāhmī, type b": "North Turkestan Brāhmī, type b",
    "Early Turkestan Brāhmī, alphabet r": "Early Turkestan Brāhmī, alphabet r",
}


def _lookup(pairs: dict[str, str], value: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    return F.when(F.coalesce(F.length(value), F.lit(0)) > 0, F.coalesce(F.try_element_at(table, value), value))


def script_display(value: Column) -> Column:
    """Stored name to shown name; unknown names pass, empty gives NULL."""
    return _lookup(SCRIPT_DISPLAY, value)


def script_stored(value: Column) -> Column:
    """Shown name to stored name; unknown names pass, empty gives NULL."""
    return _lookup({shown: stored for stored, shown in SCRIPT_DISPLAY.items()}, value)


def like_anywhere(column: Column, text: str) -> Column:
    """Case-insensitive ``%text%``; ``%`` and ``_`` inside the text stay wildcards, a backslash is plain."""
    return column.ilike("%" + text.replace("\\", "\\\\") + "%")


def normalize_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def collection_of(path: Column) -> Column:
    return F.substring_index(normalize_path(path), "/", 1)


def base_id(fragment_id: Column) -> Column:
    """Strips every trailing A or B, so both sides of a fragment share a base when no suffix follows."""
    return F.rtrim(fragment_id, F.lit("AB"))


def reverse_side_id(fragment_id: Column) -> Column:
    """The id of the other side: the first ``_`` part that is a side letter, or digits and a side
    letter, has it swapped (A-B, R-V, case kept).  NULL when there is none."""
    core = F.regexp_extract(fragment_id, r"^(.*?)(\s*\[.*\])?$", 1)
    suffix = F.regexp_extract(fragment_id, r"^(.*?)(\s*\[.*\])?$", 2)
    parts = F.split(core, "_")
    place = F.array_position(F.transform(parts, lambda p: p.rlike(r"^\d*[ABRVabrv]$")), True)
    swapped = F.transform(
        parts,
        lambda p, i: F.when(
            i.cast("long") + 1 == place, F.translate(p, "ABRVabrv", "BAVRbavr")
        ).otherwise(p),
    )
    return F.when(place > 0, F.concat(F.array_join(swapped, "_"), suffix))


def filter_key(label: Column) -> Column:
    """Column name for a label: lower case, other characters to ``_``, a leading digit gets ``f_``."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return (
        F.when(base == "", F.lit("custom"))
        .when(base.rlike("^[A-Za-z_]"), base)
        .otherwise(F.concat(F.lit("f_"), base))
    )


def clean_options(options: Column) -> Column:
    """Trimmed, non-empty options, each once, in the order given."""
    return F.array_distinct(F.filter(F.transform(options, lambda o: F.trim(o)), lambda o: o != ""))
