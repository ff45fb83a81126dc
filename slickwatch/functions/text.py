"""Time, text, path, JSON and hash column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slickwatch.functions.geo import as_col

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso_z(ts) -> Column:
    """Timestamp as ISO text in UTC, whole seconds."""
    return F.date_format(as_col(ts), ISO_Z)


def to_utc(text) -> Column:
    """ISO text (naive means UTC) or epoch seconds to a timestamp, else null."""
    text = F.trim(as_col(text).cast("string"))
    epoch = F.when(text.rlike(r"^-?[0-9]{1,12}(\.[0-9]+)?$"), text.try_cast("double"))
    iso = F.when(
        text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(text)
    )
    return F.coalesce(F.timestamp_micros((epoch * 1e6).cast("bigint")), iso)


def midpoint(a, b) -> Column:
    """Middle of two timestamps, milliseconds."""
    return F.timestamp_millis(
        F.floor((F.unix_millis(as_col(a)) + F.unix_millis(as_col(b))) / 2).cast("bigint")
    )


def basename(path) -> Column:
    return F.regexp_extract(as_col(path), r"([^/\\]*)$", 1)


def safe_name(path) -> Column:
    """Base name fit for storage, or null when nothing usable is left."""
    name = F.trim(basename(path))
    return F.when((name != "") & (name != ".") & (name != "..") & ~name.contains("\x00"), name)


def extension(path) -> Column:
    """Lower-case last suffix without the dot, or empty."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def stem(path) -> Column:
    """Base name without its last suffix."""
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def event_id(acquired, scene_id) -> Column:
    """Acquisition date if known, else the first two tokens of the scene id."""
    acquired = as_col(acquired)
    return F.when(
        F.coalesce(acquired, F.lit("")) != "", F.substring_index(acquired, "T", 1)
    ).otherwise(F.substring_index(as_col(scene_id), "_", 2))


def canonical_json(properties: Column) -> Column:
    """Map rendered as JSON with its keys in order, ready for hashing."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(properties))))


def content_hash(value) -> Column:
    return F.sha2(as_col(value), 256)


def join_codes(sep: str, *codes: Column) -> Column:
    """Join the non-null codes in order (``when`` without ``otherwise``)."""
    return F.concat_ws(sep, *codes)
