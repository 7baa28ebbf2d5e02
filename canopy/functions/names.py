"""Names that carry meaning: features, files, tiles, regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _found(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    out = F.regexp_extract(x, pattern, group)
    return F.when(out != "", out)


def tile_id(file: Column) -> Column:
    return _found(file, r"tile_(\d+)_training").cast("int")


def file_date(name: Column) -> Column:
    """A date written YYYYMMDD, or else YYYY-MM-DD or YYYY_MM_DD."""
    short = F.try_to_timestamp(_found(name, r"(\d{8})"), F.lit("yyyyMMdd"))
    long = F.try_to_timestamp(F.translate(_found(name, r"(\d{4}[-_]\d{2}[-_]\d{2})"), "_", "-"), F.lit("yyyy-MM-dd"))
    return F.coalesce(short, long).cast("date")


def group_label(feature: Column) -> Column:
    """index:component of a feature name."""
    return F.concat_ws(":", F.substring_index(feature, "_", 1), F.regexp_replace(feature, r"^[^_]*_", ""))


def group_parts(label: Column) -> tuple[Column, Column]:
    """Upper-case index, and component."""
    parts = F.split(label, ":", 2)
    return F.upper(parts[0]), parts[1]


def pretty(feature: Column, words: dict[str, str]) -> Column:
    """Words of a feature name, some of them replaced."""
    known = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.concat_ws(" ", F.transform(F.split(feature, "_"), lambda w: F.coalesce(known[w], w)))


def number_in(text: Column) -> Column:
    """The first digits of a text as a number, else 0."""
    return F.coalesce(_found(text, r"(\d+)").cast("int"), F.lit(0))


def region_name(name: Column, *maps: dict[str, str]) -> Column:
    """Spaces to underscores, then each map in turn; names that a map lacks stay."""
    out = F.replace(name, F.lit(" "), F.lit("_"))
    for m in maps:
        out = F.coalesce(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[out], out)
    return out


def leaf_habit(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("deciduous"), "deciduous").when(low.contains("evergreen"), "evergreen").otherwise("other")
