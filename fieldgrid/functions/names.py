"""File names: stems, date tags, passes and output paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, PASSES, Settings


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[A-Za-z0-9]+$", "")


def date_tag(path: Column, settings: Settings = DEFAULT) -> Column:
    """The first date-like run of digits in the base name, ``""`` without one."""
    return F.regexp_extract(base_name(path), settings.date_pattern, 0)


def pass_from_name(path: Column) -> Column:
    return F.when(path.rlike(r"(?i)_pm\.csv$"), F.lit("pm")).otherwise(F.lit("am"))


def _dir(label: Column, dirs: dict[str, str]) -> Column:
    out = F.when(label == PASSES[0], F.lit(dirs[PASSES[0]]))
    return out.when(label == PASSES[1], F.lit(dirs[PASSES[1]]))


def extracted_path(path: Column, label: Column, settings: Settings = DEFAULT) -> Column:
    """Where a granule's rows of one pass go; null for an unknown pass label."""
    low = F.lower(label)
    return F.concat(_dir(low, settings.extracted_dir), F.lit("/"), stem(path), F.lit("_"), low, F.lit(".csv"))


def detrended_path(path: Column, label: Column, settings: Settings = DEFAULT) -> Column:
    return F.concat(_dir(F.lower(label), settings.detrended_dir), F.lit("/"), stem(path), F.lit(".rds"))
