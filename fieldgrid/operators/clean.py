"""Masking, casting and dropping of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings

# Texts that stand for a missing value in delimited files.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def to_double(text: Column) -> Column:
    """A number from text; null where it is none, NaN included."""
    return no_nan(text.try_cast("double"))


def to_int(text: Column) -> Column:
    return text.try_cast("int")


def no_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def na_to_null(df: DataFrame, tokens: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    """Missing-value tokens in text columns become null."""
    return df.select(*[F.when(~F.trim(c).isin(*tokens), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def is_fill(value: Column, fill: Column, missing: Column) -> Column:
    """Whether the value is among the fill or the missing values (arrays; null: no such attribute)."""
    return F.coalesce(F.array_contains(fill, value), F.lit(False)) | F.coalesce(F.array_contains(missing, value), F.lit(False))


def mask_fill(value: Column, fill: Column, missing: Column) -> Column:
    """Null where the value is among the fill or the missing values."""
    return F.when(~is_fill(value, fill, missing), value)


def mask_range(value: Column, low: float, high: float) -> Column:
    """Null outside [low, high]; both ends stay. NaN is above every number and so outside."""
    return F.when(value.between(low, high), value)


def clean(df: DataFrame, fill: Column, missing: Column, settings: Settings = DEFAULT) -> DataFrame:
    """Mask fill values and the range of ``soil_moisture``, then drop rows without place or value.

    Where rows are dropped, the masks are one filter and the value stays as it is, so its
    expression is not repeated within itself."""
    value = F.col("soil_moisture")
    good = value.between(settings.value_min, settings.value_max) & ~is_fill(value, fill, missing)
    if settings.drop_na:
        return df.where(good & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return df.withColumn("soil_moisture", F.when(good, value))
