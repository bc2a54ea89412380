"""Checks and logs: errors are rows with a status, never a failed job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PASSES
from ..functions import names
from ..schemas import REQUIRED


def missing_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def required_columns(headers: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Adds missing (in order of ``required``) and status to source_file, header."""
    lack = F.array_except(F.array(*[F.lit(c) for c in required]), F.col("header"))
    status = F.when(F.size(lack) == 0, "ok").otherwise(F.concat(F.lit("error: missing required columns: "), F.array_join(lack, ", ")))
    return headers.withColumn("missing", lack).withColumn("status", status)


def single_pass(df: DataFrame, key: str = "source_file") -> DataFrame:
    """Per file the passes it names and whether it is exactly one; null counts as a value."""
    low = F.lower("pass")
    out = df.groupBy(key).agg((F.countDistinct(low) + F.max(F.col("pass").isNull().cast("int"))).alias("n_passes"), F.array_join(F.sort_array(F.collect_set(low)), ", ").alias("passes"))
    return out.withColumn("status", F.when(F.col("n_passes") == 1, "ok").otherwise(F.concat(F.lit("error: expected exactly one pass, found: "), F.col("passes"))))


def known_pass(checks: DataFrame, passes: tuple[str, ...] = PASSES) -> DataFrame:
    """The result of ``single_pass`` with an error where the one pass is none of ``passes``."""
    other = ~F.col("passes").isin(*passes)
    return checks.withColumn("status", F.when((F.col("status") == "ok") & other, F.concat(F.lit("error: unknown pass label: "), F.col("passes"))).otherwise(F.col("status")))


def pass_consistency(files: DataFrame) -> DataFrame:
    """files: file_name, pass. Adds pass_guess, mismatch and pass_used (the column wins)."""
    guess = names.pass_from_name(F.col("file_name"))
    out = files.withColumn("pass_guess", guess)
    return out.withColumn("mismatch", F.coalesce(F.lower("pass") != F.col("pass_guess"), F.lit(False))).withColumn("pass_used", F.coalesce(F.lower("pass"), F.col("pass_guess")))


def status_counts(log: DataFrame) -> DataFrame:
    """status, n; rows without a status are left out."""
    return log.where(F.col("status").isNotNull()).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def reconstruction(cells: DataFrame, limit: float) -> DataFrame:
    """Per file the largest |observed - (trend_hat + resid)| and whether it is too large."""
    error = F.max(F.abs(F.col("soil_moisture") - (F.col("trend_hat") + F.col("resid"))))
    return cells.groupBy("source_file", "pass").agg(error.alias("max_error")).withColumn("warning", F.col("max_error") > limit)
