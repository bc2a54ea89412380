"""Granule arrays to clean rows: one job over all granules and both passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, PASSES, Settings, candidate_table
from ..functions import names
from ..operators import clean, granules
from ..schemas import EXTRACTED
from ..sources import manifest, named
from ..sources.scratch import cut


def extract_all(arrays: DataFrame, attributes: DataFrame, limit: int | None = None, done: DataFrame | None = None, settings: Settings = DEFAULT, must: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows (schema EXTRACTED and flat position p) and log (schema EXTRACT_LOG) of all granules.

    Variables are resolved and shapes checked per granule and pass before any array is exploded;
    what fails is a log row, and the rest goes on. No granule at all is an error, but for ``must`` off.

    Value, longitude and latitude chunks are each read once, whatever the layouts."""
    rows, status = _planned(arrays, attributes, limit, done, settings, must)
    # counted by the whole path: two granules may share a base name
    counted = rows.groupBy(F.col("_granule").alias("granule"), "pass").agg(F.count(F.lit(1)).cast("int").alias("rows"))
    return rows.drop("_granule"), _log(status.join(counted, ["granule", "pass"], "left"))


def extract_to_files(arrays: DataFrame, attributes: DataFrame, root: str, limit: int | None = None, done: DataFrame | None = None, settings: Settings = DEFAULT, must: bool = True) -> DataFrame:
    """The same with one delimited file for each granule and pass, at the path of its log row below
    ``root``; returns the log. Its counts are those of the files, so no array is read for it again. A
    granule without usable rows has a file with the header alone. With overwrite off, what has a file
    is skipped, if no ``done`` is given."""
    spark = arrays.sparkSession
    if done is None and not settings.overwrite:
        have = manifest.stage_files(manifest.on_disk(spark, root, settings.table_pattern))
        arrays_of = arrays.select(F.col("granule"), names.stem(F.col("granule")).alias("stem")).distinct().withColumn("pass", F.explode(F.array(*map(F.lit, PASSES))))
        done = arrays_of.withColumn("at", F.concat_ws("_", "stem", "pass")).join(have.select("pass", F.col("source_file").alias("at")), ["pass", "at"], "left_semi").select(F.col("granule").alias("source_file"), "pass")
    rows, status = _planned(arrays, attributes, limit, done, settings, must)
    status = cut(status)
    paths = status.where(F.col("status") == "ok").select("granule", "pass", "output_file")
    named_rows = rows.join(paths.withColumnRenamed("granule", "_granule"), ["_granule", "pass"]).select(*[c.split()[0] for c in EXTRACTED.split(", ")], "output_file")
    named.write_named(named_rows, root, empty=paths)
    counted = manifest.rows_on_disk(spark, root).join(paths, "output_file").select("granule", "pass", "rows")
    return _log(status.join(counted, ["granule", "pass"], "left"))


def _planned(arrays: DataFrame, attributes: DataFrame, limit: int | None, done: DataFrame | None, settings: Settings, must: bool) -> tuple[DataFrame, DataFrame]:
    """Clean rows with _granule, and the status of each granule and pass."""
    spark = arrays.sparkSession
    arrays = arrays.join(manifest.granules(arrays, limit, settings, must), "granule", "left_semi")
    shapes = arrays.groupBy("granule", "variable").agg(F.first("dims").alias("dims"))
    status = granules.resolve_status(shapes, granules.resolve(shapes, candidate_table(spark)))
    for what in ("value", "lon", "lat"):
        named = shapes.select("granule", F.col("variable").alias(what), F.col("dims").alias(f"{what}_dims"))
        status = status.join(named, ["granule", what], "left")
    ok = F.col("status") == "ok"
    status = status.withColumn("layout", F.when(ok, granules.layout(F.col("value_dims"), F.col("lon_dims"), F.col("lat_dims"))))
    status = status.withColumn("status", F.when(ok & F.col("layout").startswith("error"), F.col("layout")).otherwise(F.col("status")))
    status = status.withColumn("output_file", names.extracted_path(F.col("granule"), F.col("pass"), settings))
    if done is not None and not settings.overwrite:
        have = done.select(F.col("source_file").alias("granule"), "pass", F.lit(True).alias("_done")).distinct()
        status = status.join(have, ["granule", "pass"], "left")
        status = status.withColumn("status", F.when((F.col("status") == "ok") & F.col("_done"), "skipped_existing").otherwise(F.col("status"))).drop("_done")

    fine = status.where(F.col("status") == "ok")
    fills = granules.attribute_values(attributes)

    def side(what: str) -> DataFrame:
        # a granule and pass is one grid: the key carries both
        chosen = fine.select("granule", "pass", "layout", F.col(what).alias("variable"))
        cells = arrays.join(chosen, ["granule", "variable"]).join(fills, ["granule", "variable"], "left")
        masked = F.transform("data", lambda v: clean.mask_fill(clean.no_nan(v), F.col("fill"), F.col("missing")))
        return cells.select(F.struct("granule", "pass", "layout").alias("granule"), "chunk", masked.alias("data"))

    value, coords = side("value"), granules.coordinates(side("lon"), side("lat"))
    of = lambda df, *layouts: df.where(F.col("granule.layout").isin(*layouts))
    grids = of(coords, "same").unionByName(granules.turned(of(coords, "transposed")))
    flat = granules.flatten_chunks(of(value, "same", "transposed"), grids)
    flat = flat.unionByName(granules.flatten_along(of(value, "lon_first", "lat_first"), of(coords, "lon_first", "lat_first"), F.col("granule.layout") == "lon_first"))
    source = F.col("granule.granule")
    rows = flat.select(names.base_name(source).alias("source_file"), names.date_tag(source, settings).alias("date_tag"), F.col("granule.pass").alias("pass"), "lon", "lat", F.col("value").alias("soil_moisture"), "p", source.alias("_granule"))
    none = F.lit(None).cast("array<double>")
    rows = clean.clean(rows, none, none, settings)
    return rows, status


def _log(status: DataFrame) -> DataFrame:
    """Log rows of granules and passes with their row counts (null: none)."""
    log = status.where(F.col("status") != "absent")
    written = F.col("status") == "ok"
    return log.select(names.base_name(F.col("granule")).alias("source_file"), "pass", F.when(written, F.coalesce("rows", F.lit(0))).alias("rows"), F.when(~F.col("status").startswith("error"), F.col("output_file")).alias("output_file"), F.when(written, "written").otherwise(F.col("status")).alias("status"))


def extract_log(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Log rows of clean rows that were written: one for each file and pass."""
    counted = rows.groupBy("source_file", "pass").agg(F.count(F.lit(1)).cast("int").alias("rows"))
    path = names.extracted_path(F.col("source_file"), F.col("pass"), settings)
    return counted.select("source_file", "pass", "rows", path.alias("output_file"), F.lit("written").alias("status"))
