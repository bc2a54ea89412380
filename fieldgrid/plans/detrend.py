"""Clean rows to detrended cells: one job over all files and both passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import geo, names
from ..operators import audit, clean, granules, trend
from ..schemas import CELLS, EXTRACTED, REQUIRED
from ..sources import io, manifest
from ..sources.named import write_named
from ..sources.scratch import cut, opening


def projected(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", geo.project_x(F.col("lon"))).withColumn("y", geo.project_y(F.col("lat")))


def detrend_all(
    rows: DataFrame,
    label: str | None = None,
    files: DataFrame | None = None,
    headers: DataFrame | None = None,
    order: list[str] | None = None,
    done: DataFrame | None = None,
    settings: Settings = DEFAULT,
    faults: DataFrame | None = None,
    numbered: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Cells (schema CELLS) and log (schema DETREND_LOG, with ``warning``): a log row for every file.

    ``files`` (file_name) is the manifest: files without rows are logged as written_empty.
    ``headers`` (source_file, header) are the columns that each file has: a file that lacks a
    required one is an error row, as are one with more than one pass or an unknown pass, and one
    without any usable row. If ``rows`` itself lacks required columns, every file is an error row.
    Where a file's name tells another pass than its rows, the rows count and ``warning`` says so.
    ``label`` is the pass to do: other files, and their errors, are left out. ``order`` gives the
    rows' order for pixel_id (default: p, or place and value). ``done`` with overwrite off skips
    files of an earlier log. ``faults`` (source_file, note) are files that could not be read or whose
    records are bad: each is one error row, and nothing of it goes further. Numbering pixels writes the
    cells once; ``numbered`` off leaves pixel_id null, for callers that want the log alone.

    Rows are read once for the groups' counts and means, once for the fit and once for the cells.
    """
    spark = rows.sparkSession
    named = lambda df: df.withColumn("guess", names.pass_from_name(F.col("source_file")))
    wanted = F.lit(True) if label is None else F.col("guess") == label
    listed = None if files is None else files.select(names.base_name(F.col("file_name")).alias("source_file")).distinct()
    if faults is not None:
        bad = faults.select("source_file").distinct()
        rows = rows.join(bad, "source_file", "left_anti") if "source_file" in rows.columns else rows
        listed = None if listed is None else listed.join(bad, "source_file", "left_anti")
        headers = None if headers is None else headers.join(bad, "source_file", "left_anti")
        cells, log = detrend_all(rows, label, None if listed is None else listed.select(F.col("source_file").alias("file_name")), headers, order, done, settings, None, numbered)
        return cells, log.unionByName(_failed(named(faults).where(wanted)))
    lacking = audit.missing_columns(rows)
    if lacking:
        known = rows.select("source_file").distinct() if "source_file" in rows.columns else spark.createDataFrame([], "source_file string")
        known = known if listed is None else known.unionByName(listed).distinct()
        bad = named(known).where(wanted).withColumn("note", F.lit(f"error: missing required columns: {', '.join(lacking)}"))
        return spark.createDataFrame([], CELLS), _failed(bad)

    rows = projected(rows.withColumn("pass", F.lower("pass")))
    usable = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("soil_moisture").isNotNull()
    seen = rows.select("source_file", "pass", *[F.when(usable, F.col(c)).alias(c) for c in ("x", "y", "soil_moisture")])
    stats = cut(trend.guarded(trend.group_stats(seen), settings))  # a row for each file and pass
    checks = named(audit.known_pass(audit.single_pass(stats)))
    if headers is not None:
        lack = audit.required_columns(headers).select("source_file", F.col("status").alias("lacks"))
        checks = checks.join(lack, "source_file", "left").withColumn("status", F.when(F.col("lacks").startswith("error"), F.col("lacks")).otherwise(F.col("status"))).drop("lacks")
    checks = cut(checks)
    fine = stats.join(checks.where(F.col("status") == "ok").select("source_file", "guess"), "source_file")
    if label is not None:
        fine = fine.where(F.col("pass") == label)
    skipped = None
    if done is not None and not settings.overwrite:
        have = done.select("source_file", "pass").distinct()
        skipped = fine.join(have, ["source_file", "pass"], "left_semi")
        fine = fine.join(have, ["source_file", "pass"], "left_anti")
    some = fine.where(F.col("n") > 0)
    rows = rows.where(usable)
    models = cut(trend.models_of(rows, settings=settings, stats=some))
    out = trend.residuals(rows, models)
    out = granules.pixel_ids(out, order or (["p"] if "p" in rows.columns else ["lon", "lat", "soil_moisture"])) if numbered else out.withColumn("pixel_id", F.lit(None).cast("int"))
    out = out.withColumn("geometry", geo.square_binary(F.col("x"), F.col("y"), settings.cell_size)).withColumn("srid", F.lit(settings.projected_srid))
    cells = out.select("source_file", "date_tag", "pass", "lon", "lat", "x", "y", "soil_moisture", "trend_hat", "resid", "sm_for_kriging", "trend_removed", "p_trend", "r2_trend", "trend_ind", "pixel_id", "geometry", "srid")

    path = names.detrended_path(F.col("source_file"), F.col("pass"), settings)
    failed = F.col("note").startswith("error")
    mismatch = F.when(F.col("pass") != F.col("guess"), F.concat(F.lit("pass of the name is "), F.col("guess")))
    log = models.select(
        "source_file", "pass", F.when(~failed, F.col("n").cast("int")).alias("rows"), F.when(~failed, path).alias("output_file"), F.when(~failed, F.col("trend_removed")).alias("trend_removed"),
        F.col("p").alias("p_trend"), F.col("r2").alias("r2_trend"), F.when(failed, "error").otherwise("written").alias("status"), "note", mismatch.alias("warning"),
    )
    log = log.unionByName(_failed(checks.where((F.col("status") != "ok") & wanted).withColumn("note", F.col("status"))))
    none = fine.where(F.col("n") == 0).select("source_file", F.col("pass").alias("guess"), F.lit("error: no usable rows").alias("note"))
    log = log.unionByName(_failed(none))
    if skipped is not None:
        log = log.unionByName(_logged(skipped.select("source_file", "pass", path.alias("output_file"), F.lit("skipped_existing").alias("status"), mismatch.alias("warning"))))
    if listed is not None:
        empty = named(listed.join(checks.select("source_file"), "source_file", "left_anti")).where(wanted).withColumn("pass", F.col("guess"))
        log = log.unionByName(_logged(empty.select("source_file", "pass", F.lit(0).alias("rows"), path.alias("output_file"), F.lit("written_empty").alias("status"), F.lit("empty_input_csv").alias("note"))))
    return cells, log


def detrend_files(spark: SparkSession, root: str, label: str | None = None, order: list[str] | None = None, done: DataFrame | None = None, settings: Settings = DEFAULT, numbered: bool = True) -> tuple[DataFrame, DataFrame]:
    """The job over all delimited files below ``root``: cells and log, a log row a file.

    Headers are read from the files themselves, and columns may stand in any order. A file that can't
    be read or has no first line, that lacks a required column, or that has a record of more or fewer
    fields than its header, is an error row; one with a header alone is written empty."""
    listed = manifest.on_disk(spark, root, settings.table_pattern).select(names.base_name(F.col("output_file")).alias("source_file")).distinct()
    headers = io.read_headers(spark, root) if not listed.isEmpty() else spark.createDataFrame([], "file_path string, file_name string, line string, header array<string>")
    headers = headers.where(F.col("file_name").rlike(settings.table_pattern))
    own = headers.select(F.col("file_name").alias("source_file"), "header")
    faults = listed.join(own, "source_file", "left_anti").withColumn("note", F.lit("error: no header can be read"))
    lacking = audit.required_columns(own).where(F.col("status") != "ok").select("source_file", F.col("status").alias("note"))
    if headers.isEmpty():
        rows = spark.createDataFrame([], EXTRACTED)
    else:
        fine = headers.join(lacking.select(F.col("source_file").alias("file_name")), "file_name", "left_anti")
        read = io.read_delimited(spark, root, [c for c in REQUIRED if c != "source_file"], fine)
        number = lambda c: clean.to_double(F.col(c)).alias(c)
        with opening(spark):
            read = cut(read.select(F.col("file_name").alias("source_file"), F.coalesce("date_tag", F.lit("")).alias("date_tag"), "pass", *map(number, ("lon", "lat", "soil_moisture")), "malformed"))
        bad = read.where("malformed").groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
        lacking = lacking.unionByName(bad.select("source_file", F.format_string("error: %d malformed records", F.col("n")).alias("note")))
        rows = read.drop("malformed")
    faults = cut(faults.unionByName(lacking))
    return detrend_all(rows, label, listed.select(F.col("source_file").alias("file_name")), None, order, done, settings, faults, numbered)


def write_cells(cells: DataFrame, log: DataFrame, root: str, settings: Settings = DEFAULT) -> int:
    """One Parquet file for each written file of the log, at its ``output_file`` below ``root``, and for
    each empty one a file of the same columns without rows. Returns the number of files."""
    path = names.detrended_path(F.col("source_file"), F.col("pass"), settings)
    empty = log.where(F.col("status") == "written_empty").select("output_file")
    return write_named(cells.withColumn("output_file", path), root, form="parquet", empty=empty)


def _logged(df: DataFrame) -> DataFrame:
    """The log's columns, null where ``df`` lacks them."""
    fields = {"source_file": "string", "pass": "string", "rows": "int", "output_file": "string", "trend_removed": "boolean", "p_trend": "double", "r2_trend": "double", "status": "string", "note": "string", "warning": "string"}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in fields.items()])


def _failed(df: DataFrame) -> DataFrame:
    """Error rows of source_file, guess, note."""
    return _logged(df.select("source_file", F.col("guess").alias("pass"), F.lit("error").alias("status"), "note"))
