"""Which files there are, which are done, and how stages compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import names
from . import io, named
from .scratch import cut, opening


class NoFiles(ValueError):
    """A manifest is empty."""


def granules(arrays: DataFrame, limit: int | None = None, settings: Settings = DEFAULT, must: bool = True) -> DataFrame:
    """granule: distinct names of granule files in binary order, the first ``limit``; an empty manifest is an error, but for ``must`` off."""
    return _listed(arrays.select("granule").distinct().where(F.col("granule").rlike(settings.granule_pattern)), "granule", limit, must)


def extracted(files: DataFrame, label: str, limit: int | None = None, settings: Settings = DEFAULT, must: bool = True) -> DataFrame:
    """file_name of one pass (a partition column, so that other passes are not read)."""
    here = files.where((F.col("pass") == label) & F.col("file_name").rlike(settings.table_pattern))
    return _listed(here.select("file_name").distinct(), "file_name", limit, must)


def _listed(found: DataFrame, name: str, limit: int | None, must: bool) -> DataFrame:
    if must and found.isEmpty():
        raise NoFiles(f"no {name} matches")
    out = found.orderBy(name)
    return out if limit is None else out.limit(max(0, limit))


def files_in(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, length of the files of a folder whose names match; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder).select("path", "length")
    return found.where(F.substring_index("path", "/", -1).rlike(pattern))


def on_disk(spark: SparkSession, root: str, pattern: str = ".") -> DataFrame:
    """output_file (path below ``root``) and length of the files there whose names match; only names
    are read, once: the listing is written to the shared folder. A folder that is not there has none."""
    store = named.Store(spark, root)
    if not store.exists():
        return spark.createDataFrame([], "output_file string, length long")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = whole.select(store.below(F.col("path")).alias("output_file"), "length")
    # Spark's scans pass over files of no bytes, its listings don't; the names stay in the JVM
    known = store.jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(whole._jdf.inputFiles())
    every = DataFrame(spark._jsparkSession.createDataset(known, store.jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    every = every.select(store.below(F.col("value"), encoded=True).alias("output_file"))
    every = every.where(F.substring_index("output_file", "/", -1).rlike(pattern))
    with opening(spark):
        return cut(every.join(found, "output_file", "left").select("output_file", F.coalesce("length", F.lit(0).cast("long")).alias("length")))


def rows_on_disk(spark: SparkSession, root: str, form: str = "csv", pattern: str = ".") -> DataFrame:
    """output_file and rows of every file below ``root``, 0 for one without any: lines but the header
    of delimited files, else what the format counts. The counts are made now and written to the shared
    folder."""
    listed = on_disk(spark, root, pattern).select("output_file")
    if listed.isEmpty():
        return listed.withColumn("rows", F.lit(0))
    each = lambda df: df.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    if form == "csv":
        ends = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit("\n"), F.lit("")))
        whole = ends + F.when(F.endswith("value", F.lit("\n")) | (F.col("value") == ""), 0).otherwise(1)
        counted = io.texts(spark, root, True).select("file_path", whole.cast("long").alias("n")).unionByName(each(io.texts(spark, root, False)))
    else:
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*").format(form)
        counted = each(reader.load(root).select(F.col("_metadata.file_path").alias("file_path")))
    counted = counted.select(named.Store(spark, root).below(F.col("file_path"), encoded=True).alias("output_file"), (F.col("n") - int(form == "csv")).alias("n"))
    with opening(spark):
        return cut(listed.join(counted, "output_file", "left").select("output_file", F.coalesce("n", F.lit(0)).cast("int").alias("rows")))


def stage_files(listed: DataFrame) -> DataFrame:
    """pass and source_file (the stem) of files ``<stage>/<pass>/<stem>.<extension>``."""
    return listed.select(F.element_at(F.split("output_file", "/"), -2).alias("pass"), names.stem(F.col("output_file")).alias("source_file"))


def done_on_disk(work: DataFrame, listed: DataFrame) -> DataFrame:
    """source_file and pass of the work whose ``output_file`` is there: what jobs take as ``done``."""
    return work.join(listed.select("output_file").distinct(), "output_file", "left_semi").select("source_file", "pass")


def pending(work: DataFrame, done: DataFrame, keys: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """The work still to do: all of it when outputs are overwritten, else what no log row has."""
    return work if settings.overwrite else work.join(done.select(*keys).distinct(), keys, "left_anti")


def skipped(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Log rows of work that is done already: rows null, status skipped_existing."""
    have = work.join(done.select(*keys).distinct(), keys, "left_semi")
    return have.select(*keys, F.lit(None).cast("int").alias("rows"), F.lit("skipped_existing").alias("status"))


def counts_with_empty(files: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row count of every file of the manifest, 0 where it has none, and its status."""
    counted = files.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return counted.select(*keys, n.alias("rows"), F.when(n == 0, "written_empty").otherwise("written").alias("status"), F.when(n == 0, "empty_input_csv").alias("note"))


def reconcile(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per pass the number of files in two stages and the difference."""
    files = lambda df, name: df.groupBy("pass").agg(F.countDistinct("source_file").alias(name))
    both = files(before, "n_before").join(files(after, "n_after"), "pass", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("pass", zero("n_before").alias("n_before"), zero("n_after").alias("n_after"), (zero("n_before") - zero("n_after")).alias("n_missing"))
