"""Readers and writers."""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.clean import na_to_null
from .scratch import cut, opening


def read_arrays(spark: SparkSession, path: str, variables: list[str] | None = None) -> DataFrame:
    """The chunked array table; a filter on variables reaches the Parquet scan."""
    df = spark.read.schema(schemas.ARRAYS).parquet(path)
    return df.where(F.col("variable").isin(*variables)) if variables else df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A delimited table with a header, the same in all files; without a schema types are inferred
    from a scan of the data."""
    reader = spark.read.option("header", True)
    if schema:
        return na_to_null(reader.schema(schema).csv(path))
    return inferred(na_to_null(reader.csv(path)))


def inferred(texts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text columns as bigint, double or string, whichever holds all their values; one pass over all
    columns decides. ``keep`` stay as they are."""
    at = [c for c in texts.columns if c not in keep]
    if not at:
        return texts
    # a cast that fails is a caught exception: what can't be a number is not tried
    may = {"bigint": r"^[^0-9A-Za-z+.\-]*[+-]?[0-9]+[^0-9A-Za-z+.\-]*$", "double": r"(?i)[0-9]|inf|nan"}
    fails = lambda c, kind: F.count_if(F.col(c).isNotNull() & (~F.col(c).rlike(may[kind]) | F.col(c).try_cast(kind).isNull()))
    bad = texts.agg(*[fails(c, kind).alias(f"{i}_{kind}") for i, c in enumerate(at) for kind in ("bigint", "double")]).first()
    pick = lambda i: "bigint" if not bad[f"{i}_bigint"] else "double" if not bad[f"{i}_double"] else "string"
    return texts.select(*[F.col(c).cast(pick(at.index(c))).alias(c) if c in at else c for c in texts.columns])


#: A plain file this small is read as one text; of a larger one a batch of lines is read for its header.
SMALL_FILE = 1 << 20
#: A field in quotes, which may hold commas.
_QUOTED = '"([^"]|"")*"'
_COMPRESSED = r"(?i)\.(gz|gzip|bz2|deflate|snappy|lz4|lzo|zst|zstd|xz|br)$"
_FOUND = "file_path string, file_name string, line string, header array<string>"


def texts(spark: SparkSession, root: str, whole: bool, *more: str) -> DataFrame:
    """value, file_path, file_name, ``more``: the small plain files below ``root`` as one text each, or
    the lines of all others. Both filters are on names and sizes, so no file is opened for nothing. The
    small ones come by the reader of bytes, which takes a seventh of the time of that of whole texts."""
    small = (F.col("_metadata.file_size") <= SMALL_FILE) & ~F.col("_metadata.file_name").rlike(_COMPRESSED)
    reader = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    named = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_name", *more)]
    if not whole:
        return reader.text(root).where(~small).select("value", *named)
    read = reader.format("binaryFile").load(root).where(small).select(F.make_valid_utf8(F.col("content").cast("string")).alias("value"), *named)
    # as readers of lines have it: without the mark of byte order, and any end of a line is one
    read = read.withColumn("value", F.when(F.startswith("value", F.lit("\ufeff")), F.substring("value", 2, 2 * SMALL_FILE)).otherwise(F.col("value")))
    return read.withColumn("value", F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", "\r\n?", "\n")).otherwise(F.col("value")))


def _named_columns(lines: pa.Array) -> pa.Array:
    """The names in first lines; bytes that are no text are shown as such."""
    texts = (x.decode(errors="replace").lstrip("\ufeff").rstrip("\r") for x in lines.cast(pa.binary()).to_pylist())
    return pa.array([[c.strip() for c in next(csv.reader([x]), [])] for x in texts], pa.list_(pa.string()))


def read_headers(spark: SparkSession, root: str) -> DataFrame:
    """file_path, file_name, line, header (its names) of every file below ``root`` that has a first
    line. Files that can't be read have no row.

    Small files are read whole, many in a task, and nothing but their first line goes further; of
    larger and compressed ones a split is one task here, which ends at the first line. So the job runs
    now and its rows are written to the shared folder."""

    def named(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _named_columns(batch.column(2))], names=["file_path", "file_name", "line", "header"])

    def first(batches):
        for batch in batches:
            if batch.num_rows and batch.column(3)[0].as_py() == 0:
                yield pa.RecordBatch.from_arrays([batch.column(1)[:1], batch.column(2)[:1], batch.column(0)[:1], _named_columns(batch.column(0)[:1])], names=["file_path", "file_name", "line", "header"])
            if batch.num_rows and batch.column(4)[0].as_py() > SMALL_FILE:
                return
            for _ in batches:
                pass

    line = F.substring_index("value", "\n", 1).alias("line")
    with opening(spark):
        small = cut(texts(spark, root, True).select("file_path", "file_name", line).mapInArrow(named, _FOUND))
    with opening(spark, spark.conf.get("spark.sql.files.maxPartitionBytes")):
        large = cut(texts(spark, root, False, "file_block_start", "file_size").mapInArrow(first, _FOUND))
    return small.unionByName(large)


def read_delimited(spark: SparkSession, root: str, columns: list[str] | None = None, headers: DataFrame | None = None) -> DataFrame:
    """All comma-delimited files below ``root``, whatever the order and number of their columns, as
    one table of texts: file_name, malformed (the line has more or fewer fields than its file's
    header) and ``columns`` (default: every name that a header has, in order of name). A column that
    a file lacks is null in its rows. A line is a row: no field holds a line feed.

    One scan: each line is split once and its fields are picked by the place of the name in its own
    file's header, a join by path; small files are joined whole, before they are split into lines.
    ``inferred`` finds types over all files. Run it within ``opening`` where files are many."""
    headers = read_headers(spark, root) if headers is None else headers
    if columns is None:
        columns = [r[0] for r in headers.select(F.explode("header").alias("c")).distinct().orderBy("c").collect()]
    width = headers.agg(F.max(F.size("header"))).first()[0] or 1
    places = [F.array_position("header", c).cast("int").alias(f"p{i}") for i, c in enumerate(columns)]
    known = headers.select("file_path", "file_name", "line", F.size("header").alias("wide"), *places)
    kept = ["file_name", "line", "wide", *[f"p{i}" for i in range(len(columns))]]
    rows = texts(spark, root, True).drop("file_name").join(known, "file_path").select(*kept, F.explode(F.split("value", "\n")).alias("value"))
    rows = rows.unionByName(texts(spark, root, False).drop("file_name").join(known, "file_path").select(*kept, F.rtrim(F.col("value"), F.lit("\r")).alias("value")))
    rows = rows.where((F.col("value") != F.rtrim(F.col("line"), F.lit("\r"))) & (F.trim("value") != ""))
    quoted = F.contains("value", F.lit('"'))
    bare = F.when(quoted, F.regexp_replace("value", _QUOTED, "")).otherwise(F.col("value"))
    n_fields = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    # a quoted line is parsed, any other one split
    fields = F.when(quoted, F.from_csv("value", ", ".join(f"c{k} string" for k in range(width))))
    rows = rows.select(*kept, (n_fields != F.col("wide")).alias("malformed"), fields.alias("f"), F.when(~quoted, F.split("value", ",", -1)).alias("s"))
    rows = rows.select(*kept, "malformed", F.coalesce("s", F.array(*[F.col(f"f.c{k}") for k in range(width)])).alias("f"))

    def by_place(i: int, c: str):
        at = F.col(f"p{i}")
        return F.when(at > 0, F.try_element_at("f", F.when(at > 0, at).otherwise(1))).alias(c)

    return na_to_null(rows.select("file_name", "malformed", *[by_place(i, c) for i, c in enumerate(columns)]))


def write_rows(df: DataFrame, path: str, form: str = "parquet") -> None:
    """One folder a pass and file; only the partitions written are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pass", "source_file")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def preview(df: DataFrame, key: str, n: int = 6) -> DataFrame:
    """The first n rows by a key."""
    return df.orderBy(key).limit(n)


def columns_of(df: DataFrame) -> DataFrame:
    """place, name, type of a table's columns."""
    rows = [(i, c, t) for i, (c, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "place int, name string, type string")
