"""Files at the paths that the logs name.

Rows are written to a staging folder below the target; when all of them are, each file is renamed to
its path. A file is whole when it appears, and a run that breaks off leaves nothing but the staging
folder and finished files, which the next run replaces.

In a folder of a mounted file system (file:) the tasks write and rename the files themselves, so
nothing of a file passes the driver. In any other store Spark writes a folder a path and names the
files itself, and the driver renames them, a few at a time.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

KEY = "_fg_path"
AT_ONCE = 16
#: Rows and bytes of a Parquet file's row group at most, but for one batch.
GROUP_ROWS, GROUP_BYTES = 1 << 20, 1 << 26


class Store:
    """The file system of a folder, by Spark's own configuration."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def below(self, path: Column, encoded: bool = False) -> Column:
        """A full path, however its scheme is written, as the path below the folder. ``encoded``:
        characters stand as in an address (%20)."""
        base = self.fs.makeQualified(self.at("")).toUri().getPath().rstrip("/")
        path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
        return F.substr(path, F.locate(base, path) + F.lit(len(base) + 1))

    def mounted(self) -> str | None:
        """The folder as a path of the operating system, the same on every executor; None in other stores."""
        return self.fs.makeQualified(self.at("")).toUri().getPath() if self.fs.getScheme() == "file" else None

    def exists(self, path: str = "") -> bool:
        return self.fs.exists(self.at(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def move(self, source: str, target: str) -> None:
        self.fs.mkdirs(self.at(target).getParent())
        self.fs.delete(self.at(target), False)
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"can't rename {source} to {target}")

    def copy(self, source: str, target: str) -> None:
        """A whole small file, so that it appears at once: beside the target, then renamed."""
        beside = f"{source}-{uuid.uuid4().hex}"
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.at(source), self.fs, self.at(beside), False, self.conf)
        self.move(beside, target)

    def files(self, path: str) -> list[tuple[str, str]]:
        """(folder below ``path``, name) of its data files."""
        out, every = [], self.fs.listFiles(self.at(path), True)
        while every.hasNext():
            p = every.next().getPath()
            if not p.getName().startswith(("_", ".")):
                out.append((p.getParent().getName(), p.getName()))
        return out


def write_named(df: DataFrame, root: str, path: str = "output_file", form: str = "csv", empty: DataFrame | None = None, order: list[str] | None = None) -> int:
    """Writes the rows of each ``path`` (below ``root``) as the one file of that name; the column
    itself stays out. Returns the number of files.

    ``empty`` (a table with the same column) are paths without rows: each gets a file of all columns
    and no row. Existing files of these paths are replaced, others stay. Rows without a path are not
    written: a log has them as errors. ``order`` are columns that sort the rows of each file and stay
    out of it. A path whose rows are a third of all is still one file, and so one task's work."""
    spark, stage = df.sparkSession, f"_staging-{uuid.uuid4().hex}"
    store = Store(spark, root)
    keyed = df.where(F.col(path).isNotNull()).withColumnRenamed(path, KEY)
    none = None if empty is None else empty.where(F.col(path).isNotNull()).select(F.col(path).alias(KEY)).distinct()
    write = _by_tasks if store.mounted() and _writable(keyed.drop(KEY, *(order or [])).schema, form) else _by_driver
    try:
        return write(keyed, store, stage, form, none, order or [])
    finally:
        store.delete(stage)


def _by_driver(keyed: DataFrame, store: Store, stage: str, form: str, empty: DataFrame | None, order: list) -> int:
    spark, options = keyed.sparkSession, {"header": True} if form == "csv" else {}
    dealt = keyed.repartition(KEY)
    dealt = dealt.sortWithinPartitions(KEY, *order) if order else dealt
    dealt.drop(*order).write.partitionBy(KEY).options(**options).format(form).save(f"{store.root}/{stage}/rows")
    moves = []
    for folder, name in store.files(f"{stage}/rows") if store.exists(f"{stage}/rows") else []:
        moves.append((f"{stage}/rows/{folder}/{name}", unquote(folder.removeprefix(f"{KEY}="))))
    found = {target for _, target in moves}
    copies = [r[0] for r in empty.collect() if r[0] not in found] if empty is not None else []
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for done in [pool.submit(store.move, *m) for m in moves]:
            done.result()
        if copies:
            nothing = spark.createDataFrame([], keyed.drop(KEY, *order).schema).coalesce(1)
            nothing.write.options(**options).format(form).save(f"{store.root}/{stage}/none")
            ((_, name),) = store.files(f"{stage}/none")
            for done in [pool.submit(store.copy, f"{stage}/none/{name}", target) for target in copies]:
                done.result()
    return len(moves) + len(copies)


def _writable(schema: T.StructType, form: str) -> bool:
    """Whether tasks can write these columns as Spark's own writer does."""
    simple = (T.BinaryType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)

    def fine(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return len(kind) > 0 and all(fine(f.dataType) for f in kind)
        inner = [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.keyType, kind.valueType] if isinstance(kind, T.MapType) else None
        return all(map(fine, inner)) if inner else isinstance(kind, simple) or kind == T.StringType()

    if form == "text":
        return [f.dataType for f in schema] == [T.StringType()]
    flat = all(isinstance(f.dataType, (*simple, T.StringType)) and not isinstance(f.dataType, T.BinaryType) for f in schema)
    return fine(schema) and (form == "parquet" or form == "csv" and flat)


def _by_tasks(keyed: DataFrame, store: Store, stage: str, form: str, empty: DataFrame | None, order: list) -> int:
    """One job writes staged files, sorted by path within a partition, and a list of them; a second one
    renames them."""
    spark, root = keyed.sparkSession, store.mounted()
    names = [c for c in keyed.columns if c not in (KEY, *order)]
    here, columns, schema = f"{root}/{stage}/files", [F.col(f"`{c}`") for c in names], keyed.drop(KEY, *order).schema
    # by the hash first: it stands in the sort's prefix, which paths with one beginning do not
    dealt = keyed.repartition(KEY).sortWithinPartitions(F.xxhash64(KEY), KEY, *order)
    if form == "parquet":
        meta = {b"org.apache.spark.version": spark.version.encode(), b"org.apache.spark.sql.parquet.row.metadata": schema.json().encode()}
        sink = lambda at: _Rows(at, meta)
        head = to_arrow_schema(schema)
        dealt = dealt.select(KEY, *[c.alias(f"c{k}") for k, c in enumerate(columns)])
    else:
        line = F.to_csv(F.struct(*columns)) if form == "csv" else F.coalesce(columns[0], F.lit(""))
        dealt = dealt.select(KEY, F.concat(line, F.lit("\n")).alias("line"))
        head = spark.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(f"c{k}") for k, c in enumerate(names)]))).first()[0].encode() + b"\n" if form == "csv" else b""
        sink = lambda at: _Lines(at, head)
    titles = names if form == "parquet" else ["line"]
    strings = lambda *v: pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in v], names=["staged", "target"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = f"{here}/{uuid.uuid4().hex}"
        os.makedirs(folder)
        staged, targets, out = [], [], None
        for batch in batches:
            rest = pa.RecordBatch.from_arrays(batch.columns[1:], names=titles)
            runs = pc.run_end_encode(batch.column(0), run_end_type=pa.int32())
            begin = 0
            for end, target in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if out is None or target != targets[-1]:
                    if out is not None:
                        out.close()
                    staged.append(f"{folder}/{len(staged)}")
                    targets.append(target)
                    out = sink(staged[-1])
                out.write(rest, begin, end)
                begin = end
        if out is not None:
            out.close()
        yield strings(staged, targets)

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = f"{here}/{uuid.uuid4().hex}"
        os.makedirs(folder)
        staged, n = [], 0
        for batch in batches:
            staged = [f"{folder}/{n + k}" for k in range(batch.num_rows)]
            n += batch.num_rows
            for at in staged:
                out = sink(at)
                if form == "parquet":
                    out.begin(head)
                out.close()
            yield strings(staged, batch.column(0).to_pylist())

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, known = 0, set()
        for batch in batches:
            for source, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder, name = os.path.split(f"{root}/{target}")
                if folder not in known:
                    os.makedirs(folder, exist_ok=True)
                    known.add(folder)
                with suppress(FileNotFoundError):  # of an earlier file written by Spark
                    os.unlink(f"{folder}/.{name}.crc")
                try:
                    os.replace(source, f"{folder}/{name}")
                except FileNotFoundError:  # an earlier attempt of this task has moved it
                    if not os.path.exists(f"{folder}/{name}"):
                        raise
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    listed = "staged string, target string"
    dealt.mapInArrow(written, listed).write.parquet(f"{store.root}/{stage}/rows")
    every = spark.read.schema(listed).parquet(f"{store.root}/{stage}/rows")
    if empty is not None:
        empty.join(every.select(F.col("target").alias(KEY)), KEY, "left_anti").mapInArrow(bare, listed).write.parquet(f"{store.root}/{stage}/none")
        every = every.unionByName(spark.read.schema(listed).parquet(f"{store.root}/{stage}/none"))
    return every.mapInArrow(moved, "n long").agg(F.sum("n")).first()[0] or 0


class _Lines:
    """A file of lines that end in line feeds; those of a batch are one stretch of its memory."""

    def __init__(self, at: str, head: bytes):
        self.out = open(at, "wb", buffering=0)
        self.head = head

    def write(self, batch: pa.RecordBatch, begin: int, end: int) -> None:
        lines = batch.column(0)
        _, places, data = lines.buffers()
        wide = pa.types.is_large_string(lines.type)
        first, last = np.frombuffer(places, np.int64 if wide else np.int32)[[lines.offset + begin, lines.offset + end]]
        self._put(self.head + memoryview(data)[first:last] if self.head else memoryview(data)[first:last])
        self.head = b""

    def _put(self, what) -> None:
        what = memoryview(what)
        while what:
            what = what[self.out.write(what) :]

    def close(self) -> None:
        self._put(self.head)
        self.out.close()


class _Rows:
    """A Parquet file."""

    def __init__(self, at: str, meta: dict[bytes, bytes]):
        self.at, self.meta, self.out, self.parts, self.n = at, meta, None, [], 0

    def begin(self, schema: pa.Schema) -> None:
        self.out = pq.ParquetWriter(self.at, schema.with_metadata(self.meta), compression="snappy", store_schema=False)

    def write(self, batch: pa.RecordBatch, begin: int, end: int) -> None:
        self.parts.append(batch.slice(begin, end - begin))
        self.n += end - begin
        if self.n >= GROUP_ROWS or self.n * batch.get_total_buffer_size() >= GROUP_BYTES * batch.num_rows:
            self._flush()

    def _flush(self) -> None:
        if self.parts:
            if self.out is None:
                self.begin(self.parts[0].schema)
            self.out.write_table(pa.Table.from_batches(self.parts).replace_schema_metadata(self.meta), row_group_size=GROUP_ROWS)
            self.parts, self.n = [], 0

    def close(self) -> None:
        self._flush()
        self.out.close()
