"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; a temporary one where driver and executors are one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}"
    return f"{found.rstrip('/')}/fieldgrid-{spark.sparkContext.applicationId}"


def place(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = place(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; its results can't be read after that."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: What opening a file counts as in folders of many small ones, in bytes.
SMALL_OPEN = 1 << 16


@contextmanager
def opening(spark: SparkSession, cost: int | str = SMALL_OPEN) -> Iterator[None]:
    """Within it a scan deals files out to tasks as if opening one were reading ``cost`` bytes. A scan
    is dealt out when its job runs, so that has to be inside (``cut``)."""
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", cost)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
