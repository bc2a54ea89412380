"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut, place, release, shared_dir  # noqa: F401  used by the operators

#: ASCII white space; every other character belongs to a word.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_aside(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``used`` renamed, so that none clashes with what an operator
    adds, and a function that brings their names and order back."""
    names = docs.columns
    short = [c if c in used else f"__fg_aside_{i}" for i, c in enumerate(names)]
    return docs.toDF(*short), lambda df: df.select(*[F.col(s).alias(c) for s, c in zip(short, names)])


def with_fold(df: DataFrame, parts: int, name: str = "fold") -> DataFrame:
    """``crc32(doc_id as text) mod parts``; a null id is in fold 0."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts
    return df.withColumn(name, F.coalesce(fold, F.lit(0)).cast("int"))


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def sliced(batches, rows: int = 256):
    """Arrow batches cut into smaller ones, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; ``bytes.split`` splits at just these six characters."""
    return text.encode().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multipliers), so that near values land far apart."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x
