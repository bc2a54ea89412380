"""Token ids in fixed-width bit packing, with block offsets for random access.

File format: a Parquet table (any store that Spark reaches, committed by Spark's writer, so a
retried task leaves no half file) of blocks in ascending doc_id order. A block is

    shard INT, block INT      place: range of doc_ids, then running number in it
    bits INT                  width of an id: the least that holds the vocabulary
    doc_ids ARRAY<BIGINT>     documents that end in or lie in the block, in order
    ends ARRAY<BIGINT>        for each, the offset in ids after its last id, from the block's start
    payload BINARY            the ids, ``bits`` bits each, least significant bit first

so id k of a block is bits [k * bits, (k + 1) * bits) of its payload: numpy unpacks any range of
ids without reading what stands before it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Pool, loaded
from .common import place, sliced

BLOCK_IDS = 1 << 18  # a block is closed when it holds so many ids
AT_ONCE = 1024  # documents encoded at once

BLOCKS = "shard int, block int, bits int, doc_ids array<bigint>, ends array<bigint>, payload binary"


def width_of(vocabulary: int) -> int:
    """The least number of bits that holds ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def _places(bits: int):
    """Of each of eight ids in a row: the 64-bit word and the bit in it where it begins."""
    return [divmod(k * bits, 64) for k in range(8)]


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids fill exactly ``bits`` bytes: each column of eight is shifted to its place at once."""
    rows = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    rows.ravel()[: len(ids)] = ids
    words = np.zeros((len(rows), 8 * bits // 64 + 1), np.uint64)
    for k, (word, bit) in enumerate(_places(bits)):
        words[:, word] |= rows[:, k] << np.uint64(bit)
        if bit + bits > 64:
            words[:, word + 1] |= rows[:, k] >> np.uint64(64 - bit)
    return words.view(np.uint8)[:, :bits].tobytes()[: (len(ids) * bits + 7) // 8]


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """Ids first to first + count - 1; touches only the bytes that hold them and those of up to seven before."""
    skip = first % 8
    start, n = first // 8 * bits, -(-(skip + count) // 8)
    raw = np.zeros((n, 8 * (8 * bits // 64 + 1)), np.uint8)
    held = np.zeros(n * bits, np.uint8)
    part = np.frombuffer(payload, np.uint8)[start : start + n * bits]
    held[: len(part)] = part
    raw[:, :bits] = held.reshape(n, bits)
    words = raw.view(np.uint64)
    out = np.empty((n, 8), np.uint64)
    for k, (word, bit) in enumerate(_places(bits)):
        out[:, k] = words[:, word] >> np.uint64(bit)
        if bit + bits > 64:
            out[:, k] |= words[:, word + 1] << np.uint64(64 - bit)
    return (out.ravel()[skip : skip + count] & np.uint64((1 << bits) - 1)).astype("<u4")


def encoded(docs: DataFrame, tokenizer_path: str, bits: int, end_id: int, bounds: list[int]) -> DataFrame:
    """shard, doc_id, n, payload: each document's packed ids with the end id, where it is read.

    A shard is a range of doc_ids: ``bounds`` are the last ids of all shards but the last."""
    edges = np.array(bounds, np.int64)

    def run(batches):
        pool = loaded(tokenizer_path, Pool)
        for batch in sliced(batches, AT_ONCE):
            ids, ends = pool.encode(batch.column(1))
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            starts = np.append(0, ends[:-1]) if len(ends) else ends
            docs_ = batch.column(0)
            shards = np.searchsorted(edges, docs_.fill_null(np.iinfo(np.int64).min).to_numpy())
            payloads = [pack(ids[a:z], bits) for a, z in zip(starts.tolist(), ends.tolist())]
            cols = [pa.array(shards, pa.int32()), docs_, pa.array(ends - starts, pa.int64()), pa.array(payloads, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "doc_id", "n", "payload"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "shard int, doc_id long, n long, payload binary")


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text, append ``end_id`` to each document, write blocks in doc_id order.

    Texts are encoded where they are read; only packed ids are dealt out, to ranges of doc_id whose
    bounds come from the ids' quantiles, and no key or source is hot. A null or empty text is the
    end id alone. Null ids come first; rows that repeat an id are each written, in the order of
    their lengths, then of their packed ids. Only doc_id and text are used.
    """
    bits = width_of(vocabulary)
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / shards for k in range(1, shards)]
    found = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), cuts, 100 * shards).alias("q")).first()["q"] if cuts else None
    rows = encoded(docs, tokenizer_path, bits, end_id, sorted(set(found or [])))

    def run(batches):
        at = block = held = 0
        shard, ids, parts, ends = None, [], [], []

        def flush():
            row = [[shard], [block], [bits], [ids], [ends], [pack(np.concatenate(parts), bits)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _ARROW)], names=_NAMES)

        for batch in sliced(batches, AT_ONCE):
            for at, doc, n, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (at != shard or held >= block_ids):
                    yield flush()
                    block = block + 1 if at == shard else 0
                    ids, parts, ends, held = [], [], [], 0
                elif at != shard:
                    block = 0
                shard = at
                parts.append(unpack(payload, bits, 0, n))
                held += n
                ids.append(doc)
                ends.append(held)
        if ids:
            yield flush()

    _NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
    _ARROW = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n", "payload")
    dealt.mapInArrow(run, BLOCKS).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Read the blocks back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    on request, ids. Only one row a shard meets in the small running sum over shards."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.select("shard", "block", F.coalesce(F.element_at("ends", -1), F.lit(0)).alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inner = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    starts = sizes.select("shard", "block", inner.alias("inner")).join(before, "shard")
    starts = starts.select("shard", "block", (F.col("inner") + F.col("shard_start")).alias("start"))

    fields = [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint"), ("shard", "int"), ("block", "int")]
    fields += [("ids", "array<int>")] * with_ids

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ends = row["ends"]
                ids = unpack(row["payload"], row["bits"], 0, ends[-1])
                starts = [0, *ends[:-1]]
                out = (row["doc_ids"], starts, [z - a for a, z in zip(starts, ends)], [zlib.crc32(ids[a:z]) for a, z in zip(starts, ends)])
                n = len(row["ends"])
                cols = [pa.array(c, pa.int64()) for c in out]
                cols += [pa.array([row[k]] * n, pa.int32()) for k in ("shard", "block")]
                cols += [pa.array([ids[a:z].astype("i4") for a, z in zip(starts, ends)], pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(cols, names=[k for k, _ in fields])

    docs = blocks.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in fields))
    joined = docs.withColumnRenamed("start", "inner").join(starts, ["shard", "block"])
    return joined.select("doc_id", (F.col("inner") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer_path: str, vocabulary: int, end_id: int = 0) -> DataFrame:
    """Write the ids of ``docs`` to a new place in the shared folder and read them back."""
    spark = docs.sparkSession
    path = place(spark, "ids")
    write_ids(docs, path, tokenizer_path, vocabulary, end_id)
    return read_ids(spark, path)
