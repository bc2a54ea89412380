"""Substring dedup by relative Lempel-Ziv parsing against blocks of earlier documents.

Every document is parsed into reference blocks that its content alone cuts: each window of
``window`` words picks its least ``gram``-word hash (the last one on a tie) as anchor, and the
windows of one anchor form a block. Equal windows therefore lie in blocks with equal anchor, at
the same place beside it, in whatever document they stand.

1. Blocks are indexed by (anchor hash, content hash) with the smallest doc_id that holds each and
   the place where it stands there. A block that an earlier document holds whole is matched whole.
2. Where a factor ends, a block matches no earlier one whole, but windows in it still may. Only
   for anchors that other blocks share too, one representative of each distinct block is read
   again and its windows are looked up one by one.
3. Each document is then factored greedily (``parse``): from where it stands, the match that
   reaches furthest is taken, extended as long as the next match goes on in the same reference
   document at the same distance. Where no match covers the place, the parse moves on to the next.
   Factors have ``window`` words at least; their words are the duplicate spans.

The matches hold a window exactly if its word sequence starts in a document of smaller doc_id.
Content hashes are taken over the words' bytes. Groups of copies meet as counts and minima, never
as lists or pairs.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mix64, sliced, small_enough

WINDOW, GRAM = 50, 25
BROADCAST_IDS = 1_000_000  # doc_ids; 8 MB

_BASE, _GRAM_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers
_POSITION = 22  # low bits of a key that hold a place; longer texts are parsed in parts
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = (out[0], out[1])
    return _powers[base]


class Parsed:
    """A text's words: joined by one space, where each starts and ends, and their hashes."""

    def __init__(self, text: str | None):
        words = text.encode().split() if text else []
        self.n = len(words)
        self.joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=self.n)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def hashes(self) -> np.ndarray:
        raw = np.frombuffer(self.joined, np.uint8).astype(np.uint64) + np.uint64(1)
        up, down = powers(_BASE, len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw * up[: len(raw)], out=total[1:])
        return mix64((total[self.ends] - total[self.starts]) * down[self.starts])

    def blocks(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor hash, first and last window start of each block, in order."""
        if self.n < window:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        h = self.hashes()
        up, down = powers(_GRAM_BASE, self.n + 1)
        total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(h * up[: self.n], out=total[1:])
        grams = mix64((total[gram:] - total[: self.n - gram + 1]) * down[: self.n - gram + 1])
        step = (1 << _POSITION) - window
        anchors = []
        for a in range(0, self.n - window + 1, step):  # one part, but for texts of millions of words
            part = grams[a : a + step + window - gram]
            low = np.uint64((1 << _POSITION) - 1)
            key = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))  # of equal hashes the last is least
            width, want = 1, window - gram + 1
            while width * 2 <= want:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            if width < want:
                key = np.minimum(key[: len(key) - (want - width)], key[want - width :])
            anchors.append((low - (key & low)).astype(np.int64)[:step] + a)
        anchor = np.concatenate(anchors)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
        return grams[anchor[first]], first, last

    def digest(self, first: int, end: int) -> int:
        """64 bits of the content of words first to end - 1."""
        piece = self.joined[self.starts[first] : self.ends[end - 1]]
        return int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)


def _key(text: str | None) -> int:
    """Tells apart texts that share a doc_id."""
    return zlib.crc32(text.encode()) - (1 << 31) if text else 0


def index_blocks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, content, doc_id, text_key, los, his: the distinct blocks of each document and where
    they stand in it (first and last window start)."""
    schema = "anchor long, content long, doc_id long, text_key int, los array<int>, his array<int>"

    def run(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in sliced(batches):
            cols = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = Parsed(text)
                anchors, lo, hi = p.blocks(window, gram)
                if not len(lo):
                    continue
                key, seen = _key(text), {}
                for a, f, z in zip(anchors.view(np.int64).tolist(), lo.tolist(), hi.tolist()):
                    at = seen.setdefault((a, p.digest(f, z + window)), ([], []))
                    at[0].append(f)
                    at[1].append(z)
                for (a, c), (f, z) in seen.items():
                    for col, v in zip(cols, (a, c, doc, key, f, z)):
                        col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _narrow(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Only the documents in ``ids``, before their texts are shuffled, if a broadcast of the ids is small enough."""
    return docs.join(F.broadcast(ids), "doc_id", "left_semi") if small_enough(ids, BROADCAST_IDS) else docs


def window_matches(docs: DataFrame, reps: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, lo, hi, ref, at of the single windows of ``reps`` that an earlier document holds too."""
    lists = reps.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "lo", "hi")).alias("blocks"))
    lists = cut(lists)
    texts = _narrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lists.select("doc_id").distinct())
    asked = texts.join(lists, "doc_id").select("doc_id", "text_key", "text", "blocks")
    schema = "anchor long, content long, doc_id long, text_key int, lo int"

    def run(batches):
        for batch in sliced(batches):
            cols = [[] for _ in range(5)]
            for row in batch.to_pylist():
                if _key(row["text"]) != row["text_key"]:
                    continue
                p = Parsed(row["text"])
                seen = set()
                for b in row["blocks"]:
                    for s in range(b["lo"], b["hi"] + 1):
                        c = p.digest(s, s + window)
                        if (b["anchor"], c) not in seen:
                            seen.add((b["anchor"], c))
                            for col, v in zip(cols, (b["anchor"], c, row["doc_id"], row["text_key"], s)):
                                col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    windows = cut(asked.mapInArrow(run, schema))
    first = windows.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "lo")).alias("r"), F.max("doc_id").alias("other")).where(F.col("r.doc_id") < F.col("other"))
    first = first.select("anchor", "content", F.col("r.doc_id").alias("ref"), F.col("r.lo").alias("at"))
    found = windows.join(first, ["anchor", "content"]).where(F.col("doc_id") > F.col("ref"))
    return found.select("doc_id", "text_key", F.col("lo"), F.col("lo").alias("hi"), "ref", "at")


def duplicate_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, lo, hi, ref, at: runs of window starts whose windows document ``ref``, of smaller id, holds too, from place ``at``.

    A window that occurs more than once in its own document stands in the list once for each block
    it lies in, or, found alone, at its first place in a block."""
    blocks = cut(index_blocks(docs, window, gram))
    where = F.struct("doc_id", "text_key", F.element_at("los", 1).alias("lo"), F.element_at("his", 1).alias("hi"))
    index = blocks.groupBy("anchor", "content").agg(F.min(where).alias("rep"), F.max("doc_id").alias("last"))
    index = cut(index)
    shared = index.where(F.col("rep.doc_id") < F.col("last")).select("anchor", "content", F.col("rep.doc_id").alias("ref"), F.col("rep.lo").alias("at"))
    whole = blocks.join(shared, ["anchor", "content"]).where(F.col("doc_id") > F.col("ref"))
    whole = whole.select("doc_id", "text_key", F.inline(F.arrays_zip(F.col("los").alias("lo"), F.col("his").alias("hi"))), "ref", "at")
    several = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("rep.doc_id").alias("least"), F.max("last").alias("most"))
    several = several.where((F.col("n") > 1) & (F.col("least") < F.col("most"))).select("anchor")
    reps = index.join(several, "anchor").select("anchor", "rep.*")
    return whole.unionByName(window_matches(docs, reps, window))


def remove_duplicates(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Add n_words, n_removed, kept_text, kept_sha256 and factors to every row.

    Removed are the words that a window of ``window`` words covers whose word sequence also starts
    in a document of smaller doc_id, judged on the input. ``factors`` lists the factors of the
    parse as (start, end, ref, ref_start) in words; neighbours overlap where windows cross a boundary. A null or
    empty text has no words; texts shorter than a window lose none; a null doc_id is no reference
    and loses none; rows that repeat a doc_id don't count against each other. All rows and columns
    stay; columns with the added names are replaced.
    """
    found = duplicate_windows(docs, window, gram)
    spans = found.groupBy(F.col("doc_id").alias("__fg_id"), F.col("text_key").alias("__fg_key")).agg(F.collect_list(F.struct("lo", "hi", "ref", "at")).alias("__fg_spans"))
    spans = spans.groupBy("__fg_id").agg(F.collect_list(F.struct("__fg_key", "__fg_spans")).alias("__fg_found"))
    docs = docs.drop("n_words", "n_removed", "kept_text", "kept_sha256", "factors")
    names = docs.columns
    at = names.index("text")
    extra = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("factors", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("ref", T.LongType()), T.StructField("ref_start", T.IntegerType())]))),
    ]
    joined = docs.join(spans, docs["doc_id"].cast("long") == F.col("__fg_id"), "left").drop("__fg_id")

    def run(batches):
        for batch in sliced(batches):
            cols = [[] for _ in extra]
            for text, found in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                words = text.encode().split() if text else []
                spans = []
                if found:
                    key = _key(text)
                    spans = next((f["__fg_spans"] for f in found if f["__fg_key"] == key), [])
                kept, factors = words, []
                if spans:
                    factors = parse(_everywhere(text, spans, window), window)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [f["start"] for f in factors], 1)
                    np.add.at(edge, [f["end"] for f in factors], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                text = b" ".join(kept)
                for col, v in zip(cols, (len(words), len(words) - len(kept), text.decode(), hashlib.sha256(text).hexdigest(), factors)):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref", pa.int64()), ("ref_start", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[*names, *[f.name for f in extra]])

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def parse(matches: list[dict], window: int) -> list[dict]:
    """Greedy factors (start, end, ref, ref_start) of a document's matches (lo, hi, ref, at).

    A match is extended by those that go on in the same reference at the same distance and leave
    no word between; of the extended matches that cover the end of the last factor, or else of
    those that begin next, the one that reaches furthest is the next factor. Every word that a
    match covers is in a factor."""
    extended: list[tuple[int, int, int, int]] = []  # start, end, ref, ref_start
    last = None
    for m in sorted(matches, key=lambda m: (m["ref"], m["at"] - m["lo"], m["lo"])):
        end = m["hi"] + window
        if last == (m["ref"], m["at"] - m["lo"]) and m["lo"] <= extended[-1][1]:
            start, reached, ref, at = extended[-1]
            extended[-1] = (start, max(reached, end), ref, at)
        else:
            extended.append((m["lo"], end, m["ref"], m["at"]))
        last = (m["ref"], m["at"] - m["lo"])
    extended.sort()
    factors, k, here = [], 0, 0
    while k < len(extended):
        if extended[k][0] > here:
            here = extended[k][0]
        best = None
        while k < len(extended) and extended[k][0] <= here:
            if extended[k][1] > here and (best is None or extended[k][1] > best[1]):
                best = extended[k]
            k += 1
        if best is not None:
            factors.append(dict(zip(("start", "end", "ref", "ref_start"), best)))
            here = best[1]
    return factors


def _everywhere(text: str, spans: list[dict], window: int) -> list[dict]:
    """Spans with the other places of single windows: a window found once is a duplicate wherever
    its text has it."""
    single = [s for s in spans if s["lo"] == s["hi"]]
    if not single:
        return spans
    p = Parsed(text)
    h = p.hashes()
    up, down = powers(_GRAM_BASE, p.n + 1)
    total = np.zeros(p.n + 1, np.uint64)
    np.cumsum(h * up[: p.n], out=total[1:])
    sums = mix64((total[window:] - total[: p.n - window + 1]) * down[: p.n - window + 1])
    wanted = {int(sums[s["lo"]]): s for s in single}
    out = list(spans)
    for s in np.flatnonzero(np.isin(sums, np.array(list(wanted), dtype=np.uint64))).tolist():
        like = wanted[int(sums[s])]
        if s != like["lo"] and p.joined[p.starts[s] : p.ends[s + window - 1]] == p.joined[p.starts[like["lo"]] : p.ends[like["lo"] + window - 1]]:
            out.append({"lo": s, "hi": s, "ref": like["ref"], "at": like["at"]})
    return out
