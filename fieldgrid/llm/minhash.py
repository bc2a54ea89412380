"""MinHash near-dedup with circulant signatures, banding and exact verification.

Two permutations make the whole signature: one (a hash) places each shingle on a circle of
2**UNIVERSE places, the other (a table) gives each place a value. Coordinate k of a signature is
the least value among the shingles' places shifted by k, so a shingle's contributions to all
coordinates are one contiguous stretch of the table.

1. Documents with equal shingle sets are one class; its smallest doc_id stands for it.
2. Classes that agree on all rows of some band meet in a bucket. Every class is paired with the
   smallest id of all its buckets, and then with the smallest and the largest of each bucket where
   they are not yet in its group; pairs whose signatures can't be near are dropped. The rest tie
   classes into candidate groups. Where a bucket's members are still in several groups, all pairs
   of it across groups are compared by signature, in cells of bounded size, so that no pair of a
   bucket is passed over.
3. Inside a candidate group all classes are compared exactly, on their full shingle sets, in cells
   of bounded size. Groups of more than one chunk are compared chunk by chunk first, and their ties
   are checked; where that leaves several parts, the members of all but the largest part meet all
   members, and each pair of chunks is a task of its own. A cell reports a spanning forest of its
   links between parts, never all pairs.
4. Links make components.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, sliced, small_enough
from .graph import components
from .rlz import powers

SHINGLE = 5
SIMILARITY = 75  # per cent, at least
BANDS, ROWS = 32, 4  # a pair at 0.75 is missed by all bands once in 2e5
NEAR = 0.5  # signatures that agree on less of their coordinates are no candidates: over 5 standard errors below 0.75
UNIVERSE = 22
CELL = 200_000  # shingles in a chunk of a candidate group
CELL_SIGNATURES = 2_048  # signatures in a chunk of a bucket
CELL_ROWS = 16_384  # about so many signatures of small buckets share a task
SIZE_CLASS = 1.34  # sizes of a link are in one class or in adjacent ones: wider than 100 / SIMILARITY
BIN_DOCS = 512
BROADCAST_IDS = 1_000_000

_BASE, _SHINGLE_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_table: dict[int, np.ndarray] = {}


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z count as a-z."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(b" ".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    up, down = powers(_BASE, len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw * up[: len(raw)], out=total[1:])
    h = mix64((total[ends] - total[starts]) * down[starts])
    n = min(SHINGLE, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_SHINGLE_BASE) + h[k : len(h) - n + 1 + k]
    return np.unique(mix64(out + np.uint64(n)))


def signature(places: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: for each k < size, the least table value among places + k."""
    if size not in _table:
        values = np.random.default_rng(20).permutation(1 << UNIVERSE).astype(np.int32)
        _table[size] = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[:size]]), size)
    out = np.full(size, np.iinfo(np.int32).max, np.int32)
    for k in range(0, len(places), 2048):
        np.minimum(out, _table[size][places[k : k + 2048]].min(axis=0), out=out)
    return out


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for an empty set), bands, sig of every row of ``docs``."""

    def run(batches):
        for batch in sliced(batches):
            n, sets, bands, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                if not len(s):
                    for col in (sets, bands, sigs):
                        col.append(None)
                    continue
                sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig = signature((s >> np.uint64(64 - UNIVERSE)).astype(np.int64), BANDS * ROWS)
                keys = np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in sig.reshape(BANDS, ROWS).astype(np.uint64).T:
                    keys = mix64(keys * np.uint64(_SHINGLE_BASE) + r)
                bands.append(keys.view(np.int64))
                sigs.append((sig & 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_hash", "bands", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bands array<long>, sig binary")


def shared_buckets(reps: DataFrame) -> DataFrame:
    """key, id, least, most: the members of buckets of two or more, and the bucket's ends."""
    members = reps.select("id", F.explode("bands").alias("key"))
    ends = members.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    return members.join(ends, "key").select("key", "id", "least", "most")


def _share(equal: np.ndarray) -> np.ndarray:
    """The share of equal coordinates, corrected for the low bytes that agree by chance."""
    return (equal.mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def near_pairs(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs u, v whose sizes and signatures allow a link."""
    side = lambda name: reps.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * SIMILARITY)

    def near(batches):
        size = BANDS * ROWS
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, size) for k in (2, 3))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(_share(a == b) >= NEAR))

    return both.select("u", "v", "sig_u", "sig_v").mapInArrow(near, "u long, v long").distinct()


def candidate_pairs(reps: DataFrame, buckets: DataFrame) -> DataFrame:
    """u, v: near pairs that make the same groups as every member of a bucket with the bucket's least
    and greatest. The first tie is with the least id of all of a member's buckets; the others are
    for ends that those ties leave in another group, so a group has about one tie a member."""
    hooks = buckets.groupBy("id").agg(F.min("least").alias("u")).where("u < id").select("u", F.col("id").alias("v"))
    first = cut(near_pairs(reps, hooks))
    members = buckets.select("key", "id").join(components(first), "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    node = F.struct("id", "label")
    ends = members.groupBy("key").agg(F.min(node).alias("lo"), F.max(node).alias("hi"), F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
    apart = members.join(ends, "key").select("id", "label", F.explode(F.array("lo", "hi")).alias("end")).where("label <> end.label")
    rest = apart.select(F.least("id", "end.id").alias("u"), F.greatest("id", "end.id").alias("v")).distinct()
    return first.unionByName(near_pairs(reps, rest))


def near_of(n: np.ndarray, sigs: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, over the groups in ``label``, of the pairs of ``left`` and ``right`` (places)
    that sizes and signatures allow; of each pair one at least is ``own``."""
    forest, out = _Forest(len(n)), []
    forest.of = np.unique(label, return_inverse=True)[1]
    for i in left.tolist():
        low, high = np.minimum(n[right], n[i]), np.maximum(n[right], n[i])
        js = right[(forest.of[right] != forest.of[i]) & (low * 100 >= high * SIMILARITY) & (own[right] | own[i])]
        if len(js):
            out += [(i, j) for j in forest.join(i, js[_share(sigs[js] == sigs[i]) >= NEAR])]
    return out


def other_pairs(reps: DataFrame, buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """u, v: ties between members of one bucket that ``groups`` (id, component) hold apart.

    A bucket is split by size class; each part meets its own class and the one below. Parts are
    dealt into chunks, and each pair of chunks is a cell, as in ``verified_links``.
    """
    found = groups.select(F.col("id").alias("g"), "component")
    sizes = reps.select("id", "n").join(found, F.col("id") == F.col("g"), "left").select("id", "n", F.coalesce("component", "id").alias("label"))
    members = buckets.select("key", "id").join(sizes, "id")
    members = members.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_CLASS)).cast("int"))
    parts = cut(members.select("key", "id", "n", "label", "class", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("part")))
    # buckets of the same members do the same work: one of them stands for all
    same = [F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("s"), F.sum(F.col("class") - F.col("part")).alias("lower")]
    apart = parts.groupBy("key", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.col("class") == F.col("part")).alias("owns"), F.count(F.lit(1)).alias("docs"), *same)
    apart = cut(apart.where("lo < hi and owns").groupBy("part", "docs", "x", "s", "lower").agg(F.min("key").alias("key")).select("key", "part", F.ceil(F.col("docs") / CELL_SIGNATURES).cast("int").alias("chunks"), "docs"))
    rows = apart.agg(F.sum("docs")).first()[0] or 0
    bins = max(1, math.ceil(rows / CELL_ROWS))
    dealt = parts.join(apart, ["key", "part"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other"))
    bin_ = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("key", "part"), F.lit(bins))).otherwise(F.xxhash64("key", "part", "a", "b"))
    cells = cells.select(bin_.alias("bin"), "key", "part", "a", "b", "chunk", "id", "n", "label", "class").join(reps.select("id", "sig"), "id")

    def compare(table: pa.Table) -> pa.Table:
        key, part, a, b, chunk, ids, n, label, own = (table.column(c).to_numpy() for c in ("key", "part", "a", "b", "chunk", "id", "n", "label", "class"))
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        order = np.lexsort((ids, b, a, part, key))
        edge = np.zeros(len(order), bool)
        for c in (key, part, a, b):
            edge[1:] |= c[order][1:] != c[order][:-1]
        us, vs = [], []
        for at in np.split(order, np.flatnonzero(edge)):
            if len(at) < 2:
                continue
            left, right = (np.flatnonzero(chunk[at] == x[at[0]]) for x in (a, b))
            for i, j in near_of(n[at], sigs[at], label[at], left, right, own[at] == part[at]):
                us.append(min(ids[at[i]], ids[at[j]]))
                vs.append(max(ids[at[i]], ids[at[j]]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return cells.groupBy("bin").applyInArrow(compare, "u long, v long")


class _Forest:
    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: int, js: np.ndarray) -> list[int]:
        """Unite i with each of js; returns those that were not with it before."""
        new = []
        for j in js.tolist():
            if self.of[i] != self.of[j]:
                new.append(j)
                self.of[self.of == self.of[j]] = self.of[i]
        return new


def links_of(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, over the groups in ``label``, of the links between members of ``left`` and of
    ``right`` (places in sets)."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    flags = np.zeros(codes.max() + 1, np.int32)
    forest, out = _Forest(len(sets)), []
    forest.of = np.unique(label, return_inverse=True)[1]
    for i in left.tolist():
        apart = forest.of[right] != forest.of[i]
        if not apart.any():
            continue
        own = codes[starts[i] : starts[i] + sizes[i]]
        flags[own] = 1
        common = np.add.reduceat(flags[codes], starts)
        flags[own] = 0
        linked = right[apart & (100 * common[right] >= SIMILARITY * (sizes[right] + sizes[i] - common[right]))]
        out += [(i, j) for j in forest.join(i, linked)]
    return out


def _compared(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v: a spanning forest, over the groups in ``label``, of the exact links between the left and the right of each cell.

    ``cells`` has bin, cell (a struct), id, label, left, right; the cells of one bin share a task."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        us, vs = [], []
        for _, cell in pdf.groupby(["group", "a", "b"], sort=False):
            ids, label, left, right = (cell[c].to_numpy() for c in ("id", "label", "left", "right"))
            sets = [shingles(t) for t in cell["text"]]
            order = np.array([k for k in np.argsort(ids, kind="stable").tolist() if len(sets[k])], dtype=np.int64)
            if len(order) < 2:
                continue
            for i, j in links_of([sets[k] for k in order.tolist()], np.flatnonzero(left[order]), np.flatnonzero(right[order]), label[order]):
                us.append(ids[order[i]])
                vs.append(ids[order[j]])
        return pd.DataFrame({"u": np.array(us, dtype=np.int64), "v": np.array(vs, dtype=np.int64)})

    return cells.select("bin", "cell.group", "cell.a", "cell.b", "id", "label", "left", "right").join(texts, "id").groupBy("bin").applyInPandas(compare, "u long, v long")


def verified_ties(texts: DataFrame, sizes: DataFrame, ties: DataFrame) -> DataFrame:
    """u, v: those of the ties that are links. The ties of one u are dealt into cells of bounded size."""
    sized = ties.join(sizes.select(F.col("id").alias("v"), "n"), "v")
    hubs = cut(sized.groupBy("u").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("chunks"), F.count(F.lit(1)).alias("ties")))
    bins = max(1, math.ceil((hubs.agg(F.sum("ties")).first()[0] or 0) / BIN_DOCS))
    chunk = F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int")
    row = lambda id_, left: (F.col(id_).alias("id"), F.col(id_).alias("label"), F.lit(left).alias("left"), F.lit(not left).alias("right"))
    members = ties.join(hubs, "u").select("u", "chunks", chunk.alias("chunk"), *row("v", False))
    centres = hubs.select("u", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), *row("u", True))
    bin_ = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("u"), F.lit(bins))).otherwise(F.xxhash64("u", "chunk"))
    cells = members.unionByName(centres).withColumn("bin", bin_).withColumn("cell", F.struct(F.col("u").alias("group"), F.lit(0).alias("a"), F.col("chunk").alias("b")))
    return _compared(cells, texts)


def other_links(texts: DataFrame, sizes: DataFrame, groups: DataFrame, linked: DataFrame) -> DataFrame:
    """u, v: links inside the candidate groups (id, component) between the parts that ``linked`` leaves.

    Of two parts one at least is not the group's largest: the members of all but the largest meet
    every member of the group, chunk by chunk. Groups of one part have no cells."""
    parts = groups.join(linked.select("id", F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id")).join(sizes, "id")
    totals = parts.groupBy("component", "label").agg(F.sum("n").alias("total"))
    whole = totals.groupBy("component").agg(F.max(F.struct("total", "label")).alias("largest"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    chunks = lambda n: F.ceil(n / CELL).cast("int")
    whole = whole.select("component", F.col("largest.label").alias("most"), chunks(F.col("total") - F.col("largest.total")).alias("strays"), chunks(F.col("largest.total")).alias("rest"))
    stray = F.col("label") != F.col("most")
    chunk = F.when(stray, F.pmod(F.xxhash64("id"), "strays")).otherwise(F.col("strays") + F.pmod(F.xxhash64("id"), "rest")).cast("int")
    others = F.sequence(F.lit(0), F.col("strays") - 1 + F.when(stray, F.col("rest")).otherwise(0))
    cells = parts.join(whole, "component").select("id", "component", "label", chunk.alias("chunk"), F.explode(others).alias("other"))
    cells = cut(cells.withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other")))
    sides = (F.col("chunk") == F.col("a")).alias("left"), (F.col("chunk") == F.col("b")).alias("right")
    return _compared(cells.select(F.xxhash64("component", "a", "b").alias("bin"), F.struct(F.col("component").alias("group"), "a", "b").alias("cell"), "id", "label", *sides), texts)


def verified_links(docs: DataFrame, reps: DataFrame, ties: DataFrame, groups: DataFrame) -> DataFrame:
    """u, v: a spanning set of the exact links inside the candidate groups (id, component)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    ids = groups.select("id")
    if small_enough(ids, BROADCAST_IDS):
        ids = F.broadcast(ids)
    texts = cut(texts.join(ids, "id", "left_semi"))
    sizes = reps.groupBy("id").agg(F.sum("n").alias("n"))
    sized = groups.join(sizes, "id")
    totals = sized.groupBy("component").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("chunks"))
    dealt = cut(sized.join(totals, "component").select("id", "component", "chunks", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk")))
    bins = max(1, math.ceil(dealt.count() / BIN_DOCS))
    # groups of one chunk share tasks, a chunk of a larger group is a task's own
    bin_ = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.xxhash64("component", "chunk"))
    cell = F.struct(F.col("component").alias("group"), F.col("chunk").alias("a"), F.col("chunk").alias("b"))
    inside = cut(_compared(dealt.select(bin_.alias("bin"), cell.alias("cell"), "id", F.col("id").alias("label"), F.lit(True).alias("left"), F.lit(True).alias("right")), texts))
    large = dealt.where("chunks > 1").select("id", "component")
    if large.isEmpty():
        return inside
    within = lambda pairs: pairs.join(large.select(F.col("id").alias("u")), "u", "left_semi").select("u", "v")
    tied = cut(verified_ties(texts, sizes, within(ties)))
    return inside.unionByName(tied).unionByName(other_links(texts, sizes, large, components(within(inside).unionByName(tied))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a set holds the distinct five-word
    shingles, or the whole sequence if it is shorter. Texts without words are linked with nothing
    and kept. A null doc_id is linked with nothing and kept, its component_id null. Rows that
    repeat a doc_id are one node of the graph; each has its own n_shingles.
    """
    signed = cut(sign(docs))
    known = signed.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut(known.groupBy("set_hash").agg(F.min("doc_id").alias("rep")))
    # one row for each class; an id that stands for several classes (a repeated id) is one node
    reps = known.join(classes, (known["set_hash"] == classes["set_hash"]) & (known["doc_id"] == classes["rep"]))
    reps = cut(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "sig").distinct())
    buckets = cut(shared_buckets(reps))
    pairs = cut(candidate_pairs(reps, buckets))
    groups = components(pairs)
    others = cut(other_pairs(reps, buckets, groups))
    if not others.isEmpty():
        pairs = pairs.unionByName(others)
        groups = components(pairs)
    links = cut(verified_links(docs, reps, pairs, groups))
    # rows of one class are linked through its representative; a repeated id ties its classes
    several = known.select("doc_id", "set_hash").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("doc_id")
    tied = known.join(several, "doc_id", "left_semi").select("doc_id", "set_hash").distinct().join(classes, "set_hash").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v")
    found = components(links.unionByName(tied))
    part = classes.join(found, F.col("rep") == F.col("id"), "left").select("set_hash", F.least("rep", F.coalesce("component", "rep")).alias("of_class"))
    out = signed.select("doc_id", "n_shingles", "set_hash").join(part, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
