"""Vector search: exact top-k by tiled matrix products, and nearest neighbours by cross-polytope hashing.

Shared rules. Rows whose vector is null, empty or holds a null or non-finite component, or whose
id is null, take no part. A repeated id is one row: the smallest of its vectors counts. Vectors of
different length are never compared. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD = 8192  # candidates in a tile
TILE = 4096  # queries in a tile
STRIPE = 512  # queries of a tile whose scores are held at once
COLUMNS = 1024  # candidates whose sums of limbs are held at once
FAN_IN = 16  # lists merged at once in the tree
PAIRS = 1 << 16  # pairs of a query and a candidate whose vectors are held at once
CHUNK = 4096  # candidates in a part of a cell
SAMPLE = 64  # queries, of each length of vectors, whose true neighbours set the number of probes
WANTED = 0.96  # share of these neighbours that the probes must meet
ASK = 8  # asking for one more bucket costs as much as comparing so many rows
BUCKETS = 1 << 28  # of one table
HELD = 1 << 21  # sums of what buckets lack that are held at once while queries are hashed
HEADS = 1 << 14  # sums of what the first rotations lack, sorted
LOUD = 1.25  # rows longer than this many times the 90th percentile of all lengths are searched whole


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) and dim of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    return kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def _integers(m: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of every component: doubles, which hold such integers as they are, or, if one
    is beyond 64 bits, Python integers, also where scale * x is beyond doubles."""
    with np.errstate(over="ignore"):
        w = np.floor(m * scale)
    giant = np.abs(w) >= 2.0**63
    if not giant.any():
        return w
    out = np.array([[int(x) for x in row] for row in np.where(giant, 0.0, w)], dtype=object).reshape(w.shape)
    for i, j in zip(*np.nonzero(giant)):
        out[i, j] = int(w[i, j]) if np.isfinite(w[i, j]) else math.floor(Fraction(float(m[i, j])) * Fraction(scale))
    return out


def _tile_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of what ``_integers`` gives, exact; beyond 64 bits the nearest number of 64 bits.

    One product of doubles while no partial sum can reach 2**53, else products of limbs; rows with
    a component beyond 64 bits are summed as Python integers."""
    if object in (q.dtype, c.dtype):
        small = [np.array([all(abs(x) < 2**63 for x in row) for row in m], bool) if m.dtype == object else np.ones(len(m), bool) for m in (q, c)]
        whole = [m if m.dtype == object else m.astype(np.int64).astype(object) for m in (q, c)]
        out = np.empty((len(q), len(c)), np.int64)
        out[np.ix_(*small)] = _tile_scores(q[small[0]].astype(np.float64), c[small[1]].astype(np.float64))
        for rows, cols in ((~small[0], np.ones(len(c), bool)), (small[0], ~small[1])):
            sums = whole[0][rows] @ whole[1][cols].T
            out[np.ix_(rows, cols)] = np.array([max(-(2**63), min(2**63 - 1, s)) for s in sums.ravel()], np.int64).reshape(sums.shape)
        return out
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if bound < 2**53:
        return q @ c.T
    return np.concatenate([_limb_scores(q, c[at : at + COLUMNS]) for at in range(0, len(c), COLUMNS)], axis=1)


def _limb_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of integers of 64 bits: each is cut into limbs so narrow that a product of
    limbs, summed over all dimensions, stays below 2**53; carries then go from sum to sum."""
    bits = (53 - q.shape[1].bit_length()) // 2
    n, mask = math.ceil(64 / bits), (1 << bits) - 1

    def limbs(m: np.ndarray) -> list[np.ndarray]:
        whole = m.astype(np.int64)
        return [((whole >> (bits * i)) & mask if i < n - 1 else whole >> (bits * i)).astype(np.float64) for i in range(n)]

    ql, cl = limbs(q), limbs(c)
    sums = [sum((ql[i] @ cl[s - i].T).astype(np.int64) for i in range(max(0, s - n + 1), min(s, n - 1) + 1)) for s in range(2 * n - 1)]
    for s in range(2 * n - 2):
        sums[s + 1] += sums[s] >> bits
        sums[s] &= mask
    low = np.zeros(sums[0].shape, np.uint64)  # the sum modulo 2**64
    for s, part in enumerate(sums):
        if s * bits < 64:
            low += part.astype(np.uint64) << np.uint64(s * bits)
    low = low.view(np.int64)
    # what is above 63 bits is all zeros, or all ones below zero, if the sum fits
    at, cut_off = divmod(63, bits)
    top = sums[-1]
    over = (top != 0) & (top != -1)
    sign = np.where(top < 0, mask, 0)
    for part in sums[at + 1 : -1]:
        over |= part != sign
    over |= (sums[at] >> cut_off) != (sign >> cut_off)
    low[over] = np.where(top[over] < 0, -(2**63), 2**63 - 1)
    return low


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row; columns stand in order of id, and ties go to the first."""
    down = ~scores if scores.dtype == np.int64 else -scores
    if scores.shape[1] <= k:
        return np.argsort(down, axis=1, kind="stable")
    # at least the k-th value everywhere; ties at that value are kept until the stable sort
    least = np.partition(down, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(scores), k), dtype=np.int64)
    for r in range(len(scores)):
        near = np.flatnonzero(down[r] <= least[r])
        out[r] = near[np.argsort(down[r, near], kind="stable")[:k]]
    return out


def _merge(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """The k candidates of highest integer inner product for each row whose id is divisible by ``every``.

    Components become floor(scale * x), integers of any size, and scores are exact. Queries, as many as there are, are
    dealt into tiles and candidates into shards, both of bounded size by a hash of the id; each
    (tile, shard) pair is one matrix product, in stripes of queries, with partial selection, and
    per-query lists are merged in a tree of fan-in 16. Ties go to the smaller vec_id; a query is no
    candidate of itself; fewer than k candidates give all. A score beyond 64 bits is given as the
    nearest number of 64 bits.
    """
    rows = usable(vectors)
    asked = F.col("vec_id") % every == 0
    n, n_asked = rows.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    shards, tiles = max(1, math.ceil(n / shard)), max(1, math.ceil(n_asked / tile))
    here = lambda parts, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts)).cast("int")
    candidates = rows.select(F.col("vec_id").alias("cand_id"), F.col("dim").alias("c_dim"), F.col("embedding").alias("c"), here(shards, 1).alias("c_shard")).withColumn("c_tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    queries = rows.where(asked).select("vec_id", "dim", F.col("embedding").alias("v"), here(tiles, 2).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def tile_best(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "shard": [], "vec_id": [], "score": []}).astype("int64")]
        if len(q) and len(c):
            c = c.sort_values("cand_id")
            ids, qids = c["cand_id"].to_numpy(), q["vec_id"].to_numpy()
            wanted, held = _integers(_matrix(q["v"]), scale), _integers(_matrix(c["c"]), scale)
            for at in range(0, len(qids), STRIPE):
                scores = _tile_scores(wanted[at : at + STRIPE], held)
                cols = _best(scores, k + 1)  # one more, as the query itself may be there
                part = pd.DataFrame({"query_id": np.repeat(qids[at : at + STRIPE], cols.shape[1]), "shard": int(key[1]), "vec_id": ids[cols.ravel()], "score": np.take_along_axis(scores, cols, 1).ravel().astype("int64")})
                out.append(part[part["query_id"] != part["vec_id"]])
        return pd.concat(out)

    keys = ["tile", "shard", "dim"]
    lists = queries.groupBy(*keys).cogroup(candidates.groupBy("c_tile", "c_shard", "c_dim")).applyInPandas(tile_best, "query_id long, shard long, vec_id long, score long")
    while shards > FAN_IN:
        lists = _merge(lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN)), ["query_id", "shard"], k)
        shards = math.ceil(shards / FAN_IN)
    return _merge(lists, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


# ---------------------------------------------------------------- cross-polytope hashing


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, whose length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(len(x), -1, 2, half)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        half *= 2
    return x / math.sqrt(n)


def rotated(unit: np.ndarray, table: int, turn: int, seed: int = 7) -> np.ndarray:
    """Both signs of each coordinate (0 to 2d - 1) after pseudo-rotation ``turn`` of ``table``:
    three rounds of random signs and a Hadamard transform, on d padded to a power of two."""
    d = 1 << max(0, unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), d))
    x[:, : unit.shape[1]] = unit
    rng = np.random.default_rng([seed, table, turn, d])
    for _ in range(3):
        x = _hadamard(x * rng.choice([-1.0, 1.0], size=d))
    return np.concatenate([x, -x], axis=1)


def code(unit: np.ndarray, table: int, turns: int, seed: int = 7) -> np.ndarray:
    """The bucket of each vector: its nearest signed axes after ``turns`` rotations, as one number."""
    out = np.zeros(len(unit), np.int64)
    for t in range(turns):
        both = rotated(unit, table, t, seed)
        out = out * both.shape[1] + both.argmax(axis=1)
    return out


def probed(unit: np.ndarray, table: int, turns: int, probes: int, seed: int = 7) -> np.ndarray:
    """The ``probes`` buckets of each vector (a row each) whose axes are least behind the nearest
    ones, by the sum of the squares of what they lack."""
    codes = lack = None
    for t in range(turns):
        both = rotated(unit, table, t, seed)
        behind = (both.max(axis=1, keepdims=True) - both) ** 2
        axis = np.broadcast_to(np.arange(both.shape[1]), both.shape)
        if codes is not None:
            behind = (lack[:, :, None] + behind[:, None, :]).reshape(len(unit), -1)
            axis = (codes[:, :, None] * both.shape[1] + axis[:, None, :]).reshape(len(unit), -1)
        if behind.shape[1] > probes:
            at = np.argpartition(behind, probes - 1, axis=1)[:, :probes]
            behind, axis = np.take_along_axis(behind, at, 1), np.take_along_axis(axis, at, 1)
        codes, lack = axis, behind
    return codes


def _axes(dim: int) -> int:
    """Signed axes of a rotation: two for each dimension, padded to a power of two."""
    return 2 << max(0, dim - 1).bit_length()


def turns_for(rows: int, dim: int) -> int:
    """The most rotations of one table: its buckets, (2 d) ** turns, are no more than the rows, and
    no more than ``BUCKETS``."""
    return max(1, int(math.log(max(2, min(rows, BUCKETS))) / math.log(_axes(dim)) + 1e-9))


def probes_needed(unit: np.ndarray, who: np.ndarray, codes: np.ndarray, turns: int, seed: int = 7) -> np.ndarray:
    """For each pair of a query (``unit[who]``) and a row (its ``codes``, one a table, of ``turns``
    rotations): how many buckets the query must ask for in every table to meet the row in one.

    That is the least, over the tables, of the place that the row's bucket has in the query's order
    (``probed``). Places are counted without listing the buckets: the sums of what the first
    rotations lack are sorted, and those of the rest are looked up in them."""
    least = np.full(len(who), np.iinfo(np.int64).max)
    for table in range(codes.shape[1]):
        lacks = []
        for t in range(turns):
            both = rotated(unit, table, t, seed)
            lacks.append((both.max(axis=1, keepdims=True) - both) ** 2)
        axes = lacks[0].shape[1]
        own = np.stack([codes[:, table] // axes ** (turns - 1 - t) % axes for t in range(turns)])
        for q in np.unique(who).tolist():
            mine = np.flatnonzero(who == q)
            heads, tails = np.zeros(1), np.zeros(1)
            for lack in lacks:
                if len(heads) * axes <= HEADS:
                    heads = (heads[:, None] + lack[q]).ravel()
                else:
                    tails = (tails[:, None] + lack[q]).ravel()
            heads.sort()
            total = sum(lack[q, own[t, mine]] for t, lack in enumerate(lacks)) + 1e-12  # equal sums come first
            place = np.array([np.searchsorted(heads, s - tails, side="right").sum() for s in total])
            least[mine] = np.minimum(least[mine], place)
    return least


def plan_for(unit: np.ndarray, who: np.ndarray, codes: np.ndarray, rows: int, most: int, seed: int = 7) -> tuple[int, int]:
    """Rotations and probes that meet ``WANTED`` of the pairs of queries and their true neighbours
    with the least work: rows compared, and buckets asked for, each as dear as ``ASK`` rows.

    ``codes`` are of ``most`` rotations; a code of fewer is its leading part."""
    if not len(who):
        return most, 1
    axes, best = _axes(unit.shape[1]), None
    for turns in range(1, most + 1):
        needed = np.sort(probes_needed(unit, who, codes // axes ** (most - turns), turns, seed))
        probes = int(needed[math.ceil(WANTED * len(needed)) - 1])
        work = probes * (rows / axes**turns + ASK)
        if best is None or work < best[0]:
            best = work, turns, probes
    return best[1:]


def _likely(q: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of all pairs that may be among the k best of their query: one sort of whole numbers
    that hold the query and the leading 40 bits of the score, largest first."""
    bits = score.view(np.int64)
    bits = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))  # as numbers in the order of the scores
    key = (q.astype(np.int64) << 40) + ((~bits >> 24) + (1 << 39))
    ordered = np.sort(key)
    of = ordered >> 40
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    last = np.minimum(first + k, np.append(first[1:], len(of))) - 1
    most = np.zeros(int(of[-1]) + 1, np.int64)
    most[of[first]] = ordered[last]
    return np.flatnonzero(key <= most[q])


def _top(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, by query, score and id; an id counts once."""
    order = np.lexsort((ids, -score, q))
    again = np.zeros(len(order), bool)
    again[1:] = (q[order[1:]] == q[order[:-1]]) & (ids[order[1:]] == ids[order[:-1]]) & (score[order[1:]] == score[order[:-1]])
    order = order[~again]
    first = np.flatnonzero(np.append(True, q[order[1:]] != q[order[:-1]])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


_LISTS = "query_id long, vec_ids array<long>, scores array<double>"


def _listed(q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.Table:
    """One row a query of what ``_top`` gives."""
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    edges = pa.array(np.append(first, len(q)), pa.int32())
    return pa.table({"query_id": pa.array(q[first], pa.int64()), "vec_ids": pa.ListArray.from_arrays(edges, pa.array(ids, pa.int64())), "scores": pa.ListArray.from_arrays(edges, pa.array(score, pa.float64()))})


def _rerank(k: int):
    """Of one cell: the exact products of each query with the candidates whose bucket it asks for,
    and the best k of each query."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        none = np.empty(0, np.int64)
        if not q.num_rows or not c.num_rows:
            return _listed(none, none, np.empty(0))
        vectors = lambda t: np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(t.num_rows, -1)
        lists = c.column("ids").combine_chunks()
        held, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        starts = starts - starts[0]
        last = c.column("last").to_numpy()
        order = np.argsort(last, kind="stable")
        vc, vq, qids = vectors(c), vectors(q), q.column("vec_id").to_numpy()
        asked = q.column("lasts").combine_chunks()
        who = np.repeat(np.arange(len(qids)), np.diff(asked.offsets.to_numpy()))
        ask = asked.flatten().to_numpy()
        begin, end = np.searchsorted(last[order], ask), np.searchsorted(last[order], ask, side="right")
        n = np.where(ask < 0, len(last), end - begin)  # -1 asks for the whole cell
        begin = np.where(ask < 0, 0, begin)
        best_q, best_c, best_s = [none], [none], [np.empty(0)]
        for a, z in _shares(n, PAIRS):
            m = n[a:z]
            qs = np.repeat(who[a:z], m)
            cs = order[np.repeat(begin[a:z] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))]
            score = np.concatenate([np.einsum("ij,ij->i", vq[qs[x : x + PAIRS]], vc[cs[x : x + PAIRS]]) for x in range(0, len(qs), PAIRS)]) if len(qs) else np.empty(0)
            if len(qs):
                top = _likely(qs, score, k + 1)  # one more, as the query itself may be alone in its vector
                for kept, v in zip((best_q, best_c, best_s), (qs[top], cs[top], score[top])):
                    kept.append(v)
        qs, cs, score = map(np.concatenate, (best_q, best_c, best_s))
        m = np.diff(starts)[cs]
        ids = held[np.repeat(starts[cs] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))]
        qs, score = qids[np.repeat(qs, m)], np.repeat(score, m)
        other = qs != ids
        qs, ids, score = qs[other], ids[other], score[other]
        top = _top(qs, ids, score, k)
        return _listed(qs[top], ids[top], score[top])

    return run


def _shares(n: np.ndarray, size: int):
    """Ranges of ``n`` whose sums are about ``size``."""
    part = (np.cumsum(n) - n) // size if len(n) else n
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(n) else n
    return zip(edges.tolist(), [*edges[1:].tolist(), len(n)])


def _merged(lists: DataFrame, k: int, bins: int) -> DataFrame:
    """query_id, rank, vec_id, score of the best k over all lists of a query."""

    def run(t: pa.Table) -> pa.Table:
        ids, scores = t.column("vec_ids").combine_chunks(), t.column("scores").combine_chunks()
        q = np.repeat(t.column("query_id").to_numpy(), np.diff(ids.offsets.to_numpy()))
        ids, scores = ids.flatten().to_numpy(), scores.flatten().to_numpy()
        top = _top(q, ids, scores, k)
        q = q[top]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) + 1
        return pa.table({"query_id": q, "rank": pa.array(rank, pa.int32()), "vec_id": ids[top], "score": scores[top]})

    return lists.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(bins)).alias("bin")).applyInArrow(run, "query_id long, rank int, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, tables: int = 10, chunk: int = CHUNK, seed: int = 7) -> DataFrame:
    """The k nearest (largest inner product) found for each row whose id is divisible by ``every``.

    Every row is indexed: in each of ``tables`` tables one or more pseudo-rotations, more as the
    table grows, assign its unit vector to their nearest signed axes, and these axes together are
    its bucket. How many rotations and how many buckets a query asks for is measured (``_plans``):
    ``SAMPLE`` queries are first compared with every row, and the least work that meets ``WANTED`` of
    their neighbours is taken, so recall holds at any number of rows and for any shape of the data.
    A query asks for the buckets nearest to it and is compared with their rows alone, in double precision on the original vectors, ties to the smaller
    id; the query itself is no candidate. Buckets that agree in all axes but the last share a cell;
    a large cell is dealt out in chunks, so one that holds a third of all rows is many tasks.

    The hash looks at direction alone, so rows much longer than others (``LOUD`` times the 90th
    percentile: a tenth of all rows at most), which win at any angle, are compared with every query,
    in chunks. A query for which fewer than k are found is compared with all rows, in chunks. Equal
    vectors are indexed once, with the k + 1 smallest ids that hold them: by the tie rule no other
    can be in a result. Zero vectors take no part.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).where(F.exists("embedding", lambda x: x != 0)).withColumn("h", F.xxhash64("embedding"))
    n = vectors.count()  # of all rows: only the number of buckets depends on it
    # equal vectors: numbered within the vector, two steps, so that a very common one is no single group
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    some = Window.partitionBy("h", "embedding", part).orderBy("vec_id")
    first = rows.withColumn("n", F.row_number().over(some)).where(F.col("n") <= k + 1)
    holders = first.groupBy("h", "embedding", "dim").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))

    def signed(batches):
        for batch in batches:
            ids, embedding, dims = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            ends, flat = embedding.offsets.to_numpy(), embedding.values.to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                v = flat[ends[at][:, None] + np.arange(d)]
                unit = v / np.abs(v).max(axis=1, keepdims=True)
                size = np.linalg.norm(unit, axis=1, keepdims=True)
                turns = turns_for(n, d)
                codes = np.stack([code(unit / size, t, turns, seed) for t in range(tables)], axis=1)
                length = size[:, 0] * np.abs(v).max(axis=1)
                cols = [ids.take(pa.array(at)), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(np.full(len(at), d), pa.int32()), pa.array(length), pa.array(list(codes), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["ids", "vector", "dim", "length", "codes"])

    index = cut(holders.select("ids", "embedding", "dim").mapInArrow(signed, "ids array<long>, vector binary, dim int, length double, codes array<long>"))
    # one number for each length of vectors
    usual = {r["dim"]: r["p"] * LOUD for r in index.groupBy("dim").agg(F.percentile_approx("length", 0.9, 1000).alias("p")).collect()}
    if not usual:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in usual.items() for x in kv]), F.col("dim"))
    quiet = index.where(F.col("length") <= limit)
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding", "dim")
    plans = _plans(queries, quiet, n, k, seed)
    per_dim = lambda value: F.element_at(F.create_map(*[F.lit(x) for d in usual for x in (d, value(d))]), F.col("dim"))
    axes = per_dim(_axes)
    spare = per_dim(lambda d: _axes(d) ** (turns_for(n, d) - plans[d][0]) if d in plans else 1)  # the last rotations, if left out
    in_table = quiet.select("ids", "vector", "dim", F.posexplode("codes").alias("tab", "code")).withColumn("code", F.floor(F.col("code") / spare))
    in_table = in_table.select("ids", "vector", "dim", "tab", F.floor(F.col("code") / axes).alias("cell"), (F.col("code") % axes).cast("int").alias("last"))
    cell = ["dim", "tab", "cell"]
    parts = in_table.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    loud = index.where(F.col("length") > limit)
    whole_parts = math.ceil(loud.count() / chunk)
    own_chunk = lambda parts: F.pmod(F.xxhash64(F.element_at("ids", 1)), parts).cast("int")
    held = in_table.join(parts, cell).select(*cell, own_chunk(F.col("parts")).alias("chunk"), "ids", "vector", "last")

    def asking(batches):
        for batch in batches:
            ids, embedding, dims = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            ends, flat = embedding.offsets.to_numpy(), embedding.values.to_numpy()
            for d in np.unique(dims).tolist():
                (turns, probes), every_at = plans[d], np.flatnonzero(dims == d)
                wide = _axes(d)
                step = max(1, min(64, HELD // (probes * wide)))
                for k0 in range(0, len(every_at), step):
                    at = every_at[k0 : k0 + step]
                    v = flat[ends[at][:, None] + np.arange(d)]
                    unit = v / np.abs(v).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    vectors_ = pa.array([x.tobytes() for x in v], pa.binary())
                    for t in range(tables):
                        found = np.sort(probed(unit, t, turns, probes, seed), axis=1)
                        who, codes = np.repeat(np.arange(len(at)), found.shape[1]), found.ravel()
                        cells = codes // wide
                        new = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]) | (who[1:] != who[:-1])))
                        lasts = pa.ListArray.from_arrays(pa.array(np.append(new, len(codes)), pa.int32()), pa.array(codes % wide, pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at][who[new]]), vectors_.take(pa.array(who[new])), pa.array(np.full(len(new), d), pa.int32()), pa.array(np.full(len(new), t), pa.int32()), pa.array(cells[new]), lasts], names=["vec_id", "vector", "dim", "tab", "cell", "lasts"])

    asked = queries.mapInArrow(asking, "vec_id long, vector binary, dim int, tab int, cell long, lasts array<int>")
    asked = asked.join(parts, cell).select(*cell, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), "vec_id", "vector", "lasts")
    keys = [*cell, "chunk"]
    lists = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_rerank(k), _LISTS)

    def in_whole(who: DataFrame, what: DataFrame, n_parts: int) -> DataFrame:
        """Lists of ``who`` (vec_id, vector, dim) against all rows of ``what``, by tiles and chunks."""
        tiles = max(1, math.ceil(who.count() / TILE))
        every_q = who.select("vec_id", "vector", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int").alias("tab"), F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("chunk"), F.array(F.lit(-1)).alias("lasts"))
        every_c = what.select("ids", "vector", "dim", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tab"), own_chunk(F.lit(n_parts)).alias("chunk"), F.lit(0).alias("last"))
        by = ["dim", "tab", "chunk"]
        return every_q.groupBy(*by).cogroup(every_c.groupBy(*by)).applyInArrow(_rerank(k), _LISTS)

    plain = lambda df: df.mapInArrow(_packed, "vec_id long, vector binary, dim int")
    if whole_parts:
        lists = lists.unionByName(in_whole(plain(queries), loud, whole_parts))
    bins = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(_merged(lists, k, bins))
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = cut(plain(queries.join(enough, "vec_id", "left_anti")))
    if short.isEmpty():
        return found
    again = _merged(in_whole(short, index, math.ceil(index.count() / chunk)), k, bins)
    return found.join(enough, found["query_id"] == enough["vec_id"], "left_semi").unionByName(again)


def _plans(queries: DataFrame, index: DataFrame, n: int, k: int, seed: int) -> dict[int, tuple[int, int]]:
    """Rotations and probes (``plan_for``) for each length of vectors that queries have.

    A sample of ``SAMPLE`` queries a length, by a hash of the id, is compared with every row of
    ``index`` in one pass; each task keeps the k + 1 best of each query, which are merged in two
    steps. Sample and neighbours, bounded by k, come to the driver."""
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id")
    drawn = queries.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= SAMPLE).collect()
    units: dict[int, list] = {}
    names: dict[int, list[int]] = {}
    for row in sorted(drawn, key=lambda r: (r["dim"], r["n"])):
        v = np.array(row["embedding"], np.float64)
        v /= np.abs(v).max()
        units.setdefault(row["dim"], []).append(v / np.linalg.norm(v))
        names.setdefault(row["dim"], []).append(row["vec_id"])
    sample = {d: np.stack(v) for d, v in units.items()}

    def compared(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                if d not in sample:
                    continue
                at = np.flatnonzero(dims == d)
                v = np.frombuffer(b"".join(batch.column(1).take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), d)
                q, c = np.divmod(np.arange(len(sample[d]) * len(at)), len(at))
                score = (sample[d] @ v.T).ravel()
                top = _likely(q, score, k + 1)
                q, c, score = q[top], c[top], score[top]
                ids, codes = batch.column(0).take(pa.array(at[c])).to_pylist(), batch.column(4).take(pa.array(at[c])).to_pylist()
                old = best.get(d, (np.empty(0, np.int64), np.empty(0), [], []))
                q, score, ids, codes = np.append(old[0], q), np.append(old[1], score), old[2] + ids, old[3] + codes
                top = _top(q, np.array([x[0] for x in ids], np.int64), score, k + 1)
                best[d] = q[top], score[top], [ids[x] for x in top], [codes[x] for x in top]
        for d, (q, score, ids, codes) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), d), pa.int32()), pa.array(q, pa.int32()), pa.array(score), pa.array(ids, pa.list_(pa.int64())), pa.array(codes, pa.list_(pa.int64()))], names=["dim", "q", "score", "ids", "codes"])

    kept = index.select("ids", "vector", "dim", "length", "codes").mapInArrow(compared, "dim int, q int, score double, ids array<long>, codes array<long>")
    kept = kept.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(64)))
    for by in (["dim", "q", "part"], ["dim", "q"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("ids")[0])
        kept = kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    pairs: dict[int, list] = {d: [] for d in sample}
    for row in kept.select("dim", "q", "ids", "codes").collect():
        if names[row["dim"]][row["q"]] not in row["ids"]:  # a row that is no other than the query
            pairs[row["dim"]].append((row["q"], row["codes"]))
    out = {}
    for d, found in pairs.items():
        who, codes = np.array([q for q, _ in found], np.int64), np.array([c for _, c in found], np.int64)
        out[d] = plan_for(sample[d], who, codes, n, turns_for(n, d), seed)
    return out


def _packed(batches):
    for batch in batches:
        rows = [np.array(x, np.float64).tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], names=["vec_id", "vector", "dim"])
