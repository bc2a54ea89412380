"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled documents is the index, with every term that three of them share:
words and word beginnings. A term's weight is its IDF, raised by how far the labels of the sample
are tied to it (chi-square), so that examples are near for what matters. A term of fewer than
``LEAST_DOCS`` examples has no weight: a copy of an example has cosine 1 only if some of its terms
are held by more, and a text without such terms has no neighbours.

Every document is a query. Terms that many examples hold are one matrix product for a batch of
documents; the others are postings, by blocks of examples. Blocks are visited in order of their
upper bound (the largest score so far in the block plus, over the query's other terms, query
weight times the block's largest weight) until no unvisited block can reach the k-th best, so the
top k is exact. The neighbours of both labels vote by cosine, and a logistic curve, fitted on the
examples, each left out of its own neighbours, turns the share of the vote into a probability.
"""

from __future__ import annotations

import math
import pickle
import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, sliced, with_fold

#: The bound of the labelled sample, and with it of the index: so many documents of label 1 and of label 0.
TOXIC_DOCS, CLEAN_DOCS = 1_500, 4_500
NEIGHBOURS = 15
BLOCK = 2048  # examples in a block
PREFIX = 5  # characters of a word's beginning, a term of its own for longer words
LEAST_DOCS = 3  # a term of fewer examples is left out
COMMON = 1 / 8  # terms in more than this share of the examples are columns of a matrix
CHANCE = 15.0  # chi-square that chance alone reaches once in 10,000 terms: only what exceeds it raises a weight


def terms(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of a column of texts: lower-cased words (runs of letters) and, marked by
    a hyphen, their beginnings; and, by text and term, each text's place, term and count."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), r"[^\pL]+")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    number = {w: i for i, w in enumerate(words)}
    begins = np.array([number.setdefault(w[:PREFIX] + "-", len(number)) if len(w) > PREFIX else -1 for w in words], np.int64)
    word = coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    some, longer = word != number.get("", -1), begins[word] >= 0 if len(word) else np.empty(0, bool)
    size = max(1, len(number))
    pairs, n = np.unique(np.concatenate([text[some] * size + word[some], text[longer] * size + begins[word[longer]]]), return_counts=True)
    return list(number), pairs // size, pairs % size, n


class Index:
    """Opened from what ``build`` packs: postings as counts, from which weights are computed again."""

    def __init__(self, packed: bytes):
        p = pickle.loads(zlib.decompress(packed))
        self.vocabulary: dict[str, int] = {w: i for i, w in enumerate(p["terms"])}
        self.weight: np.ndarray = p["weight"]  # of each term: IDF and tie to the labels
        self.ids, self.labels = p["ids"], p["labels"]  # doc_id and label of each example
        size, blocks = len(self.weight), len(p["sizes"])
        often = p["often"]  # terms that are rows of ``columns``: common terms x examples
        self.common = np.full(size, -1, np.int64)
        self.common[often] = np.arange(len(often))
        logs = 1 + np.log(np.maximum(p["columns"], 1).astype(float))
        self.columns = np.where(p["columns"] > 0, logs * self.weight[often][:, None] / p["norm"], 0.0)
        n = p["sizes"].astype(np.int32).ravel()
        ends = np.cumsum(n)
        #: [t, b]: first posting of term t in block b, and how many there are
        self.first = np.ascontiguousarray((ends - n).reshape(blocks, size).T).astype(np.int32)
        self.many = np.ascontiguousarray(p["sizes"].T).astype(np.int32)
        self.examples = p["examples"].astype(np.int32)  # of each posting, its place in the block
        term, block = np.repeat(np.tile(np.arange(size, dtype=np.int32), blocks), n), np.repeat(np.repeat(np.arange(blocks), size), n)
        self.weights = (1 + np.log(p["counts"].astype(float))) * self.weight[term] / p["norm"][block * BLOCK + self.examples]
        #: [t, b]: largest weight of term t in block b
        self.tops = np.zeros(blocks * size)
        if len(term):
            held = np.flatnonzero(n)
            self.tops[held] = np.maximum.reduceat(self.weights, ends[held] - n[held])
        self.tops = np.ascontiguousarray(self.tops.reshape(blocks, size).T)

    def nearest(self, size: int, text: np.ndarray, term: np.ndarray, n: np.ndarray, k: int = NEIGHBOURS, leave_out: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of ``size`` texts the places and cosines of the k nearest examples of positive
        cosine, ties to the earlier place. ``text``, in ascending order, ``term`` (of the index) and
        ``n`` are the counts."""
        q = (1 + np.log(n.astype(float))) * self.weight[term]
        q = q / np.sqrt(np.bincount(text, q * q, size))[text]
        at = self.common[term]
        dense = np.zeros((size, len(self.columns)))
        dense[text[at >= 0], at[at >= 0]] = q[at >= 0]
        scores = dense @ self.columns
        rare = at < 0
        term, q, edges = term[rare], q[rare], np.searchsorted(text[rare], np.arange(size + 1))
        out = []
        for r, (a, z) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
            out.append(self._best(scores[r], term[a:z], q[a:z], k, -1 if leave_out is None else int(leave_out[r])))
        return out

    def _best(self, score: np.ndarray, t: np.ndarray, q: np.ndarray, k: int, leave_out: int) -> tuple[np.ndarray, np.ndarray]:
        places, best = np.empty(0, np.int64), np.empty(0)
        if not len(score):
            return places, best
        firsts = np.arange(0, len(score), BLOCK)
        bounds = np.maximum.reduceat(score, firsts) + q @ self.tops[t]
        first, many = self.first[t], self.many[t]
        for b in np.argsort(-bounds, kind="stable").tolist():
            # a block whose bound just equals the k-th best may hold an equal example of earlier place
            if bounds[b] <= 0 or len(best) == k and bounds[b] < best[-1] - 1e-12:
                break
            here = score[b * BLOCK : (b + 1) * BLOCK]
            held = np.flatnonzero(many[:, b])
            begin, n = first[held, b], many[held, b]
            total = int(n.sum())
            if total:
                at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(total)
                here = here + np.bincount(self.examples[at], self.weights[at] * np.repeat(q[held], n), len(here))
            if 0 <= leave_out - b * BLOCK < len(here):
                here = np.where(np.arange(len(here)) == leave_out - b * BLOCK, 0.0, here)
            least = best[-1] if len(best) == k else 0.0
            if len(here) > k:
                least = max(least, np.partition(here, len(here) - k)[len(here) - k])
            hit = np.flatnonzero((here > 0) & (here >= least - 1e-12))
            places, best = np.concatenate([places, hit + b * BLOCK]), np.concatenate([best, here[hit]])
            order = np.lexsort((places, -best))[:k]
            places, best = places[order], best[order]
        return places, best

    def vote(self, places: np.ndarray, scores: np.ndarray) -> float:
        """The share of label 1 among the neighbours, weighted by cosine; 0 without any."""
        return float(scores @ self.labels[places]) / float(scores.sum()) if len(places) else 0.0


_opened: dict[int, Index] = {}


def opened(packed: bytes) -> Index:
    """The index of a packed one, kept by the worker between tasks."""
    key = zlib.crc32(packed)
    if key not in _opened:
        _opened.clear()
        _opened[key] = Index(packed)
    return _opened[key]


@dataclass(frozen=True)
class Model:
    shared: Broadcast  # the packed index, bounded by the sample
    curve: tuple[float, float]  # of the vote and 1

    def score(self, vote: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * vote + b))))


def sample_of(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_DOCS, clean: int = CLEAN_DOCS) -> DataFrame:
    """doc_id, text, toxic: at most ``toxic`` + ``clean`` rows, chosen by a hash of doc_id.

    A document with several labels has the highest; null labels and ids don't count."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(n)
    chosen = pick(1, toxic).unionByName(pick(0, clean))
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most toxic + clean rows
    return one.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, base_rate: float | None = None) -> Model:
    """Build the index from a bounded sample of labelled documents, calibrated to the labels' own rate.

    What comes to the driver are the terms of the sample and its postings, both as numbers."""

    def read(batches):
        for batch in sliced(batches):
            names, text, term, n = terms(batch.column(1))
            edges = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
            shown = pa.array(names, pa.string()).take(pa.array(term))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(edges, shown), pa.ListArray.from_arrays(edges, pa.array(n, pa.int32()))], names=["doc_id", "toxic", "terms", "counts"])

    counted = cut(sample_of(docs, labels).mapInArrow(read, "doc_id long, toxic int, terms array<string>, counts array<int>"))
    found = counted.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("a"))
    used = found.where(F.col("df") >= LEAST_DOCS).orderBy("term").toPandas()
    vocabulary = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(used["term"])})  # bounded by the sample

    def number(batches):
        for batch in sliced(batches):
            lists = batch.column(2)
            text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            term = np.fromiter(map(vocabulary.value.get, lists.flatten().to_pylist(), repeat(-1)), np.int32, len(text))
            known = term >= 0
            edges = pa.array(np.searchsorted(text[known], np.arange(batch.num_rows + 1)), pa.int32())
            n = batch.column(3).flatten().filter(pa.array(known))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(edges, pa.array(term[known])), pa.ListArray.from_arrays(edges, n)], names=["doc_id", "toxic", "terms", "counts"])

    numbered = cut(counted.mapInArrow(number, "doc_id long, toxic int, terms array<int>, counts array<int>"))
    examples = numbered.orderBy("doc_id").toPandas()
    rate = base_rate if base_rate is not None else labels.where(F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    packed = build(list(used["term"]), used["df"].to_numpy(float), used["a"].to_numpy(float), examples["doc_id"].to_numpy(np.int64), examples["toxic"].to_numpy(float), list(examples["terms"]), list(examples["counts"]))
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    return Model(shared, calibrate(examples["toxic"].to_numpy(float), votes_of(numbered, shared), rate or 0.0))


def build(terms_: list[str], df: np.ndarray, a: np.ndarray, ids: np.ndarray, labels: np.ndarray, terms_of: list[np.ndarray], counts_of: list[np.ndarray]) -> bytes:
    """A packed ``Index``. df: how many examples hold a term, a: how many of label 1; terms and
    counts of each example."""
    n, p, size = len(ids), float(labels.sum()), len(df)
    b, c, d = df - a, p - a, (n - p) - (df - a)
    chi2 = n * (a * d - b * c) ** 2 / np.maximum(df * (n - df) * p * (n - p), 1e-9)
    weight = np.log(1 + n / np.maximum(df, 1)) * (1 + np.sqrt(np.maximum(0.0, chi2 - CHANCE)))
    often = np.flatnonzero(df > COMMON * n)
    row = np.full(size, -1, np.int32)
    row[often] = np.arange(len(often))
    whole = lambda parts, kind: np.concatenate(parts).astype(kind) if len(parts) else np.empty(0, kind)
    term, count = whole(terms_of, np.int32), np.minimum(whole(counts_of, np.int64), 65_535).astype(np.uint16)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in terms_of])
    norm = np.sqrt(np.bincount(owner, ((1 + np.log(count.astype(float))) * weight[term]) ** 2, n)) if n else np.empty(0)
    columns = np.zeros((len(often), n), np.uint16)
    dense = row[term] >= 0
    columns[row[term[dense]], owner[dense]] = count[dense]
    owner, term, count = owner[~dense], term[~dense], count[~dense]
    blocks = -(-n // BLOCK)
    key = (owner // BLOCK).astype(np.int64) * size + term
    order = np.argsort(key, kind="stable")
    sizes = np.bincount(key, minlength=blocks * size).reshape(blocks, size).astype(np.uint16)
    made = {"terms": terms_, "weight": weight, "ids": ids, "labels": labels, "norm": np.maximum(norm, 1e-300), "often": often, "columns": columns, "sizes": sizes, "examples": (owner[order] % BLOCK).astype(np.uint16), "counts": count[order]}
    return zlib.compress(pickle.dumps(made, protocol=5), 1)


def votes_of(numbered: DataFrame, shared: Broadcast) -> np.ndarray:
    """The vote on each example by the others, in the order of the index."""

    def run(batches):
        ix = opened(shared.value)
        for batch in sliced(batches):
            lists = batch.column(2)
            text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            found = ix.nearest(batch.num_rows, text, lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy(), leave_out=np.searchsorted(ix.ids, batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ix.vote(*f) for f in found], pa.float64())], names=["doc_id", "vote"])

    votes = numbered.mapInArrow(run, "doc_id long, vote double").toPandas()  # one row an example
    return votes.sort_values("doc_id")["vote"].to_numpy()


def calibrate(y: np.ndarray, votes: np.ndarray, rate: float) -> tuple[float, float]:
    """A logistic curve from votes to labels ``y``, the examples weighted so that label 1 has the
    labels' own rate; targets are smoothed as Platt proposes."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    if not pos or not neg:
        return 0.0, math.log(rate / (1 - rate))
    weight = np.where(y == 1, rate / pos, (1 - rate) / neg) * len(y)
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, beta = np.column_stack([votes, np.ones(len(votes))]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (target - p)) - 1e-3 * beta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def predict(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """Add score, predicted (1 from ``least``) and evidence (doc_ids of the voting examples, nearest
    first) to every row, from text alone. A null or empty text, or one without any term of the
    index, has no neighbours: its vote is 0. Columns of those names are replaced."""
    docs = docs.drop("score", "predicted", "evidence")
    names = docs.columns
    at = names.index("text")
    extra = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(T.LongType()))]

    def run(batches):
        ix = opened(model.shared.value)
        for batch in sliced(batches):
            names_, text, term, n = terms(batch.column(at))
            known = np.fromiter(map(ix.vocabulary.get, names_, repeat(-1)), np.int64, len(names_))[term]
            found = ix.nearest(batch.num_rows, text[known >= 0], known[known >= 0], n[known >= 0])
            scores, evidence = [model.score(ix.vote(*f)) for f in found], [ix.ids[f[0]].tolist() for f in found]
            cols = [pa.array(scores, pa.float64()), pa.array([int(s >= least) for s in scores], pa.int32()), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*names, *[f.name for f in extra]])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Learn from labels of the folds that aren't held out, score every row: adds held_out, score, predicted, evidence."""
    fold = with_fold(docs.drop("held_out"), folds, "__fg_fold")
    known = with_fold(labels.select("doc_id", "toxic"), folds, "__fg_fold").where(F.col("__fg_fold") != held_out)
    model = train(fold.where(F.col("__fg_fold") != held_out), known)
    return predict(fold.withColumn("held_out", F.col("__fg_fold") == held_out).drop("__fg_fold"), model)
