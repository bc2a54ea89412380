"""LM scoring by a Brown class-based bigram model: P(w | v) from P(class w | class v) * P(w | class w).

Words are lower-cased (A-Z); a document is its words and one end, and the end also stands before its
first word. Counts cover every document of the training folds.

1. All words are counted. The ``core`` most frequent (a parameter, so what follows for them is of
   bounded size) get their classes by exchange: each round takes a word out of its class and puts it
   where the bigram likelihood of classes is greatest, given the counts of all core bigrams. Words
   are dealt into bins; a bin's words move one after another against its own copy of the class
   counts, and the counts of all are taken anew after each round. The best round stays.
2. Every other word of the training documents is placed once, by the same likelihood, from the
   classes of all its neighbours over all documents.
3. Class bigrams are counted over all training documents with all words in their classes.

Smoothing: a transition is mixed with the class's own frequency (``TRUST`` pseudo-counts); words that
training lacks are one type, whose share is that of the words seen once; the result is mixed with the
base unigram (``MODEL_SHARE``). It sums to 1 over the known words and the unknown type.

A bucket is a bounded stretch of one task's documents; its words are numbered within it. Words meet
in bins by a hash of the word, packed, one row a bucket and bin, and their counts and classes go back
to the bucket by its number. So no table of all words is broadcast or collected, and a hot word is
one entry a bucket. The driver holds the core words, their classes and one matrix of classes.

A null text is empty, a null id is in fold 0 and answered as null, repeated rows count and are answered
each. Without training documents every token is unknown. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_fold

END = "\n"  # white space, so never a word
CLASSES = 64
CORE = 1 << 14
ROUNDS = 6
TRUST = 20.0
MODEL_SHARE = 0.95
BUCKET = 900_000  # tokens
AT_ONCE = 2 << 20  # bytes of texts split at once
BIN_BYTES = 16 << 20  # of text for each bin of words
CORE_BINS = 48
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

_raw = lambda x, kind: np.frombuffer(x if isinstance(x, bytes) else x.as_buffer(), kind)


class Bucket:
    """Documents of one bucket: ids, held_out, words of each (n), their numbers one after another
    (tokens), and the distinct words by number. The number of ``END`` is ``end``."""

    def __init__(self, number: int, parts: list[pa.RecordBatch], texts: list[tuple[pa.Array, np.ndarray]]):
        self.number = number
        self.ids = [i for p in parts for i in p.column(0).to_pylist()]
        self.held = np.array([h for p in parts for h in p.column(2).to_pylist()], bool)
        coded = pa.chunked_array([w for w, _ in texts], pa.string()).combine_chunks()
        coded = (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
        self.words, at, n = coded.dictionary, coded.indices.to_numpy(), np.concatenate([n for _, n in texts])
        blank = pc.index(self.words, "").as_py()
        kept = at != blank
        self.tokens, self.n = at[kept].astype(np.int32), np.bincount(np.repeat(np.arange(len(n)), n)[kept], minlength=len(n))
        self.end = len(self.words)

    def train(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of training documents, and of how many words each consists."""
        return self.tokens[np.repeat(~self.held, self.n)], self.n[~self.held]


def stream(tokens: np.ndarray, n: np.ndarray, end: int) -> np.ndarray:
    """The documents' tokens with an end before each and one after the last: all their bigrams are
    neighbours, since what ends one document stands before the next."""
    return np.append(np.insert(tokens, np.append(0, np.cumsum(n))[:-1], end), np.int32(end))


def buckets(batches, most: int):
    """``Bucket``s of a task, of about ``most`` tokens."""
    from pyspark import TaskContext

    number, parts, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for x, y in zip(edges, edges[1:]):
            if x == y:
                continue
            part = batch.slice(x, y - x)
            split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part.column(1), "")))
            parts.append(part)
            texts.append((split.flatten(), np.diff(split.offsets.to_numpy())))
            held += len(texts[-1][0])
            if held >= most:
                full = Bucket(number, parts, texts)
                number, parts, texts, held = number + 1, [], [], 0
                yield full
                del full
                pa.default_memory_pool().release_unused()
    if parts:
        yield Bucket(number, parts, texts)


def _binned(words: pa.Array, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of words by bin, and where each bin begins."""
    of = np.array([zlib.crc32(w) % bins for w in words.cast(pa.binary()).to_pylist()], np.int64)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(bins + 1))


# ---------------------------------------------------------------- all words


def _counted(docs: DataFrame, core: int, bins: int, most: int) -> DataFrame:
    """A row a bin: tokens, distinct words, words seen once, and its ``core`` most frequent words."""

    def count(batches):
        for b in buckets(batches, most):
            tokens, n = b.train()
            words = pa.concat_arrays([b.words, pa.array([END])])
            seen = np.append(np.bincount(tokens, minlength=b.end), len(n))
            some = np.flatnonzero(seen)
            words, seen = words.take(pa.array(some)), seen[some]
            order, edges = _binned(words, bins)
            full = np.flatnonzero(np.diff(edges))
            rows = [order[edges[k] : edges[k + 1]] for k in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)), words.take(pa.array(order))), pa.array([seen[r].astype(np.int64).tobytes() for r in rows], pa.binary())],
                names=["bin", "words", "n"],
            )

    def add(t: pa.Table) -> pa.Table:
        words = t.column("words").combine_chunks().flatten().dictionary_encode()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        n = np.concatenate([_raw(x, np.int64) for x in t.column("n").combine_chunks()])
        c = np.bincount(words.indices.to_numpy(), weights=n, minlength=len(words.dictionary)).astype(np.int64)
        top = pc.sort_indices(pa.table({"c": c, "w": words.dictionary}), sort_keys=[("c", "descending"), ("w", "ascending")])[:core]
        one = lambda a, kind: pa.array([a], pa.list_(kind))
        return pa.table({"n": [int(c.sum())], "v": [len(c)], "once": [int((c == 1).sum())], "words": one(words.dictionary.take(top).to_pylist(), pa.string()), "counts": one(c[top.to_numpy()].tolist(), pa.int64())})

    return docs.mapInArrow(count, "bin int, words array<string>, n binary").groupBy("bin").applyInArrow(add, "n long, v long, once long, words array<string>, counts array<long>")


# ---------------------------------------------------------------- exchange of the core words


def _core_bigrams(docs: DataFrame, core: list[str], most: int) -> DataFrame:
    """A row a bin of core words: bigrams by the first word and by the second, as (own << 16 | other)
    and counts. Word k is in bin k % CORE_BINS."""

    def pairs(batches):
        known = pa.array(core)
        for b in buckets(batches, most):
            tokens, n = b.train()
            to_core = pc.fill_null(pc.index_in(pa.concat_arrays([b.words, pa.array([END])]), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            s = to_core[stream(tokens, n, b.end)] if len(n) else np.empty(0, np.int64)
            first, second = s[:-1], s[1:]
            both = (first >= 0) & (second >= 0)
            key, times = np.unique(first[both] << 16 | second[both], return_counts=True)
            sides = [(key, times)]
            turned = (key & 0xFFFF) << 16 | key >> 16
            order = np.argsort(turned)
            sides.append((turned[order], times[order]))
            cols = []
            for own, n_ in sides:
                of = (own >> 16) % CORE_BINS
                order = np.argsort(of, kind="stable")
                edges = np.searchsorted(of[order], np.arange(CORE_BINS + 1))
                for v, kind in ((own, np.uint32), (n_, np.int64)):
                    v = v[order].astype(kind)
                    cols.append(pa.array([v[edges[k] : edges[k + 1]].tobytes() for k in range(CORE_BINS)], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CORE_BINS, dtype=np.int32)), *cols], names=["bin", *_SIDES])

    def add(t: pa.Table) -> pa.Table:
        out = {"bin": t.column("bin")[:1]}
        for k in (0, 2):
            key, n = (np.concatenate([_raw(x, kind) for x in t.column(_SIDES[k + i]).combine_chunks()]) for i, kind in enumerate((np.uint32, np.int64)))
            known, at = np.unique(key, return_inverse=True)
            out[_SIDES[k]] = pa.array([known.tobytes()], pa.binary())
            out[_SIDES[k + 1]] = pa.array([np.bincount(at, weights=n, minlength=len(known)).astype(np.int64).tobytes()], pa.binary())
        return pa.table(out)

    schema = "bin int, " + ", ".join(f"{c} binary" for c in _SIDES)
    return docs.mapInArrow(pairs, schema).groupBy("bin").applyInArrow(add, schema)


_SIDES = ("next_key", "next_n", "prev_key", "prev_n")


def _matrix_sum(df: DataFrame, run, size: int) -> np.ndarray:
    """Sum of the (at, value) rows that ``run`` makes of batches, at most ``size`` of them a task."""
    out = np.zeros(size)
    for r in df.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def _filled(m: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(m)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(m.ravel()[at].astype(np.float64))], names=["at", "value"])


def class_bigrams(bigrams: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    def run(batches):
        for batch in batches:
            total = np.zeros(classes * classes)
            for key, n in zip(batch.column("next_key"), batch.column("next_n")):
                key = _raw(key, np.uint32)
                total += np.bincount(of[key >> 16].astype(np.int64) * classes + of[key & 0xFFFF], weights=_raw(n, np.int64), minlength=len(total))
            yield _filled(total)

    return _matrix_sum(bigrams, run, classes * classes).reshape(classes, classes)


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def objective(counts: np.ndarray) -> float:
    """What of the log-likelihood of the bigrams depends on the classes."""
    return float(_phi(counts).sum() - _phi(counts.sum(axis=1)).sum() - _phi(counts.sum(axis=0)).sum())


def exchange(own: list[int], nexts: np.ndarray, prevs: np.ndarray, loops: np.ndarray, of: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """New classes of the words ``own``, which move one after another against ``counts`` (a copy).

    ``nexts`` and ``prevs`` count each word's neighbours by class, without itself; ``loops`` those."""
    m, new = counts.copy(), of[own].astype(np.int64)
    for k in range(len(own)):
        after, before, loop, r = nexts[k], prevs[k], loops[k], new[k]
        m[r, :] -= after
        m[:, r] -= before
        m[r, r] -= loop
        rows, cols = m.sum(axis=1) + before, m.sum(axis=0) + after  # its neighbours stay where they are
        gain = (_phi(m + after) - _phi(m)).sum(axis=1) + (_phi(m + before[:, None]) - _phi(m)).sum(axis=0)
        d = np.diagonal(m)  # the cell of the class with itself takes both sides at once
        gain += _phi(d + after + before + loop) + _phi(d) - _phi(d + after) - _phi(d + before)
        gain -= _phi(rows + after.sum() + loop) - _phi(rows) + _phi(cols + before.sum() + loop) - _phi(cols)
        s = int(np.argmax(gain))
        if gain[s] <= gain[r] + 1e-9 * abs(gain[r]):
            s = r
        m[s, :] += after
        m[:, s] += before
        m[s, s] += loop
        new[k] = s
    return new


def core_classes(bigrams: DataFrame, size: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the core words, their class bigrams, and the objective before each round and at the end."""
    of = (np.arange(size) % classes).astype(np.uint8)
    best, best_counts, course = of, class_bigrams(bigrams, of, classes), []
    counts = best_counts
    for turn in range(rounds + 1):
        course.append(objective(counts))
        if course[-1] >= max(course):
            best, best_counts = of, counts
        if turn == rounds or (turn > 1 and course[-1] - course[-2] <= 1e-6 * abs(course[-2])):
            break

        def move(batches, of=of, counts=counts, turn=turn):
            for batch in batches:
                for row in batch.to_pylist():
                    own = np.arange(row["bin"], size, CORE_BINS)
                    if not len(own):
                        continue
                    sides, loops = [], np.zeros(len(own))
                    for k in (0, 2):
                        key, n = _raw(row[_SIDES[k]], np.uint32).astype(np.int64), _raw(row[_SIDES[k + 1]], np.int64)
                        self_ = key >> 16 == (key & 0xFFFF)
                        at = (key >> 16) // CORE_BINS
                        if not k:
                            loops[at[self_]] = n[self_]
                        other = of[key & 0xFFFF].astype(np.int64)
                        sides.append(np.bincount((at * classes + other)[~self_], weights=n[~self_], minlength=len(own) * classes).reshape(-1, classes))
                    new = exchange(own, *sides, loops, of, counts) if turn < 2 or (row["bin"] + turn) % 2 else of[own]
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(new.astype(np.int32))], names=["word", "class"])

        of = of.copy()
        for r in bigrams.mapInArrow(move, "word int, class int").collect():  # at most ``core`` rows
            of[r["word"]] = r["class"]
        counts = class_bigrams(bigrams, of, classes)
    return best, best_counts, course


# ---------------------------------------------------------------- all other words


def _placing(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihoods for each class: of the classes that follow it and stand before it (2 K rows, a
    column a class), of itself, and of one of its words."""
    size = counts.sum(axis=0) + 0.5
    share = size / size.sum()
    t = np.log((counts + TRUST * share) / (counts.sum(axis=1, keepdims=True) + TRUST))
    return np.concatenate([t.T, t]), np.log(share), np.log(size)


def _placed(docs: DataFrame, core: list[str], of: np.ndarray, counts: np.ndarray, bins: int, most: int) -> DataFrame:
    """bucket, numbers, c, class of all words outside the core: c is the count in training (0: unknown)."""
    classes = len(counts)
    by_context, by_class, by_size = _placing(counts)

    def words(batches):
        known = pa.array(core, pa.string())
        for b in buckets(batches, most):
            at = pc.fill_null(pc.index_in(b.words, known), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(core) else np.full(b.end, -1)
            rest = np.flatnonzero(at < 0)
            tokens, n = b.train()
            s = stream(tokens, n, b.end).astype(np.int64) if len(n) else np.empty(0, np.int64)
            kind = np.full(b.end + 1, classes)
            if len(core):
                kind[:-1][at >= 0] = of[at[at >= 0]]
                kind[b.end] = of[core.index(END)]
            k = kind[s]
            rare_first, rare_second = (k[:-1] == classes) & (k[1:] < classes), (k[1:] == classes) & (k[:-1] < classes)
            key = np.concatenate([s[:-1][rare_first] * 2 * classes + k[1:][rare_first], s[1:][rare_second] * 2 * classes + classes + k[:-1][rare_second]])
            key, times = np.unique(key, return_counts=True)
            seen = np.bincount(tokens, minlength=b.end)
            order, edges = _binned(b.words.take(pa.array(rest)), bins)
            order = rest[order]
            place = np.full(b.end + 1, -1)
            place[order] = np.arange(len(order))
            who = place[key // (2 * classes)]
            by = np.argsort(who, kind="stable")
            who, what, times = who[by], (key % (2 * classes))[by], times[by]
            cut_at = np.searchsorted(who, edges)
            full = np.flatnonzero(np.diff(edges))
            pick = lambda v, at, kind: pa.array([np.ascontiguousarray(v[at[k] : at[k + 1]], kind).tobytes() for k in full], pa.binary())
            names = pa.ListArray.from_arrays(pa.array(edges[np.append(full, len(edges) - 1)].astype(np.int32)), b.words.take(pa.array(order)))
            shifted = who - edges[:-1][np.searchsorted(edges, who, side="right") - 1] if len(who) else who
            cols = [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), b.number)), names, pick(order, edges, np.int32), pick(seen[order], edges, np.int32), pick(shifted, cut_at, np.int32), pick(what, cut_at, np.int16), pick(times, cut_at, np.int32)]
            yield pa.RecordBatch.from_arrays(cols, names=["bin", "bucket", "words", "numbers", "n", "who", "what", "times"])

    def place(t: pa.Table) -> pa.Table:
        lists = t.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        at, size = coded.indices.to_numpy(), len(coded.dictionary)
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        column = lambda c, kind: [_raw(x, kind) for x in t.column(c).combine_chunks()]
        c = np.bincount(at, weights=np.concatenate(column("n", np.int32)), minlength=size).astype(np.int64)
        who = np.concatenate([at[s + w] for s, w in zip(starts.tolist(), column("who", np.int32))])
        what, times = np.concatenate(column("what", np.int16)), np.concatenate(column("times", np.int32))
        order = np.argsort(who, kind="stable")
        who, what, times = who[order], what[order].astype(np.int64), times[order]
        kinds = np.empty(size, np.uint8)
        for x in range(0, size, 1 << 13):
            y = min(size, x + (1 << 13))
            a, z = np.searchsorted(who, (x, y))
            m = np.bincount((who[a:z] - x) * 2 * classes + what[a:z], weights=times[a:z], minlength=(y - x) * 2 * classes).reshape(-1, 2 * classes)
            alone = c[x:y] - m[:, classes:].sum(axis=1)  # times without a core word before it
            kinds[x:y] = (m @ by_context + alone[:, None] * by_class - c[x:y, None] * by_size).argmax(axis=1)
        parts = [at[s:e] for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())]
        return pa.table({"bucket": t.column("bucket"), "numbers": t.column("numbers"), "c": pa.array([c[p].tobytes() for p in parts], pa.binary()), "class": pa.array([kinds[p].tobytes() for p in parts], pa.binary())})

    out = docs.mapInArrow(words, "bin int, bucket long, words array<string>, numbers binary, n binary, who binary, what binary, times binary")
    return out.groupBy("bin").applyInArrow(place, "bucket long, numbers binary, c binary, class binary")


def _classed(docs: DataFrame, placed: DataFrame, core: list[str], core_counts: np.ndarray, of: np.ndarray, classes: int, most: int) -> DataFrame:
    """A row a bucket: its documents by numbers, each number's count and class (``classes``: unknown),
    and the class bigrams of its training documents."""

    def numbers(batches):
        known = pa.array(core, pa.string())
        for b in buckets(batches, most):
            at = pc.fill_null(pc.index_in(b.words, known), -1).to_numpy(zero_copy_only=False).astype(np.int32) if len(core) else np.full(b.end, -1, np.int32)
            one = lambda x: pa.array([x.tobytes()], pa.binary())
            cols = [pa.array([b.number]), pa.array([b.ids], pa.list_(pa.int64())), one(b.held), one(b.n.astype(np.int64)), one(b.tokens), one(at)]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "ids", "held", "words", "tokens", "core"])

    def join(key, d: pa.Table, p: pa.Table) -> pa.Table:
        row = {c: d.column(c)[0] for c in d.column_names}
        at = _raw(row["core"], np.int32)
        c, kind = np.zeros(len(at) + 1, np.int64), np.full(len(at) + 1, classes, np.uint8)
        if len(core):
            c[:-1][at >= 0], kind[:-1][at >= 0] = core_counts[at[at >= 0]], of[at[at >= 0]]
            c[-1], kind[-1] = core_counts[core.index(END)], of[core.index(END)]
        for n, counts_, kinds in zip(*(p.column(x).combine_chunks() for x in ("numbers", "c", "class"))):
            n = _raw(n, np.int32)
            c[n] = _raw(counts_, np.int64)
            kind[n] = np.where(c[n] > 0, _raw(kinds, np.uint8), classes)
        tokens, held, words = _raw(row["tokens"], np.int32), _raw(row["held"], bool), _raw(row["words"], np.int64)
        grams = np.zeros(classes * classes, np.int64)
        if not held.all():
            s = kind[stream(tokens[np.repeat(~held, words)], words[~held], len(at))].astype(np.int64)
            grams = np.bincount(s[:-1] * classes + s[1:], minlength=len(grams))
        one = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table({"ids": d.column("ids"), "held": d.column("held"), "words": d.column("words"), "tokens": d.column("tokens"), "c": one(c), "class": one(kind), "grams": one(grams)})

    told = docs.mapInArrow(numbers, "bucket long, ids array<long>, held binary, words binary, tokens binary, core binary")
    other = placed.select(F.col("bucket").alias("of"), "numbers", "c", "class")
    return told.groupBy("bucket").cogroup(other.groupBy("of")).applyInArrow(join, "ids array<long>, held binary, words binary, tokens binary, c binary, class binary, grams binary")


class Model:
    """Probabilities from class bigrams and the totals of training."""

    def __init__(self, counts: np.ndarray, n: int, v: int, once: int):
        k = len(counts)
        self.n, self.least = n, n + 0.5 * (v + 1)
        self.size = counts.sum(axis=0)
        self.unknown = (once + 1) / (n + 2)
        share = self.size / max(1.0, self.size.sum())
        rows = np.concatenate([counts, np.zeros((1, k))])  # after an unknown word: the classes' own frequency
        self.transition = (rows + TRUST * share) / (rows.sum(axis=1, keepdims=True) + TRUST)

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / self.least

    def __call__(self, before: np.ndarray, kind: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Probability of words of count ``c`` and class ``kind`` after words of class ``before``."""
        known = c > 0
        k = np.where(known, kind, 0)
        own = (1 - self.unknown) * self.transition[before, k] * c / np.maximum(self.size[k], 1)
        return MODEL_SHARE * np.where(known, own, self.unknown) + (1 - MODEL_SHARE) * self.base(c)


def _scored(table: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens, words, c_of, kind_of = (_raw(row[x], kind) for x, kind in (("tokens", np.int32), ("words", np.int64), ("c", np.int64), ("class", np.uint8)))
                s = stream(tokens, words, len(c_of) - 1)
                c, kind = c_of[s], kind_of[s]
                p = np.log10(model(kind[:-1], kind[1:], c[1:]))
                starts = np.append(0, np.cumsum(words + 1))[:-1]  # every document has its end
                add = lambda v: np.add.reduceat(v, starts)
                score, total = add(p), words + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(_raw(row["held"], bool)), pa.array(total), pa.array(add((c[1:] > 0).astype(np.int64))), pa.array(np.full(len(words), model.n)), pa.array(add(np.log10(model.base(c[1:])))), pa.array(score), pa.array(10 ** np.minimum(300.0, -score / total))],
                    names=[x.split()[0] for x in RESULT.split(", ")],
                )

    return table.mapInArrow(run, RESULT)


def score_documents(docs: DataFrame, folds: int = 5, held_out: int = 1, classes: int = CLASSES, core: int = CORE, rounds: int = ROUNDS, most: int = BUCKET) -> DataFrame:
    """Base and model log10 probability of every document (columns: ``RESULT``); the model is learned
    from all documents but those whose fold is ``held_out``."""
    if not 1 <= classes <= 255 or not 1 <= core < 1 << 16:
        raise ValueError("at most 255 classes and 65,535 core words")
    text = F.col("text").cast("string")
    docs = with_fold(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), folds)
    docs = docs.select("doc_id", "text", (F.col("fold") == held_out).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bins = max(8, math.ceil(size / BIN_BYTES))
    counted = cut(_counted(docs, core, bins, most))
    n, v, once = (int(x or 0) for x in counted.agg(F.sum("n"), F.sum("v"), F.sum("once")).first())
    top = counted.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select("w.words", "w.counts")
    ends = top.where(F.col("words") == END)
    chosen = sorted({*map(tuple, top.orderBy(F.desc("counts"), "words").limit(core).collect()), *map(tuple, ends.collect())}, key=lambda w: (-w[1], w[0]))
    if n and all(w != END for w, _ in chosen):  # not among the most frequent of its bin
        chosen.append((END, docs.where(~F.col("held_out")).count()))
    words, counts_of = [w for w, _ in chosen], np.array([c for _, c in chosen], np.int64)
    of, grams = np.zeros(0, np.uint8), np.zeros((classes, classes))
    if words:
        of, grams, _ = core_classes(cut(_core_bigrams(docs, words, most).repartition(CORE_BINS // 2, "bin")), len(words), classes, rounds)
    placed = _placed(docs, words, of, grams, bins, most)
    table = cut(_classed(docs, placed, words, counts_of, of, classes, most))

    def add(batches):
        for batch in batches:
            total = np.zeros(classes * classes)
            for g in batch.column("grams"):
                total += _raw(g, np.int64)
            yield _filled(total)

    final = _matrix_sum(table.select("grams"), add, classes * classes).reshape(classes, classes)
    return _scored(table.drop("grams"), Model(final, n, v, once))
