"""Alignment of two tokenizers by their spans, with counts of linked token ids over the corpus.

A is a byte-level BPE of the tokenizers library over a space and the text; B a sentencepiece model,
which adds the space itself. A's character offsets and the spans of B's proto are the coarse cuts.
Tokens inside a character (offsets that overlap, byte-fallback pieces) are refined by the lengths of
their decoded bytes since the last exact cut. Byte offsets where tokens of both end cut the text
into groups; the last tokens of a group are its link.

Neither tokenizer lets a token cross a space or line feed between two characters that are no white
space, if the one after it stays with it. So a text is a sequence of such chunks, each aligned once
and looked up afterwards (``Aligner``), and new chunks are encoded in one call. A text with a chunk
whose decoded bytes differ from it is encoded again as a whole.

Counts: ``tokens`` writes each document's links as places in its bucket's list of pairs (a bucket is
a bounded stretch of one task's documents) and that list. Lists are summed by pair, each pair finds
its count and whether it is its B id's best, and the answers go back to the buckets. No document and
no pair passes through the driver, and a hot pair is one row a bucket.

Texts that are null or empty, or whose decoded bytes differ from a space and the text, have no
tokens: zeros and ''. A null or repeated doc_id is answered row by row. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .common import cut, sliced

CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
KEPT = 600_000  # chunks that a worker keeps
KEPT_BYTES = 96 << 20  # of their texts and groups
LINKS = 2_000_000  # links of a bucket
AT_ONCE = 4 << 20  # bytes of texts held at once
PREFIX = " x"  # stands before chunks that are encoded together, so that none is the text's start
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for
    themselves, the others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Aligner:
    """Chunks of text to groups and links; keeps what it has aligned."""

    def __init__(self, a_path: str, b_path: str, kept: int = KEPT):
        import sentencepiece

        self.a = load(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        table, vocab = byte_level(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.a_bytes[i] = bytes(table[c] for c in name) if all(c in table for c in name) else name.encode()
        n = self.b.get_piece_size()
        self.b_is_byte = np.array([self.b.is_byte(i) for i in range(n)])
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(map(self.b.id_to_piece, range(n)), self.b_is_byte)]
        self.a_len, self.b_len = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        names = lambda size, end: np.array([f"{i}{end}" for i in range(size)], object)
        self.a_name, self.b_name = ([names(len(t), end) for end in ends] for t, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;\n")))
        self.kept, self.refined = kept, 0
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.n_a, self.n_b = array("q"), array("q")
        self.groups: list[bytes | None] = []  # None: the decoded bytes differ
        self.links: list[bytes] = []  # of 64-bit numbers
        self.held, self.differing = 0, False

    def encode(self, text: str):
        """Ids and byte ends of both tokenizers' tokens of ``text``, which starts with a space; None
        if the decoded bytes of either differ from it."""
        raw = text.encode()
        enc = self.a.encode(text, add_special_tokens=False)
        pieces = [(p.id, p.begin, p.end) for p in self.b.encode(text[1:], return_type="proto").pieces]
        if b"".join([self.a_bytes[i] for i in enc.ids]) != raw or b"".join([self.b_bytes[p[0]] for p in pieces]) != raw:
            return None
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        place = np.append(0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)))  # byte of each character
        a, off = np.array(enc.ids, np.int64), np.fromiter(chain.from_iterable(enc.offsets), np.int64, 2 * len(enc.ids)).reshape(-1, 2)
        whole = np.append(off[1:, 0] >= off[:-1, 1], True)
        a_end = self._refine(place[off[:, 1]], whole, self.a_len[a])
        b = np.fromiter(chain.from_iterable(pieces), np.int64, 3 * len(pieces)).reshape(-1, 3)
        return a, a_end, b[:, 0], self._refine(b[:, 2] + 1, ~self.b_is_byte[b[:, 0]], self.b_len[b[:, 0]])

    def _refine(self, coarse: np.ndarray, exact: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Byte ends: the coarse cut where it is exact, else the last exact one and the decoded bytes since."""
        if exact.all():
            return coarse
        self.refined += int((~exact).sum())
        done = np.append(0, np.cumsum(lengths))
        last = np.maximum.accumulate(np.where(exact, np.arange(1, len(exact) + 1), 0))
        base = np.append(0, np.where(exact, coarse, 0))
        return np.where(exact, coarse, base[last] + done[1:] - done[last])

    def _add(self, key: str | None, n_a: int, n_b: int, groups: bytes | None, links: bytes) -> int:
        k = len(self.groups)
        if key is not None:
            self.at[key] = k
        self.n_a.append(n_a)
        self.n_b.append(n_b)
        self.groups.append(groups)
        self.links.append(links)
        self.differing |= groups is None
        self.held += len(key or "") + len(groups or b"") + len(links)
        return k

    def _block(self, keys: list[str | None], chunks: list[str], prefix: str) -> bool:
        """Aligns chunks encoded as one text behind ``prefix``. False if the bytes differ or chunks run together."""
        found = self.encode(prefix + "".join(chunks))
        if found is None:
            return False
        a, a_end, b, b_end = found
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        ia, ib = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)  # the last tokens of each group
        edges = np.array(list(accumulate([len(prefix), *(len(c.encode()) for c in chunks)])))
        last = np.searchsorted(ends, edges)  # each chunk's last group, that of the prefix first
        if (ends[np.minimum(last, len(ends) - 1)] != edges)[0 if prefix else 1 :].any():
            return False
        # names of all tokens in order of groups, A's before B's; what follows each ends token, side, group or chunk
        a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_mark[ia], b_mark[ib] = 1, 1
        b_mark[ib[last[1:]]] = 2
        if prefix:
            b_mark[ib[last[0]]] = 2
        a_group, b_group = np.cumsum(a_mark) - a_mark, np.cumsum(b_mark > 0) - (b_mark > 0)
        text = np.empty(len(a) + len(b), object)
        for tokens_, mark, group, names, before in ((a, a_mark, a_group, self.a_name, np.append(0, ib + 1)), (b, b_mark, b_group, self.b_name, ia + 1)):
            place = np.arange(len(tokens_)) + before[group]
            for m, name in enumerate(names):
                text[place[mark == m]] = name[tokens_[mark == m]]
        texts = "".join(text.tolist()).split("\n")[1 if prefix else 0 :]
        links = ((a[ia] << 32) | b[ib]).tobytes()
        first = np.append(last[0] + 1 if prefix else 0, last[1:] + 1)
        of_a, of_b, at = (np.append(0, i + 1)[first].tolist() for i in (ia, ib, np.arange(len(ends))))
        for k, key in enumerate(keys):
            self._add(key, of_a[k + 1] - of_a[k], of_b[k + 1] - of_b[k], texts[k].encode(), links[8 * at[k] : 8 * at[k + 1]])
        return True

    def learn(self, new: list[str]) -> None:
        """Aligns chunks by their keys (see ``keys_of``)."""
        regular = [k for k in new if k[0] != " " and not k[-1].isspace()]
        chunk = lambda k: k if k[0] in " \n" else " " + k
        if regular and self._block(regular, [chunk(k) for k in regular], PREFIX):
            regular = []
        for k in [*regular, *(k for k in new if k[0] == " " or k[-1].isspace())]:
            if not self._block([k], [chunk(k)], "" if k[0] == " " else PREFIX):
                self._add(k, 0, 0, None, b"")

    def whole(self, text: str) -> int:
        """A text that is no plain sequence of chunks, as one."""
        if not self._block([None], [" " + text], ""):
            return self._add(None, 0, 0, None, b"")
        return len(self.groups) - 1

    def texts(self, texts: list[str | None]) -> list[list[int]]:
        """Places of each text's chunks in what is kept; none where it has no tokens."""
        if len(self.at) > self.kept or self.held > KEPT_BYTES:
            self.clear()
        keys = [keys_of(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(keys)).difference(self.at))
        for k in range(0, len(new), 1 << 14):
            self.learn(new[k : k + (1 << 14)])
        out = []
        for t, ks in zip(texts, keys):
            at = list(map(self.at.__getitem__, ks))
            if self.differing and None in map(self.groups.__getitem__, at):
                at = [self.whole(t)]
                at = [] if self.groups[at[0]] is None else at
            out.append(at)
        return out


def keys_of(text: str) -> list[str]:
    """Keys of a text's chunks: the chunk, but without its space where only one stands before it."""
    if " ".join(text.split()) == text.replace("\n", " "):  # single spaces and line feeds between words alone
        return text.replace("\n", " \n").split(" ")
    return [c[1:] if c[0] == " " and not c[1:2].isspace() and len(c) > 1 else c for c in CUT.split(" " + text)]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


_DOC = "n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>, times array<int>"
_TOKENS = f"bucket long, is_list boolean, doc_id long, {_DOC}, pairs array<long>, counts array<long>"


def _bucket(number: int, ids: list, docs: list, pairs: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of a bucket's documents and of its list of pairs."""
    flat, n = (np.concatenate([np.empty(0, np.int64), *x]) for x in (pairs, times))
    known, at = np.unique(flat, return_inverse=True)
    counts = np.bincount(at, weights=n, minlength=len(known)).astype(np.int64)
    ends = np.append(0, np.cumsum([len(p) for p in pairs])).astype(np.int32)
    rows = len(ids) + 1
    lists = lambda values, kind: pa.concat_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind)), pa.array([None], pa.list_(kind))])
    one = lambda values: pa.array([None] * len(ids) + [values], pa.list_(pa.int64()))
    column = lambda k, kind: pa.array([d[k] for d in docs] + [None], kind)
    names = [c.split()[0] for c in _TOKENS.split(", ")]
    values = [pa.array(np.full(rows, number)), pa.array([False] * len(ids) + [True]), pa.array([*ids, None], pa.int64()), column(0, pa.int64()), column(1, pa.int64()), column(2, pa.int64()), column(3, pa.string()), lists(at, pa.int32()), lists(n, pa.int32()), one(known), one(counts)]
    return pa.RecordBatch.from_arrays(values, names=names)


def tokens(docs: DataFrame, a_path: str, b_path: str, most: int = LINKS) -> DataFrame:
    """Documents with their links, and a list of pairs for each bucket (``_TOKENS``)."""

    def run(batches):
        from pyspark import TaskContext

        number, al = TaskContext.get().partitionId() << 32, aligner(a_path, b_path)
        ids, rows, pairs, times, held = [], [], [], [], 0
        for batch in (part for b in sliced(batches) for part in _by_size(b)):
            texts = batch.column(1).to_pylist()
            found = al.texts(texts)
            per_text = [b"".join(map(al.links.__getitem__, f)) for f in found]
            owner = np.repeat(np.arange(len(texts)), [len(x) // 8 for x in per_text])
            known, at = np.unique(np.frombuffer(b"".join(per_text), np.int64), return_inverse=True)
            both, n = np.unique(owner * max(1, len(known)) + at, return_counts=True)
            edges = np.searchsorted(both, np.arange(len(texts) + 1) * max(1, len(known)))
            pair = known[both % max(1, len(known))] if len(known) else known
            for k, f in enumerate(found):
                x, y = edges[k], edges[k + 1]
                digest = hashlib.sha256(b";".join(map(al.groups.__getitem__, f))).hexdigest() if f else ""
                rows.append((sum(map(al.n_a.__getitem__, f)), sum(map(al.n_b.__getitem__, f)), len(per_text[k]) // 8, digest))
                pairs.append(pair[x:y])
                times.append(n[x:y])
            ids += batch.column(0).to_pylist()
            held += len(both)
            if held >= most:
                yield _bucket(number, ids, rows, pairs, times)
                number, ids, rows, pairs, times, held = number + 1, [], [], [], [], 0
        if ids:
            yield _bucket(number, ids, rows, pairs, times)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _TOKENS)


def _by_size(batch: pa.RecordBatch, most: int = AT_ONCE):
    """Parts of a batch of about ``most`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for x, y in zip(edges, edges[1:]):
        if y > x:
            yield batch.slice(x, y - x)


def _scored(key, docs: pa.Table, known: pa.Table) -> pa.Table:
    """n_best and count_sum of a bucket's documents, from what is known of its pairs."""
    order = known.column("place").to_numpy()
    count, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    count[order], best[order] = known.column("n").to_numpy(), known.column("best").to_numpy().astype(np.int64)
    links = docs.column("links").combine_chunks()
    ends = links.offsets.to_numpy()
    at, n = links.flatten().to_numpy(), docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    total = lambda v: np.diff(np.append(0, np.cumsum(v * n))[ends - ends[0]])
    plain = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
    return pa.table([*plain, docs.column("n_groups"), pa.array(total(best[at])), pa.array(total(count[at])), docs.column("groups_sha256")], names=[c.split()[0] for c in RESULT.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str, most: int = LINKS) -> DataFrame:
    """Groups, links and their corpus-wide counts of every document (columns: ``RESULT``)."""
    found = cut(tokens(docs, a_path, b_path, most))
    lists = found.where("is_list")
    counts = lists.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    counts = cut(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    judged = counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    placed = lists.select("bucket", F.posexplode("pairs").alias("place", "pair")).join(judged, "pair").select(F.col("bucket").alias("of"), "place", "n", "best")
    rows = found.where(~F.col("is_list")).select("bucket", "doc_id", *[c.split()[0] for c in _DOC.split(", ")])
    return rows.groupBy("bucket").cogroup(placed.groupBy("of")).applyInArrow(_scored, RESULT)
