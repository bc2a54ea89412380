"""BPE encoding and decoding by tree concatenation.

A text is cut into halves, and these again, at any character, until a part has at most ``LEAF``
characters. All leaves of a batch of documents are encoded in one call, independently of each
other. Then neighbours are joined pairwise, level by level: a window around each join is encoded
again, and grows until its first piece agrees with the left half's own ids and its last piece
with the right half's. What lies between is replaced by the window's ids. No token crosses the
white space between two pieces, so agreement on both sides makes the join exact.

A piece without any white space can be arbitrarily long. ``Tree`` encodes such unsplit text in
the same way by tokens: a token sequence in which every adjacent pair is one that the encoder
itself produces is the encoder's own result.

The library sees each distinct piece once a worker (``Chunks``, ``Pool``); leaves and windows are
put together from its results.
"""

from __future__ import annotations

import hashlib
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import sliced

LEAF = 512  # characters; a longer text, or unsplit piece, is encoded by halves
KEPT = 150_000  # distinct pieces in each of the two generations that a worker keeps
POOLED = 800_000  # distinct pieces in a pool before it starts anew
GATHERED = 1 << 14  # pieces whose ids are gathered at once
#: White space after a space or line feed, or at the end: only then can a run of white space be longer than one.
_ODD_SPACE = "[ \\n](?:[\\t-\\r\\x1c-\\x20\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|\\z)"
_SPACES = " \t\n\r\x0b\x0c"

_loaded: dict[tuple[str, type], "Chunks | Pool"] = {}


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Tree:
    """Encodes one long text by halves; ``leaf`` is the largest part given to the library at once."""

    def __init__(self, tokenizer, leaf: int = LEAF):
        self.t, self.leaf = tokenizer, leaf
        self.joins = self.widest = 0

    def _encode(self, parts: list[str], at: list[int]) -> list[list[tuple[int, int, int]]]:
        out = self.t.encode_batch(parts, add_special_tokens=False)
        return [[(i, a + o, b + o) for i, (a, b) in zip(e.ids, e.offsets)] for e, o in zip(out, at)]

    def __call__(self, text: str) -> list[int]:
        level = [0, len(text)]
        while max(b - a for a, b in zip(level, level[1:])) > self.leaf:
            level = sorted({*level, *((a + b) // 2 for a, b in zip(level, level[1:]) if b - a > self.leaf)})
        spans = list(zip(level, level[1:]))
        parts = self._encode([text[a:b] for a, b in spans], [a for a, _ in spans])
        while len(parts) > 1:
            joined, joined_spans = [], []
            for k in range(0, len(parts) - 1, 2):
                (lo, mid), (_, hi) = spans[k], spans[k + 1]
                joined.append(self._join(text, parts[k], parts[k + 1], lo, mid, hi))
                joined_spans.append((lo, hi))
            if len(parts) % 2:
                joined.append(parts[-1])
                joined_spans.append(spans[-1])
            parts, spans = joined, joined_spans
        return [i for i, _, _ in parts[0]]

    def _join(self, text, left, right, lo, mid, hi):
        self.joins += 1
        width = 16
        while True:
            self.widest = max(self.widest, width)
            i, j = max(0, len(left) - width), min(len(right), width)
            start = left[i][1] if i else lo
            end = right[j - 1][2] if j < len(right) else hi
            window = self._encode([text[start:end]], [start])[0]
            agree_left = i == 0 or window[:3] == left[i : i + 3] and len(left) - i > 3
            if agree_left and j == len(right):
                return left[:i] + window
            if agree_left:
                place = {x: n for n, x in enumerate(right[:j])}
                # not among the last tokens of the window, whose end is no end in the text
                for n in range(len(window) - 5, 2, -1):
                    k = place.get(window[n])
                    if k is not None and k >= 2 and window[n - 2 : n] == right[k - 2 : k] and window[n - 2][1] > mid:
                        return left[:i] + window[: n + 1] + right[k + 1 :]
            if i == 0 and j == len(right):
                return window
            width *= 2


class Chunks:
    """Encodes documents with a tokenizer that drops white space and lets no token cross it.

    Two generations of pieces are kept: when the newer is full it becomes the older, and pieces
    still in use move up from there, so frequent words stay and rare ones go.
    """

    def __init__(self, path: str, leaf: int = LEAF, kept: int = KEPT):
        self.t, self.leaf, self.kept = load(path), max(2, leaf), kept  # a leaf of two characters at least is never empty
        self.tree = Tree(self.t, leaf)
        self.joins = self.widest = 0
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocab = self.t.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.names[i] = name
        self.mark = "<|endoftext|>"
        self.mark_id = vocab[self.mark]

    def learn(self, pieces: set[bytes], more: bool = False) -> None:
        """Encode pieces that are new here: the short ones in one call, a special token between each
        two. With ``more``, pieces learned before stay."""
        missing = pieces.difference(self.ids)
        if len(self.ids) + len(missing) > self.kept and not more:
            self.older, self.ids = self.ids, {}
            missing = set(pieces)
        ids, older = self.ids, self.older
        known = [p for p in missing if p in older]
        ids.update(zip(known, map(older.__getitem__, known)))
        missing.difference_update(known)
        for p in [p for p in missing if len(p) > self.leaf or b"<|" in p]:  # long, or it may hold a special token
            t = p.decode()
            found = self.tree(t) if len(t) > self.leaf else self.t.encode(t, add_special_tokens=False).ids
            ids[p] = np.array(found, dtype="<u4").tobytes()
            missing.discard(p)
        if missing:
            short = list(missing)
            text = self.mark.encode().join(short).decode()
            found = np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.append(np.flatnonzero(found == self.mark_id) * 4, len(found) * 4)
            starts = np.append(0, ends[:-1] + 4)
            found = found.tobytes()
            ids.update(zip(short, [found[a:b] for a, b in zip(starts.tolist(), ends.tolist())], strict=True))

    def halves(self, text: str) -> tuple[list[list[bytes]], list[bool]]:
        """The pieces of each leaf, and for each cut whether it goes through a word."""
        n = 1
        while len(text) > n * self.leaf:
            n *= 2
        at = [len(text) * k // n for k in range(n + 1)]
        cuts = [text[a - 1] not in _SPACES and text[a] not in _SPACES for a in at[1:-1]]
        return [text[a:b].encode().split() for a, b in zip(at, at[1:])], cuts

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, int]]:
        """Of each text the ids as little-endian unsigned 32-bit integers, and how many joins made them."""
        split = [self.halves(t) if t else ([[]], []) for t in texts]
        self.learn({p for parts, _ in split for part in parts for p in part})
        levels = [(parts, cuts) for parts, cuts in split]
        joins = [len(cuts) for _, cuts in split]
        while any(cuts for _, cuts in levels):
            pairs = [(d, k) for d, (parts, _) in enumerate(levels) for k in range(0, len(parts) - 1, 2)]
            joined = self._join([(levels[d][0][k], levels[d][0][k + 1], levels[d][1][k]) for d, k in pairs])
            made: dict[int, list[list[bytes]]] = {}
            for (d, _), part in zip(pairs, joined):
                made.setdefault(d, []).append(part)
            levels = [(made[d], cuts[1::2]) if d in made else (parts, cuts) for d, (parts, cuts) in enumerate(levels)]
        get = self.ids.__getitem__
        return [(b"".join(map(get, parts[0])), n) for (parts, _), n in zip(levels, joins)]

    def _join(self, pairs: list[tuple[list[bytes], list[bytes], bool]]) -> list[list[bytes]]:
        """Each pair of neighbours (left, right, whether the cut goes through a word) as one part."""
        out: list[list[bytes]] = [[] for _ in pairs]
        todo, width = range(len(pairs)), 1
        self.joins += len(pairs)
        while todo:
            windows = []
            for k in todo:
                left, right, torn = pairs[k]
                a, b = left[-width:], right[:width]
                windows.append([*a[:-1], a[-1] + b[0], *b[1:]] if torn else a + b)
            self.learn({p for w in windows for p in w if p not in self.ids}, more=True)
            ids, left_over = self.ids, []
            for k, window in zip(todo, windows):
                left, right, _ = pairs[k]
                agree_left = width >= len(left) or ids[window[0]] == ids[left[-width]]
                agree_right = width >= len(right) or ids[window[-1]] == ids[right[width - 1]]
                if agree_left and agree_right:
                    out[k] = left[:-width] + window + right[width:]
                else:
                    left_over.append(k)
            self.widest = max(self.widest, width)
            todo, width = left_over, width * 2
        return out

    def decode(self, ids: bytes) -> str:
        """What the library's ``decode`` gives for a file without a decoder: the tokens, a space between each two."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Pool:
    """Encodes columns of documents with a byte-level tokenizer, in which a single space belongs
    to the piece after it.

    Distinct pieces have numbers; their ids lie one after the other in one array, from which the
    ids of a whole column are gathered at once. A full pool starts anew.
    """

    def __init__(self, path: str, leaf: int = LEAF, kept: int = POOLED):
        self.t, self.leaf, self.kept = load(path), leaf, kept
        self.tree = Tree(self.t, leaf)
        vocab = self.t.get_vocab(with_added_tokens=True)
        self.opens = {}
        for c, seen in ((" ", "\u0120"), ("\n", "\u010a")):  # how byte-level files write the two bytes
            self.opens[c] = np.zeros(max(vocab.values()) + 1, bool)
            self.opens[c][[i for name, i in vocab.items() if name.startswith(seen)]] = True
        self.steps = np.arange(8 * GATHERED, dtype=np.int32)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.starts, self.counts, self.pool = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint32)

    def pieces(self, text: str) -> list[str]:
        """Parts that the tokenizer treats alone, of a text with runs of white space. A part stands
        for itself with a space before it, or, if it begins with one line feed, for itself, or,
        after two, for the rest. A space goes with what follows unless that is white space."""
        first, *rest = text.split(" ")
        out = ["\n\n" + first]
        for p in rest:
            if p and not p[0].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def split(self, texts: pa.Array) -> pa.Array:
        """The pieces of each text: at each space and before each line feed where no run of white space is longer than one."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        plain = pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n")
        plain = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n\n", pa.large_string()), plain, pa.scalar("", pa.large_string())), " ")
        if not pc.any(odd).as_py():
            return plain
        rest = pa.array([self.pieces(t) for t in texts.filter(odd).to_pylist()], plain.type)
        odd = odd.to_numpy(zero_copy_only=False)
        place = np.where(odd, len(plain) + np.cumsum(odd) - 1, np.cumsum(~odd) - 1)
        return pa.concat_arrays([plain, rest]).take(pa.array(place))

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that are new here. Those that begin with a space, and those that begin with
        a line feed, are each one text, as a token that begins with this byte begins a piece."""
        groups: dict[str, list[str]] = {" ": [], "\n": [], "": []}
        for p in pieces:
            if " " in p or "<|" in p or len(p) > self.leaf or p.startswith("\n\n"):  # may hold a special token, or is long
                groups[""].append(p)
            else:
                groups["\n" if p[0] == "\n" else " "].append(p)
        for c, group in groups.items():
            if not c or not group:
                continue
            text = " " + " ".join(group) if c == " " else "".join(group)
            ids = np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(self.opens[c][ids])
            if len(starts) == len(group) and starts[0] == 0:
                self._add(group, ids, np.diff(np.append(starts, len(ids))))
            else:
                groups[""] += group
        rest = groups[""]
        if rest:
            texts = [p[2:] if p.startswith("\n\n") else p if p[0] == "\n" else " " + p for p in rest]
            short = [t for t in texts if len(t) <= self.leaf]
            found = iter(self.t.encode_batch_fast(short, add_special_tokens=False))
            ids = [next(found).ids if len(t) <= self.leaf else self.tree(t) for t in texts]
            self._add(rest, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids]))

    def _add(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.number.update(zip(pieces, range(len(self.counts), len(self.counts) + len(pieces))))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts, dtype=np.int64) - counts])
        self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
        self.pool = np.concatenate([self.pool, ids])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and for each text where its ids end."""
        lists = self.split(texts)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            if len(self.number) + len(new) > self.kept:
                self._clear()
                new = np.arange(len(distinct))
            fresh = [distinct[k] for k in new.tolist()]
            self.learn(fresh)
            number[new] = np.fromiter(map(self.number.__getitem__, fresh), np.int64, len(fresh))
        of = number[coded.indices.to_numpy()]
        counts = self.counts[of]
        ends = np.append(0, np.cumsum(counts, dtype=np.int64))
        ids = np.empty(ends[-1], np.uint32)
        for a in range(0, len(of), GATHERED):  # arrays that stay in the processor's cache
            z = min(a + GATHERED, len(of))
            jump = (self.starts[of[a:z]] - (ends[a:z] - ends[a])).astype(np.int32)
            place = np.repeat(jump, counts[a:z])
            place += self.steps[: len(place)] if len(place) <= len(self.steps) else np.arange(len(place), dtype=np.int32)
            np.take(self.pool, place, out=ids[ends[a] : ends[z]], mode="clip")
        at = lists.offsets.to_numpy()
        return ids, ends[at[1:] - at[0]]


def loaded(path: str, kind: type):
    """A ``Chunks`` or ``Pool`` of a file: one a worker process, kept between tasks."""
    if (path, kind) not in _loaded:
        _loaded[path, kind] = kind(path)
    return _loaded[path, kind]


def encode_decode(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode every whole text with a word-level BPE file, then decode the ids.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, n_joins (how many joins of halves made
    the ids), with ``ids`` (array<int>) and ``decoded`` (string) on request. A null text is empty;
    an empty text has no ids and decodes to ``""``. Rows are independent: repeated rows and null
    ids are kept, other columns dropped.
    """
    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("n_joins", "int")]
    fields += [("ids", "array<int>")] * with_ids + [("decoded", "string")] * with_text

    def run(batches):
        bpe = loaded(tokenizer_path, Chunks)
        for batch in sliced(batches):
            n, sums, outs, joins, all_ids, texts = [], [], [], [], [], []
            for ids, joined in bpe.encode(batch.column(1).to_pylist()):
                decoded = bpe.decode(ids)
                n.append(len(ids) // 4)
                sums.append(hashlib.sha256(ids).hexdigest())
                outs.append(hashlib.sha256(decoded.encode()).hexdigest())
                joins.append(joined)
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype("i4"))
                if with_text:
                    texts.append(decoded)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(outs, pa.string()), pa.array(joins, pa.int32())]
            cols += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids + [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(cols, names=[k for k, _ in fields])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in fields))
