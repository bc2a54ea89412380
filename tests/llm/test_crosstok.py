"""Cross-tokenizer alignment against tokens taken from the libraries text by text."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldgrid.llm import crosstok
from fieldgrid.llm.queries import tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
a_lib = Tokenizer.from_file(A)
a_lib.encode_special_tokens = True
b_lib = sentencepiece.SentencePieceProcessor(model_file=B)


def char_to_byte():
    """The usual table of byte-level vocabularies, from characters to bytes."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, k = {chr(b): b for b in keep}, 256
    for b in range(256):
        if b not in keep:
            out[chr(k)] = b
            k += 1
    return out


BYTES = char_to_byte()


def brute(text):
    """(n_a, n_b, groups) of one text, from the whole text's tokens."""
    if not text:
        return 0, 0, []
    whole = (" " + text).encode()
    a = [(i, bytes(BYTES[c] for c in t)) for i, t in zip(*(lambda e: (e.ids, e.tokens))(a_lib.encode(" " + text, add_special_tokens=False)))]
    b = [(i, bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()) for i in b_lib.encode(text)]
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return 0, 0, []
    groups, left, right, x, y, j = [], [], [], 0, 0, 0
    for i, t in a:
        left.append(i)
        x += len(t)
        while y < x:
            right.append(b[j][0])
            y += len(b[j][1])
            j += 1
        if x == y:
            groups.append((left, right))
            left, right = [], []
    return len(a), len(b), groups


def text_of(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(rows):
    found = [brute(t) for _, t in rows]
    count = Counter((a[-1], b[-1]) for _, _, g in found for a, b in g)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), (na, nb, g) in zip(rows, found):
        links = [(a[-1], b[-1]) for a, b in g]
        sha = hashlib.sha256(text_of(g).encode()).hexdigest() if na else ""
        out.append((i, na, nb, len(g), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=str)


def aligned(al, text):
    at = al.texts([text])[0]
    return sum(al.n_a[k] for k in at), sum(al.n_b[k] for k in at), b";".join(al.groups[k] for k in at).decode()


HARD = [
    "a\u2003b\u2003 c", "a\xa0b\u3000c", "a \xa0b\n\u2028c", "q\u0301 \u200d\ufeff",
    "", " ", "  ", "\n", " \n", "\n\n", "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "a\n\nb", "x \n\ny\tz", "\r\n", "a\r\nb", "\ta\t", "trail  ", "trail\n", "\nlead",
    "café 中文 \U0001f600z", "\U0001f9ff\U0001fae8ሀꙮ", "aሀb ꙮ", "▁x", "a▁ b", "<|endoftext|> <s> </s> <unk> <0x0A>", "it's we'll 'S", "a b   c", "a b　c",
    "\x00 \x1c \x1d", "́́", "ﬁ ½ Ⅷ", "a" * 3000, "中" * 700, "ab " * 900, " " * 40 + "x" + " " * 17, "é̂ ​‍ ﻿",
]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts_agree_with_whole_texts(text):
    na, nb, g = brute(text)
    assert aligned(crosstok.Aligner(A, B), text) == (na, nb, text_of(g))


AL = crosstok.Aligner(A, B)
PIECES = st.sampled_from([" ", "\n", "  ", "\t", "\r", " ", "▁", "a", "the", "The", ".", ",", "'s", "12", "é", "中", "ሀ", "\U0001fae8", "é", "　", "\x1f", "zq", "<", "AKIA", "\xa0", "\u2003", "\x85", "\ufeff"])


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(PIECES, max_size=14).map("".join))
def test_any_text_agrees_with_the_whole_text(text):
    na, nb, g = brute(text)
    assert aligned(AL, text) == (na, nb, text_of(g))


def test_multibyte_tokens_are_refined_and_chunks_are_kept():
    al = crosstok.Aligner(A, B)
    al.texts(["ሀ 中文 café"])
    assert al.refined > 0
    n = len(al.groups)
    al.texts(["ሀ café café"])
    assert len(al.groups) == n
    small = crosstok.Aligner(A, B, kept=3)
    for t in ("one two three four", "five six", "one six"):
        na, nb, g = brute(t)
        assert aligned(small, t) == (na, nb, text_of(g))


def test_documents_agree_with_brute_force(spark):
    docs = [r[:2] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(250).collect()]
    rows = [*map(tuple, docs), (None, "null id"), (7, None), (8, ""), (9, docs[0][1]), (9, docs[0][1]), *((1000 + k, t) for k, t in enumerate(HARD))]
    df = spark.createDataFrame([(i, t, 5, "c") for i, t in rows], "doc_id long, text string, n_a int, bucket string").repartition(3)
    want = expected(rows)
    for most in (crosstok.LINKS, 500):  # one bucket a task, and many
        got = sorted(map(tuple, crosstok.align(df, A, B, most).collect()), key=str)
        assert got == want


def test_empty_table(spark):
    out = crosstok.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert out.count() == 0 and out.columns == [c.split()[0] for c in crosstok.RESULT.split(", ")]
    assert public_tokenizers.path("byte_bpe_50k.json") == A
