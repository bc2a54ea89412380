import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from fieldgrid.llm import bpe, packed  # noqa: E402

PARTS = ["a", "b", "the", "ing", "  ", " ", "\n", "\n\n", "\n ", " \n", "\t", "'s", "'", "!", "!!", "é", "é", "ß", "Σ", "İ", "1", "23", "\xa0", "\x1c", "中", "<|endoftext|>", "<|", "😀", "tion", "　", "_", "\x85"]


def test_halves_of_text_agree_with_the_library():
    whole = bpe.load(P.path("word_bpe_49k.json"))
    for leaf in (2, 3, 17):
        own = bpe.Chunks(P.path("word_bpe_49k.json"), leaf=leaf)
        r = random.Random(leaf)
        long = ["".join(r.choices(PARTS, k=400)) for _ in range(4)]  # drawn texts are short, few of them are cut

        @example(long)
        @settings(max_examples=60, deadline=None)
        @given(st.lists(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), min_size=1, max_size=4))
        def check(texts):
            for text, (ids, joins) in zip(texts, own.encode(texts), strict=True):
                want = whole.encode(text, add_special_tokens=False).ids
                assert np.frombuffer(ids, "<u4").tolist() == want
                assert own.decode(ids) == whole.decode(want, skip_special_tokens=False)
                assert (joins > 0) == (len(text) > leaf)

        check()
        assert own.joins > 20 and own.widest > 1


def test_pieces_of_bytes_agree_with_the_library():
    own, whole = bpe.Pool(P.path("byte_bpe_50k.json"), leaf=48), bpe.load(P.path("byte_bpe_50k.json"))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.none() | st.lists(st.sampled_from(PARTS), max_size=80).map("".join), max_size=5))
    def check(texts):
        ids, ends = own.encode(pa.array(texts, pa.string()))
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [ids[a:z].tolist() for a, z in zip([0, *ends], ends)] == want

    check()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_trees_of_unsplit_text_agree_with_the_library(name):
    whole = bpe.load(P.path(name))
    tree = bpe.Tree(whole, leaf=48)
    r = random.Random(3)
    for _ in range(40):  # long text without any split
        text = "".join(r.choice(["a", "b", "e", "th", "é", "!", "'s", "tion"]) for _ in range(r.randint(200, 900)))
        assert tree(text) == whole.encode(text, add_special_tokens=False).ids
    assert tree.joins > 100


def test_tables_of_pieces_may_start_anew():
    texts = [f"some words {k} and {k * 7} more some words" for k in range(50)]
    own, whole = bpe.Pool(P.path("byte_bpe_50k.json"), kept=20), bpe.load(P.path("byte_bpe_50k.json"))
    for k in range(0, 50, 3):
        ids, ends = own.encode(pa.array(texts[k : k + 3]))
        assert [ids[a:z].tolist() for a, z in zip([0, *ends], ends)] == [whole.encode(t, add_special_tokens=False).ids for t in texts[k : k + 3]]
    own, whole = bpe.Chunks(P.path("word_bpe_49k.json"), leaf=5, kept=5), bpe.load(P.path("word_bpe_49k.json"))
    for k in range(0, 50, 3):
        got = [np.frombuffer(ids, "<u4").tolist() for ids, _ in own.encode(texts[k : k + 3])]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts[k : k + 3]]


def test_encode_decode_rows(spark):
    texts = ["Hello  world", "", None, "x" * 9000, "Zoë's <|endoftext|> tea", "Hello  world"]
    df = spark.createDataFrame([(i if i != 4 else None, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    t = bpe.load(P.path("word_bpe_49k.json"))
    out = bpe.encode_decode(df, P.path("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in out if r.n_joins} == {3}
    got = sorted((tuple(r)[:4] for r in out), key=str)
    want = []
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i if i != 4 else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = bpe.encode_decode(df.limit(1), P.path("word_bpe_49k.json"), with_ids=True, with_text=True).first()
    assert len(full.ids) == full.n_tokens and "hello</w>" in full.decoded
    assert bpe.encode_decode(df.limit(0), P.path("word_bpe_49k.json")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=200), st.data())
def test_packing_round_trip_and_random_access(bits, values, data):
    ids = np.array(values, dtype=np.uint32) & np.uint32((1 << bits) - 1)
    payload = packed.pack(ids, bits)
    assert len(payload) == (len(ids) * bits + 7) // 8
    first = data.draw(st.integers(0, len(ids) - 1))
    count = data.draw(st.integers(0, len(ids) - first))
    assert packed.unpack(payload, bits, first, count).tolist() == ids[first : first + count].tolist()


def test_width():
    assert [packed.width_of(v) for v in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("vocabulary,block_ids", [(50_257, 1 << 18), (70_000, 40)])
def test_files_round_trip_in_order(spark, tmp_path, vocabulary, block_ids):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["tea", "Σ", "ham", "\n", "x" * 30]) for _ in range(r.randint(0, 60)))) for i in r.sample(range(1000), 80)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    packed.write_ids(df, str(tmp_path / "ids"), P.path("byte_bpe_50k.json"), vocabulary, 0, block_ids)
    got = {x.doc_id: x for x in packed.read_ids(spark, str(tmp_path / "ids"), with_ids=True).collect()}
    t, start = bpe.load(P.path("byte_bpe_50k.json")), 0
    assert len(got) == len(rows)
    for i, text in sorted(rows):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, got[i].ids) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)


def test_repeated_and_null_ids_are_each_written(spark, tmp_path):
    texts = ["b b", "a a a", None, "b b", "tea", ""]
    rows = [(7, t) for t in texts] + [(None, "no id"), (3, "first"), (9, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    packed.write_ids(df, str(tmp_path / "ids"), P.path("byte_bpe_50k.json"), 70_000, 0, 5)
    got = sorted(((x.start, x.n_tokens, x.doc_id, x.ids) for x in packed.read_ids(spark, str(tmp_path / "ids"), with_ids=True).collect()), key=lambda x: x[0])
    t = bpe.load(P.path("byte_bpe_50k.json"))
    assert sorted((str(x[2]), x[3]) for x in got) == sorted((str(i), t.encode(s or "", add_special_tokens=False).ids + [0]) for i, s in rows)
    assert [x[2] for x in got] == [None, 3, *[7] * 6, 9]
    assert [x[0] for x in got] == [sum(y[1] for y in got[:k]) for k in range(len(got))]
    assert [x[1] for x in got[2:8]] == sorted(x[1] for x in got[2:8])


def test_no_documents_make_an_empty_file(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    packed.write_ids(df, str(tmp_path / "ids"), P.path("byte_bpe_50k.json"), 50_257)
    assert packed.read_ids(spark, str(tmp_path / "ids")).collect() == []
