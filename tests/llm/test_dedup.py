import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldgrid.llm import minhash, rlz

from . import brute


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passage = [word() for _ in range(70)]
    base = [[word() for _ in range(r.randint(5, 160))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base)) if i % 3 else [word() for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 6)):
            if w:
                w[r.randrange(len(w))] = word()
        if i % 4 == 0:
            a = r.randrange(0, 20)
            w[len(w) // 2 : len(w) // 2] = passage[a:]
        if i % 7 == 0:
            w = w + w
        rows.append((i, r.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one two"), (n + 4, "One TWO"), (n + 5, "x " * 300), (n + 6, "x " * 90), (n + 7, "y x " * 400)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,window,gram", [(1, 50, 25), (2, 8, 3), (3, 5, 5)])
def test_substring_dedup_is_brute_force(spark, seed, window, gram):
    rows = corpus(seed)
    got = rlz.remove_duplicates(frame(spark, rows).repartition(3), window, gram)
    have = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect())
    assert have == sorted(brute.substring_dedup(rows, window))


def test_substring_dedup_factors_and_columns(spark):
    w = [f"w{k}" for k in range(120)]
    rows = [(5, " ".join(w), "a"), (9, "new " + " ".join(w[:80]) + " tail", "b"), (None, " ".join(w), "c"), (9, "other text", "d"), (5, " ".join(w), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = rlz.remove_duplicates(df).collect()
    assert len(got) == 5 and set(got[0].asDict()) == {"doc_id", "text", "n_words", "n_removed", "kept_text", "kept_sha256", "factors"}
    for r in got:
        if r.doc_id == 9 and r.text != "other text":
            assert (r.n_removed, r.kept_text) == (80, "new tail") and [tuple(f) for f in r.factors] == [(1, 81, 5, 0)]
        else:
            assert r.n_removed == 0


def test_substring_dedup_of_an_empty_table(spark):
    assert rlz.remove_duplicates(frame(spark, [])).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "aa", "ba"]), min_size=0, max_size=200), st.integers(2, 12))
def test_blocks_hold_every_window_once(words, window):
    p = rlz.Parsed(" ".join(words))
    _, lo, hi = p.blocks(window, max(1, window // 2))
    held = [s for a, b in zip(lo, hi) for s in range(a, b + 1)]
    assert held == list(range(max(0, len(words) - window + 1)))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_are_brute_force(spark, seed):
    rows = corpus(seed, 90)
    component, size = brute.near_duplicates(rows)
    got = minhash.near_duplicates(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (size[r.doc_id], component[r.doc_id], r.doc_id == component[r.doc_id])


def test_near_duplicate_edge_cases(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(7, text), (7, text), (3, text.upper()), (None, text), (8, None), (9, ""), (10, "a b"), (11, "A  B"), (12, "other " * 20)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(7, 36, 3, False), (7, 36, 3, False), (3, 36, 3, True), (None, 36, None, True), (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True)], key=str)
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_a_repeated_id_is_one_node(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a), (2, a), (2, b), (3, b)]
    assert {r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()} == {1}


def test_large_groups_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 300)
    rows = corpus(4, 80)
    component, _ = brute.near_duplicates(rows)
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == component


@pytest.mark.parametrize("chunk", [2048, 16])
def test_near_copies_between_longer_pages_of_the_same_passage(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CELL_SIGNATURES", chunk, raising=False)
    r = random.Random(1)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage = words(300)
    rows = [(i, " ".join(passage + words(10 if i in (100, 101) else 115))) for i in range(200)]
    component, _ = brute.near_duplicates(rows)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(frame(spark, rows).repartition(3)).collect()}
    assert component[101] == 100 and got == component


def near_copies(n):
    """Copies of one text of 120 words, each with one to three words of its own."""
    r = random.Random(5)
    rows = []
    for i in range(n):
        w = [f"w{k}" for k in range(120)]
        for _ in range(r.randint(1, 3)):
            w[r.randrange(120)] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    return rows


def test_a_large_group_of_near_copies_has_few_ties_and_links(spark, monkeypatch):
    made = []
    whole = minhash.components

    def counted(links):
        made.append(links.count())
        return whole(links)

    monkeypatch.setattr(minhash, "components", counted)
    n = 240
    rows = near_copies(n)
    component, _ = brute.near_duplicates(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == component and set(got.values()) == {0}
    assert max(made) <= 2 * n


def test_parts_that_ties_leave_are_linked_across_cells(spark, monkeypatch):
    """A chain of texts, each linked only with its neighbours, in cells of two or three texts."""
    monkeypatch.setattr(minhash, "CELL", 300)
    words = [f"w{k}" for k in range(700)]
    rows = [(i, " ".join(words[i * 14 : i * 14 + 140])) for i in random.Random(3).sample(range(40), 40)]
    component, _ = brute.near_duplicates(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert set(component.values()) == {0} and got == component


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    common, a, b = (r.integers(0, 1 << minhash.UNIVERSE, n) for n in (600, 100, 100))
    one, two = (minhash.signature(np.concatenate([common, x]), 128) for x in (a, b))
    assert abs((one == two).mean() - 0.75) < 0.15
    places = np.array([5])
    s = minhash.signature(places, 128)
    assert np.array_equal(minhash.signature(places + 1, 128)[:-1], s[1:])  # a shift of the circle


def test_components(spark):
    from fieldgrid.llm.graph import components

    links = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (60, 100), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and got[100] == got[60] == got[50] == 50
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_factors_are_greedy_and_stand_in_their_references(spark):
    from fieldgrid.llm import rlz

    r = random.Random(11)
    word = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    a, b = word(200), word(120)
    texts = [a, b, word(10) + a[20:150] + word(5) + b[:100], a[:90] + b[30:110] + word(3), a[100:150] + a[100:150], word(300)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: [(f.start, f.end, f.ref, f.ref_start) for f in x.factors] for x in rlz.remove_duplicates(df, 50, 25).collect()}
    assert got[0] == got[1] == got[5] == []
    assert got[2] == [(10, 140, 0, 20), (145, 245, 1, 0)]
    assert got[3] == [(0, 90, 0, 0), (90, 170, 1, 30)]
    assert got[4] == [(0, 50, 0, 100), (50, 100, 0, 100)]
    for i, factors in got.items():
        for start, end, ref, at in factors:
            assert ref < i and end - start >= 50 and texts[i][start:end] == texts[ref][at : at + end - start]


def test_every_matched_word_is_in_a_factor():
    from fieldgrid.llm import rlz

    r = random.Random(12)
    for _ in range(300):
        matches = [{"lo": lo, "hi": lo + r.randint(0, 6), "ref": r.randint(0, 2), "at": lo + r.choice([0, 3])} for lo in (r.randint(0, 60) for _ in range(r.randint(0, 12)))]
        covered = {w for m in matches for w in range(m["lo"], m["hi"] + 5)}
        factors = rlz.parse(matches, 5)
        assert {w for f in factors for w in range(f["start"], f["end"])} == covered
        assert all(x["end"] < y["end"] and x["start"] <= y["start"] for x, y in zip(factors, factors[1:]))
