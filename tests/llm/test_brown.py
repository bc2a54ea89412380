"""The class model against plain counts and sums."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldgrid.llm import brown

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, score string, n_tokens int"


def tokens_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [brown.END]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base(rows):
    """What the contract fixes: {row: (held_out, n_tokens, n_known, N, base score)}."""
    c = Counter(t for i, x in rows if not held_out(i) for t in tokens_of(x))
    n, v = sum(c.values()), len(c)
    out = []
    for i, x in rows:
        ts = tokens_of(x)
        out.append((i, held_out(i), len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)))
    return out


def scored(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], SCHEMA).repartition(parts)
    return brown.score_documents(df, **more).collect()


def agree(got, rows):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    a, b = sorted([tuple(r)[:6] for r in got], key=key), sorted(base(rows), key=key)
    assert [r[:5] for r in a] == [r[:5] for r in b]
    assert all(math.isclose(x[5], y[5], rel_tol=1e-9) for x, y in zip(a, b))
    assert all(r.score <= 0 and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9) for r in got)


def languages(n, seed=3):
    """Documents of two alternating kinds of words in two languages."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = "pq"[i % 2]
        out.append((i, " ".join(f"{lang}{'xy'[k % 2]}{r.zipf(1.6) % 60}" for k in range(int(r.integers(20, 60))))))
    return out


def test_counts_and_base_score_are_exact_whatever_the_buckets(spark):
    rows = languages(120) + [(None, "Null Id here"), (200, None), (201, ""), (202, " \t\n"), (203, "\x0bOne\x1ctwo\x85 \xa0 É é\r\nend"), (204, "only"), (3, "same ID"), (3, "same ID")]
    a = scored(spark, rows, classes=8, core=50, rounds=3)
    agree(a, rows)
    b = scored(spark, rows, parts=5, classes=8, core=50, rounds=3, most=300)
    agree(b, rows)
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.base_score, 6))
    assert all(math.isclose(x.score, y.score, rel_tol=1e-9) for x, y in zip(sorted(a, key=key), sorted(b, key=key)))


def test_classes_lower_held_out_perplexity(spark):
    rows = languages(400)
    got = scored(spark, rows, classes=8, core=60, rounds=6)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)  # both negative
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = brown.score_documents(table, core=4096, rounds=3).where("held_out").collect()
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    c, kind = r.integers(1, 9, 40), r.integers(0, 5, 40)
    n, v, once = int(c.sum()), 40, int((c == 1).sum())
    grams = r.multinomial(n, np.full(25, 1 / 25)).reshape(5, 5).astype(float)
    size = np.bincount(kind, weights=c, minlength=5)
    grams *= size / grams.sum(axis=0)  # words of a class are as many as transitions into it
    model = brown.Model(grams, n, v, once)
    for before in range(6):
        p = model(np.full(41, before), np.append(kind, 5), np.append(c, 0))
        assert math.isclose(p.sum(), 1, rel_tol=1e-12)


def test_exchange_gain_is_the_change_of_the_objective():
    """One word moves; the class it gets is the best of all by counting anew."""
    r = np.random.default_rng(2)
    words, classes = 12, 4
    grams = r.integers(0, 20, (words, words)) * (r.random((words, words)) < 0.5)
    of = r.integers(0, classes, words).astype(np.uint8)

    def counted(of):
        m = np.zeros((classes, classes))
        np.add.at(m, (of[:, None], of[None, :]), grams)
        return m

    moved = 0
    for w in range(words):
        other = grams.copy()
        other[w, w] = 0
        nexts = np.bincount(of, weights=other[w], minlength=classes)[None, :]
        prevs = np.bincount(of, weights=other[:, w], minlength=classes)[None, :]
        new = brown.exchange([w], nexts, prevs, np.array([grams[w, w]]), of, counted(of))
        tried = [brown.objective(counted(np.where(np.arange(words) == w, k, of))) for k in range(classes)]
        assert math.isclose(tried[new[0]], max(tried), rel_tol=1e-12)
        moved += new[0] != of[w]
    assert moved


def test_rounds_raise_the_objective_and_words_of_one_kind_meet(spark):
    rows = languages(300)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "false AS held_out").repartition(3)
    c = Counter(t for _, x in rows for t in tokens_of(x))
    core = sorted(c, key=lambda w: (-c[w], w))[:60]
    of, grams, course = brown.core_classes(brown.cut(brown._core_bigrams(df, core, 1000)), len(core), 5, 6)
    assert max(course) > course[0] and math.isclose(brown.objective(grams), max(course))
    whole = Counter()
    known = set(core)
    for _, x in rows:
        ts = [brown.END, *tokens_of(x)]
        whole.update(p for p in zip(ts, ts[1:]) if known.issuperset(p))
    assert sum(whole.values()) == grams.sum()
    groups = {}
    for w, k in zip(core, of):
        groups.setdefault(w[:2], Counter())[k] += c[w]
    assert all(max(g.values()) > 0.8 * sum(g.values()) for g in groups.values())


@pytest.mark.parametrize("rows", [[], [(2, "held")], [(1, None)]])
def test_empty_tables_and_tables_without_words(spark, rows):
    got = scored(spark, rows, parts=1, classes=4, core=10, rounds=1)
    assert len(got) == len(rows)
    agree(got, rows)


def test_no_training_documents(spark):
    rows = [(i, f"a b {i}") for i in range(200) if held_out(i)][:5]
    got = scored(spark, rows, classes=4, core=10, rounds=1)
    agree(got, rows)
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in got)
