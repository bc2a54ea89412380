import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldgrid.llm import langid, toxicity
from fieldgrid.llm.common import with_fold

SYLLABLES = {
    "aa": ["ka", "to", "mi", "re", "su"],
    "bb": ["sch", "ung", "ver", "ein", "ich"],
    "cc": ["é", "eau", "ment", "oi", "que"],
}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def lang_docs(spark, n=300):
    r = random.Random(3)
    rows = [(i, sentence(r, lang, r.randint(6, 60)), lang, "s") for i in range(n) for lang in [r.choice(list(SYLLABLES))]]
    rows += [(n, None, "aa", "s"), (n + 1, "", None, "s"), (n + 2, "12 34 !!", "bb", "s"), (n + 3, sentence(r, "cc", 40000), None, "s"), (None, sentence(r, "bb", 30), "bb", "s"), (0, rows[0][1], rows[0][2], "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), rows


def test_language_of_held_out_documents(spark):
    df, rows = lang_docs(spark)
    got = langid.identify(df, 3, 1)
    assert got.columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score"]
    out = got.collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held_out and r.lang and r.text]
    assert len(held) > 50 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    by = {r.doc_id: r for r in out}
    n = len(rows) - 6
    assert [by[n + k].lang_pred for k in range(4)] == ["und", "und", "und", "cc"] and by[n].score == 0
    assert all(0 <= r.score <= 1 for r in out)


def test_no_labels_make_no_language(spark):
    df, _ = lang_docs(spark, 20)
    out = langid.identify(df.withColumn("lang", F.lit(None).cast("string")), 3, 1).collect()
    assert {r.lang_pred for r in out} == {"und"}
    assert langid.identify(df.limit(0), 3, 1).collect() == []


def test_more_languages_than_bits_of_a_word(spark):
    r = random.Random(8)
    letters = [chr(0x4E00 + k) for k in range(70 * 6)]
    text = lambda k: " ".join("".join(r.choice(letters[k * 6 : k * 6 + 6]) for _ in range(4)) for _ in range(20))
    rows = [(k * 12 + j, text(k), f"l{k:02}") for k in range(70) for j in range(12)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 3, 1).collect()
    held = [x for x in out if x.held_out]
    assert {x.lang for x in held} == {x.lang_pred for x in held} and all(x.lang == x.lang_pred for x in held)


def known_grams(texts):
    """lang -> n-gram hashes that its filter must hold, of (lang, text)."""
    seen = {}
    for lang, t in texts:
        if lang and t is not None:
            seen.setdefault(lang, Counter()).update(langid.grams(t).tolist())
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in seen.items()}
    top = Counter()
    for c in share.values():
        for g, v in c.items():
            top[g] = max(top[g], v)
    return {x: {g for g, v in c.items() if v >= top[g] * langid.LEAST_SHARE} for x, c in share.items()}


def test_filters_have_no_false_negatives(spark):
    """Every n-gram of the sample, however rare, finds all its languages; few others do."""
    df, rows = lang_docs(spark, 60)
    rare = "zwjxzwx"
    df = df.unionByName(spark.createDataFrame([(777, rare, "aa", "s")], df.schema))
    model = langid.train(df)
    assert model.languages == ["aa", "bb", "cc"] and (model.fill > 0).all()
    known = known_grams([(lang, t) for _, t, lang, _ in rows] + [("aa", rare)])
    assert set(langid.grams(rare).tolist()) <= known["aa"]
    for i, lang in enumerate(model.languages):
        held = lambda keys: langid.masks_of(np.array(sorted(keys), np.uint64), model)[:, 0] >> np.uint64(i) & np.uint64(1)  # noqa: B023, E731
        assert held(known[lang]).all()
        absent = held(set().union(*known.values()) - known[lang])
        assert absent.mean() <= model.fill[i] ** langid.HASHES + 0.02


def test_tables_grow_with_their_ngrams(spark, monkeypatch):
    df, rows = lang_docs(spark, 60)
    monkeypatch.setattr(langid, "LEAST_BITS", 1)
    model = langid.train(df)
    most = max(map(len, known_grams([(lang, t) for _, t, lang, _ in rows]).values()))
    assert len(model.table) / 2 < langid.SLOTS_EACH * most <= len(model.table) and model.fill.max() < 0.4
    monkeypatch.setattr(langid, "MOST_BITS", 8)  # beyond the last power no n-gram goes
    full = langid.train(df)
    assert len(full.table) == 256 and (full.fill > model.fill).all()


def test_predictions_are_those_of_plain_sets(spark):
    """The whole query against dictionaries of n-grams in place of filters: the filters' false
    positives are few, so predictions agree and scores are near."""
    df, rows = lang_docs(spark, 150)
    out = langid.identify(df, 3, 1).collect()
    import zlib

    def grams(text):
        c = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
        return Counter((n, c[k : k + n]) for n in langid.SIZES for k in range(len(c) - n + 1))

    counts = {}
    for i, t, lang, _ in rows:
        fold = zlib.crc32(str(i).encode()) % 3 if i is not None else 0
        if lang and t is not None and fold != 1:
            counts.setdefault(lang, Counter()).update(grams(t))
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    top = Counter()
    for c in share.values():
        for g, v in c.items():
            top[g] = max(top[g], v)
    known = {x: {g for g, v in c.items() if v >= top[g] * langid.LEAST_SHARE} for x, c in share.items()}
    for r in out:
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        g = grams(r.text)
        total = sum(g.values())
        real = {x: sum(n for y, n in g.items() if y in s) / total for x, s in known.items()}
        best = max(sorted(real), key=real.get)
        odds = {x: math.exp(min(40.0, 4.0 + math.sqrt(total)) * (v - real[best])) for x, v in real.items()}
        assert r.lang_pred == best and abs(r.score - odds[best] / sum(odds.values())) < 0.05


def test_grams_do_not_depend_on_case_or_marks():
    assert np.array_equal(langid.grams("The TEA, 12 is!"), langid.grams("the tea is"))


# ---------------------------------------------------------------- toxicity

BAD = ["idiot", "scum", "moron", "trash"]


def toxic_docs(spark, n=900):
    r = random.Random(5)
    word = lambda: "".join(r.choice(["an", "th", "er", "on", "ti"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 80))]
        y = int(r.random() < 0.2)
        for b in r.sample(BAD, 2) if y else ():
            w.insert(r.randrange(len(w)), b)
        rows.append((i, " ".join(w)))
        if i % 5 < 4:
            labels.append((i, y))
    rows += [(n, None), (n + 1, ""), (None, "you idiot"), (n + 2, "Scum IDIOT " * 500)]
    labels += [(0, None), (None, 1), (3, 0), (99999, 1)]
    truth = dict(labels[: -4])
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), truth, len(rows)


def test_toxicity_of_held_out_documents(spark):
    df, labels, truth, n = toxic_docs(spark)
    out = toxicity.score_documents(df.withColumn("score", F.lit("x")), labels).collect()
    assert len(out) == n and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[900].predicted == by[901].predicted == 0 and by[902].predicted == by[None].predicted == 1 and by[900].evidence == []


@pytest.mark.parametrize("y", [0, 1, None])
def test_one_label_only(spark, y):
    df, labels, _, n = toxic_docs(spark, 60)
    labels = labels.withColumn("toxic", F.lit(y).cast("int"))
    out = toxicity.score_documents(df, labels).collect()
    assert len(out) == n and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_documents(df.limit(0), labels).collect() == []


def brute_nearest(docs, queries, k):
    """Cosines by plain dictionaries; docs: (label, counts)."""
    n, p = len(docs), sum(y for y, _ in docs)
    df, a = Counter(), Counter()
    for y, c in docs:
        df.update(c.keys())
        a.update(c.keys() if y else ())

    def weight(w):
        x, b = a[w], df[w] - a[w]
        chi2 = n * (x * (n - p - b) - b * (p - x)) ** 2 / max(df[w] * (n - df[w]) * p * (n - p), 1e-9)
        return math.log(1 + n / df[w]) * (1 + math.sqrt(max(0, chi2 - toxicity.CHANCE)))

    def vec(c):
        v = {w: (1 + math.log(m)) * weight(w) for w, m in c.items() if df[w] >= toxicity.LEAST_DOCS}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    held = [vec(c) for _, c in docs]
    for q in queries:
        v = vec(q)
        s = [(-sum(x * h.get(w, 0.0) for w, x in v.items()), e) for e, h in enumerate(held)]
        yield sorted(x for x in s if x[0] < 0)[:k], dict((e, -x) for x, e in s)


@pytest.mark.parametrize("block", [64, 512])
def test_block_max_search_is_exact(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    r = random.Random(2)
    words = [f"t{k}" for k in range(400)] + ["the", "of"] * 40
    docs = [(int(r.random() < 0.3), Counter(r.choices(words, k=r.randint(0, 40)))) for _ in range(700)]
    for y, c in docs:
        if y:
            c[r.choice(["bad", "worse"])] += 1
    df, a = Counter(), Counter()
    for y, c in docs:
        df.update(c.keys())
        a.update(c.keys() if y else ())
    vocabulary = {w: i for i, w in enumerate(sorted(w for w in df if df[w] >= toxicity.LEAST_DOCS))}
    packed = toxicity.build(
        list(vocabulary), np.array([df[w] for w in vocabulary], float), np.array([a[w] for w in vocabulary], float), np.arange(len(docs)), np.array([y for y, _ in docs], float),
        [np.array([vocabulary[w] for w in c if w in vocabulary], int) for _, c in docs], [np.array([m for w, m in c.items() if w in vocabulary], int) for _, c in docs],
    )
    ix = toxicity.Index(packed)
    assert 0 < len(ix.columns) < len(vocabulary)
    queries = [Counter(r.choices([*words, "bad", "unknown"], k=r.randint(0, 60))) for _ in range(60)] + [c for _, c in docs[:20]]

    def nearest(some):
        rows = [(d, vocabulary[w], m) for d, c in enumerate(some) for w, m in c.items() if w in vocabulary]
        return ix.nearest(len(some), *np.array(rows).T, k=15)

    for (places, cosines), (want, every) in zip(nearest(queries), brute_nearest(docs, queries, 15), strict=True):
        assert np.allclose(cosines, [-x for x, _ in want]) and np.allclose([every[e] for e in places], cosines)
    for e, (places, cosines) in enumerate(nearest([c for _, c in docs[:20]])):
        if docs[e][1].keys() & vocabulary.keys():
            assert math.isclose(cosines[0], 1)  # a copy of an example


def test_terms_of_texts():
    names, text, term, n = toxicity.terms(pa.array(["Tea, tea 2 Biscuits", None, "", "_É-b"]))
    assert [(int(d), names[t], int(m)) for d, t, m in sorted(zip(text, term, n), key=lambda x: (x[0], names[x[1]]))] == [(0, "biscu-", 1), (0, "biscuits", 1), (0, "tea", 2), (3, "b", 1), (3, "é", 1)]
    assert [len(x) for x in toxicity.terms(pa.array([], pa.string()))] == [0, 0, 0, 0]


def test_the_sample_is_bounded(spark):
    df, labels, _, _ = toxic_docs(spark)
    got = toxicity.sample_of(df, labels, 10, 20).collect()
    assert Counter(r.toxic for r in got) == {1: 10, 0: 20}


def test_folds(spark):
    import zlib

    df = with_fold(spark.range(50).withColumnRenamed("id", "doc_id"), 3)
    assert all(r.fold == zlib.crc32(str(r.doc_id).encode()) % 3 for r in df.collect())
