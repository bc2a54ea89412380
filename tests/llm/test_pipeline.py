import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from fieldgrid.llm import bpe, mixing, secrets
from fieldgrid.llm.queries import tokenizer

from . import brute

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda lang: "".join(r.choice({"en": ["th", "an", "er", "ing"], "de": ["sch", "ung", "ver", "ich"]}[lang]) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(240):
        lang = r.choice(["en", "de"])
        rows.append([i, " ".join(word(lang) for _ in range(r.randint(12, 60))), lang, "src0" if i % 3 else f"src{i % 5}", 0])
    for k in range(20):
        i, w = r.randrange(200), None
        w = rows[i][1].split()
        w[-1:] = ["end"]
        rows[220 + k][1:3] = [" ".join(w), rows[i][2]]
    rows[5][1] += " token = 24be64439e3e49cf46b2d7c90f3602a3"
    rows += [[240, None, "en", None, 0], [241, "12345 !!", "de", "src1", 0]]
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_stages_work_on_what_came_before(spark, small):
    path, rows = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    after, columns = {}, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        after[name] = docs.collect()
        if k < 4:
            assert docs.columns == columns
    kept = after["language ID"]
    assert {r.doc_id for r in kept} == set(range(240))  # clean documents stay, those without letters go
    assert sum(r.lang == rows[r.doc_id][2] for r in kept) >= 238

    component, _ = brute.near_duplicates([(r.doc_id, r.text) for r in kept])
    once = after["MinHash near-dedup"]
    assert sorted(r.doc_id for r in once) == sorted(set(component.values())) and len(once) < 240

    clean = {r.doc_id: r for r in after["secret scan"]}
    assert set(clean) == {r.doc_id for r in once}
    assert all(not brute.base_spans(r.text) and r.n_chars == len(r.text) for r in clean.values())
    assert secrets.MASK in clean[5].text and "24be6443" not in clean[5].text

    copies = Counter(r.doc_id for r in after["source mixing"])
    rates = {r.source: r.rate for r in mixing.source_rates(spark.createDataFrame(list(clean.values()))).collect()}
    for i, r in clean.items():
        import hashlib

        u = int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:12], 16) / 2**48
        assert copies.get(i, 0) == sum(c <= u for c in mixing.poisson_table(rates[r.source]))

    t = bpe.load(tokenizer("word_bpe_49k.json"))
    out = after["BPE"]
    assert Counter(r.doc_id for r in out) == copies
    assert all(r.n_tokens == len(t.encode(clean[r.doc_id].text, add_special_tokens=False).ids) for r in out)
    assert sorted(map(str, corpus_pipeline.run(spark, path).collect())) == sorted(map(str, out))


def test_names_and_order():
    assert [len(re.findall(r"\w", n)) > 0 for n, _ in corpus_pipeline.STAGES] == [True] * 5


def test_clashing_columns_survive(spark, small):
    path, rows = small
    clash = ["score", "held_out", "lang_pred", "secrets", "copy", "shuffle_key", "kept", "n", "id", "_fold", "rate", "evidence"]
    wide = [(*r, *[f"{c}{r[0]}" for c in clash]) for r in rows[:60]]
    docs = spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, path)
        assert docs.columns == names
    found = docs.collect()
    assert found and all(r[c] == f"{c}{r.doc_id}" for r in found for c in clash)


def test_scratch_folders_can_be_released(spark):
    from fieldgrid.llm.common import cut, release

    df = cut(spark.range(5).toDF("x"))
    assert df.count() == 5
    folder = df.inputFiles()[0].removeprefix("file:").rsplit("/", 2)[0]
    import os

    assert os.path.isdir(folder.replace("//", "/"))
    release(spark)
    assert not os.path.isdir(folder.replace("//", "/"))
