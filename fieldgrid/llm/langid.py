"""Language identification with a bit-sliced Bloom filter of character n-grams.

One table of slots holds all languages' filters at once: each slot has as many 64-bit words as
the languages need, and bit l % 64 of word l // 64 belongs to language l. Each n-gram has a few slots; the AND of their bits is the set of languages whose
training text holds the n-gram, with no false negatives. A document adds up those bits over its
n-grams; each language's count is corrected for the share of false positives that its fill
predicts, and the largest corrected count decides.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mix64, sliced, with_fold

#: A table has the least power of two of slots that is this many times the n-grams of its largest
#: language (at most 39 % of a language's bits are set then), within these powers. Beyond the last
#: one no n-gram goes: the fill rises, and with it the correction.
SLOTS_EACH = 6
LEAST_BITS, MOST_BITS = 16, 24
HASHES = 3
SIZES = (2, 3, 4, 5)
#: The model is fitted on about so many labelled documents of each language, by a hash of doc_id.
SAMPLE_DOCS = 4_000
#: An n-gram of a language's sample is held to be another language's, quoted there, if its relative
#: frequency is under this share of its highest one in any language. No other n-gram is left out.
LEAST_SHARE = 1 / 16
WORD_BITS = 64
UNDEFINED = "und"
#: At once through numpy; longer texts are cut there, n-grams that cross a cut included.
WINDOW = 1 << 20

_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # uint64, slots x words; bit l % 64 of word l // 64: language l
    fill: np.ndarray  # per language, the share of its set slots


def grams(text: str) -> np.ndarray:
    """64-bit hashes of the character n-grams of the lower-cased letters, a space between words."""
    clean = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(clean.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    out = []
    h = c
    for n in range(2, max(SIZES) + 1):
        if len(c) < n:
            break
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
        if n in SIZES:
            out.append(mix64(h + np.uint64(n)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def slots_of(h: np.ndarray, k: int, size: int) -> np.ndarray:
    """Slot k of each n-gram in a table of ``size`` slots, a power of two: double hashing by the
    halves of the 64-bit hash. ``_slot`` is the same as a column expression."""
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


def _slot(gram: Column, k: int, size: int) -> Column:
    low, step = gram.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(gram, 32).bitwiseOR(F.lit(1).cast("long"))
    return (low + F.lit(k) * step).bitwiseAND(F.lit(size - 1).cast("long"))


def bits_of(words: np.ndarray, language: int) -> np.ndarray:
    """The bit of a language in each row of ``words``."""
    return (words[:, language // WORD_BITS] >> np.uint64(language % WORD_BITS)) & np.uint64(1)


def masks_of(h: np.ndarray, model: Model) -> np.ndarray:
    """The words of the languages whose filters hold each n-gram."""
    masks = model.table[slots_of(h, 0, len(model.table))]
    for k in range(1, HASHES):
        masks &= model.table[slots_of(h, k, len(model.table))]
    return masks


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from text and non-null lang of ``docs``.

    About ``sample_docs`` documents of each language (drawn by a hash of doc_id) are counted by
    Spark, and every n-gram of them goes into its language's filter, but for those that quotations
    bring there (``LEAST_SHARE``), however rare. Spark also sets the bits; what
    comes to the driver is one word for each slot that is not empty and 64 languages, at most 2 **
    ``MOST_BITS`` for each 64 languages. No labelled document gives a model without languages.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    words = max(1, math.ceil(len(languages) / WORD_BITS))
    if not languages:
        return Model([], np.zeros((1 << LEAST_BITS, words), np.uint64), np.zeros(0))
    picks = F.create_map(*[v for x in languages for v in (F.lit(x), F.lit(min(1.0, sample_docs / sizes[x])))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw < F.coalesce(F.try_element_at(picks, F.col("lang")), F.lit(0.0))).select("lang", "text")

    def count(batches):
        held: dict[str, list] = {}
        room = 0
        for batch in sliced(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in range(0, len(text), WINDOW):
                    g = grams(text[k : k + WINDOW])
                    held.setdefault(lang, []).append(g)
                    room += len(g)
                    if room > 1_000_000:
                        yield from pour(held)
                        held, room = {}, 0
        yield from pour(held)

    def pour(held):
        for lang, parts in held.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = cut(sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = F.create_map(*[v for x in languages for v in (F.lit(x), F.lit(float(totals.get(x, 1))))])[F.col("lang")]
    shares = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", (F.col("n") / total).alias("share"))).alias("shares"))  # an entry a language
    top = F.array_max(F.transform("shares", lambda x: x["share"])) * LEAST_SHARE
    kept = cut(shares.withColumn("least", top).select("gram", F.explode(F.filter("shares", lambda x: x["share"] >= F.col("least"))["lang"]).alias("lang")))
    most = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    size = 1 << min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(SLOTS_EACH * most))))
    table = np.zeros((size, words), dtype=np.uint64)
    nth = F.create_map(*[v for i, x in enumerate(languages) for v in (F.lit(x), F.lit(i))])[F.col("lang")]
    bits = kept.select(
        F.floor(nth / WORD_BITS).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), nth % WORD_BITS).alias("bit"),
        F.explode(F.array(*[_slot(F.col("gram"), k, size) for k in range(HASHES)])).alias("slot"),
    )
    found = bits.groupBy("word", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    word, slot, held = (found.column(c).to_numpy() for c in ("word", "slot", "bits"))
    table[slot, word] = held.view(np.uint64)
    fill = np.array([float(bits_of(table, i).mean()) for i in range(len(languages))])
    return Model(languages, table, fill)


def judge(text: str | None, model: Model) -> tuple[str, float]:
    """The predicted language and a score from 0 to 1; ``und`` and 0 without letters or model."""
    if not text or not model.languages or not _LETTER.search(text):
        return UNDEFINED, 0.0
    n = len(model.languages)
    hits, total = np.zeros(n), 0
    for k in range(0, len(text), WINDOW):
        h = grams(text[k : k + WINDOW + max(SIZES) - 1])
        masks = masks_of(h, model)
        total += len(h)
        if n <= 12:  # few languages: count each set of languages once
            seen = np.bincount(masks[:, 0].astype(np.int64), minlength=1 << n)
            sets = np.arange(1 << n)
            hits += [seen[(sets >> i) & 1 == 1].sum() for i in range(n)]
        else:
            hits += [int(bits_of(masks, i).sum()) for i in range(n)]
    if not total:
        return UNDEFINED, 0.0
    chance = model.fill**HASHES  # an absent n-gram finds all its slots set
    real = np.maximum(0.0, (hits / total - chance) / np.maximum(1e-9, 1 - chance))
    best = int(np.argmax(real))
    # odds from the excess of the best count over the others, sharper the more n-grams there are
    sharp = min(40.0, 4.0 + math.sqrt(total))
    weights = np.exp(sharp * (real - real[best]))
    return model.languages[best], float(weights[best] / weights.sum()) if real[best] > 0 else 0.0


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred and score to every row, from text alone. Other columns and rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 bytes a slot for each 64 languages
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in sliced(batches):
            found = [judge(t, m) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Train on the folds that aren't held out, predict every row: adds held_out, lang_pred, score."""
    fold = with_fold(docs.drop("held_out"), folds, "__fg_fold")
    model = train(fold.where(F.col("__fg_fold") != held_out))
    return predict(fold.withColumn("held_out", F.col("__fg_fold") == held_out).drop("__fg_fold"), model)
