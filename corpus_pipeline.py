"""A training-corpus pipeline of five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them in turn to
``documents``, and writes what a stage returns as Parquet, to the shared folder, before the next
one reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgrid.llm import bpe, langid, minhash, mixing, secrets
from fieldgrid.llm.common import set_aside
from fieldgrid.llm.queries import tokenizer
from fieldgrid.session import ship
from fieldgrid.sources.scratch import cut

#: Below this score the language of a document is not clear and it goes.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a clear language, by models learned from two folds of three; the
    language found becomes ``lang``. Documents without letters go."""
    bare, back = set_aside(docs, ("doc_id", "text", "lang"))
    found = langid.identify(bare, folds=3, held_out=1)
    clear = found.where((F.col("lang_pred") != langid.UNDEFINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return back(clear.withColumn("lang", F.col("lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of each group of near copies."""
    found = minhash.near_duplicates(docs)
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mask; ``n_chars`` follows the text. No document goes."""
    bare, back = set_aside(docs, ("doc_id", "text", "n_chars"))
    clean = secrets.redact(secrets.scan(bare))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back(clean)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents so that sources meet their target weights, and shuffle."""
    bare, back = set_aside(docs, ("doc_id", "text", "source"))
    return back(mixing.mix(bare))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe.encode_decode(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("source mixing", mixture),
    ("BPE", tokens),
]

#: Language models, MinHash and BPE are not expressible in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
